"""Nearest neighbours through low-dimensional stable projections and a kd-tree.

Gaussian projections are 2-stable: a squared projected distance is the squared
distance times a chi-square variable with as many degrees of freedom as there
are projections. A kd-tree, split on a bounded sample, deals all projected
vectors into cells. A query verifies its projected neighbours in order until a
chi-square test says that, with probability ``p``, a vector nearer than its k-th
best would have shown up: r^2 > quantile(p) * D^2. Cells whose box lies beyond
that radius are not visited. Inner products become distances by one more
coordinate that gives all vectors the same norm.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import vectors as V
from .exact_topk import lifted

#: projections (an even number) and the sample on which the tree is split
PROJECTIONS, SAMPLE, MOST_CELLS = 16, 16_384, 1024
#: projected neighbours verified before the test is made again
STEP = 256


def quantile(p: float, freedom: int) -> float:
    """Of the chi-square law with an even number of degrees of freedom, by bisection."""

    def below(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def grown(points: np.ndarray, leaves: int):
    """A kd-tree: inner nodes (axis, cut, left, right), and the boxes of its cells.

    A node is split at the median of its widest axis; negative children are
    cells. Points that are all equal are not split.
    """
    width = points.shape[1]
    nodes, lows, highs = [], [], []

    def build(own, low, high, depth):
        spread = own.max(0) - own.min(0) if len(own) else np.zeros(width)
        if depth == 0 or len(own) < 2 or spread.max() == 0:
            lows.append(low)
            highs.append(high)
            return -len(lows)
        axis = int(spread.argmax())
        cut = float(np.median(own[:, axis]))
        if not (own[:, axis] < cut).any():
            cut = float(own[:, axis][own[:, axis] > cut].min())
        at = len(nodes)
        nodes.append(None)
        up, down = high.copy(), low.copy()
        up[axis] = down[axis] = cut
        left = build(own[own[:, axis] < cut], low, up, depth - 1)
        right = build(own[own[:, axis] >= cut], down, high, depth - 1)
        nodes[at] = (axis, cut, left, right)
        return at

    root = build(points, np.full(width, -np.inf), np.full(width, np.inf), max(0, math.ceil(math.log2(max(leaves, 1)))))
    return root, nodes, np.array(lows), np.array(highs)


def cells_of(points: np.ndarray, root: int, nodes) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    todo = [(root, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if node < 0:
            out[own] = -node - 1
        elif len(own):
            axis, cut, left, right = nodes[node]
            under = points[own, axis] < cut
            todo += [(left, own[under]), (right, own[~under])]
    return out


def search(table: DataFrame, is_query: Column, k: int = 20, p: float = 0.95, seed: int = 17, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (double): ``k`` of the largest inner products of each query.

    A true neighbour is found with probability ``p`` at least. Vectors that are
    zero take no part, nor do those that ``usable`` leaves out. Candidates are
    all other ids; fewer than ``k`` give fewer rows, no usable vectors none.
    Ties go to the smaller id.
    """
    rows = V.usable(table, vec_id, vector, lambda x: x).where(F.exists("v", lambda x: x != 0))
    some = V.distinct(rows, k + 1)
    count, most = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    most = (most or 0.0) * (1 + 1e-12)
    drawn = V.sample(rows, SAMPLE)
    width = drawn.shape[1] + 1
    project = np.random.default_rng(seed).standard_normal((width, PROJECTIONS))
    points = lifted(drawn, most) @ project if len(drawn) else np.zeros((0, PROJECTIONS))
    root, nodes, lows, highs = grown(points, min(MOST_CELLS, -(-count // V.BLOCK)))

    def key(batches):
        for pdf in batches:
            y = lifted(np.stack(pdf["v"]), most) @ project
            yield pdf.assign(cell=cells_of(y, root, nodes), dist=np.sqrt((y * y).sum(1)))

    cells = some.mapInPandas(key, "gid long, ids array<long>, v array<double>, cell int, dist double")
    vecs = V.blocked(cells, 10 * math.sqrt(most) + 1e-300)
    ask = rows.where(is_query).withColumnRenamed("vec_id", "query_id")
    ask = cut_lineage(ask.join(vecs.select("v", "block"), "v").select("query_id", "v", "block"))
    n_queries = ask.count()
    stop = quantile(p, PROJECTIONS)

    def verify(q, v):
        x, gids, ids = np.stack(v["v"]), v["gid"].to_numpy(), v["ids"].to_numpy()
        counts = np.array([len(i) for i in ids])
        y = lifted(x, most) @ project
        square = (y * y).sum(1)
        out = []
        for query_id, qv, kth in zip(q["query_id"], q["v"], q["kth"]):
            z = np.append(qv, 0.0) @ project
            r = square - 2 * y @ z + z @ z
            base = float(qv @ qv) + most
            # the k-th best so far; without one, everything is verified
            near = base - 2 * kth if not np.isnan(kth) else np.inf
            left = np.flatnonzero(r <= stop * max(near, 0) + 1e-9)
            left = left[np.argsort(r[left], kind="stable")]
            seen, scores, at = [], [], 0
            while at < len(left) and r[left[at]] <= stop * max(near, 0) + 1e-9:
                part = left[at : at + max(STEP, at)]
                part = part[r[part] <= stop * max(near, 0) + 1e-9]
                seen.append(part)
                scores.append(x[part] @ qv)
                at += len(part)
                got = np.concatenate(scores)
                top = V.best(got, gids[np.concatenate(seen)], k + 1)
                others = counts[np.concatenate(seen)[top]]
                if others.sum() > k:
                    near = min(near, base - 2 * float(got[top[np.searchsorted(np.cumsum(others), k + 1)]]))
            if seen:
                places = np.concatenate(seen)[top]
                exact = (x[places] * qv).sum(1)
                out.append(V.rows_of(query_id, places, gids, ids, exact))
        return pd.concat(out) if out else V.rows_of(0, np.zeros(0, int), gids, ids, np.zeros(0))

    near = cut_lineage(V.evaluated(ask.withColumn("kth", F.lit(float("nan"))), vecs, n_queries, verify))

    def reached(batches):
        for pdf in batches:
            x = np.stack(pdf["v"])
            z = np.concatenate([x, np.zeros((len(x), 1))], axis=1) @ project
            for i, (query_id, home, reach) in enumerate(zip(pdf["query_id"], pdf["home"], pdf["reach"])):
                off = np.maximum(np.maximum(lows - z[i], z[i] - highs), 0)
                gap = (off * off).sum(1)
                cell = np.flatnonzero(gap <= reach).astype(np.int32)
                yield pd.DataFrame({"query_id": query_id, "home": home, "reach": reach, "cell": cell, "at": float(np.sqrt(z[i] @ z[i])), "off": gap[cell]})

    def goals(state):
        boxes = state.mapInPandas(reached, "query_id long, home string, reach double, cell int, at double, off double")
        # within a cell blocks are annuli around the origin of the projections
        meta = vecs.groupBy("cell", "block").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
        ring = F.greatest(F.lit(0.0), F.col("lo") - F.col("at"), F.col("at") - F.col("hi"))
        met = boxes.join(meta, "cell").where("block <> home").withColumn("gap", F.greatest("off", ring * ring))
        return met.where("gap <= reach").select("query_id", "block", "gap")

    def reach(norm, kth):
        return F.when(kth.isNull(), float("inf")).otherwise(stop * F.greatest(norm + most - 2 * kth, F.lit(0.0)) + 1e-9)

    return V.ranked(V.expanded(near, ask, goals, vecs, n_queries, k, reach, verify), k)
