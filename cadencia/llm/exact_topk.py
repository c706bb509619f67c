"""Exact largest integer inner products through a pivot-distance index.

One more coordinate makes the largest inner product the smallest distance:
x' = (x, sqrt(M - |x|^2)) and q' = (q, 0), with M the largest squared norm. A
vector is keyed by its nearest pivot and its distance to it, and blocks are runs
of that order. A query first expands its own block, then the other annuli in the
order of |d(q, pivot) - d(x, pivot)|, the least distance that the triangle inequality
allows. It stops where that exceeds D, the distance of its k-th best so far, which
falls with each step inside a block and each round of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import vectors as V

#: pivots, chosen far apart from a bounded sample
PIVOTS, SAMPLE = 64, 4096
#: rows on either side that an annulus grows by at first, twice as many each step
STEP = 128


def choose(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the point farthest from those before it."""
    if not len(points):
        return points
    took = [int(np.argmax(((points - points.mean(0)) ** 2).sum(1)))]
    gap = ((points - points[took[0]]) ** 2).sum(1)
    while len(took) < min(n, len(points)) and gap.max() > 0:
        took.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((points - points[took[-1]]) ** 2).sum(1))
    return points[took]


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the coordinate that gives all of them the squared norm ``most``."""
    rest = np.sqrt(np.maximum(most - (x * x).sum(1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def search(table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): each query's ``k`` highest scores.

    Components become floor(scale * x); scores are inner products of those, exact
    while sums stay under 2**53. Candidates are all other ids; fewer than ``k``
    give fewer rows, no usable vectors none. ``is_query`` is a condition on
    ``vec_id``. Ties go to the smaller id.
    """
    rows = V.usable(table, vec_id, vector, lambda x: F.floor(x * scale))
    some = V.distinct(rows, k + 1)
    most = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    drawn = V.sample(rows, SAMPLE)
    pivots = choose(lifted(drawn, most), PIVOTS) if len(drawn) else np.zeros((1, 1))

    def key(batches):
        for pdf in batches:
            d = distances(lifted(np.stack(pdf["v"]), most), pivots)
            cell = d.argmin(1)
            yield pdf.assign(cell=cell.astype(np.int32), dist=d[np.arange(len(d)), cell])

    cells = some.mapInPandas(key, "gid long, ids array<long>, v array<double>, cell int, dist double")
    vecs = V.blocked(cells, 2 * float(np.sqrt(most)))
    ask = rows.where(is_query).withColumnRenamed("vec_id", "query_id")
    home = vecs.select("v", "block")
    ask = cut_lineage(ask.join(home, "v").select("query_id", "v", "block"))
    n_queries = ask.count()

    def reach_of(norm, kth):
        # a little more than D, as distances are rounded
        return np.sqrt(np.maximum(norm + most - 2 * kth, 0)) * (1 + 1e-9) + 1e-6

    def expand(q, v):
        x, gids, ids, dist = np.stack(v["v"]), v["gid"].to_numpy(), v["ids"].to_numpy(), v["dist"].to_numpy()
        own = v["cell"].iloc[0]
        asked = np.stack(q["v"])
        at = distances(np.concatenate([asked, np.zeros((len(asked), 1))], axis=1), pivots[own : own + 1])[:, 0]
        out = []
        for query_id, qv, here, kth in zip(q["query_id"], asked, at, q["kth"].to_numpy(dtype=float, na_value=np.nan)):
            norm = float(qv @ qv)
            reach = np.inf if np.isnan(kth) else reach_of(norm, kth)
            a = b = int(np.searchsorted(dist, here))
            scores, step = np.zeros(0), STEP
            while True:
                low, high = np.searchsorted(dist, here - reach, side="left"), np.searchsorted(dist, here + reach, side="right")
                na, nb = min(a, max(int(low), a - step)), max(b, min(int(high), b + step))
                if (na, nb) == (a, b):
                    break
                scores = np.concatenate([x[na:a] @ qv, scores, x[b:nb] @ qv])
                a, b, step = na, nb, 2 * step
                # k + 1 vectors hold k others
                if len(scores) > k:
                    least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    reach = min(reach, reach_of(norm, least))
            if len(scores):
                top = V.best(scores, gids[a:b], k + 1)
                out.append(V.rows_of(query_id, top + a, gids, ids, scores[top]))
        return pd.concat(out) if out else V.rows_of(0, np.zeros(0, int), gids, ids, np.zeros(0))

    near = cut_lineage(V.evaluated(ask.withColumn("kth", F.lit(float("nan"))), vecs, n_queries, expand))

    def annuli(batches):
        for pdf in batches:
            x = np.stack(pdf["v"])
            d = distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), pivots)
            i = np.repeat(np.arange(len(x)), len(pivots))
            yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[i], "home": pdf["home"].to_numpy()[i], "reach": pdf["reach"].to_numpy()[i], "cell": np.tile(np.arange(len(pivots), dtype=np.int32), len(x)), "at": d.ravel()})

    def goals(state):
        ring = state.mapInPandas(annuli, "query_id long, home string, reach double, cell int, at double")
        meta = vecs.groupBy("cell", "block").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
        gap = F.greatest(F.lit(0.0), F.col("lo") - F.col("at"), F.col("at") - F.col("hi"))
        met = ring.join(meta, "cell").where("block <> home").withColumn("gap", gap)
        return met.where("gap <= reach").select("query_id", "block", "gap")

    def reach(norm, kth):
        far = F.sqrt(F.greatest(norm + most - 2 * kth, F.lit(0.0))) * (1 + 1e-9) + 1e-6
        return F.when(kth.isNull(), float("inf")).otherwise(far)

    top = V.ranked(V.expanded(near, ask, goals, vecs, n_queries, k, reach, expand), k)
    return top.withColumn("score", F.col("score").cast("long"))
