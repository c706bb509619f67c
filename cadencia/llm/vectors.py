"""What the two vector searches share: clean vectors, blocks of cells, visits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import gapless_rank, stored

#: vectors of a block; a task holds one block and as many queries at a time
BLOCK = 4096
#: blocks that a query visits in its first round after home
FIRST = 8
FOUND = "query_id long, gid long, ids array<long>, score double"


def usable(table: DataFrame, vec_id: str, vector: str, component: Callable[[Column], Column]) -> DataFrame:
    """(vec_id, v) of the vectors that take part, one row per vec_id.

    Left out are null ids, null vectors and those with null or non-finite
    components. Of several vectors with one id the smallest counts. Shorter
    vectors are filled up with zeros.
    """
    raw = F.col(vector).cast("array<double>")
    good = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(good, raw).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.select("vec_id", F.transform("v", component).cast("array<double>").alias("v"))
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    fill = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))
    return rows.select("vec_id", F.when(F.size("v") < width, F.concat("v", fill)).otherwise(F.col("v")).alias("v"))


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(gid, ids, v) of each different vector: its ``keep`` smallest ids, the first as gid.

    More ids of one vector can't be among ``keep - 1`` nearest, as ties go to
    smaller ids. The rank limit is applied before the shuffle, too.
    """
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_r") <= keep)
    ids = ranked.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return ids.select(F.col("ids")[0].alias("gid"), "ids", "v")


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """``most`` vectors at most, by a hash of the vector."""
    top = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(most)
    got = [r[0] for r in top.collect()]
    return np.array(got, dtype=np.float64) if got else np.zeros((0, 0))


def blocked(cells: DataFrame, scale: float) -> DataFrame:
    """``cells`` (gid, ids, v, cell, dist, ...) with ``block``: at most BLOCK rows of one cell, by dist."""
    place = F.floor(F.col("dist") / max(scale, 1e-300) * 1024).cast("long")
    ranked = gapless_rank(cells.select("cell", "dist", "gid"), ["cell"], ["dist", "gid"], place, "_rank")
    number = F.concat_ws(":", F.col("cell").cast("string"), F.floor(F.col("_rank") / BLOCK).cast("string"))
    return stored(cells.join(ranked.select("gid", number.alias("block")), "gid"))


def evaluated(visits: DataFrame, vecs: DataFrame, n_queries: int, found: Callable) -> DataFrame:
    """FOUND rows of ``found(visits of a block, vectors of the block)``.

    Queries are dealt into slots, so that a task holds a bounded number of them;
    a block goes to the slots that visit it.
    """
    slots = -(-max(n_queries, 1) // BLOCK)
    left = visits.withColumn("slot", F.pmod(F.xxhash64("query_id"), F.lit(slots)).cast("int"))
    # both sides may stem from one table; new names for its columns keep them apart
    left = left.toDF(*left.columns)
    wanted = left.select("block", "slot").distinct()
    right = vecs.toDF(*vecs.columns).join(wanted.toDF(*wanted.columns), "block")
    right = right.toDF(*right.columns)

    def run(key, q, v):
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "gid": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        v = v.sort_values(["dist", "gid"], ignore_index=True)
        return found(q, v)

    return left.groupBy("block", "slot").cogroup(right.groupBy("block", "slot")).applyInPandas(run, FOUND)


def best(scores: np.ndarray, gids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller gid."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((gids[at], -scores[at]))][:k]


def rows_of(query_id: int, at: np.ndarray, gids, ids, scores) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.full(len(at), query_id), "gid": gids[at], "ids": [ids[i] for i in at], "score": scores})


def bounds(found: DataFrame, k: int) -> DataFrame:
    """(query_id, kth): the k-th score so far, null if there are fewer."""
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))


def shrunk(found: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` best vectors of each query: one may be its own."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "gid")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).drop("_r")


def expanded(near: DataFrame, ask: DataFrame, goals: Callable[[DataFrame], DataFrame], vecs: DataFrame, n_queries: int, k: int, reach: Callable[[Column, Column], Column], found: Callable) -> DataFrame:
    """FOUND rows of each query's best vectors, its blocks expanded in order.

    ``near`` is what the home blocks gave. ``goals`` turns the queries (query_id,
    v, home, kth, reach) into (query_id, block, gap); ``reach`` is how large a gap
    may be at a squared norm and a k-th best score (null: not yet known). A query
    visits its blocks by gap, FIRST of them, then twice as many each round. Its
    bound is taken again after each round, and it stops at the first block whose
    gap is beyond reach, as all later ones are. The driver learns only whether a
    visit is left.
    """
    asked = ask.select("query_id", "v", F.col("block").alias("home"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("_norm"))

    def bounded(best: DataFrame) -> DataFrame:
        j = asked.join(bounds(best, k), "query_id", "left")
        return cut_lineage(j.withColumn("reach", reach(F.col("_norm"), F.col("kth"))).drop("_norm"))

    best, state = near, bounded(near)
    turn = Window.partitionBy("query_id").orderBy("gap", "block")
    plan = cut_lineage(goals(state).withColumn("turn", F.row_number().over(turn)))
    done, width = 0, FIRST
    while True:
        due = plan.where((F.col("turn") > done) & (F.col("turn") <= done + width)).join(state, "query_id").where("gap <= reach")
        if due.isEmpty():
            return best
        got = evaluated(due.select("query_id", "v", "kth", "block"), vecs, n_queries, found)
        best = cut_lineage(shrunk(best.union(got), k))
        state = bounded(best)
        done, width = done + width, 2 * width


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best; at most k + 1 rows come from a block."""
    each = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
