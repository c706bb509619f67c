"""Helpers that several training-data operators share."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def process_cache() -> dict:
    """A dict that lives as long as the Python process.

    Functions travel to the workers by value, so each task has its own copy of a
    module's globals; models and vocabularies are kept here instead.
    """
    return sys.modules.setdefault("_cadencia_process_cache", types.ModuleType("_cadencia_process_cache")).__dict__


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose text in ``column`` is about ``limit`` bytes, or one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again.

    Used instead of ``checkpoint()`` where the rows are many or wide, as Parquet
    is compressed and its columns can be pruned. Whoever owns the folder clears
    it, as with checkpoints.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        cut_lineage(spark.range(0))
    path = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_into(key: str, share: float, salt: int) -> Column:
    """Whether a 63-bit hash of ``key`` falls into ``share`` of its range, however small the share."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), key), 1) < F.lit(min(int(share * 2.0**63), (1 << 63) - 1))


def unused(taken: list[str], name: str) -> str:
    """``name`` with as many underscores as make it differ from the columns ``taken``, in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def concatenated(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def hex_number(text: Column, digits: int) -> Column:
    """The first hex digits (13 at most) of the MD5 of ``text`` as a long."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def gapless_rank(df: DataFrame, group: list[str], order: list[str], bucket: Column, out: str) -> DataFrame:
    """Rank rows from 0 within ``group``, ordered by ``bucket`` and then ``order``.

    Keeps the columns of ``group`` and ``order`` only. No task ever holds a whole
    group: equal rows are counted before they are shuffled, a bucket of a group
    is ordered in one task, and buckets are chained by their sizes. Rows that are
    equal in all these columns can't be told apart and get successive ranks.
    """
    counted = df.groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket)
    counted = cut_lineage(counted)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counted.groupBy(*group, "_bucket").agg(F.sum("_n").alias("_size"))
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    for g in group:
        sizes = sizes.withColumnRenamed(g, f"_g_{g}")
    sizes = sizes.withColumnRenamed("_bucket", "_g_bucket")
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    at = counted.withColumn("_at", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    same = F.col("_bucket") == F.col("_g_bucket")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = at.join(sizes, same)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return joined.select(*group, *order, "_first", "_at", each.alias("_i")).select(
        *group, *order, (F.col("_first") + F.col("_at") + F.col("_i")).cast("long").alias(out)
    )
