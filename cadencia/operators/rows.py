"""Run a NumPy kernel over array columns, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLES = T.ArrayType(T.DoubleType())

#: points that a kernel gets at a time, so that what it makes on the way stays small
POINTS = 2**16


def stacked(columns: list[pd.Series]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows grouped by the lengths of their arrays: (row numbers, stacks), a
    bounded number of points at a time. Rows with a missing array are left out."""
    ok = np.ones(len(columns[0]), dtype=bool)
    for c in columns:
        ok &= c.notna().to_numpy()
    groups: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(ok):
        groups.setdefault(tuple(len(c.iat[i]) for c in columns), []).append(int(i))
    for lengths, every in groups.items():
        step = max(1, POINTS // max(1, sum(lengths)))
        for k in range(0, len(every), step):
            rows = every[k : k + step]
            yield np.asarray(rows), [np.stack([np.asarray(c.iat[i], dtype=float) for i in rows]) for c in columns]


def row_kernel(fn: Callable[..., np.ndarray], *columns: str | Column, min_points: int = 1) -> Column:
    """array<double> column from ``fn(stack, ...) -> stack``; NULL for waves with
    fewer points than the kernel needs."""

    @F.pandas_udf(DOUBLES)
    def run(*cols: pd.Series) -> pd.Series:
        out = np.empty(len(cols[0]), dtype=object)
        for at, stacks in stacked(list(cols)):
            if stacks[0].shape[1] >= min_points:
                res = fn(*stacks)
                for i, r in zip(at, res):
                    out[i] = r
        return pd.Series(out)

    return run(*columns)


def ragged_kernel(fn: Callable[..., list[np.ndarray]], column: str | Column, by: str | Column | None = None) -> Column:
    """array<double> column from a kernel that takes rows of different lengths
    together. Rows are sorted by length and handed over in groups of similar
    ones, so that little is padded. With ``by``, a number per row, a group has
    one such number, and the kernel gets it too."""

    @F.pandas_udf(DOUBLES)
    def run(col: pd.Series, number: pd.Series) -> pd.Series:
        rows = {i: np.asarray(v, dtype=float) for i, v in enumerate(col) if v is not None and len(v)}
        out = np.empty(len(col), dtype=object)
        for n in sorted({number.iat[i] for i in rows}):
            order = sorted((i for i in rows if number.iat[i] == n), key=lambda i: rows[i].size)
            for k in range(0, len(order), 256):
                some = order[k : k + 256]
                for i, r in zip(some, fn([rows[i] for i in some], *([] if by is None else [n]))):
                    out[i] = r
        return pd.Series(out)

    return run(column, F.lit(0.0) if by is None else by)


def struct_kernel(fn: Callable[..., tuple], schema: str, *columns: str | Column) -> Column:
    """Struct column from ``fn(stack, ...) -> tuple of vectors``."""
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = st.fieldNames()

    @F.pandas_udf(st)
    def run(*cols: pd.Series) -> pd.DataFrame:
        out = {n: np.full(len(cols[0]), np.nan) for n in names}
        for at, stacks in stacked(list(cols)):
            for n, v in zip(names, fn(*stacks)):
                out[n][at] = v
        return pd.DataFrame(out)

    return run(*columns)


def long_to_chunks(samples: DataFrame, keys: list[str], value: str, *, chunk: int, halo: int) -> DataFrame:
    """Samples (keys, idx, value) as bounded stretches of consecutive points.

    Each chunk carries ``halo`` points of its neighbours on both sides, so a
    filter can settle before the part that is kept. A series of any length
    becomes many small arrays spread over the cluster.
    """
    own = F.floor(F.col("idx") / chunk)
    first = F.floor((F.col("idx") - halo) / chunk)
    last = F.floor((F.col("idx") + halo) / chunk)
    spread = samples.select(
        *keys,
        "idx",
        F.col(value).cast("double").alias("_v"),
        own.cast("bigint").alias("_own"),
        F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("chunk"),
    )
    arr = spread.groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("idx", "_v"))).alias("_p"),
        F.count_if(F.col("_own") == F.col("chunk")).alias("_core"),
    )
    # the last halo may reach past the end into a chunk without points of its own
    return arr.where("_core > 0").select(
        *keys, "chunk", F.transform("_p", lambda p: p["idx"]).alias("idxs"), F.transform("_p", lambda p: p["_v"]).alias("vs")
    )


def chunks_to_long(chunks: DataFrame, keys: list[str], values: str, *, chunk: int, out: str = "v") -> DataFrame:
    """The kept part of filtered chunks as rows (keys, idx, out)."""
    z = chunks.select(*keys, "chunk", F.explode(F.arrays_zip(F.col("idxs").alias("idx"), F.col(values).alias("v"))).alias("_z"))
    return z.select(*keys, "chunk", F.col("_z.idx").alias("idx"), F.col("_z.v").alias(out)).where(
        F.floor(F.col("idx") / chunk) == F.col("chunk")
    ).drop("chunk")
