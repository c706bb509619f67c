"""Replace channel values by those of a processed source, matched by time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import nearest_asof
from .ordered import exact_quantiles, ordered_scan, time_cell

# fixed values: share of the median step, smallest tolerance in seconds
STEP_SHARE = 0.51
MIN_TOLERANCE = 1e-7


def patch_by_time(target: DataFrame, source: DataFrame, keys: Sequence[str], *, cell_width: float) -> DataFrame:
    """Each target sample with the value of the nearest source sample (the later
    one on a tie). Beyond ``max(0.51 * median source step, 1e-7)`` nothing is
    taken: ``new_value`` stays missing and ``gap`` keeps the distance."""
    keys = list(keys)
    src = source.select(*keys, F.col("t").alias("_st"), "event_id", F.col("value").alias("_sv"))
    step = ordered_scan(
        src.select(*keys, "_st").distinct(),
        keys,
        ["_st"],
        prevs={"_p": F.struct(F.col("_st").alias("t"))},
        cell=time_cell("_st", cell_width),
    ).withColumn("_dt", F.col("_st") - F.col("_p.t"))
    tol = exact_quantiles(step, keys, "_dt", {"_med": 0.5}).select(
        *keys, F.greatest(F.lit(STEP_SHARE) * F.col("_med"), F.lit(MIN_TOLERANCE)).alias("tol")
    )
    near = nearest_asof(
        target, src, keys, "t", "_st", ["_sv"], ties="later", cell_width=cell_width, tie_order=["event_id"]
    )
    return (
        near.join(tol, keys, "left")
        .withColumn("tol", F.coalesce("tol", F.lit(MIN_TOLERANCE)))
        .withColumn("new_value", F.when(F.col("gap") <= F.col("tol"), F.col("_sv")))
        .drop("_sv")
    )


def patch_report(patched: DataFrame, keys: Sequence[str], *, dry_run: bool = False) -> DataFrame:
    """Counts and a status per file; a sample beyond tolerance is an error."""
    ok = F.col("gap") <= F.col("tol")
    rep = patched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(ok).alias("replaced"),
        F.count_if(F.col("gap").isNull() | ~ok).alias("missing"),
        F.max("gap").alias("max_gap"),
        F.count_if(~ok).alias("_far"),
    )
    status = (
        F.when(F.col("max_gap").isNull(), "missing_source")
        .when(F.col("_far") > 0, "error")
        .when(F.col("replaced") == 0, "no_emg_replaced")
        .otherwise("dry_run" if dry_run else "patched")
    )
    return rep.withColumn("status", status).drop("_far")
