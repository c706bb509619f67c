"""Counts, limits, grouped statistics and group comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as X
from .ordered import exact_quantiles, ordered_scan, value_cells


def event_span(events: DataFrame, keys: Sequence[str], *, origin: float = 0.0) -> DataFrame:
    """First and last event, range and last event relative to the time origin."""
    return (
        events.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.min("t").alias("t_first"),
            F.max("t").alias("t_last"),
        )
        .withColumns(
            {
                "duration": F.col("t_last") - F.col("t_first"),
                "t_last_rel": F.col("t_last") - F.lit(float(origin)),
            }
        )
    )


def selection_counts(cycles: DataFrame) -> DataFrame:
    """Cycles by mode and selection, overall (side ``all``) and for the left and
    right side; unknown sides count overall only."""
    s = F.lower("side")
    side = F.when(s.contains("left") | (s == "l"), "left").when(s.contains("right") | (s == "r"), "right").otherwise("?")
    kin = F.coalesce(F.col("kinetic").cast("int"), F.lit(0)) == 1
    sel = F.coalesce(F.col("selected").cast("int"), F.lit(1)) == 1
    c = cycles.select(side.alias("side"), kin.alias("_k"), sel.alias("_s"))
    out = c.rollup("side").agg(
        F.count_if(F.col("_k") & F.col("_s")).alias("kinetic_selected"),
        F.count_if(F.col("_k") & ~F.col("_s")).alias("kinetic_unselected"),
        F.count_if(~F.col("_k") & F.col("_s")).alias("kinematic_selected"),
        F.count_if(~F.col("_k") & ~F.col("_s")).alias("kinematic_unselected"),
    )
    return out.withColumn("side", F.coalesce("side", F.lit("all"))).where("side <> '?'")


def axis_limits(points: DataFrame, by: Sequence[str], *, margin: float = 0.05) -> DataFrame:
    """Limits of the finite points of selected visible lines, widened by a share
    of the span; an empty span counts as one unit around the value."""
    fin = (
        F.coalesce(F.col("selected").cast("int"), F.lit(1)) == 1
    ) & F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    g = points.where(fin).groupBy(*by).agg(
        *[f(c).alias(f"{c}_{n}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))]
    )
    m = max(0.0, margin)
    cols = []
    for c in "xy":
        lo, hi = F.col(f"{c}_min"), F.col(f"{c}_max")
        flat = hi <= lo
        d = F.when(flat, 1.0).otherwise(hi - lo)
        lo2 = F.when(flat, lo - 0.5).otherwise(lo)
        hi2 = F.when(flat, lo + 0.5).otherwise(hi)
        cols += [(lo2 - d * m).alias(f"{c}_lo"), (hi2 + d * m).alias(f"{c}_hi")]
    return g.select(*by, *cols)


def histogram(rows: DataFrame, value: str, *, bins: int = 200) -> DataFrame:
    """Counts in equal bins between minimum and maximum, empty bins included."""
    v = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    lim = v.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("_l")).scalar()
    v = v.withColumn("_l", lim)
    step = (F.col("_l.hi") - F.col("_l.lo")) / F.lit(float(bins))
    b = F.when(step > 0, F.least(F.floor((F.col("_v") - F.col("_l.lo")) / step), F.lit(bins - 1))).otherwise(0)
    n = v.groupBy(b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return (
        rows.sparkSession.range(bins)
        .select(F.col("id").alias("bin"))
        .join(n, "bin", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


def descriptives(rows: DataFrame, by: Sequence[str], columns: Sequence[str], *, grain: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample SD, median, minimum and maximum per group and column,
    after keeping the first row of each grain key."""
    from .quality import dedupe

    by = list(by)
    src = dedupe(rows, grain, order or grain) if grain else rows
    long = src.select(
        *by,
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])),
    ).where(F.col("v").isNotNull())
    g = long.groupBy(*by, "metric").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("sd"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    med = exact_quantiles(long, [*by, "metric"], "v", {"median": 0.5})
    return g.join(med, [*by, "metric"])


# fixed values: named percent windows of a cycle
PHASES = {
    "Loading_Response": (0, 10),
    "Midstance": (10, 30),
    "First_Stance_Phase_Half": (0, 30),
    "Terminal_Stance": (30, 50),
    "Pre_Swing": (50, 60),
    "Second_Stance_Phase_Half": (30, 60),
    "Initial_Swing": (60, 73),
    "Mid_Swing": (73, 87),
    "Terminal_Swing": (87, 100),
    "Swing_Phase": (60, 100),
}

METRICS = ("mean", "median", "std", "min", "max", "auc")


def _window_metrics(a: Column, t0: Column) -> dict[str, Column]:
    one = F.size(a) == 1
    return {
        "mean": X.mean(a),
        "median": X.median(a),
        "std": X.std(a),
        "min": F.array_min(a),
        "max": F.array_max(a),
        "auc": F.when(one, F.get(a, 0) * t0).otherwise(X.area(a)),
    }


def stance_metrics(waves: DataFrame, keys: Sequence[str], wave: str, stance_pct: Column) -> DataFrame:
    """Mean, median, population SD, extremes and area of the wave from 0 up to
    the stance percentage. Works on one row at a time."""
    n = F.rint(F.coalesce(stance_pct, F.lit(0.0))).cast("int")
    n = F.greatest(F.lit(1), F.least(n, F.size(wave)))
    w = waves.withColumn("_a", F.slice(F.col(wave), F.lit(1), n))
    return w.select(*keys, *[c.alias(m) for m, c in _window_metrics(F.col("_a"), F.lit(0.0)).items()])


def raw_stance_metrics(waves: DataFrame, keys: Sequence[str], wave: str, times: str) -> DataFrame:
    """The same metrics of the samples of a stance as they were recorded; the area
    is taken over their real times. ``times`` is as long as ``wave``."""
    n = F.size(wave)
    low, high = (lambda c: F.slice(c, F.lit(1), n - 1)), (lambda c: F.slice(c, F.lit(2), n - 1))
    means = F.zip_with(low(F.col(wave)), high(F.col(wave)), lambda a, b: (a + b) / 2)
    steps = F.zip_with(low(F.col(times)), high(F.col(times)), lambda a, b: b - a)
    area = F.aggregate(F.zip_with(means, steps, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    found = {**_window_metrics(F.col(wave), F.lit(0.0)), "auc": F.when(n > 1, area).when(n == 1, 0.0)}
    return waves.select(*keys, *[c.alias(m) for m, c in found.items()])


def cluster_counts(rows: DataFrame, file: str, cluster: str) -> DataFrame:
    """(file, cluster, n): how many cycles of each cluster a file has."""
    return rows.groupBy(file, cluster).agg(F.count(F.lit(1)).alias("n"))


def subphase_metrics(waves: DataFrame, keys: Sequence[str], wave: str, phases=PHASES) -> DataFrame:
    """The same metrics over named percent windows, both ends included."""
    spec = F.array(
        *[F.struct(F.lit(p).alias("phase"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, (a, b) in phases.items()]
    )
    w = waves.select(*keys, wave, F.inline(spec))
    w = w.withColumn("_a", F.slice(F.col(wave), F.col("a") + 1, F.col("b") - F.col("a") + 1))
    return w.select(
        *keys, "phase", *[c.alias(m) for m, c in _window_metrics(F.col("_a"), F.col("a").cast("double")).items()]
    )


def compare_two_groups(long: DataFrame, by: Sequence[str], group: str, value: str, *, n_comparisons: int = 18, alpha: float = 0.05) -> DataFrame:
    """Both groups' statistics, their mean difference with its standard error, and
    the Kruskal-Wallis test with Bonferroni correction.

    ``group`` is 0 or 1. Values are counted per distinct value first; ranks come
    from running counts over value cells, so no metric is ranked in one task.
    """
    by = list(by)
    v = long.where(F.col(group).isin(0, 1) & F.col(value).isNotNull()).select(
        *by, F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")
    )
    stats = v.groupBy(*by).agg(
        *[
            f(F.when(F.col("_g") == g, F.col("_v"))).alias(f"{n}_{g}")
            for g in (0, 1)
            for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop), ("min", F.min), ("max", F.max))
        ]
    )
    med = exact_quantiles(v, [*by, "_g"], "_v", {"_med": 0.5})
    med = med.groupBy(*by).agg(*[F.max(F.when(F.col("_g") == g, F.col("_med"))).alias(f"median_{g}") for g in (0, 1)])

    ties = v.groupBy(*by, "_v").agg(
        F.count(F.lit(1)).alias("_t"), F.count_if(F.col("_g") == 0).alias("_t0")
    )
    ties = ordered_scan(value_cells(ties, by, "_v"), by, ["_v"], totals={"_below": F.col("_t")})
    t = F.col("_t").cast("double")
    rank = F.col("_below") + (t + 1) / 2
    r = ties.groupBy(*by).agg(
        F.sum(rank * F.col("_t0")).alias("_r0"),
        F.sum(rank * (F.col("_t") - F.col("_t0"))).alias("_r1"),
        F.sum(t * t * t - t).alias("_tie"),
    )
    j = stats.join(med, by).join(r, by)
    n0, n1 = F.col("n_0").cast("double"), F.col("n_1").cast("double")
    n = n0 + n1
    h = F.lit(12.0) / (n * (n + 1)) * (F.col("_r0") * F.col("_r0") / n0 + F.col("_r1") * F.col("_r1") / n1) - 3 * (n + 1)
    corr = 1 - F.col("_tie") / (n * n * n - n)
    enough = (n0 > 1) & (n1 > 1)
    j = j.withColumns(
        {
            "mean_diff": F.col("mean_0") - F.col("mean_1"),
            "se_diff": F.sqrt(F.col("sd_0") * F.col("sd_0") / n0 + F.col("sd_1") * F.col("sd_1") / n1),
            "h": F.when(enough & (corr > 0), F.greatest(h / corr, F.lit(0.0))),
        }
    )
    j = j.withColumn("p", chi2_1_tail("h"))
    j = j.withColumn("p_corrected", F.least(F.col("p") * n_comparisons, F.lit(1.0)))
    verdict = (
        F.when(~enough, "Insufficient Data for Test")
        .when(F.col("p").isNull(), "Test Failed")
        .when(F.col("p_corrected") < alpha, "SIGNIFICANT")
        .otherwise("NOT SIGNIFICANT")
    )
    return j.withColumn("verdict", verdict).drop("_r0", "_r1", "_tie")


@F.pandas_udf(T.DoubleType())
def chi2_1_tail(h: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom, for result rows."""
    return h.map(lambda x: None if pd.isna(x) else math.erfc(math.sqrt(x / 2.0)))


def percent_to_nodes(start: Column, end: Column, n_points: int = 101, min_points: int = 3) -> tuple[Column, Column]:
    """(first, last) node of a percent window, widened to a minimum number of
    nodes and kept inside the wave."""
    last = n_points - 1
    inside = lambda c: F.greatest(F.lit(0), F.least(c.cast("int"), F.lit(last)))
    first = inside(F.ceil(F.round(start / 100.0 * last, 9)))
    second = inside(F.floor(F.round(end / 100.0 * last, 9)))
    lo, hi = F.least(first, second), F.greatest(first, second)
    half = min_points // 2
    centre = F.rint((lo + hi) / 2.0).cast("int")
    s = F.greatest(F.lit(0), centre - half)
    over = s + min_points - 1 > last
    wide_lo = F.when(over, F.lit(max(0, last - min_points + 1))).otherwise(s)
    wide_hi = F.when(over, F.lit(last)).otherwise(s + min_points - 1)
    enough = hi - lo + 1 >= min_points
    return F.when(enough, lo).otherwise(wide_lo), F.when(enough, hi).otherwise(wide_hi)


def tests_for_clusters(k: Column) -> Column:
    """Number of tests for k clusters: none, one, or one and all pairs."""
    return F.when(k < 2, 0).when(k == 2, 1).otherwise(1 + (k * (k - 1) / 2)).cast("int")


def cluster_crosstab(rows: DataFrame, cluster: str, ident: str, side: str, clusters: Sequence, sides: Sequence[str] = ("L", "R")) -> DataFrame:
    """Counts per id and side with one column per cluster; every id gets both
    sides, empty cells are 0."""
    n = rows.groupBy(ident, side).agg(
        *[F.count_if(F.col(cluster) == c).alias(f"cluster_{c}") for c in clusters]
    )
    grid = rows.select(ident).distinct().select(ident, F.explode(F.array(*[F.lit(s) for s in sides])).alias(side))
    return grid.join(n, [ident, side], "left").fillna(0)
