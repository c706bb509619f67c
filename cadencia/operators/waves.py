"""Aggregating and comparing waves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as X
from ..functions import kernels as N
from ..session import cut_lineage
from .ordered import exact_quantiles, ordered_scan, value_cells
from .rows import DOUBLES, row_kernel, struct_kernel

GRID = T.ArrayType(DOUBLES)


def _ordered_array(long: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, idx, columns) rows to one array per column; a wave has a fixed, small
    number of points."""
    g = long.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", *columns))).alias("_a"))
    return g.select(*by, *[F.col("_a").getField(c).alias(c) for c in columns])


def wave_stats(waves: DataFrame, by: Sequence[str], wave: str = "wave") -> DataFrame:
    """Pointwise mean and population SD per group as arrays."""
    long = waves.select(*by, F.posexplode(wave).alias("idx", "_v"))
    g = long.groupBy(*by, "idx").agg(F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("sd"))
    return _ordered_array(g, by, ["mean", "sd"])


def mean_wave(waves: DataFrame, by: Sequence[str], wave: str = "wave") -> DataFrame:
    return wave_stats(waves, by, wave).select(*by, F.col("mean").alias("wave"))


def median_wave(waves: DataFrame, by: Sequence[str], wave: str = "wave") -> DataFrame:
    """Pointwise exact median of groups of any size."""
    long = waves.select(*by, F.posexplode(wave).alias("idx", "_v"))
    return _ordered_array(exact_quantiles(long, [*by, "idx"], "_v", {"wave": 0.5}), by, ["wave"])


def _parts_schema(df: DataFrame, by: Sequence[str]) -> T.StructType:
    return T.StructType(
        [df.schema[b] for b in by]
        + [T.StructField("n", T.DoubleType()), T.StructField("total", DOUBLES), T.StructField("rows", GRID)]
    )


def component_parts(waves: DataFrame, by: Sequence[str], wave: str = "wave", weight: str | None = None, *, salts: int = 8) -> DataFrame:
    """Per group the number of waves, their sum, and at most as many rows as a
    wave has points with the same cross products (n, total, rows).

    Each partition shrinks what it holds by QR before anything is shuffled; the
    partial results are merged in two rounds, so the largest group never meets
    in one task as more than a handful of small matrices.
    """
    by = list(by)
    src = waves.select(*by, F.col(wave).alias("_w"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_q"))
    schema = _parts_schema(src, by)
    names = [f.name for f in schema]

    def pack(key: tuple, n: float, total: np.ndarray, rows: np.ndarray) -> tuple:
        return (*key, n, total.tolist(), rows.tolist())

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        size = 0

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([pack(k, *v) for k, v in held.items()], columns=names)
            held.clear()
            return out

        for pdf in batches:
            if pdf.empty:
                continue
            for key, g in pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]:
                key = key if isinstance(key, tuple) else (key,)
                x = np.stack(g["_w"].to_numpy())
                q = g["_q"].to_numpy()
                n, total, rows = float(q.sum()), (x * q[:, None]).sum(axis=0), x * np.sqrt(q)[:, None]
                if key in held:
                    m, t, r = held[key]
                    size -= len(r)
                    n, total, rows = n + m, total + t, np.concatenate([r, rows])
                rows = N.shrink_rows(rows)
                held[key] = [n, total, rows]
                size += len(rows)
            if size > 50_000:
                yield flush()
                size = 0
        if held:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.stack(r) for r in pdf["rows"] if len(r)])
        key = tuple(pdf[b].iloc[0] for b in by)
        total = np.sum(np.stack(pdf["total"].to_numpy()), axis=0)
        return pd.DataFrame([pack(key, float(pdf["n"].sum()), total, N.shrink_rows(rows))], columns=names)

    parts = src.mapInPandas(local, schema)
    if salts > 1:
        salted = parts.withColumn("_salt", F.spark_partition_id() % salts)
        parts = salted.groupBy(*by, "_salt").applyInPandas(lambda p: merge(p), schema)
    return parts.groupBy(*by).applyInPandas(lambda p: merge(p), schema)


def component_of(rows: str | Column, total: str | Column, n: str | Column) -> Column:
    """First component of merged parts as a column."""

    @F.pandas_udf(DOUBLES)
    def run(rows: pd.Series, total: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for r, t, k in zip(rows, total, n):
            x = np.stack(r)
            out.append(N.first_component(x.T @ x, np.asarray(t) / k))
        return pd.Series(out)

    return run(rows, total, n)


def pca_wave(waves: DataFrame, by: Sequence[str], wave: str = "wave", weight: str | None = None, *, salts: int = 8) -> DataFrame:
    """First right singular vector of the uncentred waves of a group, signed along
    the mean wave and scaled to its norm."""
    p = component_parts(waves, by, wave, weight, salts=salts)
    return p.select(*by, component_of("rows", "total", "n").alias("wave"), F.col("n").cast("bigint").alias("n"))


def aggregate_waves(waves: DataFrame, by: Sequence[str], how: str = "pca", wave: str = "wave") -> DataFrame:
    """mean | median | pca wave per group."""
    if how == "pca":
        return pca_wave(waves, by, wave).select(*by, "wave")
    if how not in ("mean", "median"):
        raise ValueError(f"unknown aggregation {how}")
    return (mean_wave if how == "mean" else median_wave)(waves, by, wave)


def global_waves(traces: DataFrame, label: str, *, cycles: str | None = None, raw: DataFrame | None = None, ident: str = "sid") -> DataFrame:
    """One trace per label over the subjects' traces, with the number of subjects
    and, if given, the range of their cycle counts. From the raw waves (``ident``,
    label) come the number of all subjects and of those with waves of the label,
    before any were left out."""
    g = pca_wave(traces, [label]).withColumnRenamed("n", "n_ids_used")
    if raw is not None:
        total = raw.agg(F.countDistinct(ident).alias("n")).scalar()
        g = g.join(raw.groupBy(label).agg(F.countDistinct(ident).alias("n_ids_raw")), label).withColumn("n_ids_total", total)
    if cycles is None:
        return g
    c = traces.groupBy(label).agg(F.min(cycles).alias("cycles_min"), F.max(cycles).alias("cycles_max"))
    med = exact_quantiles(traces, [label], cycles, {"cycles_median": 0.5})
    return g.join(c, label).join(med, label)


def xcorr_best(a: str, b: str, max_lag: int | None = None) -> Column:
    """struct(corr, lag): the best lagged correlation of two wave columns."""
    return struct_kernel(
        lambda x, y: N.xcorr_best_rows(x, y, max_lag), "corr double, lag double", a, b
    )


def convolution_best(a: str, b: str) -> Column:
    """struct(corr, lag): the best normalised full convolution of two wave columns."""
    return struct_kernel(N.convolution_best_rows, "corr double, lag double", a, b)


def xcorr_series(a: str, b: str, max_lag: int | None = None) -> Column:
    """Correlation at every lag."""
    return row_kernel(lambda x, y: N.xcorr_rows(x, y, max_lag)[1], a, b)


def circular_best(a: str, b: str, lags: Sequence[int]) -> Column:
    """struct(corr, lag, mad): best circular correlation over the lags, and the
    mean absolute difference at that lag."""
    lags = [int(k) for k in lags]

    def run(x: np.ndarray, y: np.ndarray) -> tuple:
        c, k = N.circular_best_rows(x, y, lags)
        return c, k, N.mad_rows(N.roll_rows(x, k), y)

    return struct_kernel(run, "corr double, lag double, mad double", a, b)


def circular_best_mad(a: str, b: str, lags: Sequence[int]) -> Column:
    """struct(mad, lag): smallest mean absolute difference over the lags."""
    lags = np.asarray(list(lags), dtype=int)

    def run(x: np.ndarray, y: np.ndarray) -> tuple:
        m = np.stack([N.mad_rows(np.roll(x, int(k), axis=1), y) for k in lags], axis=1)
        k = m.argmin(axis=1)
        return m[np.arange(len(x)), k], lags[k]

    return struct_kernel(run, "mad double, lag double", a, b)


def compare_to_trace(waves: DataFrame, traces: DataFrame, by: Sequence[str], *, max_lag: int) -> DataFrame:
    """Each wave with its best correlation to the trace of its group, over limited
    and over all lags. Traces are one row per group."""
    t = traces.select(*by, F.col("wave").alias("_trace"))
    j = waves.join(t, list(by)).withColumns(
        {"_lim": xcorr_best("wave", "_trace", max_lag), "_full": xcorr_best("wave", "_trace")}
    )
    return j.select(
        *waves.columns,
        F.col("_lim.corr").alias("corr"),
        F.col("_lim.lag").alias("lag"),
        F.col("_full.corr").alias("corr_full"),
        F.col("_full.lag").alias("lag_full"),
    )


def quantile_threshold(rows: DataFrame, value: str, *, upper: bool = False, q: float = 0.025) -> DataFrame:
    """One row with the lower (or upper) empirical limit of the finite values."""
    return exact_quantiles(rows, [], value, {"threshold": 1.0 - q if upper else q})


def central_interval(rows: DataFrame, by: Sequence[str], value: str, level: float = 0.8) -> DataFrame:
    """Central interval per group; missing below two values."""
    a = (1.0 - level) / 2.0
    fin = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    n = fin.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    q = exact_quantiles(fin, by, value, {"low": a, "high": 1.0 - a})
    return n.join(q, list(by)).withColumns({c: F.when(F.col("n") >= 2, F.col(c)) for c in ("low", "high")})


def outlier_waves(compared: DataFrame, by: Sequence[str], *, min_cycles: int = 3) -> DataFrame:
    """``outlier`` marks waves whose limited-lag correlation lies below the 2.5 %
    quantile of all waves, in groups that keep at least ``min_cycles`` others."""
    thr = quantile_threshold(compared, "corr").scalar()
    low = compared.withColumn("_low", F.coalesce(F.col("corr") < thr, F.lit(False)))
    keep = low.groupBy(*by).agg(F.count_if(~F.col("_low")).alias("_kept"))
    return low.join(keep, list(by)).withColumn("outlier", F.col("_low") & (F.col("_kept") >= min_cycles)).drop("_low", "_kept")


def within_stats(compared: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, means and exact medians of the correlations and lags of the waves
    of a group."""
    by = list(by)
    base = compared.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cycles"),
        F.avg("corr").alias("corr_mean"),
        F.avg("lag_full").alias("lag_mean"),
    )
    parts = {
        "corr_med": "corr",
        "lag_med": "lag_full",
        "lag_abs_med": F.abs("lag_full"),
        "lag_abs_med_lim": F.abs("lag"),
        "corr_med_full": "corr_full",
        "lag_med_lim": "lag",
    }
    long = compared.select(
        *by,
        F.inline(
            F.array(*[F.struct(F.lit(m).alias("m"), (F.col(c) if isinstance(c, str) else c).alias("v")) for m, c in parts.items()])
        ),
    )
    q = exact_quantiles(long, [*by, "m"], "v", {"q": 0.5})
    q = q.groupBy(*by).agg(*[F.max(F.when(F.col("m") == m, F.col("q"))).alias(m) for m in parts])
    return base.join(q, by)


def early_late(waves: DataFrame, by: Sequence[str], order: str, *, max_lag: int, cell: Column) -> DataFrame:
    """Correlation and lag between the trace of the first half and that of the
    second half of a group's waves; groups of at least four."""
    by = list(by)
    n = waves.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 4")
    w = ordered_scan(waves.select(*by, order, "wave"), by, [order], row_no="_k", cell=cell).join(n, by)
    w = w.withColumn("half", F.when(F.col("_k") <= F.floor(F.col("_n") / 2), "early").otherwise("late"))
    t = pca_wave(w, [*by, "half"])
    both = t.groupBy(*by).agg(
        F.max_by("wave", F.when(F.col("half") == "early", 1)).alias("_e"),
        F.max_by("wave", F.when(F.col("half") == "late", 1)).alias("_l"),
    )
    x = both.withColumn("_x", xcorr_best("_e", "_l", max_lag))
    return x.select(*by, F.col("_x.corr").alias("early_late_corr"), F.col("_x.lag").alias("early_late_lag"))


def homogeneity(
    waves: DataFrame, by: Sequence[str], order: str, *, max_lag: int, cell: Column, min_cycles: int = 3
) -> tuple[DataFrame, DataFrame]:
    """Traces without outlier waves, and the statistics of what is left around them.

    Waves below the 2.5 % quantile of all correlations to the first traces are
    left out and the traces taken again. A group is flagged when its halves agree
    less than that quantile; not if fewer than ``min_cycles`` waves reach it. Groups
    of fewer than ``min_cycles`` waves get no trace and take no part.
    """
    by = list(by)
    enough = waves.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cycles)
    waves = waves.join(enough, by, "left_semi")
    first = cut_lineage(compare_to_trace(waves, pca_wave(waves, by), by, max_lag=max_lag))
    limit = quantile_threshold(first, "corr").select(F.col("threshold").alias("within_corr_low"))
    marked = cut_lineage(outlier_waves(first, by, min_cycles=min_cycles).withColumn("_limit", limit.scalar()))
    high = ~F.coalesce(F.col("corr") < F.col("_limit"), F.lit(False))
    counts = marked.groupBy(*by).agg(
        F.count_if("outlier").alias("n_outliers"), F.count_if(high).alias("_high"), F.max("_limit").alias("within_corr_low")
    )
    kept = marked.where(~F.col("outlier")).select(*waves.columns)
    traces = cut_lineage(pca_wave(kept, by).select(*by, "wave"))
    stats = within_stats(cut_lineage(compare_to_trace(kept, traces, by, max_lag=max_lag)), by)
    halves = early_late(kept, by, order, max_lag=max_lag, cell=cell)
    apart = F.coalesce(F.col("early_late_corr") < F.col("within_corr_low"), F.lit(False)) & (F.col("_high") >= min_cycles)
    stats = stats.join(counts, by).join(halves, by, "left").withColumn("homogeneity_flag", apart).drop("_high")
    return traces, stats


def snr_by_channel(waves: DataFrame, file: Sequence[str], channel: Sequence[str]) -> DataFrame:
    """Median signal-to-noise per file, then the median of the files."""
    s = waves.select(*dict.fromkeys([*file, *channel]), X.snr("wave").alias("_s"))
    per_file = exact_quantiles(s, list(dict.fromkeys([*channel, *file])), "_s", {"_f": 0.5})
    return exact_quantiles(per_file, list(channel), "_f", {"snr": 0.5})


def label_consistency(labels: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Keys that carry more than one label."""
    d = labels.select(*keys, label).distinct()
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_labels"), F.min(label).alias("first_label"), F.max(label).alias("last_label")
    ).where("n_labels > 1")


def unexpected_labels(labels: DataFrame, key: str, label: str, expected: DataFrame) -> DataFrame:
    """(key, label, expected) once for each label that is not spelled as expected."""
    return labels.select(key, label).distinct().join(expected, key).where(F.col(label) != F.col("expected"))


#: replicates that the bootstrap draws from one seed
REPLICATES = 100
#: such batches, and blocks of traces, that one task of the bootstrap takes
BATCHES, BLOCKS = 10, 16


def _draws(seed: Sequence[int], n: int, lo: int, hi: int, block: int, reps: int) -> np.ndarray:
    """How often each of the rows lo..hi of n is drawn in each replicate of n draws.

    The draws are split over halves of the rows by seeded binomials down to the
    block, so that tasks agree on them without exchanging any.
    """
    first, last, count = 0, n, np.full(reps, n)
    while (first, last) != (lo, hi):
        mid = first + block * (-(-(last - first) // block) // 2)
        left = np.random.default_rng([*seed, first, last]).binomial(count, (mid - first) / (last - first))
        first, last, count = (first, mid, left) if lo < mid else (mid, last, count - left)
    at = np.random.default_rng([*seed, lo, hi]).integers(0, hi - lo, count.sum())
    at += np.repeat(np.arange(reps), count) * (hi - lo)
    return np.bincount(at, minlength=reps * (hi - lo)).reshape(reps, hi - lo)


def bootstrap_waves(
    traces: DataFrame, by: Sequence[str], ident: str, *, n_boot: int, seed: int, cell: Column, block: int = 2048
) -> DataFrame:
    """Pointwise mean, SD and 2.5/50/97.5 percentiles of the first component over
    resamples with replacement.

    A task takes some blocks of ``block`` traces and some replicates, draws how
    often each trace occurs, weighs the traces' products with that and adds them up
    over its blocks; replicates of a group of more blocks than a task takes add up
    their products in two rounds.
    """
    by = list(by)
    n = traces.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    numbered = ordered_scan(traces.select(*by, ident, "wave"), by, [ident], row_no="_k", cell=cell).join(n, by)
    batch = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // (REPLICATES * BATCHES))))
    at = numbered.select(
        *by, "_n", "_k", "wave", F.floor((F.col("_k") - 1) / (block * BLOCKS)).cast("bigint").alias("_block"), F.xxhash64(*by).alias("_h"), batch.alias("_batch")
    )
    schema = T.StructType(
        [at.schema[c] for c in [*by, "_n", "_batch", "_block"]]
        + [T.StructField("rep", T.LongType())]
        + [T.StructField(c, DOUBLES) for c in ("_total", "_products", "wave")]
    )
    names = [f.name for f in schema]

    def whole(total: np.ndarray, products: np.ndarray, n: int) -> np.ndarray:
        upper = np.triu_indices(len(total))
        gram = np.zeros((len(total), len(total)))
        gram[upper] = products
        return N.first_component(gram + np.triu(gram, 1).T, total / n)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_k")
        x = np.stack(pdf["wave"].to_numpy())
        head = pdf.iloc[0]
        size, lo = int(head["_n"]), int(head["_block"]) * block * BLOCKS
        first, end = (min((int(head["_batch"]) + k) * REPLICATES * BATCHES, n_boot) for k in (0, 1))
        i, j = np.triu_indices(x.shape[1])
        totals, products = np.zeros((end - first, x.shape[1])), np.zeros((end - first, len(i)))
        for at in range(0, len(x), block):
            some = x[at : at + block]
            both = some[:, i] * some[:, j]
            for r in range(first, end, REPLICATES):
                reps = min(REPLICATES, end - r)
                key = [seed, int(head["_h"]) % 2**64, r // REPLICATES]
                w = _draws(key, size, lo + at, lo + at + len(some), block, reps).astype(float)
                totals[r - first : r - first + reps] += w @ some
                products[r - first : r - first + reps] += w @ both
        fixed = tuple(head[c] for c in [*by, "_n", "_batch", "_block"])
        if len(x) == size:
            rows = [(*fixed, first + r, None, None, whole(t, p, size).tolist()) for r, (t, p) in enumerate(zip(totals, products))]
        else:
            rows = [(*fixed, first + r, t.tolist(), p.tolist(), None) for r, (t, p) in enumerate(zip(totals, products))]
        return pd.DataFrame(rows, columns=names)

    def merge(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
        if pdf["wave"].notna().all():
            return pdf[names]
        rows = []
        for rep, g in pdf.groupby("rep"):
            total, products = (np.sum(np.stack(g[c].to_numpy()), axis=0) for c in ("_total", "_products"))
            fixed = tuple(g[c].iloc[0] for c in [*by, "_n", "_batch", "_block"])
            if last:
                rows.append((*fixed, rep, None, None, whole(total, products, int(g["_n"].iloc[0])).tolist()))
            else:
                rows.append((*fixed, rep, total.tolist(), products.tolist(), None))
        return pd.DataFrame(rows, columns=names)

    # few rows are long work here, so the number of tasks isn't left to their bytes
    tasks = max(4 * traces.sparkSession.sparkContext.defaultParallelism, 256)
    key = [*by, "_batch", "_block"]
    parts = at.repartition(tasks, *key).groupBy(*key).applyInPandas(draw, schema)
    salt = F.pmod(F.col("_block"), F.ceil(F.sqrt(F.col("_n") / (block * BLOCKS))).cast("bigint"))
    parts = parts.withColumn("_salt", salt).groupBy(*by, "_batch", "_salt").applyInPandas(lambda p: merge(p, False), schema)
    reps = parts.groupBy(*by, "_batch").applyInPandas(lambda p: merge(p, True), schema)
    long = reps.select(*by, F.posexplode("wave").alias("idx", "_v"))
    # one value per replicate: the groups are as large as n_boot
    g = long.groupBy(*by, "idx").agg(
        F.avg("_v").alias("mean"),
        F.stddev_pop("_v").alias("sd"),
        F.percentile("_v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_p"),
    )
    g = g.select(*by, "idx", "mean", "sd", *[F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(("p2_5", "p50", "p97_5"))])
    return _ordered_array(g, by, ["mean", "sd", "p2_5", "p50", "p97_5"])


def leave_one_out(
    traces: DataFrame, by: Sequence[str], ident: str, *, pool: DataFrame | None = None, per_task: int = 1000
) -> DataFrame:
    """Each trace against the first component of the group's traces of all other
    ids: correlation at lag 0, mean absolute difference, and that component.

    ``pool`` holds the traces to take the component of when they are more than
    ``traces``. The group's cross products are worked out once; a task takes them
    and about ``per_task`` traces, and subtracts one id at a time.
    """
    by = list(by)
    parts = component_parts(traces if pool is None else pool, by)
    salts = F.ceil(F.col("n") / per_task).cast("bigint")
    n = parts.select(*by, salts.alias("_s"))
    left = traces.select(*by, ident, "wave").join(n, by).withColumn("_salt", F.pmod(F.xxhash64(ident), F.col("_s"))).drop("_s")
    right = parts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    schema = T.StructType(
        [traces.schema[c] for c in [*by, ident]]
        + [T.StructField(c, T.DoubleType()) for c in ("corr", "mad")]
        + [T.StructField("loo_wave", DOUBLES)]
    )
    names = [*by, ident, "corr", "mad", "loo_wave"]

    def run(tr: pd.DataFrame, pt: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(tr) and len(pt):
            r = np.stack(pt["rows"].iloc[0])
            gram, total, n = r.T @ r, np.asarray(pt["total"].iloc[0]), pt["n"].iloc[0]
            for _, g in tr.groupby(ident, sort=False):
                w = np.stack(g["wave"].to_numpy())
                if n - len(w) < 1:
                    continue
                rest = N.first_component(gram - w.T @ w, (total - w.sum(axis=0)) / (n - len(w)))
                loo = np.broadcast_to(rest, w.shape)
                out.append(
                    g[[*by, ident]].assign(
                        corr=N.xcorr_rows(w, loo, 0)[1][:, 0], mad=N.mad_rows(w, loo), loo_wave=[rest] * len(w)
                    )
                )
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    k = [*by, "_salt"]
    return left.groupBy(*k).cogroup(right.groupBy(*k)).applyInPandas(run, schema)


def loo_outliers(loo: DataFrame, by: Sequence[str], ident: str, *, q: float = 0.025, top_fraction: float = 0.0) -> DataFrame:
    """Traces of low correlation, of high difference, or among the most
    dissimilar: (1 - corr) + mad / median mad."""
    by = list(by)
    # both measures in one column, so that their quantiles are found in one pass
    both = F.array(*[F.struct(F.lit(c).alias("_of"), F.col(c).alias("_x")) for c in ("corr", "mad")])
    found = exact_quantiles(loo.select(*by, F.inline(both)), [*by, "_of"], "_x", {"_lo": q, "_mid": 0.5, "_hi": 1.0 - q})
    take = lambda c, name: F.max(F.when(F.col("_of") == c, F.col(name)))
    limits = found.groupBy(*by).agg(take("corr", "_lo").alias("_c"), take("mad", "_hi").alias("_m"), take("mad", "_mid").alias("_med"))
    j = loo.join(limits, by).withColumn(
        "dissim", (1 - F.col("corr")) + F.col("mad") / (F.col("_med") + 1e-8)
    )
    hit = (F.col("corr") < F.col("_c")) | (F.col("mad") > F.col("_m"))
    if top_fraction > 0:
        j = top_share(j, by, "dissim", ident, top_fraction, out="_top")
        hit = hit | F.col("_top")
    return j.where(hit).select(*by, ident, "corr", "mad", "dissim")


def top_share(rows: DataFrame, by: Sequence[str], value: str, ident: str, fraction: float, *, out: str = "top") -> DataFrame:
    """Mark the largest ``fraction`` of a group, at least one row. The border
    value is an exact order statistic; only rows that equal it are numbered."""
    by = list(by)
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_k", F.greatest(F.lit(1), F.rint(F.lit(float(fraction)) * F.col("_n"))).cast("bigint"))
    v = value_cells(rows.select(*by, ident, value), by, value)
    v = v.withColumn("_neg", -F.col(value)).withColumn("_cell", -F.col("_cell"))
    r = ordered_scan(v, by, ["_neg", ident], row_no="_r").join(n, by)
    mark = r.select(*by, ident, (F.col("_r") <= F.col("_k")).alias(out))
    return rows.join(mark, [*by, ident])


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows per group; Spark prunes to k per partition before the
    shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def boundary_summary(waves: DataFrame, by: Sequence[str], wave: str = "wave") -> DataFrame:
    """Mean, median and 90th percentile of each end-to-start metric per group."""
    by = list(by)
    b = waves.select(*by, X.boundary(wave).alias("_b")).where("_b is not null")
    names = ("diff", "diff_n", "ddiff", "ddiff_n", "diff_shift50")
    long = b.select(
        *by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_b.{m}").alias("v")) for m in names]))
    )
    mean = long.groupBy(*by, "metric").agg(F.avg("v").alias("mean"))
    return mean.join(exact_quantiles(long, [*by, "metric"], "v", {"median": 0.5, "p90": 0.9}), [*by, "metric"])


def agreement(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean waves of two sources compared: counts, best normalised convolution
    and its lag, positive where the first source is later."""
    by = list(by)
    na = a.groupBy(*by).agg(F.count(F.lit(1)).alias("n_a"))
    nb = b.groupBy(*by).agg(F.count(F.lit(1)).alias("n_b"))
    j = na.join(nb, by, "full_outer")
    j = j.join(mean_wave(a, by).withColumnRenamed("wave", "_a"), by, "left")
    j = j.join(mean_wave(b, by).withColumnRenamed("wave", "_b"), by, "left")
    j = j.withColumn("_x", convolution_best("_a", "_b"))
    return j.select(
        *by,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b")],
        F.col("_x.corr").alias("corr"),
        F.col("_x.lag").alias("lag"),
    )


def source_homogeneity(waves: DataFrame, by: Sequence[str], *, min_waves: int = 2) -> DataFrame:
    """How well the waves of a group agree with its mean wave: number of waves,
    median and mean of the best normalised convolution and of its lag.

    ``by`` holds the source, too. Flat waves have no correlation and count with lag
    0. Groups of fewer than ``min_waves`` waves are left out.
    """
    by = list(by)
    means = mean_wave(waves, by).withColumnRenamed("wave", "_mean")
    j = waves.select(*by, "wave").join(means, by).withColumn("_x", convolution_best("wave", "_mean"))
    known = F.col("_x.corr").isNotNull() & ~F.isnan("_x.corr")
    x = cut_lineage(j.select(*by, F.when(known, F.col("_x.corr")).alias("corr"), F.when(known, F.col("_x.lag")).otherwise(0.0).alias("lag")))
    base = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("corr").alias("corr_mean"), F.avg("lag").alias("lag_mean"))
    parts = F.array(*[F.struct(F.lit(m).alias("_m"), F.col(m).alias("_v")) for m in ("corr", "lag")])
    q = exact_quantiles(x.select(*by, F.inline(parts)), [*by, "_m"], "_v", {"q": 0.5})
    q = q.groupBy(*by).agg(*[F.max(F.when(F.col("_m") == m, F.col("q"))).alias(f"{m}_med") for m in ("corr", "lag")])
    return base.where(F.col("n") >= min_waves).join(q, by).select(*by, "n", "corr_med", "lag_med", "corr_mean", "lag_mean")


# --- curves -------------------------------------------------------------------


def _sums(waves: DataFrame, group: str) -> DataFrame:
    long = waves.select(group, F.posexplode("wave").alias("idx", "_v"))
    return long.groupBy("idx", group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("m"), F.var_pop("_v").alias("s2")
    )


def curve_t(waves: DataFrame, group: str, a, b) -> DataFrame:
    """Two-sample t with pooled variance at each point (idx, t, df)."""
    s = _sums(waves.where(F.col(group).isin(a, b)), group)
    pick = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c)))
    p = s.groupBy("idx").agg(*[pick(c, g).alias(f"{c}{i}") for c in ("n", "m", "s2") for i, g in enumerate((a, b))])
    df = F.col("n0") + F.col("n1") - 2
    pooled = (F.col("n0") * F.col("s20") + F.col("n1") * F.col("s21")) / df
    se = F.sqrt(pooled * (1 / F.col("n0") + 1 / F.col("n1")))
    return p.select("idx", F.try_divide(F.col("m0") - F.col("m1"), se).alias("t"), df.alias("df"))


def curve_t_paired(waves_a: DataFrame, waves_b: DataFrame, key: str) -> DataFrame:
    """Paired t at each point for waves matched on a key."""
    j = waves_a.select(key, F.col("wave").alias("_a")).join(waves_b.select(key, F.col("wave").alias("_b")), key)
    d = j.select(F.posexplode(F.zip_with("_a", "_b", lambda x, y: x - y)).alias("idx", "_d"))
    g = d.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("m"), F.stddev_samp("_d").alias("s"))
    return g.select("idx", F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")).alias("t"), (F.col("n") - 1).alias("df"))


def curve_f(waves: DataFrame, group: str) -> DataFrame:
    """One-way F at each point (idx, f, df1, df2)."""
    s = _sums(waves, group)
    g = s.groupBy("idx").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("m")).alias("sm"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("smm"),
        F.sum(F.col("n") * F.col("s2")).alias("within"),
    )
    between = F.col("smm") - F.col("sm") * F.col("sm") / F.col("n")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return g.select(
        "idx", F.try_divide(between / df1, F.col("within") / df2).alias("f"), df1.alias("df1"), df2.alias("df2")
    )


def runs_above(curve: DataFrame, value: str, threshold: Column, *, n_points: int = 101) -> DataFrame:
    """Contiguous stretches where |value| exceeds the threshold, with their peak
    and their ends in percent. A curve has a fixed, small number of points."""
    c = curve.withColumn("_up", F.abs(value) > threshold).where("_up")
    w = Window.orderBy("idx")
    c = c.withColumn("_island", F.col("idx") - F.row_number().over(w))
    scale = 100.0 / (n_points - 1)
    return c.groupBy("_island").agg(
        F.min("idx").alias("node_from"), F.max("idx").alias("node_to"), F.max(F.abs(value)).alias("peak")
    ).select(
        "node_from",
        "node_to",
        "peak",
        (F.col("node_from") * scale).alias("pct_from"),
        (F.col("node_to") * scale).alias("pct_to"),
    )


def relabelled_max_t(waves: DataFrame, group: str, a, b, ident: str, *, n_perm: int, seed: int) -> DataFrame:
    """Largest |t| along the curve under seeded random relabelling (perm, max_t).

    A wave joins the first group of relabelling p when a number drawn for (wave, p,
    seed) falls below the first group's share. The draws are runs of eight digits of
    an md5, four of a digest, which any engine can repeat. Each partition adds up
    its waves for all relabellings at once and only these sums are shuffled.
    """
    two = waves.where(F.col(group).isin(a, b))
    share = two.agg(F.avg(F.when(F.col(group) == a, 1.0).otherwise(0.0))).scalar()
    name = lambda i: F.concat_ws(":", F.col(ident).cast("string"), i.cast("string"), F.lit(str(seed)))
    digests = F.transform(F.sequence(F.lit(0), F.lit((n_perm - 1) // 4)), lambda i: F.md5(name(i)))
    places = F.array(*[F.lit(1 + 8 * i) for i in range(4)])
    draws = F.flatten(F.transform(digests, lambda h: F.transform(places, lambda i: F.substr(h, i, F.lit(8)))))
    bound = F.lpad(F.lower(F.hex(F.floor(F.col("_share") * 2**32).cast("long"))), 8, "0")
    # if all waves are of the first group the bound has nine digits
    u = F.transform(F.slice(draws, 1, n_perm), lambda x: (x < F.col("_bound")) | (F.col("_share") == 1))
    two = two.withColumn("_share", share).withColumn("_bound", bound)
    src = two.select("wave", u.alias("_in"))
    schema = "perm int, n double, n0 double, s array<double>, q array<double>, s0 array<double>, q0 array<double>"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["wave"].to_numpy())
            m = np.stack(pdf["_in"].to_numpy()).astype(float).T
            now = [float(len(x)), m.sum(axis=1), x.sum(axis=0), (x * x).sum(axis=0), m @ x, m @ (x * x)]
            acc = now if acc is None else [p + q for p, q in zip(acc, now)]
        if acc is not None:
            n, n0, s, q, s0, q0 = acc
            yield pd.DataFrame(
                {
                    "perm": np.arange(len(n0), dtype="int32"),
                    "n": n,
                    "n0": n0,
                    "s": [s.tolist()] * len(n0),
                    "q": [q.tolist()] * len(n0),
                    "s0": s0.tolist(),
                    "q0": q0.tolist(),
                }
            )

    def peak(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n0 = pdf["n"].sum(), pdf["n0"].sum()
        s, q, s0, q0 = (np.sum(np.stack(pdf[c].to_numpy()), axis=0) for c in ("s", "q", "s0", "q0"))
        n1 = n - n0
        if n0 < 2 or n1 < 2:
            return pd.DataFrame({"perm": pdf["perm"].iloc[:1], "max_t": [0.0]})
        m0, m1 = s0 / n0, (s - s0) / n1
        within = (q0 - n0 * m0**2) + (q - q0 - n1 * m1**2)
        t = (m0 - m1) / np.sqrt(np.maximum(within, 1e-300) / (n - 2) * (1 / n0 + 1 / n1))
        return pd.DataFrame({"perm": pdf["perm"].iloc[:1], "max_t": [float(np.abs(t).max())]})

    return src.mapInPandas(add, schema).groupBy("perm").applyInPandas(peak, "perm int, max_t double")


def curve_significance(waves: DataFrame, group: str, a, b, ident: str, *, alpha: float, n_perm: int = 500, seed: int = 0, n_points: int = 101) -> DataFrame:
    """Stretches of the t curve above the (1 - alpha) quantile of the relabelled
    maxima, each with the share of relabellings that reach its peak."""
    null = relabelled_max_t(waves, group, a, b, ident, n_perm=n_perm, seed=seed)
    # one number per relabelling
    both = null.agg(
        F.struct(F.percentile("max_t", F.lit(1.0 - alpha)).alias("thr"), F.collect_list("max_t").alias("all"))
    ).scalar()
    t = curve_t(waves, group, a, b).withColumn("_null", both)
    runs = runs_above(t, "t", F.col("_null.thr"), n_points=n_points).withColumn("_null", both)
    p = F.size(F.filter(F.col("_null.all"), lambda m: m >= F.col("peak"))) / F.size("_null.all")
    return runs.withColumn("p", p).drop("_null")
