"""Wave aggregation and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import arrays as X
from ..operators import waves as V
from ..session import cut_lineage
from .registry import WAVES, n64, query, r6, r6s

N = 64


def _points(df, *keys, col="wave"):
    p = df.select(*keys, F.posexplode(col).alias("idx", "v"))
    return p.select(*keys, n64("idx").alias("idx"), r6("v").alias("v"))


def first_sql(name: str, src: str) -> str:
    """CTE ``name`` (k, n, wave): first right singular vector of the lists xs of each
    key of ``src`` (k, xs), turned along their mean and as long as it.

    The Gram matrix of the lists is squared until only its first direction is left.
    """
    squared = "list_transform(g, lambda r: list_transform(g, lambda q: list_dot_product(r, q)))"
    trace = "list_sum(list_transform(range(1, n + 1), lambda i: g[i][i]))"
    return f"""{name}g AS (SELECT k, xs, len(xs) AS n, 0 AS step, list_transform(xs, lambda r: list_transform(xs, lambda q: list_dot_product(r, q))) AS g FROM {src}),
{name}p AS (SELECT * FROM {name}g UNION ALL SELECT k, xs, n, step + 1, list_transform(g, lambda r: list_transform(r, lambda v: v / tr))
  FROM (SELECT *, {trace} AS tr FROM (SELECT k, xs, n, step, {squared} AS g FROM {name}p WHERE step < 30))),
{name}u AS (SELECT k, xs, n, g[list_position(dg, list_max(dg))] AS u FROM (SELECT *, list_transform(range(1, n + 1), lambda i: g[i][i]) AS dg FROM {name}p WHERE step = 30)),
{name}v AS (SELECT k, n, list_transform(range(1, {N + 1}), lambda j: list_sum(list_transform(range(1, n + 1), lambda i: u[i] * xs[i][j]))) AS w,
  list_transform(range(1, {N + 1}), lambda j: list_avg(list_transform(xs, lambda x: x[j]))) AS m FROM {name}u),
{name} AS (SELECT k, n, list_transform(w, lambda v: v * f) AS wave FROM (SELECT k, n, w, sqrt(list_dot_product(m, m) / list_dot_product(w, w))
  * CASE WHEN list_dot_product(w, list_transform(m, lambda v: v - list_avg(m))) < 0 THEN -1 ELSE 1 END AS f FROM {name}v))"""


COMPONENT_SQL = f"""WITH RECURSIVE {WAVES}, ts AS (SELECT {{'subject': subject, 'label': label}} AS k, list(wave ORDER BY sample_id) AS xs FROM w GROUP BY subject, label), {first_sql('tr', 'ts')}"""
LOO_SQL = f"""{COMPONENT_SQL}, lk AS (SELECT {{'subject': a.k.subject, 'label': a.k.label}} AS k, list(b.wave ORDER BY b.k.subject) AS xs FROM tr a JOIN tr b ON b.k.label = a.k.label AND b.k.subject <> a.k.subject GROUP BY 1), {first_sql('lo', 'lk')},
lp AS (SELECT tr.k.label AS label, tr.k.subject AS subject, unnest(tr.wave) AS a, unnest(lo.wave) AS b FROM tr JOIN lo ON lo.k.subject = tr.k.subject AND lo.k.label = tr.k.label),
lc AS (SELECT label, subject, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b) + 1e-8) AS corr, avg(abs(a - b)) AS mad FROM lp GROUP BY label, subject)"""


@query("mean_wave", f"WITH {WAVES} SELECT label, idx, {r6s('avg(v)')} AS v FROM pt GROUP BY label, idx")
def mean_wave(spark, d):
    return _points(V.aggregate_waves(A.waves(spark, d), ["label"], "mean"), "label")


@query("median_wave", f"WITH {WAVES} SELECT label, idx, {r6s('quantile_cont(v, 0.5)')} AS v FROM pt GROUP BY label, idx")
def median_wave(spark, d):
    return _points(V.aggregate_waves(A.waves(spark, d), ["label"], "median"), "label")


@query("wave_mean_sd", f"WITH {WAVES} SELECT cluster, idx, {r6s('avg(v)')} AS mean, {r6s('stddev_pop(v)')} AS sd FROM pt GROUP BY cluster, idx")
def wave_mean_sd(spark, d):
    s = V.wave_stats(A.waves(spark, d), ["cluster"])
    p = s.select("cluster", F.posexplode(F.arrays_zip("mean", "sd")).alias("idx", "z"))
    return p.select("cluster", n64("idx").alias("idx"), r6("z.mean").alias("mean"), r6("z.sd").alias("sd"))


SNR_SQL = f"""{WAVES}, a AS (SELECT sample_id, subject, label, side, abs(v) AS v FROM pt), q AS (SELECT sample_id, quantile_cont(v, 0.2) AS c FROM a GROUP BY sample_id),
sn AS (SELECT a.sample_id, any_value(subject) AS subject, any_value(label) AS label, any_value(side) AS side, avg(v) / (stddev_pop(v) FILTER (WHERE v <= c) + 1e-8) AS s FROM a JOIN q USING (sample_id) GROUP BY a.sample_id)"""


@query("snr", f"WITH {SNR_SQL} SELECT sample_id, {r6s('s')} AS snr FROM sn")
def snr(spark, d):
    return A.waves(spark, d).select("sample_id", r6(X.snr(X.rectify("wave"))).alias("snr"))


@query(
    "snr_by_channel",
    f"WITH {SNR_SQL}, f AS (SELECT label, subject, side, quantile_cont(s, 0.5) AS m FROM sn GROUP BY ALL) SELECT label, side, {r6s('quantile_cont(m, 0.5)')} AS snr FROM f GROUP BY label, side",
)
def snr_by_channel(spark, d):
    w = A.waves(spark, d).withColumn("wave", X.rectify("wave"))
    return V.snr_by_channel(w, ["subject"], ["label", "side"]).select("label", "side", r6("snr").alias("snr"))


@query(
    "thresholds",
    f"""WITH {WAVES}, p AS (SELECT label, list_max(wave) AS v FROM w)
SELECT label, count(*) AS n, {r6s('quantile_cont(v, 0.1)')} AS low, {r6s('quantile_cont(v, 0.9)')} AS high, (SELECT {r6s('quantile_cont(v, 0.025)')} FROM p) AS lower_all, (SELECT {r6s('quantile_cont(v, 0.975)')} FROM p) AS upper_all FROM p GROUP BY label""",
)
def thresholds(spark, d):
    p = A.waves(spark, d).select("label", F.array_max("wave").alias("v"))
    ci = V.central_interval(p, ["label"], "v")
    lo, hi = V.quantile_threshold(p, "v").scalar(), V.quantile_threshold(p, "v", upper=True).scalar()
    return ci.withColumns({"_lo": lo, "_hi": hi}).select(
        "label", "n", r6("low").alias("low"), r6("high").alias("high"), r6("_lo").alias("lower_all"), r6("_hi").alias("upper_all")
    )


@query(
    "label_consistency",
    """WITH x AS (SELECT DISTINCT c_nationkey AS sid, c_custkey % 7 AS number, c_mktsegment AS label FROM customer)
SELECT sid, number, count(*) AS n_labels, min(label) AS first_label, max(label) AS last_label FROM x GROUP BY sid, number HAVING count(*) > 1""",
)
def label_consistency(spark, d):
    c = A.table(spark, d, "customer").select(
        F.col("c_nationkey").alias("sid"), (F.col("c_custkey") % 7).alias("number"), F.col("c_mktsegment").alias("label")
    )
    return V.label_consistency(c, ["sid", "number"], "label")


@query(
    "unexpected_labels",
    """WITH e AS (SELECT p_type AS k, min(p_name) AS expected FROM part GROUP BY p_type) SELECT DISTINCT p.p_type AS k, p.p_name AS label, e.expected FROM part p JOIN e ON e.k = p.p_type WHERE p.p_name <> e.expected""",
)
def unexpected_labels(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_type").alias("k"), F.col("p_name").alias("label"))
    return V.unexpected_labels(p, "k", "label", p.groupBy("k").agg(F.min("label").alias("expected")))


TRACE_SQL = f"""{WAVES}, mw AS (SELECT label, idx, avg(v) AS m FROM pt GROUP BY label, idx)"""


def _xc(max_lag: int) -> str:
    return f"""xl AS (SELECT p.sample_id, p.label, l.lag, count(*) AS n, CASE WHEN count(*) >= 3 THEN covar_pop(p.v, m.m) / (stddev_pop(p.v) * stddev_pop(m.m) + 1e-8) ELSE 0.0 END AS c
FROM pt p JOIN (SELECT unnest(range(-{max_lag}, {max_lag + 1})) AS lag) l ON true JOIN mw m ON m.label = p.label AND m.idx = p.idx + l.lag GROUP BY p.sample_id, p.label, l.lag)"""


def _with_trace(spark, d):
    w = A.waves(spark, d)
    t = V.mean_wave(w, ["label"]).select("label", F.col("wave").alias("trace"))
    return w.join(t, "label")


@query(
    "xcorr_best",
    f"""WITH {TRACE_SQL}, {_xc(63)}, g AS (SELECT sample_id, arg_max((c, lag), (c, -lag)) FILTER (WHERE n >= 3) AS f, arg_max((c, lag), (c, -lag)) FILTER (WHERE abs(lag) <= 5) AS l FROM xl GROUP BY sample_id)
SELECT sample_id, {r6s('l[1]')} AS corr, l[2] AS lag, {r6s('f[1]')} AS corr_full, f[2] AS lag_full FROM g""",
)
def xcorr_best(spark, d):
    w = A.waves(spark, d)
    c = V.compare_to_trace(w, V.mean_wave(w, ["label"]), ["label"], max_lag=5)
    return c.select("sample_id", r6("corr").alias("corr"), n64("lag").alias("lag"), r6("corr_full").alias("corr_full"), n64("lag_full").alias("lag_full"))


@query("xcorr_series", f"WITH {TRACE_SQL}, {_xc(63)} SELECT label, CAST(lag + 63 AS BIGINT) AS idx, {r6s('quantile_cont(c, 0.5)')} AS v FROM xl GROUP BY label, lag")
def xcorr_series(spark, d):
    """Pointwise median over waves of the correlation at every lag."""
    s = _with_trace(spark, d).select("label", V.xcorr_series("wave", "trace").alias("wave"))
    return _points(V.median_wave(s, ["label"]), "label")


CIRC_SQL = f"""{TRACE_SQL}, cl AS (SELECT p.sample_id, l.lag, covar_pop(p.v, m.m) / (stddev_pop(p.v) * stddev_pop(m.m) + 1e-8) AS c, avg(abs(p.v - m.m)) AS mad
FROM pt p JOIN (SELECT unnest(range(-5, 6)) AS lag) l ON true JOIN mw m ON m.label = p.label AND m.idx = (p.idx + l.lag + {N}) % {N} GROUP BY p.sample_id, l.lag)"""


@query("circular_corr", f"WITH {CIRC_SQL}, g AS (SELECT sample_id, arg_max((c, lag, mad), (c, -lag)) AS b FROM cl GROUP BY sample_id) SELECT sample_id, {r6s('b[1]')} AS corr, b[2] AS lag, {r6s('b[3]')} AS mad FROM g")
def circular_corr(spark, d):
    c = _with_trace(spark, d).withColumn("c", V.circular_best("wave", "trace", range(-5, 6)))
    return c.select("sample_id", r6("c.corr").alias("corr"), n64("c.lag").alias("lag"), r6("c.mad").alias("mad"))


@query("circular_mad", f"WITH {CIRC_SQL}, g AS (SELECT sample_id, arg_min((mad, lag), (mad, lag)) AS b FROM cl GROUP BY sample_id) SELECT sample_id, {r6s('b[1]')} AS mad, b[2] AS lag FROM g")
def circular_mad(spark, d):
    c = _with_trace(spark, d).withColumn("c", V.circular_best_mad("wave", "trace", range(-5, 6)))
    return c.select("sample_id", r6("c.mad").alias("mad"), n64("c.lag").alias("lag"))


@query(
    "pearson_mad",
    f"WITH {TRACE_SQL} SELECT p.sample_id, {r6s('covar_pop(v, m) / (stddev_pop(v) * stddev_pop(m) + 1e-8)')} AS corr, {r6s('avg(abs(v - m))')} AS mad FROM pt p JOIN mw USING (label, idx) GROUP BY p.sample_id",
)
def pearson_mad(spark, d):
    return _with_trace(spark, d).select("sample_id", r6(X.pearson("wave", "trace")).alias("corr"), r6(X.mad("wave", "trace")).alias("mad"))


COMPARED_SQL = f"""{TRACE_SQL}, {_xc(63)}, g AS (SELECT sample_id, label, arg_max((c, lag), (c, -lag)) FILTER (WHERE n >= 3) AS f, arg_max((c, lag), (c, -lag)) FILTER (WHERE abs(lag) <= 5) AS l FROM xl GROUP BY sample_id, label),
cp AS (SELECT sample_id, label, l[1] AS corr, l[2] AS lag, f[1] AS corr_full, f[2] AS lag_full FROM g)"""


def _compared(spark, d):
    w = A.waves(spark, d).select("sample_id", "label", "wave")
    return V.compare_to_trace(w, V.mean_wave(w, ["label"]), ["label"], max_lag=5)


@query(
    "within_stats",
    f"""WITH {COMPARED_SQL} SELECT label, count(*) AS n_cycles, {r6s('avg(corr)')} AS corr_mean, {r6s('avg(lag_full)')} AS lag_mean, {r6s('quantile_cont(corr, 0.5)')} AS corr_med, {r6s('quantile_cont(lag_full, 0.5)')} AS lag_med,
{r6s('quantile_cont(abs(lag_full), 0.5)')} AS lag_abs_med, {r6s('quantile_cont(abs(lag), 0.5)')} AS lag_abs_med_lim, {r6s('quantile_cont(corr_full, 0.5)')} AS corr_med_full, {r6s('quantile_cont(lag, 0.5)')} AS lag_med_lim FROM cp GROUP BY label""",
)
def within_stats(spark, d):
    s = V.within_stats(_compared(spark, d), ["label"])
    return s.select("label", "n_cycles", *[r6(c).alias(c) for c in s.columns if c not in ("label", "n_cycles")])


@query("outlier_waves", f"WITH {COMPARED_SQL} SELECT sample_id, label, corr < (SELECT quantile_cont(corr, 0.025) FROM cp) AS outlier FROM cp")
def outlier_waves(spark, d):
    return V.outlier_waves(_compared(spark, d), ["label"]).select("sample_id", "label", "outlier")


BOUND_SQL = f"""{WAVES}, b AS (SELECT sample_id, label, subject, abs(wave[64] - wave[1]) AS diff, abs((wave[64] - wave[63]) - (wave[2] - wave[1])) AS ddiff, abs(wave[32] - wave[33]) AS sh,
 sqrt(list_sum(list_transform(wave, lambda x: (x - list_avg(wave)) * (x - list_avg(wave)))) / 64) + 1e-8 AS sd FROM w)"""


@query("boundary", f"WITH {BOUND_SQL} SELECT sample_id, {r6s('diff')} AS diff, {r6s('diff / sd')} AS diff_n, {r6s('ddiff')} AS ddiff, {r6s('ddiff / sd')} AS ddiff_n, {r6s('sh')} AS diff_shift50 FROM b")
def boundary(spark, d):
    b = A.waves(spark, d).select("sample_id", X.boundary("wave").alias("b"))
    return b.select("sample_id", *[r6(f"b.{c}").alias(c) for c in ("diff", "diff_n", "ddiff", "ddiff_n", "diff_shift50")])


@query(
    "boundary_summary",
    f"""WITH {BOUND_SQL}, l AS (SELECT label, unnest([{{'m': 'diff', 'v': diff}}, {{'m': 'diff_n', 'v': diff / sd}}, {{'m': 'ddiff', 'v': ddiff}}, {{'m': 'ddiff_n', 'v': ddiff / sd}}, {{'m': 'diff_shift50', 'v': sh}}]) AS s FROM b)
SELECT label, s.m AS metric, {r6s('avg(s.v)')} AS mean, {r6s('quantile_cont(s.v, 0.5)')} AS median, {r6s('quantile_cont(s.v, 0.9)')} AS p90 FROM l GROUP BY label, s.m""",
)
def boundary_summary(spark, d):
    s = V.boundary_summary(A.waves(spark, d), ["label"])
    return s.select("label", "metric", *[r6(c).alias(c) for c in ("mean", "median", "p90")])


@query("top_k", f"WITH {BOUND_SQL}, k AS (SELECT label, sample_id, row_number() OVER (PARTITION BY label ORDER BY diff / sd DESC, sample_id) AS r FROM b) SELECT label, sample_id FROM k WHERE r <= 5")
def top_k(spark, d):
    b = A.waves(spark, d).select("label", "sample_id", X.boundary("wave").alias("b"))
    return V.top_k(b, ["label"], [F.desc("b.diff_n"), F.asc("sample_id")], 5).select("label", "sample_id")


@query("top_share", f"WITH {WAVES}, k AS (SELECT label, sample_id, row_number() OVER (PARTITION BY label ORDER BY list_max(wave) DESC, sample_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM w) SELECT label, sample_id FROM k WHERE r <= greatest(1, round_even(0.1 * n, 0))")
def top_share(spark, d):
    w = A.waves(spark, d).select("label", "sample_id", F.array_max("wave").alias("v"))
    return V.top_share(w, ["label"], "v", "sample_id", 0.1).where("top").select("label", "sample_id")


@query(
    "agreement",
    f"""WITH {WAVES}, mw AS (SELECT label, side, idx, avg(v) AS m, count(*) AS n FROM pt WHERE NOT (side = 'L' AND label = 'm3') GROUP BY ALL),
ce AS (SELECT label, side, idx, m - avg(m) OVER (PARTITION BY label, side) AS m FROM mw),
no AS (SELECT label, sqrt(sum(m * m) FILTER (WHERE side = 'L') * sum(m * m) FILTER (WHERE side = 'R')) AS q FROM ce GROUP BY label),
xl AS (SELECT a.label, a.idx - b.idx AS lag, sum(a.m * b.m) / any_value(q) AS c FROM ce a JOIN ce b ON b.label = a.label AND b.side = 'R' JOIN no ON no.label = a.label WHERE a.side = 'L' GROUP BY a.label, a.idx - b.idx),
g AS (SELECT label, arg_max((c, lag), (c, -lag)) AS b FROM xl GROUP BY label),
n AS (SELECT label, count(*) FILTER (WHERE side = 'L' AND label <> 'm3') AS n_a, count(*) FILTER (WHERE side = 'R') AS n_b FROM w GROUP BY label)
SELECT n.label, n_a, n_b, {r6s('b[1]')} AS corr, b[2] AS lag FROM n LEFT JOIN g USING (label)""",
)
def agreement(spark, d):
    w = A.waves(spark, d)
    out = V.agreement(w.where("side = 'L' and label <> 'm3'"), w.where("side = 'R'"), ["label"])
    return out.select("label", "n_a", "n_b", r6("corr").alias("corr"), n64("lag").alias("lag"))


@query(
    "source_homogeneity",
    f"""WITH {WAVES}, mw AS (SELECT label, side, idx, avg(v) AS m FROM pt GROUP BY ALL),
me AS (SELECT label, side, idx, m - avg(m) OVER (PARTITION BY label, side) AS m FROM mw),
ce AS (SELECT sample_id, label, side, idx, v - avg(v) OVER (PARTITION BY sample_id) AS v FROM pt),
no AS (SELECT sample_id, sqrt(sum(v * v) * sum(m * m)) AS q FROM ce JOIN me USING (label, side, idx) GROUP BY sample_id),
xl AS (SELECT sample_id, label, side, a.idx - b.idx AS lag, sum(a.v * b.m) AS c FROM ce a JOIN me b USING (label, side) GROUP BY ALL),
g AS (SELECT sample_id, label, side, arg_max((c, lag), (c, -lag)) AS x FROM xl GROUP BY ALL),
h AS (SELECT label, side, CASE WHEN q > 0 THEN x[1] / q END AS corr, CASE WHEN q > 0 THEN x[2] ELSE 0 END AS lag FROM g JOIN no USING (sample_id))
SELECT label, side, count(*) AS n, {r6s('quantile_cont(corr, 0.5)')} AS corr_med, {r6s('quantile_cont(lag, 0.5)')} AS lag_med, {r6s('avg(corr)')} AS corr_mean, {r6s('avg(lag)')} AS lag_mean FROM h GROUP BY label, side HAVING count(*) >= 2""",
)
def source_homogeneity(spark, d):
    h = V.source_homogeneity(A.waves(spark, d), ["label", "side"])
    return h.select("label", "side", "n", *[r6(c).alias(c) for c in h.columns[3:]])


GROUP_SQL = f"""{WAVES}, gs AS (SELECT idx, cluster, count(*) AS n, avg(v) AS m, var_pop(v) AS s2 FROM pt GROUP BY idx, cluster)"""
T_SQL = f"""{GROUP_SQL}, ct AS (SELECT a.idx, (a.m - b.m) / sqrt((a.n * a.s2 + b.n * b.s2) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t, a.n + b.n - 2 AS df FROM gs a JOIN gs b USING (idx) WHERE a.cluster = 0 AND b.cluster = 1)"""


@query("curve_t", f"WITH {T_SQL} SELECT CAST(idx AS BIGINT) AS idx, {r6s('t')} AS t, df FROM ct")
def curve_t(spark, d):
    return V.curve_t(A.waves(spark, d), "cluster", 0, 1).select(n64("idx").alias("idx"), r6("t").alias("t"), "df")


@query(
    "curve_t_paired",
    f"""WITH {WAVES}, dd AS (SELECT a.idx, a.v - b.v AS d FROM pt a JOIN pt b ON b.sample_id = a.sample_id + 1 AND b.idx = a.idx WHERE a.sample_id % 2 = 0)
SELECT CAST(idx AS BIGINT) AS idx, {r6s('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} AS t, count(*) - 1 AS df FROM dd GROUP BY idx""",
)
def curve_t_paired(spark, d):
    w = A.waves(spark, d).withColumn("pair", F.floor(F.col("sample_id") / 2))
    t = V.curve_t_paired(w.where("side = 'L'"), w.where("side = 'R'"), "pair")
    return t.select(n64("idx").alias("idx"), r6("t").alias("t"), "df")


@query(
    "curve_f",
    f"""WITH {GROUP_SQL}, g AS (SELECT idx, count(*) AS k, sum(n) AS n, sum(n * m) AS sm, sum(n * m * m) AS smm, sum(n * s2) AS wi FROM gs GROUP BY idx)
SELECT CAST(idx AS BIGINT) AS idx, {r6s('((smm - sm * sm / n) / (k - 1)) / (wi / (n - k))')} AS f, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM g""",
)
def curve_f(spark, d):
    return V.curve_f(A.waves(spark, d), "cluster").select(n64("idx").alias("idx"), r6("f").alias("f"), "df1", "df2")


@query(
    "curve_intervals",
    f"""WITH {T_SQL}, u AS (SELECT idx, t, idx - row_number() OVER (ORDER BY idx) AS isl FROM ct WHERE abs(t) > 1.0)
SELECT CAST(min(idx) AS BIGINT) AS node_from, CAST(max(idx) AS BIGINT) AS node_to, {r6s('max(abs(t))')} AS peak, {r6s('min(idx) * 100.0 / 63')} AS pct_from, {r6s('max(idx) * 100.0 / 63')} AS pct_to FROM u GROUP BY isl""",
)
def curve_intervals(spark, d):
    t = V.curve_t(A.waves(spark, d), "cluster", 0, 1)
    out = V.runs_above(t, "t", F.lit(1.0), n_points=N)
    return out.select(n64("node_from").alias("node_from"), n64("node_to").alias("node_to"), *[r6(c).alias(c) for c in ("peak", "pct_from", "pct_to")])


PERMS = 200
BUMP_SQL = f"""{WAVES}, bu AS (SELECT sample_id, cluster, idx, v + CASE WHEN cluster = 1 AND idx BETWEEN 20 AND 27 THEN 0.2 ELSE 0 END AS v FROM pt WHERE cluster IN (0, 1)),
gs AS (SELECT idx, cluster, count(*) AS n, avg(v) AS m, var_pop(v) AS s2 FROM bu GROUP BY idx, cluster),
ct AS (SELECT a.idx, (a.m - b.m) / sqrt((a.n * a.s2 + b.n * b.s2) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t FROM gs a JOIN gs b USING (idx) WHERE a.cluster = 0 AND b.cluster = 1),
ow AS (SELECT DISTINCT sample_id, cluster FROM bu), sh AS (SELECT printf('%08x', CAST(floor(avg(CAST(cluster = 0 AS INTEGER)) * 4294967296) AS BIGINT)) AS bound FROM ow),
dr AS (SELECT sample_id, p, substr(md5(concat_ws(':', sample_id, p // 4, 0)), CAST(1 + 8 * (p % 4) AS INTEGER), 8) < bound AS one FROM ow, sh, range({PERMS}) r(p)),
ps AS (SELECT p, idx, count(*) AS n, count(*) FILTER (WHERE one) AS n0, sum(v) FILTER (WHERE one) AS s0, sum(v) FILTER (WHERE NOT one) AS s1, sum(v * v) AS q FROM bu JOIN dr USING (sample_id) GROUP BY p, idx),
pt2 AS (SELECT p, max(abs(s0 / n0 - s1 / (n - n0)) / sqrt((q - s0 * s0 / n0 - s1 * s1 / (n - n0)) / (n - 2) * (1.0 / n0 + 1.0 / (n - n0)))) AS max_t FROM ps GROUP BY p),
up AS (SELECT idx, t, idx - row_number() OVER (ORDER BY idx) AS isl FROM ct WHERE abs(t) > (SELECT quantile_cont(max_t, 0.95) FROM pt2)),
iv AS (SELECT min(idx) AS a, max(idx) AS b, max(abs(t)) AS peak FROM up GROUP BY isl)"""


@query(
    "curve_significance",
    f"""WITH {BUMP_SQL} SELECT CAST(a AS BIGINT) AS node_from, CAST(b AS BIGINT) AS node_to, {r6s('peak')} AS peak, {r6s('a * 100.0 / 63')} AS pct_from, {r6s('b * 100.0 / 63')} AS pct_to,
{r6s('(SELECT count(*) FROM pt2 WHERE max_t >= peak) / CAST(' + str(PERMS) + ' AS DOUBLE)')} AS p FROM iv""",
)
def curve_significance(spark, d):
    """Cluster 1 is raised by 0.2 on eight points, which must be found."""
    raised = F.transform("wave", lambda v, i: v + F.when((F.col("cluster") == 1) & i.between(20, 27), 0.2).otherwise(0.0))
    out = V.curve_significance(A.waves(spark, d).withColumn("wave", raised), "cluster", 0, 1, "sample_id", alpha=0.05, n_perm=PERMS, n_points=N)
    return out.select(n64("node_from").alias("node_from"), n64("node_to").alias("node_to"), *[r6(c).alias(c) for c in ("peak", "pct_from", "pct_to", "p")])


@query("pca_wave", f"{COMPONENT_SQL} SELECT k.subject AS subject, k.label AS label, unnest(range(0, {N})) AS idx, {r6s('unnest(wave)')} AS v FROM tr")
def pca_wave(spark, d):
    return _points(V.aggregate_waves(A.waves(spark, d), ["subject", "label"], "pca"), "subject", "label")


def _traces(spark, d):
    """One trace per subject and label."""
    return cut_lineage(V.pca_wave(A.waves(spark, d), ["subject", "label"]).withColumnRenamed("n", "n_cycles"))


@query(
    "global_wave",
    f"""{COMPONENT_SQL}, gk AS (SELECT k.label AS k, list(wave ORDER BY k.subject) AS xs FROM tr GROUP BY k.label), {first_sql('gl', 'gk')},
gc AS (SELECT k.label AS k, min(n) AS cycles_min, quantile_cont(n, 0.5) AS cycles_median, max(n) AS cycles_max FROM tr GROUP BY k.label)
SELECT k AS label, n AS n_ids_used, (SELECT count(DISTINCT subject) FROM w) AS n_ids_total, (SELECT count(DISTINCT subject) FROM w WHERE label = k) AS n_ids_raw,
  cycles_min, cycles_median, cycles_max, {r6s('wave[1]')} AS first_v FROM gl JOIN gc USING (k)""".replace("FROM tr GROUP BY k.label)", "FROM tr WHERE n >= 3 GROUP BY k.label)"),
)
def global_wave(spark, d):
    # traces of at least three cycles, counted against all subjects
    traces = _traces(spark, d).where("n_cycles >= 3")
    g = V.global_waves(traces, "label", cycles="n_cycles", raw=A.waves(spark, d).select("subject", "label"), ident="subject")
    return g.select("label", "n_ids_used", "n_ids_total", "n_ids_raw", "cycles_min", "cycles_median", "cycles_max", r6(F.get("wave", F.lit(0))).alias("first_v"))


@query(
    "early_late",
    f"""WITH RECURSIVE {WAVES}, nw AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS r, count(*) OVER (PARTITION BY label) AS c FROM w),
hs AS (SELECT {{'label': label, 'late': r > c // 2}} AS k, list(wave ORDER BY sample_id) AS xs FROM nw WHERE c >= 4 GROUP BY label, r > c // 2), {first_sql('hf', 'hs')},
hp AS (SELECT k.label AS label, k.late AS late, unnest(range(0, {N})) AS idx, unnest(wave) AS v FROM hf),
hx AS (SELECT a.label, l.lag, covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v) + 1e-8) AS c FROM hp a JOIN (SELECT unnest(range(-5, 6)) AS lag) l ON true
 JOIN hp b ON b.label = a.label AND b.late AND b.idx = a.idx + l.lag WHERE NOT a.late GROUP BY a.label, l.lag),
hb AS (SELECT label, arg_max((c, lag), (c, -lag)) AS b FROM hx GROUP BY label)
SELECT label, {r6s('b[1]')} AS early_late_corr, CAST(b[2] AS DOUBLE) AS early_late_lag FROM hb""",
)
def early_late(spark, d):
    cell = F.floor(F.col("sample_id") / 100_000).cast("bigint")
    out = V.early_late(A.waves(spark, d), ["label"], "sample_id", max_lag=5, cell=cell)
    return out.withColumn("early_late_corr", r6("early_late_corr"))


@query("loo", f"{LOO_SQL} SELECT label, subject, {r6s('corr')} AS corr, {r6s('mad')} AS mad FROM lc")
def loo(spark, d):
    out = V.leave_one_out(_traces(spark, d), ["label"], "subject")
    return out.select("label", "subject", r6("corr").alias("corr"), r6("mad").alias("mad"))


@query(
    "loo_outliers",
    f"""{LOO_SQL}, lq AS (SELECT label, quantile_cont(corr, 0.025) AS c, quantile_cont(mad, 0.975) AS m, quantile_cont(mad, 0.5) AS md FROM lc GROUP BY label),
ld AS (SELECT lc.*, c, m, (1 - corr) + mad / (md + 1e-8) AS dissim FROM lc JOIN lq USING (label)),
lr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dissim DESC, subject) AS r, count(*) OVER (PARTITION BY label) AS n FROM ld)
SELECT label, subject, {r6s('corr')} AS corr, {r6s('mad')} AS mad, {r6s('dissim')} AS dissim FROM lr WHERE corr < c OR mad > m OR r <= greatest(1, round_even(0.1 * n, 0))""",
)
def loo_outliers(spark, d):
    loo = cut_lineage(V.leave_one_out(_traces(spark, d), ["label"], "subject"))
    out = V.loo_outliers(loo, ["label"], "subject", top_fraction=0.1)
    return out.select("label", "subject", *[r6(c).alias(c) for c in ("corr", "mad", "dissim")])


@query(
    "leave_one_subject_out",
    f"""{COMPONENT_SQL}, gk AS (SELECT k.label AS k, list(wave ORDER BY k.subject) AS xs FROM tr GROUP BY k.label), {first_sql('gl', 'gk')},
oth AS (SELECT k.label AS label, k.subject AS s, wave FROM tr UNION ALL SELECT k, -1, wave FROM gl),
lk AS (SELECT {{'subject': a.k.subject, 'label': a.k.label}} AS k, list(o.wave ORDER BY o.s) AS xs FROM tr a JOIN oth o ON o.label = a.k.label AND o.s <> a.k.subject GROUP BY 1), {first_sql('lo', 'lk')}
SELECT k.subject AS sid, k.label AS label, {r6s('wave[1]')} AS first_v, {r6s('wave[40]')} AS later_v FROM lo""",
)
def leave_one_subject_out(spark, d):
    """Global traces without one subject; the trace over all counts as one more."""
    from ..operators.repair import leave_one_subject_out as without

    traces = _traces(spark, d)
    base = cut_lineage(V.global_waves(traces, "label").select("label", "wave"))
    loo, _ = without(traces.withColumnRenamed("subject", "sid"), base)
    return loo.select("sid", "label", *[r6(F.get("wave", F.lit(i))).alias(n) for i, n in ((0, "first_v"), (39, "later_v"))])


@query("bootstrap")
def bootstrap(spark, d):
    cell = F.floor(F.col("sample_id") / 100_000).cast("bigint")
    b = V.bootstrap_waves(A.waves(spark, d), ["label"], "sample_id", n_boot=10_000, seed=1, cell=cell)
    p = b.select("label", F.posexplode(F.arrays_zip("mean", "sd", "p2_5", "p50", "p97_5")).alias("idx", "z"))
    return p.select("label", n64("idx").alias("idx"), *[r6(f"z.{c}").alias(c) for c in ("mean", "sd", "p2_5", "p50", "p97_5")])
