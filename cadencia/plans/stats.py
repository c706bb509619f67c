"""Grouped statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import arrays as X
from ..operators import stats as S
from .registry import WAVES, n64, query, r6, r6s

STATS_SQL = lambda v: f"count({v}) AS n, {r6s(f'avg({v})')} AS mean, {r6s(f'stddev_samp({v})')} AS sd, {r6s(f'quantile_cont({v}, 0.5)')} AS median, min({v}) AS min, max({v}) AS max"


@query(
    "descriptives",
    f"""WITH o AS (SELECT * FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1),
j AS (SELECT c.c_mktsegment, n.n_name, o.o_totalprice, c.c_acctbal FROM o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)
SELECT c_mktsegment, 'o_totalprice' AS metric, {STATS_SQL('o_totalprice')} FROM j GROUP BY c_mktsegment
UNION ALL SELECT c_mktsegment, 'c_acctbal', {STATS_SQL('c_acctbal')} FROM j GROUP BY c_mktsegment""",
)
def descriptives(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal", "c_nationkey")
    j = o.join(c, "o_custkey")
    out = S.descriptives(
        j, ["c_mktsegment"], ["o_totalprice", "c_acctbal"], grain=["o_custkey"], order=["o_orderdate", "o_orderkey"]
    )
    return out.select("c_mktsegment", "metric", "n", *[r6(x).alias(x) for x in ("mean", "sd", "median")], "min", "max")


@query("participant_join", "SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def participant_join(spark, d):
    t = lambda n: A.table(spark, d, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


R101 = """rs AS (SELECT sample_id, cluster, i, CASE WHEN lo + 2 > len(wave) THEN wave[len(wave)] ELSE wave[lo + 1] * (1 - (p - lo)) + wave[lo + 2] * (p - lo) END AS v FROM (
  SELECT sample_id, cluster, wave, i, i * (len(wave) - 1) / 100.0 AS p, CAST(floor(i * (len(wave) - 1) / 100.0) AS BIGINT) AS lo FROM w, (SELECT unnest(range(0, 101)) AS i)))"""


@query("resample_linear", f"WITH {WAVES}, {R101} SELECT sample_id, i AS idx, {r6s('v')} AS v FROM rs")
def resample_linear(spark, d):
    w = A.waves(spark, d).select("sample_id", X.resample_linear("wave").alias("wave"))
    return w.select("sample_id", F.posexplode("wave").alias("idx", "v")).select("sample_id", n64("idx").alias("idx"), r6("v").alias("v"))


def _stance(c="sample_id"):
    return 20.0 + (F.col(c) % 80).cast("double") + 0.5


@query(
    "stance_metrics",
    f"""WITH {WAVES}, {R101}, x AS (SELECT rs.*, round_even(20.5 + sample_id % 80, 0) AS n FROM rs), y AS (SELECT *, lead(v) OVER (PARTITION BY sample_id ORDER BY i) AS nv FROM x WHERE i < n)
SELECT sample_id, {r6s('avg(v)')} AS mean, {r6s('quantile_cont(v, 0.5)')} AS median, {r6s('stddev_pop(v)')} AS std, {r6s('min(v)')} AS min, {r6s('max(v)')} AS max, {r6s('sum((v + nv) / 2)')} AS auc FROM y GROUP BY sample_id""",
)
def stance_metrics(spark, d):
    w = A.waves(spark, d).select("sample_id", X.resample_linear("wave").alias("wave"))
    out = S.stance_metrics(w, ["sample_id"], "wave", _stance())
    return out.select("sample_id", *[r6(m).alias(m) for m in S.METRICS])


@query(
    "raw_stance_metrics",
    f"""WITH {WAVES}, x AS (SELECT sample_id, idx, v, idx + idx % 3 / 4.0 AS t FROM pt WHERE idx < sample_id % 60),
y AS (SELECT *, lead(v) OVER o AS nv, lead(t) OVER o AS nt FROM x WINDOW o AS (PARTITION BY sample_id ORDER BY idx))
SELECT sample_id, {r6s('avg(v)')} AS mean, {r6s('quantile_cont(v, 0.5)')} AS median, {r6s('stddev_pop(v)')} AS std, {r6s('min(v)')} AS min, {r6s('max(v)')} AS max,
  {r6s('coalesce(sum((v + nv) / 2 * (nt - t)), 0)')} AS auc FROM y GROUP BY sample_id""",
)
def raw_stance_metrics(spark, d):
    """Stances of different lengths, sampled at uneven times."""
    n = (F.col("sample_id") % 60).cast("int")
    w = A.waves(spark, d).select("sample_id", F.slice("wave", F.lit(1), n).alias("wave")).where(F.size("wave") > 0)
    times = F.transform("wave", lambda x, i: i + (i % 3) / 4.0)
    out = S.raw_stance_metrics(w.withColumn("times", times), ["sample_id"], "wave", "times")
    return out.select("sample_id", *[r6(m).alias(m) for m in S.METRICS])


@query("cluster_counts", "SELECT CAST(vec_id % 20 AS BIGINT) AS subject, label AS cluster, count(*) AS n FROM embeddings GROUP BY ALL")
def cluster_counts(spark, d):
    return S.cluster_counts(A.waves(spark, d), "subject", "cluster")


@query(
    "subphase_metrics",
    f"""WITH {WAVES}, {R101}, ph(phase, a, b) AS (VALUES ('Loading_Response', 0, 10), ('Midstance', 10, 30), ('First_Stance_Phase_Half', 0, 30), ('Terminal_Stance', 30, 50), ('Pre_Swing', 50, 60),
('Second_Stance_Phase_Half', 30, 60), ('Initial_Swing', 60, 73), ('Mid_Swing', 73, 87), ('Terminal_Swing', 87, 100), ('Swing_Phase', 60, 100)),
y AS (SELECT sample_id, phase, v, lead(v) OVER (PARTITION BY sample_id, phase ORDER BY i) AS nv FROM rs JOIN ph ON i BETWEEN a AND b)
SELECT sample_id, phase, {r6s('avg(v)')} AS mean, {r6s('quantile_cont(v, 0.5)')} AS median, {r6s('stddev_pop(v)')} AS std, {r6s('min(v)')} AS min, {r6s('max(v)')} AS max, {r6s('sum((v + nv) / 2)')} AS auc FROM y GROUP BY sample_id, phase""",
)
def subphase_metrics(spark, d):
    w = A.waves(spark, d).select("sample_id", X.resample_linear("wave").alias("wave"))
    out = S.subphase_metrics(w, ["sample_id"], "wave")
    return out.select("sample_id", "phase", *[r6(m).alias(m) for m in S.METRICS])


COMPARE_SQL = f"""{WAVES}, lo AS (SELECT cluster % 2 AS g, m.metric, round(CASE m.metric WHEN 'first' THEN wave[1] ELSE list_max(wave) END, 2) AS v FROM w, (VALUES ('first'), ('peak')) m(metric)),
rk AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY metric, v) AS t, count(*) OVER (PARTITION BY metric) AS n FROM lo),
ag AS (SELECT metric, any_value(n)::DOUBLE AS n, count(*) FILTER (WHERE g = 0) AS n_0, count(*) FILTER (WHERE g = 1) AS n_1, avg(v) FILTER (WHERE g = 0) AS m0, avg(v) FILTER (WHERE g = 1) AS m1,
 stddev_pop(v) FILTER (WHERE g = 0) AS s0, stddev_pop(v) FILTER (WHERE g = 1) AS s1, quantile_cont(v, 0.5) FILTER (WHERE g = 0) AS q0, quantile_cont(v, 0.5) FILTER (WHERE g = 1) AS q1,
 sum(r) FILTER (WHERE g = 0) AS r0, sum(r) FILTER (WHERE g = 1) AS r1, sum(t::DOUBLE * t - 1) AS tie FROM rk GROUP BY metric),
hh AS (SELECT *, greatest((12 / (n * (n + 1)) * (r0 * r0 / n_0 + r1 * r1 / n_1) - 3 * (n + 1)) / (1 - tie / (n * n * n - n)), 0) AS h FROM ag),
pp AS (SELECT *, 1 - CASE WHEN h = 0 THEN 0.0 ELSE 2 / sqrt(pi()) * exp(-h / 2) * list_sum(list_transform(range(0, 150),
 lambda k: exp(k * ln(2.0) + (2 * k + 1) * ln(sqrt(h / 2)) - ((k + 1) * ln(2.0) + lgamma(k + 1.5) - 0.5 * ln(pi()))))) END AS p FROM hh)"""


@query(
    "compare_groups",
    f"""WITH {COMPARE_SQL} SELECT metric, n_0, n_1, {r6s('m0')} AS mean_0, {r6s('m1')} AS mean_1, {r6s('q0')} AS median_0, {r6s('q1')} AS median_1, {r6s('m0 - m1')} AS mean_diff,
{r6s('sqrt(s0 * s0 / n_0 + s1 * s1 / n_1)')} AS se_diff, {r6s('h')} AS h, {r6s('p')} AS p, {r6s('least(p * 18, 1.0)')} AS p_corrected, CASE WHEN p * 18 < 0.05 THEN 'SIGNIFICANT' ELSE 'NOT SIGNIFICANT' END AS verdict FROM pp""",
)
def compare_groups(spark, d):
    w = A.waves(spark, d)
    both = F.array(
        F.struct(F.lit("first").alias("metric"), F.get("wave", F.lit(0)).alias("v")),
        F.struct(F.lit("peak").alias("metric"), F.array_max("wave").alias("v")),
    )
    long = w.select((F.col("cluster") % 2).alias("g"), F.inline(both)).withColumn("v", F.round("v", 2))
    out = S.compare_two_groups(long, ["metric"], "g", "v")
    num = ("mean_0", "mean_1", "median_0", "median_1", "mean_diff", "se_diff", "h", "p", "p_corrected")
    return out.select("metric", "n_0", "n_1", *[r6(c).alias(c) for c in num], "verdict")


@query(
    "percent_nodes",
    """WITH x AS (SELECT DISTINCT l_quantity AS a, l_quantity + l_linenumber - 4 AS b FROM lineitem), y AS (SELECT a, b, greatest(0, least(CAST(ceil(round(a, 9)) AS BIGINT), 100)) AS f, greatest(0, least(CAST(floor(round(b, 9)) AS BIGINT), 100)) AS s FROM x),
z AS (SELECT a, b, least(f, s) AS lo, greatest(f, s) AS hi FROM y), c AS (SELECT *, greatest(0, CAST(round_even((lo + hi) / 2.0, 0) AS BIGINT) - 1) AS st FROM z)
SELECT a, b, CASE WHEN hi - lo + 1 >= 3 THEN lo WHEN st + 2 > 100 THEN 98 ELSE st END AS node_from, CASE WHEN hi - lo + 1 >= 3 THEN hi WHEN st + 2 > 100 THEN 100 ELSE st + 2 END AS node_to FROM c""",
)
def percent_nodes(spark, d):
    x = A.table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_linenumber") - 4).alias("b")
    ).distinct()
    lo, hi = S.percent_to_nodes(F.col("a"), F.col("b"))
    return x.select("a", "b", n64(lo).alias("node_from"), n64(hi).alias("node_to"))


@query("bonferroni_family", "WITH k AS (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY user_id) SELECT user_id, k, CASE WHEN k < 2 THEN 0 WHEN k = 2 THEN 1 ELSE 1 + k * (k - 1) // 2 END AS n_tests FROM k")
def bonferroni_family(spark, d):
    k = A.table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("k"))
    return k.withColumn("n_tests", n64(S.tests_for_clusters(F.col("k"))))


@query(
    "crosstab",
    """WITH e AS (SELECT CAST(vec_id % 20 AS BIGINT) AS subject, CASE WHEN vec_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, label FROM embeddings),
g AS (SELECT DISTINCT subject, s.side FROM e, (VALUES ('L'), ('R')) s(side))
SELECT g.subject, g.side, """ + ", ".join(f"count(*) FILTER (WHERE label = {c}) AS cluster_{c}" for c in range(10)) + " FROM g LEFT JOIN e ON e.subject = g.subject AND e.side = g.side GROUP BY g.subject, g.side",
)
def crosstab(spark, d):
    return S.cluster_crosstab(A.waves(spark, d), "cluster", "subject", "side", range(10))
