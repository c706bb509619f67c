"""Label-repair queries. Embedding labels m0..m9 stand for channels: odd ones
are left, two neighbours are one muscle, four neighbours lie close."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import repair as R
from ..operators import waves as V
from ..operators.signal import robust_amplitude_norm
from ..session import cut_lineage
from .registry import WAVES, query, r6, r6s

LAG = 3


def facts(spark, d):
    k = F.expr("cast(substr(label, 2) as int)")
    return A.waves(spark, d).select("label").distinct().select(
        "label",
        F.when(k % 2 == 0, "R").otherwise("L").alias("side"),
        F.concat(F.lit("k"), F.floor(k / 2).cast("string")).alias("muscle_key"),
        F.concat(F.lit("k"), F.floor(k / 2).cast("string")).alias("canon"),
        F.floor(k / 4).cast("int").alias("close_group"),
    )


def _mean_traces(spark, d):
    w = A.waves(spark, d)
    t = V.mean_wave(w, ["subject", "label"]).withColumnRenamed("subject", "sid")
    return t, V.mean_wave(w, ["label"])


FACT_SQL = """fa AS (SELECT DISTINCT 'm' || CAST(label AS VARCHAR) AS label, label AS k, CASE WHEN label % 2 = 0 THEN 'R' ELSE 'L' END AS side, label // 2 AS mk, label // 4 AS cg FROM embeddings),
ca AS (SELECT a.label, b.label AS candidate, 'lr' AS stage FROM fa a JOIN fa b ON a.mk = b.mk AND a.side <> b.side UNION ALL
SELECT a.label, b.label, 'close' FROM fa a JOIN fa b ON a.side = b.side AND a.cg = b.cg AND a.k <> b.k UNION ALL
SELECT a.label, b.label, 'general' FROM fa a JOIN fa b ON a.side = b.side AND a.mk <> b.mk)"""

SCORE_SQL = f"""{WAVES}, tr AS (SELECT subject AS sid, label, idx, avg(v) AS v FROM pt GROUP BY ALL), gl AS (SELECT label, idx, avg(v) AS m FROM pt GROUP BY ALL), {FACT_SQL},
ba0 AS (SELECT t.sid, t.label, l.lag, covar_pop(v, m) / (stddev_pop(v) * stddev_pop(m) + 1e-8) AS c, avg(abs(v - m)) AS mad FROM tr t JOIN (SELECT unnest(range(-{LAG}, {LAG + 1})) AS lag) l ON true
  JOIN gl g ON g.label = t.label AND g.idx = (t.idx + l.lag + 64) % 64 GROUP BY ALL),
ba AS (SELECT sid, label, arg_max((c, lag, mad), (c, -lag)) AS b FROM ba0 GROUP BY ALL),
pc0 AS (SELECT t.sid, t.label, ca.candidate, ca.stage, l.lag, covar_pop(v, m) / (stddev_pop(v) * stddev_pop(m) + 1e-8) AS c, avg(abs(v - m)) AS mad FROM tr t JOIN ca USING (label)
  JOIN (SELECT unnest(range(-{LAG}, {LAG + 1})) AS lag) l ON true JOIN gl g ON g.label = ca.candidate AND g.idx = (t.idx + l.lag + 64) % 64 WHERE stage <> 'lr' GROUP BY ALL),
pc AS (SELECT sid, label, candidate, stage, arg_max((c, lag, mad), (c, -lag)) AS b FROM pc0 GROUP BY ALL),
lr0 AS (SELECT t.sid, t.label, ca.candidate, l.lag, covar_pop(v, m) / (stddev_pop(v) * stddev_pop(m) + 1e-8) AS c FROM tr t JOIN ca USING (label)
  JOIN (SELECT unnest(list_concat(range(-36, -27), range(28, 37))) AS lag) l ON true JOIN gl g ON g.label = ca.candidate AND g.idx = (t.idx + l.lag + 64) % 64 WHERE stage = 'lr' GROUP BY ALL),
lr1 AS (SELECT sid, label, candidate, arg_max(lag, (round(c, 9), -lag)) AS s FROM lr0 GROUP BY ALL),
lr2 AS (SELECT t.sid, t.label, r.candidate, r.s, l.lag, covar_pop(v, m) / (stddev_pop(v) * stddev_pop(m) + 1e-8) AS c, avg(abs(v - m)) AS mad FROM tr t JOIN lr1 r USING (sid, label)
  JOIN (SELECT unnest(range(-{LAG}, {LAG + 1})) AS lag) l ON true JOIN gl g ON g.label = r.candidate AND g.idx = (t.idx + r.s + l.lag + 128) % 64 GROUP BY ALL),
lr AS (SELECT sid, label, candidate, 'lr' AS stage, arg_max((c, s, mad), (c, -lag)) AS b FROM lr2 GROUP BY ALL),
sc AS (SELECT x.*, ba.b AS bb, x.b[1] - ba.b[1] AS corr_up, (ba.b[3] - x.b[3]) / greatest(ba.b[3], 1e-8) AS mad_down FROM (SELECT * FROM pc UNION ALL SELECT * FROM lr) x JOIN ba USING (sid, label))"""


def _scored(spark, d):
    t, g = _mean_traces(spark, d)
    fl = R.compare_to_global(t, g, max_lag=LAG)
    sc = R.score_candidates(fl, g, R.candidates(facts(spark, d)), max_lag=LAG, lr_lags=(28, 36))
    return fl, sc


@query("candidates", f"WITH {FACT_SQL} SELECT * FROM ca")
def candidates(spark, d):
    return R.candidates(facts(spark, d))


@query(
    "score_candidates",
    f"WITH {SCORE_SQL} SELECT sid, label, candidate, stage, {r6s('corr_up')} AS corr_up, {r6s('mad_down')} AS mad_down, {r6s('corr_up + mad_down')} AS score FROM sc",
)
def score_candidates(spark, d):
    sc = _scored(spark, d)[1]
    return sc.select("sid", "label", "candidate", "stage", r6("corr_up").alias("corr_up"), r6("mad_down").alias("mad_down"), r6("score").alias("score"))


DEC_SQL = f"""{SCORE_SQL},
bs AS (SELECT *, CASE stage WHEN 'lr' THEN 0 WHEN 'close' THEN 1 ELSE 2 END AS rk, row_number() OVER (PARTITION BY sid, label, stage ORDER BY corr_up + mad_down DESC, candidate) AS rn FROM sc),
bt AS (SELECT * FROM bs WHERE rn = 1),
sg AS (SELECT sid, label, arg_min((stage, candidate), rk) FILTER (WHERE corr_up >= 0.05 AND mad_down >= 0.02) AS s, arg_min((stage, candidate), (b[3], rk)) AS m FROM bt GROUP BY sid, label),
fu AS (SELECT s[2] AS t, min((sid, label)) AS f FROM sg WHERE s IS NOT NULL GROUP BY s[2]),
dc AS (SELECT sg.sid, sg.label, CASE WHEN s IS NULL THEN 'unsure_ci' WHEN f = (sg.sid, sg.label) THEN 'suggest_' || s[1] ELSE 'unsure_target_used' END AS decision,
 CASE WHEN s IS NULL THEN m[2] WHEN f = (sg.sid, sg.label) THEN s[2] END AS target FROM sg LEFT JOIN fu ON fu.t = s[2])"""


def _decisions(spark, d):
    fl, sc = _scored(spark, d)
    fl, sc = cut_lineage(fl), cut_lineage(sc)
    return R.suggest_remap(sc, fl, corr_gain=0.05, mad_gain=0.02)


@query("remap", f"WITH {DEC_SQL} SELECT sid, label, decision, target FROM dc")
def remap(spark, d):
    return _decisions(spark, d).select("sid", "label", "decision", "target")


@query("review_queue", f"WITH {DEC_SQL}, nm AS (SELECT dc.*, bt.corr_up, bt.mad_down FROM dc LEFT JOIN (SELECT sid, label, arg_min((corr_up, mad_down), (b[3], rk)) AS z, min(b[3]) AS mm FROM bt GROUP BY ALL) q USING (sid, label) LEFT JOIN bt ON bt.sid = dc.sid AND bt.label = dc.label AND bt.corr_up = q.z[1] AND bt.mad_down = q.z[2] AND dc.target = bt.candidate AND bt.b[3] = q.mm QUALIFY row_number() OVER (PARTITION BY dc.sid, dc.label ORDER BY bt.rk) = 1) SELECT sid, label, target AS candidate, decision AS reason FROM nm WHERE starts_with(decision, 'suggest_') OR (decision = 'unsure_ci' AND corr_up >= 0.04 AND mad_down >= 0.016)")
def review_queue(spark, d):
    return R.review_queue(_decisions(spark, d), corr_gain=0.05, mad_gain=0.02)


@query(
    "review_sample",
    f"WITH {DEC_SQL}, td AS (SELECT sid, label, target, md5(CAST(sid AS VARCHAR) || ':' || label || ':7') AS h FROM dc WHERE sid <> 0), cp AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY h, label) AS r FROM td) SELECT sid, label, target FROM cp WHERE r <= 3 ORDER BY h, sid, label LIMIT 25",
)
def review_sample(spark, d):
    dec = _decisions(spark, d)
    done = dec.where("sid = 0").select("sid", "label")
    return R.review_sample(dec.select("sid", "label", "target"), done, n=25, per_subject=3, seed=7)


FB_SQL = """fb AS (SELECT DISTINCT CAST(vec_id % 20 AS BIGINT) AS sid, 'm' || CAST(label AS VARCHAR) AS src, label FROM embeddings)"""


@query(
    "apply_feedback",
    f"""WITH {FB_SQL}, mp AS (SELECT sid, src, CASE WHEN label % 2 = 0 THEN 'm' || CAST((label + 1) % 10 AS VARCHAR) ELSE src END AS dst FROM fb),
f AS (SELECT sid, CASE WHEN sid % 4 = 0 THEN 'y' || src ELSE src END AS src, CASE WHEN sid % 4 = 0 THEN 'unsure' WHEN (sid + label) % 3 = 0 THEN 'swap' WHEN (sid + label) % 3 = 1 THEN 'ok' ELSE 'unsure' END AS r, 'x' || src AS c FROM fb)
SELECT sid, src, CASE r WHEN 'swap' THEN c WHEN 'ok' THEN NULL ELSE dst END AS dst FROM (SELECT coalesce(mp.sid, f.sid) AS sid, coalesce(mp.src, f.src) AS src, dst, coalesce(r, 'unsure') AS r, c FROM mp FULL OUTER JOIN f ON f.sid = mp.sid AND f.src = mp.src)
WHERE CASE r WHEN 'swap' THEN c WHEN 'ok' THEN NULL ELSE dst END IS NOT NULL""",
)
def apply_feedback(spark, d):
    fb = A.waves(spark, d).select(F.col("subject").alias("sid"), F.col("label").alias("src"), "cluster").distinct()
    # labels of odd clusters stay as they are; a quarter of the answers is unsure of labels that nobody has
    moved = F.concat(F.lit("m"), ((F.col("cluster") + 1) % 10).cast("string"))
    mp = fb.select("sid", "src", F.when(F.col("cluster") % 2 == 0, moved).otherwise(F.col("src")).alias("dst"))
    k, none = (F.col("sid") + F.col("cluster")) % 3, F.col("sid") % 4 == 0
    resp = F.when(none, "unsure").when(k == 0, "Swap").when(k == 1, "ok").otherwise("unsure")
    f = fb.select("sid", F.when(none, F.concat(F.lit("y"), "src")).otherwise(F.col("src")).alias("label"), F.concat(F.lit("x"), "src").alias("candidate"), resp.alias("response"), F.lit(2).alias("seq"))
    old = f.withColumns({"response": F.lit("swap"), "candidate": F.lit("old"), "seq": F.lit(1)})
    return R.apply_feedback(mp, old.unionByName(f))


FLIP_SQL = """x AS (SELECT o_custkey AS sid, CASE o_orderkey % 3 WHEN 0 THEN 'suggest_lr' WHEN 1 THEN 'suggest_close' ELSE 'unsure_ci' END AS decision, CAST(o_orderkey % 41 - 20 AS DOUBLE) AS lag FROM orders)"""


def _flips(spark, d):
    k = F.col("o_orderkey")
    return A.table(spark, d, "orders").select(
        F.col("o_custkey").alias("sid"),
        F.when(k % 3 == 0, "suggest_lr").when(k % 3 == 1, "suggest_close").otherwise("unsure_ci").alias("decision"),
        (k % 41 - 20).cast("double").alias("lag"),
    )


@query("flip_lags", f"WITH {FLIP_SQL} SELECT {r6s('quantile_cont(abs(lag), 0.1)')} AS p10, {r6s('quantile_cont(abs(lag), 0.5)')} AS p50, {r6s('quantile_cont(abs(lag), 0.9)')} AS p90 FROM x WHERE decision = 'suggest_lr'")
def flip_lags(spark, d):
    lags, _ = R.flip_summary(_flips(spark, d))
    return lags.select(*[r6(c).alias(c) for c in ("p10", "p50", "p90")])


@query("flip_summary", f"WITH {FLIP_SQL}, g AS (SELECT sid, count(*) FILTER (WHERE decision = 'suggest_lr') AS n_lr, count(*) AS n FROM x GROUP BY sid) SELECT sid, n_lr, n, {r6s('n_lr / n')} AS ratio FROM g ORDER BY n_lr / n DESC, sid LIMIT 10")
def flip_summary(spark, d):
    _, per = R.flip_summary(_flips(spark, d))
    return per.select("sid", "n_lr", "n", r6("ratio").alias("ratio"))


@query("validate_channels")
def validate_channels(spark, d):
    w = A.waves(spark, d).withColumnRenamed("subject", "sid")
    cell = F.floor(F.col("sample_id") / 100_000).cast("bigint")
    normed = robust_amplitude_norm(w.select("sid", "label", "sample_id", "wave"), ["sid", "label"]).drop("amplitude")
    traces, stats = V.homogeneity(normed, ["sid", "label"], "sample_id", max_lag=LAG, cell=cell)
    stats = stats.select("sid", "label", "corr_med", "lag_abs_med_lim", "within_corr_low", "homogeneity_flag")
    g = cut_lineage(V.global_waves(traces, "label").select("label", "wave"))
    snr = V.snr_by_channel(w, ["side"], ["sid", "label"])
    full = traces.join(g.withColumnRenamed("wave", "_g"), "label").withColumn("_x", V.xcorr_best("wave", "_g"))
    full = full.select("sid", "label", F.col("_x.corr").alias("corr"), F.col("_x.lag").alias("lag"))
    base = R.compare_to_global(traces, g, max_lag=LAG).drop("wave")
    s = full.join(base, ["sid", "label"]).join(stats, ["sid", "label"], "left").join(snr, ["sid", "label"], "left")
    return R.validate_channels(cut_lineage(s), within_lag_max=LAG)


@query("tune")
def tune(spark, d):
    w = A.waves(spark, d)
    traces = cut_lineage(V.pca_wave(w, ["subject", "label"]).select(F.col("subject").alias("sid"), "label", "wave"))
    base = cut_lineage(V.global_waves(traces, "label").select("label", "wave"))
    expected = traces.select("sid").distinct().withColumn("mode", F.when(F.col("sid") % 5 == 0, "lr").otherwise("ok"))
    feedback = traces.select(
        "sid", "label", F.lit("m1").alias("candidate"), F.when(F.col("sid") % 2 == 0, "swap").otherwise("ok").alias("response")
    )
    return R.tune_thresholds(
        traces, base, facts(spark, d), expected, feedback, [0.0, 0.02, 0.05, 0.08, 0.1], [0.0, 0.1, 0.2, 0.3], max_lag=LAG, lr_lags=(28, 36)
    )
