"""Signal-conditioning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import arrays as X
from ..functions import kernels as N
from ..operators import signal as S
from ..operators.ordered import ordered_scan, time_cell
from ..session import cut_lineage
from .registry import EV, WAVES, n64, query, r6, r6s

FS = 1000.0


def _long(df, col="wave"):
    return df.select("sample_id", F.posexplode(col).alias("idx", "v")).select("sample_id", n64("idx").alias("idx"), r6("v").alias("v"))


def pass_sql(name: str, src: str, sections: tuple) -> str:
    """CTE ``name`` (sample_id, y): the lists of ``src`` (sample_id, x) through the
    sections, each started in the steady state of its first value."""
    n = range(len(sections))
    sections = [tuple(map(float, s)) for s in sections]
    gains = [(b0 + b1 + b2) / (1.0 + a1 + a2) for b0, b1, b2, a1, a2 in sections]
    first, cols, inner, nxt, gain = [], [], f"SELECT *, x[t + 1] AS v0 FROM {name}r WHERE t < len(x)", [], 1.0
    for i, (b0, b1, b2, a1, a2) in zip(n, sections):
        g = gains[i]
        s2 = f"({(b2 - a2 * g) * gain!r}) * x[1]"
        first += [f"({(b1 - a1 * g) * gain!r}) * x[1] + {s2} AS p{i}", f"{s2} AS q{i}"]
        cols += [f"p{i}", f"q{i}"]
        inner = f"SELECT *, ({b0!r}) * v{i} + p{i} AS v{i + 1} FROM ({inner})"
        nxt += [f"({b1!r}) * v{i} - ({a1!r}) * v{i + 1} + q{i}", f"({b2!r}) * v{i} - ({a2!r}) * v{i + 1}"]
        gain *= g
    return (
        f"{name}r AS (SELECT sample_id, x, 0 AS t, CAST([] AS DOUBLE[]) AS y, {', '.join(first)} FROM {src} UNION ALL "
        f"SELECT sample_id, x, t + 1, list_append(y, v{len(sections)}), {', '.join(nxt)} FROM ({inner})), "
        f"{name} AS (SELECT sample_id, y FROM {name}r WHERE t = len(x))"
    )


def zero_phase_sql(name: str, src: str, sections: tuple) -> str:
    """CTEs up to ``name`` (sample_id, x): both ways with odd extension at the ends."""
    taps = 2 * len(sections) + 1 - all(s[2] == 0.0 and s[4] == 0.0 for s in sections)
    pad = f"least({3 * taps}, len(x) - 1)"
    ext = (
        f"list_concat(list_transform(range({pad}, 0, -1), lambda i: 2 * x[1] - x[i + 1]), x, "
        f"list_transform(range(1, {pad} + 1), lambda i: 2 * x[len(x)] - x[len(x) - i]))"
    )
    return (
        f"{name}0 AS (SELECT sample_id, {pad} AS pad, len(x) AS n, {ext} AS x FROM {src}), {pass_sql(name + '1', name + '0', sections)}, "
        f"{name}2 AS (SELECT sample_id, list_reverse(y) AS x FROM {name}1), {pass_sql(name + '3', name + '2', sections)}, "
        f"{name} AS (SELECT sample_id, list_slice(list_reverse(y), pad + 1, pad + n) AS x FROM {name}3 JOIN {name}0 USING (sample_id))"
    )


def points_sql(src: str) -> str:
    return f"SELECT sample_id, unnest(range(0, len(x))) AS idx, {r6s('unnest(x)')} AS v FROM {src}"


WAVE_X = f"WITH RECURSIVE {WAVES}, w0 AS (SELECT sample_id, wave AS x FROM w)"


def envelope_sql(st: S.EnvelopeSettings, percent: bool = False, start: str | None = None) -> str:
    """The envelope of the lists in CTE w0 of ``start``. They have no zeros, so the
    low-pass covers all of a wave."""
    band, low = N.bandpass_sections(FS, st.bp_low, st.bp_high), N.lowpass_sections(FS, st.lp_cut)
    flat = "list_transform(x, lambda v: v - list_avg(x))" if st.demean else "x"
    up = "list_transform(x, lambda v: abs(v))" if st.rectify else "x"
    top = "list_transform(x, lambda v: greatest(v, 0.0))" if st.non_negative else "x"
    share = "list_transform(x, lambda v: CASE WHEN list_max(x) > 0 THEN v / list_max(x) * 100.0 ELSE 0.0 END)" if percent else "x"
    return (
        f"{start or WAVE_X}, d0 AS (SELECT sample_id, {flat} AS x FROM w0), {zero_phase_sql('bp', 'd0', band)}, "
        f"ab AS (SELECT sample_id, {up} AS x FROM bp), {zero_phase_sql('lp', 'ab', low)}, "
        f"cl AS (SELECT sample_id, {top} AS x FROM lp), pc AS (SELECT sample_id, {share} AS x FROM cl) {points_sql('pc')}"
    )


SERIES_X = """WITH RECURSIVE li AS (SELECT l_suppkey AS sample_id, list(CAST(l_quantity AS DOUBLE) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS x FROM lineitem GROUP BY l_suppkey),
w0 AS (SELECT * FROM li WHERE sample_id % 5 <> 0 AND len(x) >= 5)"""
SERIES_SQL = (
    envelope_sql(S.EnvelopeSettings(), start=SERIES_X).replace("SELECT sample_id, unnest(range(0, len(x))) AS idx", "SELECT sample_id AS trial_id, unnest(range(0, len(x))) AS idx")
    + f" UNION ALL SELECT sample_id, unnest(range(0, len(x))), {r6s('unnest(x)')} FROM li WHERE sample_id % 5 = 0"
)
SPLINE_SQL = f"""{WAVE_X},
fw AS (SELECT sample_id, x, 1 AS i, CAST([0.25] AS DOUBLE[]) AS c, [6 * (x[3] - 2 * x[2] + x[1]) / 4] AS d FROM w0
 UNION ALL SELECT sample_id, x, i + 1, list_append(c, 1 / (4 - c[i])), list_append(d, (6 * (x[i + 3] - 2 * x[i + 2] + x[i + 1]) - d[i]) / (4 - c[i])) FROM fw WHERE i < len(x) - 2),
bw AS (SELECT sample_id, x, c, d, i, CAST([0.0] AS DOUBLE[]) AS m FROM fw WHERE i = len(x) - 2
 UNION ALL SELECT sample_id, x, c, d, i - 1, list_prepend(d[i] - c[i] * m[1], m) FROM bw WHERE i > 0),
ms AS (SELECT sample_id, x, list_prepend(0.0, m) AS m, len(x) AS k FROM bw WHERE i = 0),
g AS (SELECT *, least(CAST(floor(j * (k - 1) / 100.0) AS BIGINT), k - 2) AS i FROM ms, (SELECT unnest(range(0, 101)) AS j)),
h AS (SELECT sample_id, j, x[i + 1] AS y0, x[i + 2] AS y1, m[i + 1] AS m0, m[i + 2] AS m1, j * (k - 1) / 100.0 - i AS b FROM g)
SELECT sample_id, j AS idx, {r6s('m0 * (1 - b) ** 3 / 6 + m1 * b ** 3 / 6 + (y0 - m0 / 6) * (1 - b) + (y1 - m1 / 6) * b')} AS v FROM h"""


@query("demean", f"WITH {WAVES} SELECT sample_id, idx, {r6s('v - avg(v) OVER (PARTITION BY sample_id)')} AS v FROM pt")
def demean(spark, d):
    return _long(A.waves(spark, d).select("sample_id", X.demean("wave").alias("wave")))


@query(
    "demean_series",
    f"WITH {EV} SELECT event_id, {r6s('value - avg(value) OVER (PARTITION BY trial_id, label)')} AS value FROM ev",
)
def demean_series(spark, d):
    return S.demean_long(A.events(spark, d), ["trial_id", "label"], "value").select("event_id", r6("value").alias("value"))


@query("zscore", f"WITH {WAVES} SELECT sample_id, idx, {r6s('(v - avg(v) OVER w1) / stddev_pop(v) OVER w1')} AS v FROM pt WINDOW w1 AS (PARTITION BY sample_id)")
def zscore(spark, d):
    return _long(A.waves(spark, d).select("sample_id", X.zscore("wave").alias("wave")))


@query(
    "scale_columns",
    f"""WITH {WAVES} SELECT sample_id, idx, {r6s('(v - avg(v) OVER w1) / stddev_pop(v) OVER w1')} AS standard, {r6s('(v - min(v) OVER w1) / (max(v) OVER w1 - min(v) OVER w1)')} AS minmax FROM pt WINDOW w1 AS (PARTITION BY idx)""",
)
def scale_columns(spark, d):
    out = S.scale_columns(A.points(A.waves(spark, d), "sample_id"), "idx", "v")
    return out.select("sample_id", n64("idx").alias("idx"), r6("standard").alias("standard"), r6("minmax").alias("minmax"))


GAPS = "CASE WHEN (vec_id + i) % 7 IN (1, 2) THEN NULL ELSE x END"


def _gappy(spark, d):
    return A.waves(spark, d).select(
        "sample_id",
        F.transform(
            "wave", lambda x, i: F.when(~((F.col("sample_id") + i) % 7).isin(1, 2), x)
        ).alias("wave"),
    )


GAPS_SQL = f"""{WAVES}, gp AS (SELECT sample_id, idx, CASE WHEN (sample_id + idx) % 7 NOT IN (1, 2) THEN v END AS v FROM pt),
nb AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY sample_id ORDER BY idx) AS p, min(CASE WHEN v IS NOT NULL THEN idx END) OVER (PARTITION BY sample_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM gp),
fg AS (SELECT nb.sample_id, nb.idx, CASE WHEN nb.v IS NOT NULL THEN nb.v WHEN p IS NULL THEN b.v WHEN n IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (nb.idx - p) / (n - p) END AS v
 FROM nb LEFT JOIN pt a ON a.sample_id = nb.sample_id AND a.idx = p LEFT JOIN pt b ON b.sample_id = nb.sample_id AND b.idx = n)"""


@query("fill_gaps", f"WITH {GAPS_SQL} SELECT sample_id, idx, {r6s('v')} AS v FROM fg")
def fill_gaps(spark, d):
    return _long(_gappy(spark, d).select("sample_id", X.fill_gaps("wave").alias("wave")))


@query("max_norm", f"WITH {GAPS_SQL} SELECT sample_id, idx, {r6s('v / max(v) OVER (PARTITION BY sample_id) * 100')} AS v FROM fg")
def max_norm(spark, d):
    return _long(_gappy(spark, d).select("sample_id", X.max_normalise("wave").alias("wave")))


@query(
    "fill_gaps_series",
    f"""WITH {EV}, g AS (SELECT trial_id, event_id, t, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM ev),
p AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY trial_id ORDER BY t) AS tp, min(CASE WHEN v IS NOT NULL THEN t END) OVER (PARTITION BY trial_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tn FROM g)
SELECT p.event_id, {r6s('CASE WHEN p.v IS NOT NULL THEN p.v WHEN tp IS NULL THEN b.v WHEN tn IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (p.t - tp) / (tn - tp) END')} AS v
FROM p LEFT JOIN g a ON a.trial_id = p.trial_id AND a.t = tp LEFT JOIN g b ON b.trial_id = p.trial_id AND b.t = tn""",
)
def fill_gaps_series(spark, d):
    s = A.events(spark, d).select("trial_id", "event_id", "t", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    out = S.fill_gaps_long(s, ["trial_id"], "t", "v", cell=time_cell("t", 7 * A.DAY))
    return out.select("event_id", r6("v").alias("v"))


@query("rectify_clamp", f"WITH {WAVES} SELECT sample_id, idx, {r6s('abs(v)')} AS v, {r6s('greatest(v, 0)')} AS c FROM pt")
def rectify_clamp(spark, d):
    w = A.waves(spark, d).select("sample_id", F.arrays_zip(X.rectify("wave").alias("a"), X.clamp_non_negative("wave").alias("c")).alias("z"))
    p = w.select("sample_id", F.posexplode("z").alias("idx", "z"))
    return p.select("sample_id", n64("idx").alias("idx"), r6("z.a").alias("v"), r6("z.c").alias("c"))


@query(
    "robust_norm",
    f"""WITH {WAVES}, g AS (SELECT subject, label, avg(abs(v)) + 3 * stddev_pop(abs(v)) AS amp FROM pt GROUP BY subject, label)
SELECT sample_id, idx, {r6s('abs(v) / amp')} AS v, {r6s('amp')} AS amplitude FROM pt JOIN g USING (subject, label)""",
)
def robust_norm(spark, d):
    w = A.waves(spark, d).select("sample_id", "subject", "label", X.rectify("wave").alias("wave"))
    out = S.robust_amplitude_norm(w, ["subject", "label"])
    return out.select("sample_id", r6("amplitude").alias("amplitude"), F.posexplode("wave").alias("idx", "v")).select(
        "sample_id", n64("idx").alias("idx"), r6("v").alias("v"), "amplitude"
    )


TAPS = [float(h) for h in N.fir_taps(13, 6.0, 100.0)]
# mirrored ends: index i, then 2 * last - i
_REFL = lambda k: f"wave[1 + CASE WHEN abs(i + {k}) > len(wave) - 1 THEN 2 * (len(wave) - 1) - abs(i + {k}) ELSE abs(i + {k}) END]"
FIR_SQL = " + ".join(f"{_REFL(6 - k)} * {h!r}" for k, h in enumerate(TAPS))


@query("fir", f"WITH {WAVES}, x AS (SELECT sample_id, wave, unnest(range(0, len(wave))) AS i FROM w) SELECT sample_id, i AS idx, {r6s(FIR_SQL)} AS v FROM x")
def fir(spark, d):
    return _long(A.waves(spark, d).select("sample_id", S.fir_lowpass("wave", 100.0, 6.0).alias("wave")))


@query("bandpass", f"{WAVE_X}, {zero_phase_sql('bp', 'w0', N.bandpass_sections(FS, 10, 490))} {points_sql('bp')}")
def bandpass(spark, d):
    return _long(A.waves(spark, d).select("sample_id", S.bandpass("wave", FS, 10, 490).alias("wave")))


@query("lowpass", f"{WAVE_X}, {zero_phase_sql('lp', 'w0', N.lowpass_sections(FS, 15))} {points_sql('lp')}")
def lowpass(spark, d):
    return _long(A.waves(spark, d).select("sample_id", S.lowpass("wave", FS, 15).alias("wave")))


@query("envelope", envelope_sql(S.EnvelopeSettings()))
def envelope(spark, d):
    return _long(A.waves(spark, d).select("sample_id", S.envelope("wave", FS).alias("wave")))


@query("legacy_envelope", envelope_sql(S.LEGACY, percent=True))
def legacy_envelope(spark, d):
    return _long(A.waves(spark, d).select("sample_id", S.legacy_envelope("wave", FS).alias("wave")))


@query("envelope_series", SERIES_SQL)
def envelope_series(spark, d):
    """Every supplier's line items in shipping order as one long series."""
    li = A.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("trial_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").alias("v")
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    month = F.expr("year(l_shipdate) * 12 + month(l_shipdate)").cast("bigint")
    s = ordered_scan(li, ["trial_id"], order, row_no="_k", cell=month)
    s = cut_lineage(s.select("trial_id", F.lit("EMG 1").alias("channel"), (F.col("_k") - 1).alias("idx"), "v"))
    rates = s.select("trial_id").distinct().withColumn("rate", F.when(F.col("trial_id") % 5 == 0, F.lit(None)).otherwise(F.lit(FS)))
    out = S.preprocess_before_split(s, rates, ["trial_id", "channel"], "v")
    return out.select("trial_id", "idx", r6("v").alias("v"))


@query("spline", SPLINE_SQL)
def spline(spark, d):
    return _long(A.waves(spark, d).select("sample_id", S.spline_101("wave").alias("wave")))


@query(
    "akima",
    f"""WITH {WAVES}, w0 AS (SELECT sample_id, wave AS x, len(wave) AS k FROM w),
e0 AS (SELECT *, list_transform(range(1, k), lambda i: x[i + 1] - x[i]) AS m FROM w0),
e1 AS (SELECT *, 2 * m[1] - m[2] AS l1, 2 * m[k - 1] - m[k - 2] AS r1 FROM e0),
e2 AS (SELECT sample_id, x, k, m, list_concat([2 * l1 - m[1], l1], m, [r1, 2 * r1 - m[k - 1]]) AS e FROM e1),
s0 AS (SELECT *, list_transform(range(1, k + 1), lambda i: {{'a': abs(e[i + 3] - e[i + 2]), 'b': abs(e[i + 1] - e[i]), 'p': e[i + 1], 'q': e[i + 2]}}) AS z FROM e2),
s1 AS (SELECT *, list_transform(z, lambda t: CASE WHEN t.a + t.b > 0 THEN (t.a * t.p + t.b * t.q) / (t.a + t.b) ELSE 0.5 * (t.p + t.q) END) AS sl FROM s0),
g AS (SELECT sample_id, j, x, m, sl, k, least(CAST(floor(j * (k - 1) / 100.0) AS BIGINT), k - 2) AS i FROM s1, (SELECT unnest(range(0, 101)) AS j)),
h AS (SELECT sample_id, j, j * (k - 1) / 100.0 - i AS d, x[i + 1] AS x0, m[i + 1] AS dm, sl[i + 1] AS s0, sl[i + 2] AS s1 FROM g)
SELECT sample_id, j AS idx, {r6s('x0 + d * (s0 + d * ((3 * dm - 2 * s0 - s1) + d * (s0 + s1 - 2 * dm)))')} AS v FROM h""",
)
def akima(spark, d):
    return _long(A.waves(spark, d).select("sample_id", S.akima_101("wave").alias("wave")))


@query(
    "percent_resample",
    f"""WITH {EV}, s AS (SELECT trial_id, label, t, value, row_number() OVER (PARTITION BY trial_id, label ORDER BY t, value) AS k FROM ev WHERE value < 80),
g AS (SELECT trial_id, label, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM s GROUP BY ALL),
q AS (SELECT g.*, i, t0 + (t1 - t0) * i / 100.0 AS x FROM g, (SELECT unnest(range(0, 101)) AS i) WHERE n >= 2),
f0 AS (SELECT q.trial_id, q.label, q.i, q.x, q.n, count(*) FILTER (WHERE s.t <= q.x) AS c FROM q JOIN s ON s.trial_id = q.trial_id AND s.label = q.label GROUP BY q.trial_id, q.label, q.i, q.x, q.n),
f AS (SELECT *, greatest(1, least(c, n - 1)) AS lo FROM f0)
SELECT f.trial_id, f.label, f.i AS idx, round(CASE WHEN b.t > a.t THEN a.value + (b.value - a.value) * (f.x - a.t) / (b.t - a.t) ELSE a.value END + 1e-9, 3) AS v
FROM f JOIN s a ON a.trial_id = f.trial_id AND a.label = f.label AND a.k = f.lo JOIN s b ON b.trial_id = f.trial_id AND b.label = f.label AND b.k = f.lo + 1""",
)
def percent_resample(spark, d):
    ev = A.events(spark, d).withColumn("v", F.when(F.col("value") < 80, F.col("value")))
    out = S.percent_resample(ev, ["trial_id", "label"], "t", "v", cell_width=7 * A.DAY).where("reason is null")
    p = out.select("trial_id", "label", F.posexplode("wave").alias("idx", "v"))
    return p.select("trial_id", "label", n64("idx").alias("idx"), F.round(F.col("v") + 1e-9, 3).alias("v"))


@query(
    "extract_waves",
    f"""WITH c AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, CASE vec_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Hip' WHEN 2 THEN 'Knee' WHEN 3 THEN 'LKnee' ELSE 'RKnee' END AS ch, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
r AS (SELECT *, CASE WHEN ch IS NULL THEN 'no_point' WHEN ch NOT IN ('Knee', side || 'Knee') THEN 'missing_key' END AS reason FROM c)
SELECT vec_id, reason, CASE WHEN reason IS NULL THEN {r6s('w[1]')} END AS first_v, CASE WHEN reason IS NULL THEN {r6s('w[32] * 0.5 + w[33] * 0.5')} END AS mid_v FROM r""",
)
def extract_waves(spark, d):
    m = F.col("sample_id") % 5
    ch = F.when(m == 1, "Hip").when(m == 2, "Knee").when(m == 3, "LKnee").when(m == 4, "RKnee")
    c = A.waves(spark, d).select(F.col("sample_id").alias("vec_id"), "side", ch.alias("channel"), "wave")
    out = S.extract_waves(c, ["vec_id"], "Knee")
    return out.select("vec_id", "reason", r6(F.get("wave", F.lit(0))).alias("first_v"), r6(F.get("wave", F.lit(50))).alias("mid_v"))


@query(
    "resultant_ratio",
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_discount AS di, l_tax AS ta, sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, {r6s('r')} AS resultant, {r6s('CASE WHEN di + ta <> 0 THEN di / (di + ta) * 100 END')} AS ratio, {r6s('di + ta')} AS total FROM x""",
)
def resultant_ratio(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        r6(S.resultant("l_quantity", "l_discount", "l_tax")).alias("resultant"),
        r6(S.medial_ratio("l_discount", "l_tax")).alias("ratio"),
        r6(F.col("l_discount") + F.col("l_tax")).alias("total"),
    )


@query(
    "body_norm",
    f"""SELECT o_orderkey, {r6s('o_totalprice / ((50 + c_custkey % 50) * 9.81) * 100')} AS force, {r6s('o_totalprice / (1500 + c_custkey % 400) * 100')} AS length FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def body_norm(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("sid"), F.col("o_totalprice").alias("force"), F.col("o_totalprice").alias("length"))
    c = A.table(spark, d, "customer").select(
        F.col("c_custkey").alias("sid"), (F.lit(50) + F.col("c_custkey") % 50).cast("double").alias("mass"), (F.lit(1500) + F.col("c_custkey") % 400).cast("double").alias("height")
    )
    return S.body_normalise(o, c, "sid", forces=["force"], lengths=["length"]).select("o_orderkey", r6("force").alias("force"), r6("length").alias("length"))


@query(
    "first_existing",
    """WITH x AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 END AS r, l_returnflag AS channel, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT l_orderkey, arg_min(v, r) AS v, arg_min(channel, r) AS channel FROM x WHERE r IS NOT NULL GROUP BY l_orderkey""",
)
def first_existing(spark, d):
    x = A.table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("channel")).agg(F.sum("l_quantity").alias("v"))
    return S.first_existing(x, ["l_orderkey"], "channel", "v", ["R", "A"])
