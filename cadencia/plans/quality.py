"""Quality-check and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import cycles as C
from ..operators import quality as Q
from ..operators import stats as S
from ..operators.ordered import ordered_scan, time_cell
from ..session import cut_lineage
from .events import VISIT_SQL, WEEK, visits
from .registry import WAVES, query, r6, r6s

CK = ["trial_id", "cycle_no"]

QC_SQL = f"""{VISIT_SQL},
so AS (SELECT c.trial_id, c.cycle_no, c.t_start, c.t_end, x.t, x.event_id, x.label, x.value, x.event_id % 100 AS k,
  row_number() OVER (PARTITION BY c.trial_id, c.cycle_no ORDER BY x.t, x.event_id) - 1 AS idx
  FROM cy c JOIN ev x ON x.trial_id = c.trial_id AND x.t BETWEEN c.t_start AND c.t_end),
bo AS (SELECT trial_id, cycle_no, CASE WHEN cycle_no % 5 <> 0 THEN t_start + 0.1 * (t_end - t_start) END AS t_off,
  CASE WHEN cycle_no % 7 = 0 THEN t_start ELSE t_start + 0.9 * (t_end - t_start) END AS t_strike FROM cy),
wn AS (SELECT b.trial_id, b.cycle_no, count(*) AS n, any_value(t_off) AS t_off, any_value(t_strike) AS t_strike,
  greatest(0, count(*) FILTER (WHERE s.t < t_off) + 1) AS i0, least(count(*) - 1, count(*) FILTER (WHERE s.t <= t_strike) - 1 - 1) AS i1
  FROM bo b JOIN so s USING (trial_id, cycle_no) GROUP BY b.trial_id, b.cycle_no),
ws AS (SELECT *, CASE WHEN t_off IS NULL THEN 'event_missing' WHEN t_strike <= t_off THEN 'event_order' WHEN i1 < i0 THEN 'window_empty' WHEN n < 2 THEN 'too_short' ELSE 'ok' END AS status FROM wn)"""

RULES = Q.QcRules(so_ms_tol=100.0, moment_rms_max=60.0, moment_max_max=90.0)


def _cycles(spark, d):
    """The cycles, written once: samples, windows and checks all start from them."""
    return cut_lineage(visits(spark, d))


def _so(spark, d, cyc):
    """Samples of each cycle with their index, written once: the checks below
    read them several times."""
    ev = A.events(spark, d).select("trial_id", "t", "event_id", "label", "value")
    so = C.slice_cycles(ev, cyc.select(*CK, "t_start", "t_end"), ["trial_id"], cell_width=WEEK)
    so = ordered_scan(so, CK, ["t", "event_id"], row_no="idx", cell=time_cell("t", WEEK))
    v, k = F.col("value"), (F.col("event_id") % 100).cast("double")
    so = so.select(
        *CK,
        "t",
        (F.col("idx") - 1).alias("idx"),
        "label",
        v.alias("FX"),
        (v / 10).alias("FY"),
        (-v).alias("FZ"),
        k.alias("MX"),
        (k / 2).alias("MY"),
        (-k).alias("MZ"),
        "value",
        "event_id",
    )
    return cut_lineage(so)


def _windows(cyc, so):
    n = F.col("cycle_no")
    dur = F.col("t_end") - F.col("t_start")
    bounds = cyc.select(
        *CK,
        F.when(n % 5 != 0, F.col("t_start") + F.lit(0.1) * dur).alias("t_off"),
        F.when(n % 7 == 0, F.col("t_start")).otherwise(F.col("t_start") + F.lit(0.9) * dur).alias("t_strike"),
        F.lit(10.0).alias("rate"),
    )
    return Q.support_windows(so, bounds, CK, RULES)


@query("qc_window", f"WITH {QC_SQL} SELECT trial_id, cycle_no, n, CASE WHEN status = 'ok' THEN i0 END AS i0, CASE WHEN status = 'ok' THEN i1 END AS i1, status FROM ws")
def qc_window(spark, d):
    cyc = _cycles(spark, d)
    return _windows(cyc, _so(spark, d, cyc))


PLATE_SQL = f"""{QC_SQL},
pl AS (SELECT trial_id, cycle_no, label AS plate, value, row_number() OVER (PARTITION BY trial_id, cycle_no, label ORDER BY t, event_id) - 1 AS j FROM so WHERE label IN ('click', 'purchase')),
ps AS (SELECT trial_id, cycle_no, plate, count(*) AS len FROM pl GROUP BY ALL),
pw AS (SELECT p.*, round_even(w.i0::DOUBLE / (w.n - 1) * (len - 1), 0) AS j0, round_even(w.i1::DOUBLE / (w.n - 1) * (len - 1), 0) AS j1 FROM ps p JOIN ws w USING (trial_id, cycle_no) WHERE w.status = 'ok'),
pp AS (SELECT pl.trial_id, pl.cycle_no, pl.plate, sqrt(avg(value * value)) AS r, max(abs(value)) AS m FROM pl JOIN pw USING (trial_id, cycle_no, plate) WHERE j BETWEEN j0 AND j1 GROUP BY ALL),
pg AS (SELECT trial_id, cycle_no, max(r) AS r, max(m) AS m FROM pp GROUP BY ALL)"""


def _plates(so):
    pl = so.where(F.col("label").isin("click", "purchase"))
    pl = ordered_scan(pl, [*CK, "label"], ["t", "event_id"], row_no="_j", cell=time_cell("t", WEEK))
    v = F.col("value")
    comps = F.array(
        *[F.struct(F.lit(c).alias("comp"), (v / x).alias("v")) for c, x in (("Fx", 2.0), ("Fy", 3.0), ("Fz", 1.0))]
    )
    return pl.select(*CK, F.col("label").alias("plate"), (F.col("_j") - 1).alias("idx"), F.inline(comps))


@query(
    "plate_window_stat",
    f"WITH {PLATE_SQL} SELECT trial_id, cycle_no, {r6s('r')} AS rms_fz, {r6s('m')} AS max_fz, {r6s('r / 2')} AS rms_fx FROM pg",
)
def plate_window_stat(spark, d):
    cyc = _cycles(spark, d)
    so = _so(spark, d, cyc)
    return Q.plate_stats(_plates(so), _windows(cyc, so), CK).select(
        *CK, r6("plate_rms_Fz").alias("rms_fz"), r6("plate_max_Fz").alias("max_fz"), r6("plate_rms_Fx").alias("rms_fx")
    )


IK_SQL = """ik AS (SELECT trial_id, cycle_no, max(k / 4000.0) <= 0.02 AS rms_ok, max(value / 5000.0) <= 0.04 AS max_ok FROM so WHERE label <> 'view' GROUP BY ALL)"""


@query("qc_max", f"WITH {QC_SQL}, {IK_SQL} SELECT c.trial_id, c.cycle_no, coalesce(rms_ok, true) AS \"IK_RMS_ok\", coalesce(max_ok, true) AS \"IK_MAX_ok\" FROM cy c LEFT JOIN ik USING (trial_id, cycle_no)")
def qc_max(spark, d):
    cyc = _cycles(spark, d)
    return _ik(cyc, _so(spark, d, cyc))


def _ik(cyc, so):
    err = so.where("label <> 'view'").select(
        *CK,
        ((F.col("event_id") % 100) / 4000.0).alias("marker_error_RMS"),
        (F.col("value") / 5000.0).alias("marker_error_max"),
    )
    return Q.ik_flags(err, cyc, CK, RULES)


FLAG_SQL = f"""{PLATE_SQL}, {IK_SQL},
fo AS (SELECT trial_id, cycle_no, sqrt(avg((value / 10) * (value / 10))) AS rf, max(abs(value / 10)) AS mf, sqrt(avg(k * k)) AS rm, max(k) AS mm
  FROM so JOIN ws USING (trial_id, cycle_no) WHERE status = 'ok' AND idx BETWEEN i0 AND i1 GROUP BY ALL),
fl AS (SELECT ws.trial_id, ws.cycle_no, CASE WHEN status = 'ok' AND pg.r IS NULL THEN 'no_plate' ELSE status END AS status,
  rf < 0.06 * pg.r AS a, mf < 0.2 * pg.m AS b, rm <= 60 AS c, mm <= 90 AS d FROM ws LEFT JOIN fo USING (trial_id, cycle_no) LEFT JOIN pg USING (trial_id, cycle_no)),
al AS (SELECT cy.trial_id, cy.cycle_no, fl.status, coalesce(rms_ok, true) AS e, coalesce(max_ok, true) AS f, coalesce(a, true) AS a, coalesce(b, true) AS b, coalesce(c, true) AS c, coalesce(d, true) AS d
  FROM cy LEFT JOIN ik USING (trial_id, cycle_no) LEFT JOIN fl USING (trial_id, cycle_no))"""


@query(
    "qc_flags",
    f"""WITH {FLAG_SQL} SELECT trial_id, cycle_no, status, e AS "IK_RMS_ok", f AS "IK_MAX_ok", a AS "SO_F_RMS_ok", b AS "SO_F_MAX_ok", c AS "SO_M_RMS_ok", d AS "SO_M_MAX_ok",
NOT (a AND b AND c AND d AND e AND f) AS bad FROM al""",
)
def qc_flags(spark, d):
    cyc = _cycles(spark, d)
    so = _so(spark, d, cyc)
    w = cut_lineage(_windows(cyc, so))
    plates = cut_lineage(Q.plate_stats(_plates(so), w, CK))
    flags = Q.so_flags(w, Q.force_stats(so, w, CK), plates, CK, RULES)
    return Q.qc_bad(Q.qc_all(_ik(cyc, so), flags, CK))


@query(
    "valid_cycles",
    f"""WITH {QC_SQL},
sp AS (SELECT trial_id, cycle_no, min(t) AS t0, max(t) AS t1, max(abs(value)) FILTER (WHERE label IN ('click', 'purchase')) AS fz FROM so GROUP BY ALL),
md AS (SELECT so.trial_id, so.cycle_no, sqrt(avg((value / 10) * (value / 10))) AS r, max(abs(value / 10)) AS m FROM so JOIN sp USING (trial_id, cycle_no)
  WHERE t - t0 > 0.1 * (t1 - t0) AND t - t0 < 0.3 * (t1 - t0) GROUP BY ALL)
SELECT trial_id, cycle_no, {r6s('r / fz')} AS rms_rel, {r6s('m / fz')} AS max_rel FROM md JOIN sp USING (trial_id, cycle_no)
WHERE fz <> 0 AND r / fz < 0.05 AND m / fz < 0.1 AND cycle_no % 4 <> 0 AND trial_id % 3 <> 0""",
)
def valid_cycles(spark, d):
    cyc = _cycles(spark, d)
    so = _so(spark, d, cyc)
    plates = so.where(F.col("label").isin("click", "purchase")).select(*CK, F.col("value").alias("v"))
    flags = cyc.select(
        *CK, (F.col("cycle_no") % 4 != 0).alias("selected"), (F.col("trial_id") % 3 != 0).alias("kinetic")
    )
    return Q.valid_cycles(so, plates, flags, CK).select(*CK, r6("rms_rel").alias("rms_rel"), r6("max_rel").alias("max_rel"))


@query("residual_filter", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount < 0.05 AND l_tax < 0.04")
def residual_filter(spark, d):
    li = A.table(spark, d, "lineitem")
    return Q.residual_filter(li, "l_discount", "l_tax", 0.05, 0.04).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "residual_shares",
    f"""SELECT l_returnflag, count(*) AS n, {r6s('avg(CASE WHEN l_discount >= 0.05 THEN 100.0 ELSE 0.0 END)')} AS excl_rms_pct, {r6s('avg(CASE WHEN l_tax >= 0.04 THEN 100.0 ELSE 0.0 END)')} AS excl_max_pct,
{r6s('avg(CASE WHEN l_discount < 0.05 AND l_tax < 0.04 THEN 100.0 ELSE 0.0 END)')} AS valid_pct FROM lineitem GROUP BY l_returnflag""",
)
def residual_shares(spark, d):
    s = Q.residual_shares(A.table(spark, d, "lineitem"), "l_discount", "l_tax", 0.05, 0.04, ["l_returnflag"])
    return s.select("l_returnflag", "n", *[r6(c).alias(c) for c in ("excl_rms_pct", "excl_max_pct", "valid_pct")])


@query(
    "dedupe_grain",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_grain(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_shipdate")
    return Q.dedupe(li, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_quantity"]).drop("l_shipdate")


def _cycles_table(spark, d):
    """documents with labels as reviewed cycles: quality = selected, toxic = kinetic."""
    docs = A.table(spark, d, "documents").select("doc_id", "lang")
    lab = A.table(spark, d, "labels")
    side = F.when(F.col("lang") == "en", "Left").when(F.col("lang") == "fr", "right_stride").when(F.col("lang") == "de", "l").otherwise("x")
    return docs.join(lab, "doc_id", "left").select(
        "doc_id", side.alias("side"), F.col("quality").alias("selected"), F.col("toxic").alias("kinetic")
    )


CYC_SQL = """c AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'Left' WHEN 'fr' THEN 'right_stride' WHEN 'de' THEN 'l' ELSE 'x' END AS side, quality AS selected, toxic AS kinetic FROM documents LEFT JOIN labels USING (doc_id))"""


@query(
    "side_mode_counts",
    f"""WITH {CYC_SQL}, x AS (SELECT CASE side WHEN 'Left' THEN 'left' WHEN 'l' THEN 'left' WHEN 'right_stride' THEN 'right' ELSE '?' END AS side, coalesce(kinetic, 0) = 1 AS k, coalesce(selected, 1) = 1 AS s FROM c),
g AS (SELECT coalesce(side, 'all') AS side, count(*) FILTER (WHERE k AND s) AS kinetic_selected, count(*) FILTER (WHERE k AND NOT s) AS kinetic_unselected,
count(*) FILTER (WHERE NOT k AND s) AS kinematic_selected, count(*) FILTER (WHERE NOT k AND NOT s) AS kinematic_unselected FROM x GROUP BY ROLLUP (side)) SELECT * FROM g WHERE side <> '?'""",
)
def side_mode_counts(spark, d):
    return S.selection_counts(_cycles_table(spark, d))


@query("default_flags", f"WITH {CYC_SQL} SELECT doc_id, coalesce(selected, 1) AS selected, true AS reconstruction_ok, coalesce(selected, 1) AS initial_selected FROM c")
def default_flags(spark, d):
    c = _cycles_table(spark, d).withColumns(
        {"reconstruction_ok": F.lit(None).cast("boolean"), "initial_selected": F.lit(None).cast("int")}
    )
    return Q.default_flags(c).select("doc_id", "selected", "reconstruction_ok", "initial_selected")


@query("side_mode_filter", f"WITH {CYC_SQL} SELECT doc_id FROM c WHERE side IN ('Left', 'x') AND coalesce(kinetic, 0) = 0 AND coalesce(selected, 1) = 1")
def side_mode_filter(spark, d):
    return Q.side_mode_filter(_cycles_table(spark, d), sides=("Left", "x"), kinetic=False, hide_deselected=True).select("doc_id")


@query("cluster_filter", "WITH n AS (SELECT label FROM embeddings WHERE label IN (0, 1, 2, 3, 4, 5) AND label NOT IN (3) GROUP BY label HAVING count(*) >= 50) SELECT vec_id, label FROM embeddings WHERE label IN (SELECT label FROM n)")
def cluster_filter(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", "label")
    return Q.filter_clusters(e, "label", min_cycles=50, include=[0, 1, 2, 3, 4, 5], exclude=[3])


BOX_SQL = f"""{WAVES}, cs AS (SELECT sample_id, CASE WHEN sample_id % 3 = 0 THEN 0 ELSE 1 END AS selected FROM w),
ch AS (SELECT sample_id FROM cs WHERE selected = 1 AND sample_id IN (SELECT sample_id FROM pt WHERE idx BETWEEN 10 AND 20 AND v BETWEEN 0.2 AND 0.5))"""


def _boxes(spark, d):
    w = A.waves(spark, d)
    pts = A.points(w, "sample_id").select("sample_id", F.col("idx").alias("x"), F.col("v").alias("y"))
    cyc = w.select("sample_id", "side", F.when(F.col("sample_id") % 3 == 0, 0).otherwise(1).alias("selected"), (F.col("cluster") < 5).alias("kinetic"))
    return cyc, Q.box_select(pts, cyc, ["sample_id"], (20, 10, 0.2, 0.5), 0)


@query("box_select", f"WITH {BOX_SQL} SELECT sample_id, 1 AS old, 0 AS new FROM ch")
def box_select(spark, d):
    return _boxes(spark, d)[1]


@query(
    "selection_diff",
    f"""WITH {BOX_SQL}, x AS (SELECT w.side, w.cluster < 5 AS kinetic, cs.selected AS b, CASE WHEN ch.sample_id IS NOT NULL THEN 0 WHEN w.sample_id % 21 = 0 THEN 1 ELSE cs.selected END AS n
FROM w JOIN cs USING (sample_id) LEFT JOIN ch USING (sample_id))
SELECT side, kinetic, count(*) FILTER (WHERE b = 0 AND n = 1) AS n_added, count(*) FILTER (WHERE b = 1 AND n = 0) AS n_removed, count(*) FILTER (WHERE b <> n) AS n_changed FROM x GROUP BY side, kinetic""",
)
def selection_diff(spark, d):
    cyc, changes = _boxes(spark, d)
    now = Q.apply_changes(cyc, changes, ["sample_id"])
    now = now.withColumn("selected", F.when((F.col("sample_id") % 21 == 0) & (F.col("sample_id") % 3 == 0), 1).otherwise(F.col("selected")))
    return Q.selection_diff(now, cyc, ["sample_id"])


OP = "CASE WHEN seq % 4 IN (1, 2) THEN 'push' WHEN seq % 4 = 3 THEN 'undo' WHEN seq % 8 = 0 THEN 'redo' ELSE 'push' END"


@query(
    "replay_log",
    f"""WITH {QC_SQL.split('nx AS')[0].rstrip().rstrip(',')},
lg AS (SELECT trial_id, seq, label, kinetic, {OP} AS op FROM sq),
dp AS (SELECT *, sum(CASE WHEN op = 'undo' THEN -1 ELSE 1 END) OVER (PARTITION BY trial_id ORDER BY seq) AS d FROM lg),
fi AS (SELECT trial_id, arg_max(d, seq) AS fd FROM dp GROUP BY trial_id),
lv AS (SELECT dp.trial_id, max(seq) AS seq FROM dp JOIN fi USING (trial_id) WHERE op = 'push' AND d <= fd GROUP BY dp.trial_id, d),
ed AS (SELECT p.trial_id, p.label, p.seq, CAST(p.kinetic AS INTEGER) AS new, lv.seq IS NOT NULL AS live FROM dp p LEFT JOIN lv USING (trial_id, seq) WHERE op = 'push')
SELECT trial_id, label, CAST(coalesce(arg_max(new, seq) FILTER (WHERE live), arg_min(1 - new, seq)) AS INTEGER) AS state FROM ed GROUP BY trial_id, label""",
)
def replay_log(spark, d):
    ev = ordered_scan(A.events(spark, d), ["trial_id"], C.ORDER, row_no="seq", cell=time_cell("t", WEEK))
    lg = ev.select("trial_id", "seq", "label", F.col("kinetic").cast("int").alias("new"), F.expr(OP).alias("op"))
    edits = lg.where("op = 'push'").withColumn("old", 1 - F.col("new"))
    return Q.replay_selection_log(
        lg.select("trial_id", "seq", "op"), edits, "trial_id", "label", cell=F.floor(F.col("seq") / 100_000).cast("bigint")
    )


@query(
    "merge_flags",
    """SELECT d.doc_id, coalesce(l.quality, CASE WHEN d.doc_id % 2 = 0 THEN 0 END, 1) AS manually_selected, coalesce(l.toxic, 1) AS "IK_RMS_ok" FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def merge_flags(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, False).alias("manually_selected"))
    edits = A.table(spark, d, "labels").select(
        "doc_id", F.col("quality").alias("manually_selected"), F.col("toxic").cast("boolean").alias("IK_RMS_ok"), F.lit(1).alias("junk")
    )
    return Q.merge_flags(docs, edits, ["doc_id"], {"manually_selected": 1, "IK_RMS_ok": 1})


@query(
    "valid_id_counts",
    "SELECT CAST(vec_id % 20 AS BIGINT) AS subject, CASE WHEN vec_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, count(*) AS n_valid FROM embeddings GROUP BY 1, 2 UNION ALL SELECT CAST(vec_id % 20 AS BIGINT), NULL, count(*) FROM embeddings GROUP BY 1",
)
def valid_id_counts(spark, d):
    return Q.valid_id_counts(A.waves(spark, d))


@query(
    "axis_limits",
    f"""WITH x AS (SELECT event_type AS label, epoch_us(ts) / 1e6 - 1704067200 AS x, value AS y FROM events WHERE user_id % 3 <> 0),
g AS (SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM x GROUP BY label)
SELECT label, {r6s('x0 - (x1 - x0) * 0.05')} AS x_lo, {r6s('x1 + (x1 - x0) * 0.05')} AS x_hi, {r6s('y0 - (y1 - y0) * 0.05')} AS y_lo, {r6s('y1 + (y1 - y0) * 0.05')} AS y_hi FROM g""",
)
def axis_limits(spark, d):
    e = A.events(spark, d).select(
        "label", (F.col("t") - 1704067200).alias("x"), F.col("value").alias("y"), (F.col("trial_id") % 3 != 0).alias("selected")
    )
    return S.axis_limits(e, ["label"]).select("label", *[r6(c).alias(c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")])


@query(
    "histogram",
    """WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 200.0)), 199) AS BIGINT) AS bin FROM events, l)
SELECT r.bin, count(b.bin) AS n FROM (SELECT unnest(range(0, 200)) AS bin) r LEFT JOIN b USING (bin) GROUP BY r.bin""",
)
def histogram(spark, d):
    return S.histogram(A.events(spark, d), "value")
