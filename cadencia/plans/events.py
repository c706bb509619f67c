"""Event, cycle and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import cycles as C
from ..operators import joins as J
from ..operators import patching as P
from ..operators.ordered import time_cell
from .registry import EV, query, r6, r6s

WEEK = 7 * A.DAY
KEY = ["trial_id"]
VISIT = {"visit": ["view", "click", "view"]}


def _after(label: str) -> str:
    return (
        f"min(CASE WHEN label = '{label}' THEN seq END) OVER (PARTITION BY trial_id ORDER BY seq "
        "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    )


VISIT_SQL = f"""{EV},
nx AS (SELECT *, {_after('click')} AS c_seq, {_after('view')} AS v_seq FROM sq),
cy AS (
  SELECT s.trial_id, row_number() OVER (PARTITION BY s.trial_id ORDER BY s.seq) AS cycle_no,
         s.seq AS s_seq, s.t AS t_start, c.t AS t_central, e.t AS t_end, c.seq AS c_seq
  FROM nx s JOIN nx c ON c.trial_id = s.trial_id AND c.seq = s.c_seq
  JOIN nx e ON e.trial_id = c.trial_id AND e.seq = c.v_seq WHERE s.label = 'view')"""


def visits(spark, d, **kw):
    return C.extract_cycles(A.events(spark, d), VISIT, KEY, cell_width=WEEK, **kw)


@query(
    "cycle_summary",
    f"""WITH {VISIT_SQL}
SELECT c.trial_id, 'visit' AS cycle_type, c.cycle_no, {r6s('c.t_end - c.t_start')} AS duration,
  {r6s('CASE WHEN c.t_end = c.t_start THEN 0.0 ELSE (c.t_central - c.t_start) / (c.t_end - c.t_start) * 100 END')} AS central_pct,
  count(*) AS n_samples, {r6s('avg(x.value)')} AS mean_value
FROM cy c JOIN ev x ON x.trial_id = c.trial_id AND x.t BETWEEN c.t_start AND c.t_end
GROUP BY c.trial_id, c.cycle_no, c.t_start, c.t_central, c.t_end""",
)
def cycle_summary(spark, d):
    samples = A.events(spark, d).select("trial_id", "t", "value")
    inside = C.slice_cycles(samples, visits(spark, d), KEY, cell_width=WEEK)
    return inside.groupBy(
        "trial_id", "cycle_type", "cycle_no", "t_start", "t_end", "central_pct"
    ).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("value").alias("m")).select(
        "trial_id",
        "cycle_type",
        "cycle_no",
        r6(F.col("t_end") - F.col("t_start")).alias("duration"),
        r6("central_pct").alias("central_pct"),
        "n_samples",
        r6("m").alias("mean_value"),
    )


@query(
    "cycles_three_events",
    f"""WITH {VISIT_SQL} SELECT trial_id, 'visit' AS cycle_type, cycle_no, t_start, t_central, t_end FROM cy""",
)
def cycles_three_events(spark, d):
    return visits(spark, d).drop("central_pct")


@query(
    "slice_cycles",
    f"""WITH {VISIT_SQL} SELECT c.trial_id, c.cycle_no, x.event_id, x.label AS channel, {r6s('x.t - c.t_start')} AS t_rel, x.value
FROM cy c JOIN ev x ON x.trial_id = c.trial_id AND x.t BETWEEN c.t_start AND c.t_end""",
)
def slice_cycles(spark, d):
    s = A.events(spark, d).select("trial_id", "t", "event_id", F.col("label").alias("channel"), "value")
    return C.slice_cycles(s, visits(spark, d), KEY, cell_width=WEEK).select(
        "trial_id", "cycle_no", "event_id", "channel", r6(F.col("t") - F.col("t_start")).alias("t_rel"), "value"
    )


@query(
    "cycles_same_label",
    f"""WITH {EV}, x AS (SELECT *, lead(t) OVER (PARTITION BY trial_id ORDER BY t, event_id) AS t_end,
row_number() OVER (PARTITION BY trial_id ORDER BY t, event_id) AS cycle_no FROM ev WHERE label = 'click')
SELECT trial_id, cycle_no, t AS t_start, t_end FROM x WHERE t_end IS NOT NULL""",
)
def cycles_same_label(spark, d):
    return C.extract_cycles(
        A.events(spark, d), {"clicks": ["click", "click"]}, KEY, cell_width=WEEK
    ).select("trial_id", "cycle_no", "t_start", "t_end")


@query(
    "cycles_many_definitions",
    f"""WITH {VISIT_SQL}, nx2 AS (SELECT *, {_after('purchase')} AS e, {_after('view')} AS again FROM sq)
SELECT trial_id, 'visit' AS cycle_type, cycle_no, t_start, t_central, t_end FROM cy
UNION ALL SELECT s.trial_id, 'buy', row_number() OVER (PARTITION BY s.trial_id ORDER BY s.seq), s.t, NULL, e.t
FROM nx2 s JOIN nx2 e ON e.trial_id = s.trial_id AND e.seq = s.e WHERE s.label = 'view'
UNION ALL SELECT s.trial_id, 'return', row_number() OVER (PARTITION BY s.trial_id ORDER BY s.seq), s.t, m.t, e.t
FROM nx2 s JOIN nx2 m ON m.trial_id = s.trial_id AND m.seq = s.e JOIN nx2 e ON e.trial_id = m.trial_id AND e.seq = m.again WHERE s.label = 'view'""",
)
def cycles_many_definitions(spark, d):
    """Three definitions in one scan."""
    definitions = {**VISIT, "buy": ["view", "purchase"], "return": ["view", "purchase", "view"]}
    return C.extract_cycles(A.events(spark, d), definitions, KEY, cell_width=WEEK).drop("central_pct")


@query(
    "cycles_two_events",
    f"""WITH {EV}, nx AS (SELECT *, {_after('purchase')} AS e FROM sq)
SELECT s.trial_id, row_number() OVER (PARTITION BY s.trial_id ORDER BY s.seq) AS cycle_no, s.t AS t_start, e.t AS t_end
FROM nx s JOIN nx e ON e.trial_id = s.trial_id AND e.seq = s.e WHERE s.label = 'view'""",
)
def cycles_two_events(spark, d):
    return C.extract_cycles(
        A.events(spark, d), {"buy": ["view", "purchase"]}, KEY, cell_width=WEEK
    ).select("trial_id", "cycle_no", "t_start", "t_end")


@query(
    "central_percent",
    f"""WITH {VISIT_SQL}
SELECT c.trial_id, c.cycle_no, {r6s('CASE WHEN t_end = t_start THEN 0.0 ELSE (t_central - t_start) / (t_end - t_start) * 100 END')} AS central_pct,
  arg_min(f.event_id, (abs(f.t - c.t_central), f.t, f.event_id)) AS frame
FROM cy c LEFT JOIN ev f ON f.trial_id = c.trial_id AND f.label = 'error'
GROUP BY c.trial_id, c.cycle_no, c.t_start, c.t_central, c.t_end""",
)
def central_percent(spark, d):
    frames = A.events(spark, d).where("label = 'error'").select(
        "trial_id", "t", F.col("event_id").alias("frame")
    )
    return C.central_frames(visits(spark, d), frames, KEY, cell_width=WEEK).select(
        "trial_id", "cycle_no", r6("central_pct").alias("central_pct"), "frame"
    )


def _contra_sql(kind, place, hit):
    """Time, place in per cent and nearest frame of a contralateral event of each visit."""
    pct = f"CASE WHEN t_end <> t_start THEN (t_contra_{kind} - t_start) / (t_end - t_start) * 100 END"
    return f"""WITH {VISIT_SQL},
p AS (SELECT c.trial_id, c.cycle_no, c.t_start, c.t_end, {place} AS o_seq FROM cy c LEFT JOIN sq o
  ON o.trial_id = c.trial_id AND {hit[0]} GROUP BY c.trial_id, c.cycle_no, c.t_start, c.t_end),
x AS (SELECT p.trial_id, p.cycle_no, p.t_start, p.t_end, CASE WHEN {hit[1]} THEN o.t END AS t_contra_{kind}
  FROM p LEFT JOIN sq o ON o.trial_id = p.trial_id AND o.seq = p.o_seq),
fr AS (SELECT x.trial_id, x.cycle_no, arg_min(f.event_id, (abs(f.t - x.t_contra_{kind}), f.t, f.event_id)) AS frame
  FROM x JOIN ev f ON f.trial_id = x.trial_id AND f.label = 'error' WHERE x.t_contra_{kind} IS NOT NULL GROUP BY x.trial_id, x.cycle_no)
SELECT x.trial_id, x.cycle_no, t_contra_{kind}, {r6s(pct)} AS contra_{kind}_pct, frame FROM x LEFT JOIN fr USING (trial_id, cycle_no)"""


def _contra(spark, d, kind, **kw):
    frames = A.events(spark, d).where("label = 'error'").select("trial_id", "t", F.col("event_id").alias("frame"))
    found = C.central_frames(visits(spark, d, **kw), frames, KEY, cell_width=WEEK, time=f"t_contra_{kind}")
    return found.select("trial_id", "cycle_no", f"t_contra_{kind}", r6(f"contra_{kind}_pct").alias(f"contra_{kind}_pct"), "frame")


@query("previous_contra_event", _contra_sql("off", "max(o.seq)", ("o.seq < c.c_seq AND contains(o.label, 'r')", "o.label = 'error'")))
def previous_contra_event(spark, d):
    return _contra(spark, d, "off", contra_off=("r", "error"))


@query(
    "next_contra_event",
    _contra_sql("strike", "min(o.seq)", ("o.seq > c.s_seq AND contains(o.label, 's')", "o.label = 'purchase' AND o.t BETWEEN p.t_start AND p.t_end")),
)
def next_contra_event(spark, d):
    return _contra(spark, d, "strike", contra_strike=("s", "purchase"))


@query(
    "nearest_event_flag",
    f"""WITH {VISIT_SQL}
SELECT c.trial_id, c.cycle_no, arg_min(f.kinetic, (abs(f.t - c.t_start), f.t, f.label, f.event_id)) AS kinetic
FROM cy c JOIN ev f ON f.trial_id = c.trial_id AND f.label <> 'view' GROUP BY c.trial_id, c.cycle_no""",
)
def nearest_event_flag(spark, d):
    ev = A.events(spark, d).where("label <> 'view'").select("trial_id", "t", "label", "event_id", "kinetic")
    return C.cycle_flag(visits(spark, d), ev, KEY, "kinetic", cell_width=WEEK).select(
        "trial_id", "cycle_no", "kinetic"
    )


@query(
    "scheme_detect",
    f"""WITH {EV}, l AS (SELECT * FROM ev WHERE label = 'click'), r AS (SELECT * FROM ev WHERE label = 'view'),
m AS (SELECT l.trial_id, l.event_id, coalesce(bool_or(abs(l.t - r.t) < 36000), false) AS hit
  FROM l LEFT JOIN r ON r.trial_id = l.trial_id GROUP BY l.trial_id, l.event_id)
SELECT trial_id, count(*) AS n_left, count(*) FILTER (WHERE hit) AS n_matched,
  CASE WHEN avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 'exercise' ELSE 'locomotion' END AS scheme
FROM m GROUP BY trial_id""",
)
def scheme_detect(spark, d):
    return C.detect_scheme(
        A.events(spark, d),
        KEY,
        F.col("label") == "click",
        F.col("label") == "view",
        F.lit("x"),
        tolerance=36000.0,
        cell_width=WEEK,
    ).drop("share")


@query(
    "build_events",
    """WITH raw AS (SELECT user_id AS trial_id, event_id, epoch_us(ts) / 1e6 AS t,
  CASE WHEN event_id % 2 = 0 THEN 'Left' ELSE 'Right' END || ' ' || event_type AS label FROM events)
SELECT trial_id, event_id, t, label, row_number() OVER (PARTITION BY trial_id ORDER BY t, label, event_id) AS seq FROM raw""",
)
def build_events(spark, d):
    raw = A.events(spark, d).withColumns(
        {
            "context": F.when(F.col("event_id") % 2 == 0, "Left ").otherwise("Right"),
            "label": F.concat("label", F.lit(" ")),
        }
    )
    return C.build_events(raw, KEY, cell_width=WEEK).select("trial_id", "event_id", "t", "label", "seq")


@query(
    "filter_events",
    f"WITH {EV} SELECT trial_id, label, count(*) AS n FROM ev WHERE contains(label, 'ic') OR contains(label, 'up') GROUP BY trial_id, label",
)
def filter_events(spark, d):
    return (
        C.filter_events(A.events(spark, d), ["IC", "up"])
        .groupBy("trial_id", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "strikes_by_side",
    f"WITH {EV} SELECT DISTINCT trial_id, CASE WHEN kinetic THEN 'left' ELSE 'right' END AS side, t FROM ev WHERE label = 'click'",
)
def strikes_by_side(spark, d):
    ev = A.events(spark, d).withColumn("side", F.when(F.col("kinetic"), "left").otherwise("right"))
    return C.strikes_by_side(ev, "CLICK", KEY)


@query(
    "choose_time_row",
    f"""WITH {EV}, s AS (SELECT trial_id, coalesce(sum(abs(value)) FILTER (WHERE kinetic), -1.0) AS s1,
  coalesce(sum(abs(value)) FILTER (WHERE NOT kinetic), 0.0) AS s0 FROM ev GROUP BY trial_id)
SELECT e.trial_id, count(*) AS n, {r6s('sum(e.value)')} AS total FROM ev e JOIN s USING (trial_id)
WHERE e.kinetic = (s1 >= s0) GROUP BY e.trial_id""",
)
def choose_time_row(spark, d):
    rows = A.events(spark, d).select(
        "trial_id", F.col("kinetic").cast("int").alias("row"), F.col("value").alias("t")
    )
    return C.choose_time_row(rows, "trial_id").groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("t")).alias("total")
    )


@query(
    "turn_sequence",
    """WITH x AS (SELECT conv_id, role, lead(role, 1) OVER w AS r1, lead(role, 2) OVER w AS r2 FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, coalesce(bool_or(role = 'user' AND r1 = 'assistant' AND r2 = 'user'), false) AS matched FROM x GROUP BY conv_id""",
)
def turn_sequence(spark, d):
    ev = A.table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("label"))
    return C.has_sequence(
        ev, ["conv_id"], "turn", ["user", "assistant", "user"], cell=F.floor(F.col("turn") / 64).cast("bigint")
    )


@query(
    "missing_events",
    f"""WITH {EV}, u AS (SELECT DISTINCT trial_id FROM ev), x AS (SELECT unnest(['click', 'purchase', 'refund', 'view']) AS label),
m AS (SELECT u.trial_id, x.label FROM u, x WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.trial_id = u.trial_id AND ev.label = x.label AND ev.value > 40))
SELECT trial_id, string_agg(label, ',' ORDER BY label) AS missing FROM m GROUP BY trial_id""",
)
def missing_events(spark, d):
    ev = A.events(spark, d).withColumn("label", F.when(F.col("value") > 40, F.col("label")))
    return C.missing_required(ev, KEY, "label", ["click", "purchase", "refund", "view"]).select(
        "trial_id", F.array_join("missing", ",").alias("missing")
    )


@query(
    "missing_sections",
    """WITH s AS (SELECT DISTINCT conv_id, role FROM conversations), t AS (SELECT DISTINCT conv_id FROM conversations),
x AS (SELECT unnest(['assistant', 'system', 'user']) AS role)
SELECT t.conv_id, string_agg(x.role, ',' ORDER BY x.role) AS missing FROM t, x
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.conv_id = t.conv_id AND s.role = x.role) GROUP BY t.conv_id""",
)
def missing_sections(spark, d):
    conv = A.table(spark, d, "conversations")
    sections = conv.select("conv_id", F.col("role").alias("section"))
    out = C.missing_sections(
        sections, conv.select("conv_id").distinct(), "conv_id", ["assistant", "system", "user"]
    )
    return out.select("conv_id", F.array_join("missing", ",").alias("missing"))


@query(
    "strike_intervals",
    f"""WITH {EV}, s AS (SELECT DISTINCT trial_id, label, t FROM ev),
i AS (SELECT *, lead(t) OVER (PARTITION BY trial_id, label ORDER BY t) AS t_end FROM s)
SELECT i.trial_id, i.label, i.t AS t_start, i.t_end, count(*) AS n_samples FROM i JOIN ev x
ON x.trial_id = i.trial_id AND x.t BETWEEN i.t AND i.t_end WHERE i.t_end > i.t
GROUP BY i.trial_id, i.label, i.t, i.t_end HAVING count(*) >= 5""",
)
def strike_intervals(spark, d):
    ev = A.events(spark, d)
    return C.strike_intervals(
        ev.select("trial_id", "label", "t"),
        ev.select("trial_id", "t"),
        ["trial_id", "label"],
        sample_keys=KEY,
        min_samples=5,
        cell_width=WEEK,
    )


@query(
    "sampling_rate",
    f"""WITH {EV}, s AS (SELECT DISTINCT trial_id, t FROM ev), d AS (SELECT trial_id, t - lag(t) OVER (PARTITION BY trial_id ORDER BY t) AS dt FROM s),
m AS (SELECT trial_id, quantile_cont(dt, 0.5) AS q FROM d WHERE dt IS NOT NULL GROUP BY trial_id)
SELECT trial_id, round(q, 3) AS median_dt, round(3600 / q, 6) AS rate_per_hour FROM m""",
)
def sampling_rate(spark, d):
    return C.sampling_rate(A.events(spark, d), KEY, cell_width=WEEK).select(
        "trial_id",
        F.round("median_dt", 3).alias("median_dt"),
        F.round(3600 * F.col("rate"), 6).alias("rate_per_hour"),
    )


@query(
    "time_axes",
    f"""WITH x AS (SELECT vec_id AS sample_id, unnest(range(0, len(embedding))) AS idx, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)
SELECT sample_id, CAST(count(*) AS BIGINT) AS n, min(100 + sample_id + idx) AS first_frame, {r6s('min((100 + sample_id + idx) / 200.0 - 1.0 / 200.0)')} AS t_min,
{r6s('max((100 + sample_id + idx) / 200.0 - 1.0 / 200.0)')} AS t_max, {r6s('max(idx / 1000.0 + (100 + sample_id) / 200.0 - 1.0 / 200.0)')} AS analog_max
FROM x GROUP BY sample_id""",
)
def time_axes(spark, d):
    arr = A.waves(spark, d).select("sample_id", F.col("wave").alias("values"))
    start = (F.lit(100) + F.col("sample_id")).cast("double")
    pt = C.time_axes(arr, "point", F.lit(200.0), start)
    an = C.time_axes(arr, "analog", F.lit(1000.0), start / 200.0 - F.lit(1.0) / 200.0)
    a = pt.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("frame").alias("first_frame"),
        r6(F.min("t")).alias("t_min"),
        r6(F.max("t")).alias("t_max"),
    )
    return a.join(an.groupBy("sample_id").agg(r6(F.max("t")).alias("analog_max")), "sample_id")


@query(
    "trial_header",
    "SELECT p_partkey AS trial_id, CASE WHEN p_partkey % 7 = 0 THEN 'UNKNOWN' ELSE split_part(p_name, ' ', 1) END AS subject FROM part",
)
def trial_header(spark, d):
    t = A.table(spark, d, "part").select(
        F.col("p_partkey").alias("trial_id"),
        F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit(" "))).otherwise(F.split("p_name", " ")).alias("subjects"),
    )
    return C.trial_header(t).drop("subjects")


@query(
    "list_cycles",
    f"""WITH {VISIT_SQL},
g AS (SELECT c.trial_id, c.cycle_no, string_agg(DISTINCT x.label, ',' ORDER BY x.label) AS every,
  string_agg(DISTINCT x.label, ',' ORDER BY x.label) FILTER (WHERE x.label IN ('error', 'purchase')) AS hit
  FROM cy c JOIN ev x ON x.trial_id = c.trial_id AND x.t BETWEEN c.t_start AND c.t_end GROUP BY c.trial_id, c.cycle_no)
SELECT trial_id, cycle_no, coalesce(hit, every) AS groups,
  CASE WHEN cycle_no % 3 = 0 THEN CAST(cycle_no % 2 AS INTEGER) ELSE 1 END AS selected, true AS reconstruction_ok,
  CASE WHEN cycle_no % 3 = 0 AND cycle_no % 6 <> 0 THEN CAST(cycle_no AS INTEGER) END AS cluster FROM g""",
)
def list_cycles(spark, d):
    cyc = visits(spark, d).select("trial_id", "cycle_no", "t_start", "t_end")
    groups = C.slice_cycles(
        A.events(spark, d).select("trial_id", "t", F.col("label").alias("group")), cyc, KEY, cell_width=WEEK
    ).select("trial_id", "cycle_no", "group")
    n = F.col("cycle_no")
    flags = cyc.where(n % 3 == 0).select(
        "trial_id",
        "cycle_no",
        (n % 2).alias("selected"),
        F.lit(None).cast("boolean").alias("reconstruction_ok"),
        F.when(n % 6 == 0, "x").otherwise(n.cast("string")).alias("cluster"),
    )
    out = C.list_cycles(
        cyc.select("trial_id", "cycle_no"), groups, flags, ["trial_id", "cycle_no"], ["error", "purchase"]
    )
    return out.withColumn("groups", F.array_join("groups", ","))


@query(
    "kinetic_validity",
    f"""WITH e AS (SELECT user_id AS trial_id, event_id, epoch_us(ts) / 1e6 AS t, event_type, value AS x,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, CAST(event_id % 10 AS DOUBLE) AS z FROM events),
a AS (SELECT trial_id, event_id, t, CASE event_type WHEN 'click' THEN 'left' WHEN 'view' THEN 'right' END AS side FROM e),
pl AS (SELECT trial_id, event_type AS plate, CASE event_type WHEN 'signup' THEN 'left' ELSE 'right' END AS side,
  avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM e WHERE event_type IN ('signup', 'purchase') GROUP BY trial_id, event_type),
ph AS (SELECT p.*, max(abs(e.x - cx)) AS hx, max(abs(e.y - cy)) AS hy FROM pl p JOIN e ON e.trial_id = p.trial_id AND e.event_type = p.plate
  GROUP BY ALL),
n AS (SELECT a.trial_id, a.event_id, a.side, arg_min((m.x, m.y, m.z), (abs(m.t - a.t), m.t, m.event_id)) AS m
  FROM a JOIN e m ON m.trial_id = a.trial_id AND m.event_type = 'error' WHERE a.side IS NOT NULL GROUP BY a.trial_id, a.event_id, a.side),
k AS (SELECT DISTINCT n.trial_id, n.event_id FROM n JOIN ph USING (trial_id, side)
  WHERE abs(m[1] - cx) <= hx - 20 AND abs(m[2] - cy) <= hy - 10 AND abs(m[3] - cz) <= 3)
SELECT a.trial_id, a.event_id, k.event_id IS NOT NULL AS kinetic FROM a LEFT JOIN k USING (trial_id, event_id)""",
)
def kinetic_validity(spark, d):
    e = A.table(spark, d, "events").select(
        F.col("user_id").alias("trial_id"),
        "event_id",
        A.epoch_seconds("ts").alias("t"),
        "event_type",
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        (F.col("event_id") % 10).cast("double").alias("z"),
    )
    is_left, is_right = F.col("event_type") == "click", F.col("event_type") == "view"
    ev = e.select(
        "trial_id",
        "event_id",
        "t",
        F.when(is_left, "Left Foot Strike").when(is_right, "Right Foot Strike").otherwise("Sync").alias("label"),
    )
    points = e.where("event_type = 'error'").select(
        "trial_id", F.lit("heel").alias("marker"), F.col("event_id").alias("frame"), "t", "x", "y", "z"
    )
    plates = e.where(F.col("event_type").isin("signup", "purchase")).select(
        "trial_id",
        F.col("event_type").alias("plate"),
        F.when(F.col("event_type") == "signup", "Left").otherwise("Right").alias("side"),
        "x",
        "y",
        "z",
    )
    target = [("heel", -20.0, -10.0, 3.0)]
    return C.kinetic_validity(
        ev, points, plates, KEY, {"left": target, "right": target}, cell_width=WEEK
    ).select("trial_id", "event_id", "kinetic")


@query(
    "event_span",
    f"""WITH {EV} SELECT trial_id, count(*) AS n_events, min(t) AS t_first, max(t) AS t_last, {r6s('max(t) - min(t)')} AS duration,
{r6s('max(t) - 1704067200')} AS t_last_rel FROM ev GROUP BY trial_id""",
)
def event_span(spark, d):
    from ..operators.stats import event_span as span

    return span(A.events(spark, d), KEY, origin=1704067200.0).select(
        "trial_id", "n_events", "t_first", "t_last", r6("duration").alias("duration"), r6("t_last_rel").alias("t_last_rel")
    )


def _leaves(spark, d):
    li = A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cycle"),
        F.when(F.col("l_returnflag") == "R", "point")
        .when(F.col("l_returnflag") == "A", "SO_forces")
        .otherwise("analog")
        .alias("block"),
        F.col("l_linenumber").alias("leaf"),
        "l_quantity",
        "l_discount",
    )
    base = li.where("l_quantity <= 40").groupBy("cycle", "block", "leaf").agg(F.sum("l_quantity").alias("v"))
    patch = li.where("l_discount >= 0.03").groupBy("cycle", "block", "leaf").agg(
        (F.sum("l_quantity") + 1).alias("v")
    )
    return base, patch


LEAVES_SQL = """li AS (SELECT l_orderkey AS cycle, CASE l_returnflag WHEN 'R' THEN 'point' WHEN 'A' THEN 'SO_forces' ELSE 'analog' END AS block,
  l_linenumber AS leaf, l_quantity, l_discount FROM lineitem),
b AS (SELECT cycle, block, leaf, sum(l_quantity) AS v FROM li WHERE l_quantity <= 40 GROUP BY ALL),
p AS (SELECT cycle, block, leaf, sum(l_quantity) + 1 AS v FROM li WHERE l_discount >= 0.03 GROUP BY ALL)"""


@query(
    "overlay_merge",
    f"""WITH {LEAVES_SQL},
b2 AS (SELECT * FROM b WHERE cycle IN (SELECT cycle FROM p) AND NOT (block = 'point' AND cycle IN (SELECT cycle FROM p WHERE block = 'point'))),
p2 AS (SELECT * FROM p WHERE cycle IN (SELECT cycle FROM b) AND block <> 'analog')
SELECT cycle, block, leaf, coalesce(p2.v, b2.v) AS v, CASE WHEN p2.v IS NOT NULL THEN 'patch' ELSE 'base' END AS source
FROM b2 FULL OUTER JOIN p2 USING (cycle, block, leaf)""",
)
def overlay_merge(spark, d):
    base, patch = _leaves(spark, d)
    return J.overlay_merge(base, patch, ["cycle"], "block", "leaf", "v")


@query(
    "one_sided_keys",
    f"""WITH {LEAVES_SQL} SELECT DISTINCT cycle, 'only_base' AS side FROM b WHERE cycle NOT IN (SELECT cycle FROM p)
UNION ALL SELECT DISTINCT cycle, 'only_patch' AS side FROM p WHERE cycle NOT IN (SELECT cycle FROM b)""",
)
def one_sided_keys(spark, d):
    base, patch = _leaves(spark, d)
    return J.one_sided_keys(base, patch, ["cycle"], ("only_base", "only_patch"))


@query(
    "intersect_keys",
    f"WITH {LEAVES_SQL} SELECT cycle FROM b INTERSECT SELECT cycle FROM p",
)
def intersect_keys(spark, d):
    base, patch = _leaves(spark, d)
    return base.select("cycle").intersect(patch.select("cycle"))


@query(
    "outer_counts",
    f"""WITH {EV}, a AS (SELECT trial_id, label, count(*) AS n_a FROM ev WHERE value > 80 GROUP BY ALL),
b AS (SELECT trial_id, label, count(*) AS n_b FROM ev WHERE value < 20 GROUP BY ALL)
SELECT trial_id, label, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL OUTER JOIN b USING (trial_id, label)""",
)
def outer_counts(spark, d):
    ev = A.events(spark, d)
    return J.outer_counts(ev.where("value > 80"), ev.where("value < 20"), ["trial_id", "label"])


@query(
    "outer_merge",
    f"""WITH w AS (SELECT vec_id, label, list_sum(CAST(embedding AS DOUBLE[])) AS s FROM embeddings),
l AS (SELECT vec_id - vec_id % 2 AS sample, s AS left_sum FROM w WHERE vec_id % 2 = 0),
r AS (SELECT CASE WHEN label > 2 THEN vec_id - vec_id % 2 ELSE -vec_id END AS sample, s AS right_sum FROM w WHERE vec_id % 2 = 1)
SELECT sample, {r6s('left_sum')} AS left_sum, {r6s('right_sum')} AS right_sum FROM l FULL OUTER JOIN r USING (sample)""",
)
def outer_merge(spark, d):
    w = A.waves(spark, d).select(
        (F.col("sample_id") - F.col("sample_id") % 2).alias("sample"),
        "side",
        "cluster",
        F.aggregate("wave", F.lit(0.0), lambda a, x: a + x).alias("s"),
    )
    left = w.where("side = 'L'").select("sample", r6("s").alias("left_sum"))
    # samples of the first clusters have no counterpart
    key = F.when(F.col("cluster") > 2, F.col("sample")).otherwise(-F.col("sample") - 1)
    right = w.where("side = 'R'").select(key.alias("sample"), r6("s").alias("right_sum"))
    return left.join(right, "sample", "full_outer")


@query(
    "prefix_fallback",
    """WITH r AS (SELECT p_partkey AS rid, p_name || ' ' || p_brand || CASE WHEN p_partkey % 2 = 1 THEN '' ELSE ' spare' END AS rkey FROM part),
l AS (SELECT p_partkey AS lid, p_name || ' ' || p_brand AS lkey, p_name AS lbase FROM part),
x AS (SELECT l.lid, l.lkey, r.rid, r.rkey, 'exact' AS match FROM l JOIN r ON l.lkey = r.rkey),
f AS (SELECT l.lid, l.lkey, min((r.rkey, r.rid)) AS b FROM l JOIN r ON starts_with(r.rkey, l.lbase)
  WHERE l.lkey NOT IN (SELECT rkey FROM r) GROUP BY l.lid, l.lkey)
SELECT * FROM x UNION ALL SELECT lid, lkey, b[2] AS rid, b[1] AS rkey, 'prefix' AS match FROM f""",
)
def prefix_fallback(spark, d):
    p = A.table(spark, d, "part").select(
        "p_partkey", "p_name", F.concat_ws(" ", "p_name", "p_brand").alias("k")
    )
    # every second part has a counterpart, the others fall back
    other = F.when(F.col("p_partkey") % 2 == 1, F.col("k")).otherwise(F.concat("k", F.lit(" spare")))
    right = p.select(F.col("p_partkey").alias("rid"), other.alias("rkey"))
    left = p.select(
        F.col("p_partkey").alias("lid"), F.col("k").alias("lkey"), F.col("p_name").alias("lbase")
    )
    return J.exact_or_prefix(left, right, "lkey", "lbase", "rkey", ["rid"]).drop("lbase")


@query(
    "interpolate_at_events",
    f"""WITH {EV}, l AS (SELECT * FROM ev WHERE label = 'click'), r AS (SELECT trial_id, t, min(value) AS value FROM ev WHERE label = 'view' GROUP BY trial_id, t),
p AS (SELECT l.trial_id, l.event_id, l.t, max(r.t) FILTER (WHERE r.t <= l.t) AS t0, min(r.t) FILTER (WHERE r.t > l.t) AS t1
  FROM l LEFT JOIN r ON r.trial_id = l.trial_id GROUP BY l.trial_id, l.event_id, l.t)
SELECT p.trial_id, p.event_id, {r6s('CASE WHEN p.t = p.t0 THEN a.value ELSE a.value + (b.value - a.value) * (p.t - p.t0) / (p.t1 - p.t0) END')} AS sim_value
FROM p LEFT JOIN r a ON a.trial_id = p.trial_id AND a.t = p.t0 LEFT JOIN r b ON b.trial_id = p.trial_id AND b.t = p.t1""",
)
def interpolate_at_events(spark, d):
    ev = A.events(spark, d)
    return J.interpolate_at(
        ev.where("label = 'click'").select("trial_id", "event_id", "t"),
        ev.where("label = 'view'").select("trial_id", F.col("t").alias("ts"), "value"),
        KEY,
        "t",
        "ts",
        "value",
        "sim_value",
        cell_width=WEEK,
    ).select("trial_id", "event_id", r6("sim_value").alias("sim_value"))


@query(
    "patch_by_time",
    f"""WITH {EV}, src AS (SELECT trial_id, t, min(event_id) AS event_id FROM ev WHERE label = 'view' GROUP BY trial_id, t),
dt AS (SELECT trial_id, t - lag(t) OVER (PARTITION BY trial_id ORDER BY t) AS dt FROM src),
tol AS (SELECT trial_id, greatest(0.51 * quantile_cont(dt, 0.5), 1e-7) AS tol FROM dt WHERE dt IS NOT NULL GROUP BY trial_id),
l AS (SELECT * FROM ev WHERE label = 'click'),
g AS (SELECT l.trial_id, l.event_id, min(abs(l.t - s.t)) AS gap FROM l LEFT JOIN src s ON s.trial_id = l.trial_id GROUP BY l.trial_id, l.event_id),
h AS (SELECT g.*, coalesce(tol.tol, 1e-7) AS tol FROM g LEFT JOIN tol USING (trial_id))
SELECT trial_id, count(*) AS seen, count(*) FILTER (WHERE gap <= tol) AS replaced, count(*) FILTER (WHERE gap IS NULL OR gap > tol) AS missing,
  {r6s('max(gap)')} AS max_gap, CASE WHEN max(gap) IS NULL THEN 'missing_source' WHEN count(*) FILTER (WHERE gap > tol) > 0 THEN 'error'
  WHEN count(*) FILTER (WHERE gap <= tol) > 0 THEN 'patched' ELSE 'no_emg_replaced' END AS status
FROM h GROUP BY trial_id""",
)
def patch_by_time(spark, d):
    ev = A.events(spark, d)
    patched = P.patch_by_time(
        ev.where("label = 'click'").select("trial_id", "event_id", "t", "value"),
        ev.where("label = 'view'").select("trial_id", "event_id", "t", "value"),
        KEY,
        cell_width=WEEK,
    )
    return P.patch_report(patched, KEY).select(
        "trial_id", "seen", "replaced", "missing", r6("max_gap").alias("max_gap"), "status"
    )


@query(
    "align_window",
    f"""WITH {EV}, l AS (SELECT trial_id, seq - 1 AS idx, t FROM sq),
s AS (SELECT trial_id, idx - 3 AS idx, t FROM l WHERE idx >= 3),
n AS (SELECT trial_id, count(*) AS n FROM s GROUP BY trial_id),
r AS (SELECT l.trial_id, l.idx - s.idx AS o, count(DISTINCT s.idx) AS h FROM l JOIN s ON s.trial_id = l.trial_id AND abs(s.t - l.t) <= 1e-3 GROUP BY ALL)
SELECT r.trial_id, min(o) AS start_idx, any_value(n) AS n FROM r JOIN n USING (trial_id) WHERE h = n GROUP BY r.trial_id""",
)
def align_window(spark, d):
    from ..operators.ordered import ordered_scan

    ev = ordered_scan(A.events(spark, d), KEY, C.ORDER, row_no="seq", cell=time_cell("t", WEEK))
    long = ev.select("trial_id", (F.col("seq") - 1).alias("idx"), "t")
    short = long.where("idx >= 3").withColumn("idx", F.col("idx") - 3)
    return J.align_window(long, short, KEY, tol=1e-3)
