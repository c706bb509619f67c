"""Queries that replay the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from .. import streaming as S
from .events import VISIT, VISIT_SQL
from .registry import EV, query, r6, r6s

SLICES = 3


def _replayed(spark, table, order, *, twice=False):
    """``table`` as a stream of files that arrive in ``order``."""
    folder = S.shared_folder(spark, "arrivals")
    S.arrive(table, folder, order, SLICES)
    if twice:
        S.arrive(table, folder, order, 1)
    return S.files(spark, folder, table.schema)


def _drained(spark, stream):
    return S.drain(stream, S.shared_folder(spark, "stream-out"), S.shared_folder(spark, "stream-state"))[0]


@query(
    "online_cycles",
    f"""WITH {VISIT_SQL}, ck AS (SELECT trial_id, t, lead(t) OVER (PARTITION BY trial_id ORDER BY t, event_id) AS t_end,
  row_number() OVER (PARTITION BY trial_id ORDER BY t, event_id) AS cycle_no FROM ev WHERE label = 'click')
SELECT trial_id, 'visit' AS cycle_type, cycle_no, t_start, t_central, t_end FROM cy
UNION ALL SELECT trial_id, 'clicks', cycle_no, t, NULL, t_end FROM ck WHERE t_end IS NOT NULL""",
)
def online_cycles(spark, d):
    stream = _replayed(spark, A.events(spark, d).select("trial_id", "t", "label", "event_id"), "t")
    found = S.online_cycles(stream, {**VISIT, "clicks": ["click", "click"]}, ["trial_id"])
    return _drained(spark, found).drop("central_pct")


def _timed(spark, d):
    ev = A.table(spark, d, "events")
    return ev.select(F.col("user_id").alias("trial_id"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id"))


def _closing(rows):
    """One row of no series a year after the others, so that no window stays open."""
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 365 DAYS")).alias("ts"))
    none = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema}
    end = last.select(*[F.col("ts") if c == "ts" else none[c].alias(c) for c in rows.columns])
    return rows.unionByName(end)


def _epoch(c):
    return (F.unix_micros(c) / 1e6).alias(c)


@query(
    "stream_sessions",
    f"""WITH {EV}, b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY trial_id ORDER BY t, event_id) < 172800 THEN 0 ELSE 1 END AS fresh FROM ev),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY trial_id ORDER BY t, event_id) AS no FROM b)
SELECT trial_id, min(t) AS start, max(t) + 172800 AS "end", count(*) AS n, min(value) AS lowest, max(value) AS highest, {r6s('avg(value)')} AS mean FROM s GROUP BY trial_id, no""",
)
def stream_sessions(spark, d):
    """Sessions of events that follow one another within two days."""
    stream = _replayed(spark, _closing(_timed(spark, d)), "ts")
    found = _drained(spark, S.sessions(stream, ["trial_id"], "ts", "2 days", "value", delay="1 hour"))
    return found.where("trial_id IS NOT NULL").select("trial_id", _epoch("start"), _epoch("end"), "n", "lowest", "highest", r6("mean").alias("mean"))


@query(
    "stream_windows",
    f"""WITH {EV}, w AS (SELECT *, unnest([CAST(floor(t / 302400) AS BIGINT) * 302400, CAST(floor(t / 302400) AS BIGINT) * 302400 - 302400]) AS s FROM ev)
SELECT trial_id, CAST(s AS DOUBLE) AS start, CAST(s + 604800 AS DOUBLE) AS "end", count(*) AS n, min(value) AS lowest, max(value) AS highest, {r6s('avg(value)')} AS mean FROM w GROUP BY trial_id, s""",
)
def stream_windows(spark, d):
    """Weekly summaries that begin every half week."""
    stream = _replayed(spark, _closing(_timed(spark, d)), "ts")
    found = _drained(spark, S.sliding(stream, ["trial_id"], "ts", "604800 seconds", "302400 seconds", "value", delay="1 hour"))
    return found.where("trial_id IS NOT NULL").select("trial_id", _epoch("start"), _epoch("end"), "n", "lowest", "highest", r6("mean").alias("mean"))


@query("ingest_once", f"WITH {EV} SELECT trial_id, event_id, t, value FROM ev")
def ingest_once(spark, d):
    """All events delivered twice."""
    stream = _replayed(spark, _timed(spark, d), "ts", twice=True)
    found = _drained(spark, S.once(stream, ["event_id"], "ts", "3650 days"))
    return found.select("trial_id", "event_id", (F.unix_micros("ts") / 1e6).alias("t"), "value")
