"""Streams give what the batch operators give for the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from cadencia import streaming as S
from cadencia.operators import cycles

DEFINITIONS = {"turn": ["a", "b", "a"], "pair": ["a", "a"], "two": ["b", "c"], "same": ["a", "b", "b"]}
SCHEMA = "trial_id long, t double, label string, event_id long"


def made(seed, n=160):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2, None]), float(r.randint(0, n)), r.choice("abcd"), i) for i in range(n)]


def order(e):
    return e[1:]


def played(spark, tmp_path, batches, **kw):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows, late = None, 0
    for b in batches:  # a new run for each: the state goes on from the checkpoint
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = S.files(spark, src, spark.createDataFrame([], SCHEMA).schema, files_per_batch=2)
        rows, _ = S.drain(S.online_cycles(stream, DEFINITIONS, ["trial_id"], **kw), out, state)
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def batch(spark, events):
    ev = spark.createDataFrame(events, SCHEMA)
    got = cycles.extract_cycles(ev.where("trial_id IS NOT NULL"), DEFINITIONS, ["trial_id"], cell_width=10.0)
    return sorted((tuple(r) for r in got.select("trial_id", "cycle_type", "cycle_no", "t_start", "t_central", "t_end", "central_pct").collect()), key=repr)


@pytest.mark.parametrize("cuts", [[], [80], [1, 2, 159]])
def test_online_cycles_for_any_split(spark, tmp_path, cuts):
    events = sorted(made(len(cuts)), key=order)
    edges = [0, *cuts, len(events)]
    got = played(spark, tmp_path, [events[a:b] for a, b in zip(edges, edges[1:])])
    assert [r for r in got if r[0] is not None] == batch(spark, events)


def test_online_cycles_hold_events_back(spark, tmp_path):
    """Events that come up to 20 seconds out of order change nothing."""
    r = random.Random(5)
    events = [e for e in made(9) if e[0] is not None]
    mixed = sorted(events, key=lambda e: e[1] + r.uniform(0, 19))
    end = [(k, 1e6, "z", 10_000 + k) for k in (1, 2)]
    got = played(spark, tmp_path, [mixed[:70], mixed[70:], end], delay=20.0)
    assert got == batch(spark, events)


def test_late_events_are_reported(spark, tmp_path):
    first = [(1, 0.0, "a", 1), (1, 5.0, "b", 2), (1, 9.0, "a", 3)]
    got = played(spark, tmp_path, [first, [(1, 4.0, "a", 4)], [(1, 12.0, "a", 5)]])
    assert (1, "late", 4, 4.0, None, None, None) in got
    assert [r for r in got if r[1] != "late"] == batch(spark, [*first, (1, 12.0, "a", 5)])


def test_given_up_starts(spark, tmp_path):
    got = played(spark, tmp_path, [[(1, 0.0, "b", 1), (1, 50.0, "d", 2), (1, 60.0, "c", 3)]], patience=10.0)
    assert got == []


TIMED = "trial_id long, ts timestamp, value double"


def timed(spark, rows):
    return spark.createDataFrame([(k, float(s), v) for k, s, v in rows], "trial_id long, s double, value double").select("trial_id", F.timestamp_seconds("s").alias("ts"), "value")


@pytest.mark.parametrize("kind", ["sessions", "sliding"])
def test_windows_equal_the_batch_and_count_late_rows(spark, tmp_path, kind):
    r = random.Random(3)
    rows = sorted(((r.choice([1, 2]), r.randint(0, 4000), float(i)) for i in range(120)), key=lambda x: x[1])
    make = {"sessions": lambda d, **kw: S.sessions(d, ["trial_id"], "ts", "30 seconds", "value", **kw), "sliding": lambda d, **kw: S.sliding(d, ["trial_id"], "ts", "60 seconds", "20 seconds", "value", **kw)}[kind]
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    total = 0
    for part in (rows[:60], rows[60:], [(9, 10**6, 0.0)], [(1, 5, -1.0)], [(9, 2 * 10**6, 0.0)]):
        data = timed(spark, part)
        data.coalesce(1).write.mode("append").parquet(src)
        found, late = S.drain(make(S.files(spark, src, data.schema), delay="10 seconds"), out, state)
        total += late
    got = sorted(tuple(x) for x in found.where("trial_id <> 9").collect())
    assert got == sorted(tuple(x) for x in make(timed(spark, rows)).collect())
    assert total == (1 if kind == "sessions" else 3)


def test_files_delivered_twice_count_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    data = timed(spark, [(i, 1000 + i, float(i)) for i in range(50)])

    def run():
        return S.drain(S.once(S.files(spark, src, data.schema), ["trial_id"], "ts", "1 day"), out, state)[0].count()

    data.coalesce(2).write.mode("append").parquet(src)
    assert run() == 50
    data.coalesce(1).write.mode("append").parquet(src)
    assert run() == 50
    assert run() == 50
