"""Edge rules of events and cycles."""

import random

import pytest
from pyspark.sql import functions as F

from cadencia.operators import cycles as C
from cadencia.operators import joins as J
from cadencia.operators import patching as P
from cadencia.operators.ordered import exact_quantiles, ordered_scan, time_cell


def events(spark, text, trial="x"):
    rows = []
    for i, p in enumerate(text.split(",")):
        t, lab = p.strip().split(" ", 1)
        rows.append((trial, float(t), lab, i))
    return spark.createDataFrame(rows, "trial string, t double, label string, event_id long")


def cut(df, labels, width=1000.0, **kw):
    c = C.extract_cycles(df, {"c": labels}, ["trial"], cell_width=width, **kw).orderBy("cycle_no")
    cols = ["t_start", "t_central", "t_end"] if len(labels) == 3 else ["t_start", "t_end"]
    return [tuple(r) for r in c.select(*cols).collect()]


@pytest.mark.parametrize("width", [0.5, 2.0, 1000.0])
@pytest.mark.parametrize(
    "text, labels, want",
    [
        ("1 A, 2 B, 3 A, 4 B, 5 A", ["A", "B", "A"], [(1, 2, 3), (3, 4, 5)]),
        ("1 A, 2 A, 3 B, 4 A", ["A", "B", "A"], [(1, 3, 4), (2, 3, 4)]),
        ("1 A, 2 B", ["A", "B", "A"], []),
        ("1 A, 2 A, 4 A", ["A", "A"], [(1, 2), (2, 4)]),
        ("1 A, 2 A, 3 E", ["A", "E"], [(1, 3), (2, 3)]),
        ("1 A, 1 E", ["A", "E"], [(1, 1)]),
    ],
)
def test_cycles(spark, text, labels, want, width):
    """The result does not depend on where cells end."""
    assert cut(events(spark, text), labels, width) == [tuple(map(float, w)) for w in want]


def test_contralateral(spark):
    base = "1 L Strike, 2 R Off, 3 R Strike, 4 L Off, 5 L Strike"
    kw = {"contra_off": ("Off", "R Off"), "contra_strike": ("Strike", "R Strike"), "cell_width": 1.5}
    c = C.extract_cycles(events(spark, base), {"s": ["L Strike", "L Off", "L Strike"]}, ["trial"], **kw)
    r = c.first()
    assert (r.t_contra_off, r.t_contra_strike, r.central_pct) == (2.0, 3.0, 75.0)
    same = "1 L Strike, 2 L Off, 3 R Strike, 4 L Off, 5 L Strike"
    r = C.extract_cycles(events(spark, same), {"s": ["L Strike", "L Off", "L Strike"]}, ["trial"], **kw).first()
    assert r.t_contra_off is None  # nothing before the first Off
    late = "1 L Strike, 4 L Off, 5 L Strike, 6 R Strike"
    r = C.extract_cycles(events(spark, late), {"s": ["L Strike", "L Off", "L Strike"]}, ["trial"], **kw).first()
    assert r.t_contra_strike is None  # next strike is the same side


def test_boundary_sample_in_both(spark):
    s = spark.createDataFrame([("x", t) for t in (1.0, 1.5, 2.0)], "trial string, t double")
    c = spark.createDataFrame([("x", 1, 1.0, 2.0), ("x", 2, 2.0, 3.0)], "trial string, cycle_no int, t_start double, t_end double")
    got = C.slice_cycles(s, c, ["trial"], cell_width=0.7).groupBy("cycle_no").count().orderBy("cycle_no").collect()
    assert [tuple(r) for r in got] == [(1, 3), (2, 1)]


@pytest.mark.parametrize("gaps, want", [((0.019, 0.0199, 5, 5), "exercise"), ((5, 0.03), "locomotion"), ((0.02,), "locomotion")])
def test_scheme(spark, gaps, want):
    rows, n = [], 0
    for i, g in enumerate(gaps):
        rows += [("x", i * 100.0, "L", n), ("x", i * 100.0 + g, "R", n + 1)]
        n += 2
    e = spark.createDataFrame(rows, "trial string, t double, side string, event_id long")
    r = C.detect_scheme(e, ["trial"], F.col("side") == "L", F.col("side") == "R", F.lit("strike"), tolerance=0.02, cell_width=30.0)
    assert r.first().scheme == want


def test_has_sequence(spark):
    e = spark.createDataFrame([("x", i, s) for i, s in enumerate("SOSO")], "trial string, seq int, label string")
    assert C.has_sequence(e, ["trial"], "seq", ["S", "O", "S"]).first().matched
    assert not C.has_sequence(e, ["trial"], "seq", ["S", "S"]).first().matched
    assert C.has_sequence(e, ["trial"], "seq", []).first().matched


@pytest.mark.parametrize("ties, want", [("later", 1), ("earlier", 0)])
def test_nearest_ties(spark, ties, want):
    left = spark.createDataFrame([("x", 0.5)], "k string, t double")
    right = spark.createDataFrame([("x", 0.0, 0), ("x", 1.0, 1)], "k string, rt double, p int")
    r = J.nearest_asof(left, right, ["k"], "t", "rt", ["p"], ties=ties, cell_width=0.3).first()
    assert (r.p, r.gap) == (want, 0.5)


def test_interpolation_missing_outside(spark):
    left = spark.createDataFrame([("x", t) for t in (-0.1, 0.5, 1.1)], "k string, t double")
    right = spark.createDataFrame([("x", 0.0, 10.0), ("x", 1.0, 20.0)], "k string, rt double, v double")
    got = J.interpolate_at(left, right, ["k"], "t", "rt", "v", "y", cell_width=0.25).orderBy("t").collect()
    assert [r.y for r in got] == [None, 15.0, None]


@pytest.mark.parametrize("block, want", [("SO_x", {"a": 1, "b": 2}), ("point", {"a": 1})])
def test_overlay(spark, block, want):
    base = spark.createDataFrame([(1, block, "a", 0), (1, block, "b", 2), (2, block, "a", 9)], "c int, block string, leaf string, v int")
    patch = spark.createDataFrame([(1, block, "a", 1)], "c int, block string, leaf string, v int")
    got = J.overlay_merge(base, patch, ["c"], "block", "leaf", "v").collect()
    assert {r.leaf: r.v for r in got} == want


def test_prefix_only_without_any_exact(spark):
    t = spark.createDataFrame([(1, "ab01", "ab"), (2, "cd01", "cd")], "id int, core string, base string")
    ix = spark.createDataFrame([("ab01", "IK", "p1"), ("ab02", "ID", "p2"), ("cd09", "IK", "p3"), ("cd08", "IK", "p4")], "c string, key string, path string")
    got = J.exact_or_prefix(t, ix, "core", "base", "c", ["key", "path"], per=["key"])
    rows = sorted((r.id, r.key, r.path, r.match) for r in got.collect())
    assert rows == [(1, "IK", "p1", "exact"), (2, "IK", "p4", "prefix")]


def test_prefix_by_bases_of_many_lengths(spark):
    """Against plain Python: bases of several classes of lengths, empty and null ones, keys shorter than a base."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    left = [(i, f"{word(4)}!", word(i % 10)) for i in range(60)] + [(60, "abab", "ab"), (61, None, "ba"), (62, "c", None), (63, "d", "")]
    right = [(word(i % 14), rng.choice(["IK", "ID"]), f"p{i}") for i in range(80)] + [("abab", "IK", "q")]
    t = spark.createDataFrame(left, "id int, core string, base string")
    ix = spark.createDataFrame(right, "c string, key string, path string")
    got = sorted((r.id, r.c, r.key, r.path, r.match) for r in J.exact_or_prefix(t, ix, "core", "base", "c", ["key", "path"], per=["key"]).collect())
    want = []
    for i, core, base in left:
        if any(c == core for c, _, _ in right):
            want += [(i, c, k, p, "exact") for c, k, p in right if c == core]
        elif base is not None:
            for key in ("IK", "ID"):
                fits = [(c, p) for c, k, p in right if k == key and c.startswith(base)]
                want += [(i, min(fits)[0], key, min(fits)[1], "prefix")] if fits else []
    assert got == sorted(want)


def test_prefix_cuts_only_keys_that_begin_as_a_base(spark):
    bases = spark.createDataFrame([("zz" + "a" * n,) for n in range(2, 6)] + [("k1234",)], "_base string")
    keys = spark.createDataFrame([(f"k{i:09d}",) for i in range(500)] + [("k123456789",)], "c string")
    assert [(r.c, r._head) for r in J._heads(bases, keys, "c").collect()] == [("k123456789", "k1234")]


def test_equal_keys_are_paired_in_many_tasks(spark):
    t = spark.range(400).selectExpr("id", "concat('k', id % 40) AS core", "'x' AS base")
    got = J.exact_or_prefix(t, t.selectExpr("core AS c", "id AS rid"), "core", "base", "c", ["rid"])
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 4000 and len(tasks) > 10


def test_patch_status(spark):
    tg = spark.createDataFrame([("a", 1, 0.5, 0.0), ("b", 2, 9.0, 0.0), ("c", 3, 1.0, 0.0)], "k string, event_id long, t double, value double")
    src = spark.createDataFrame([(k, i, float(i), 5.0 + i) for k in "ab" for i in range(3)], "k string, event_id long, t double, value double")
    p = P.patch_by_time(tg, src, ["k"], cell_width=0.6)
    assert p.where("k = 'a'").first().new_value == 6.0  # later sample on a tie
    rep = {r.k: r.status for r in P.patch_report(p, ["k"]).collect()}
    assert rep == {"a": "patched", "b": "error", "c": "missing_source"}


def test_scan_matches_plain_python(spark):
    """A series that holds nearly all rows, cut into many cells."""
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.9 else f"k{rnd.randrange(3)}", float(rnd.randrange(500)), i, rnd.choice("ABC")) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t double, id long, lab string")
    got = ordered_scan(
        df, ["k"], ["t", "id"],
        prevs={"p": F.when(F.col("lab") == "A", F.col("id"))},
        nexts={"n": F.when(F.col("lab") == "B", F.col("id"))},
        totals={"s": F.when(F.col("lab") == "C", F.lit(1)).otherwise(0)},
        chained={"x": (F.when(F.col("lab") == "C", F.col("id")), ["n", "p"])},
        row_no="r", cell=time_cell("t", 7.0),
    ).collect()
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        s = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        ids = [r[2] for r in s]
        by_id = {g.id: g for g in got if g.k == key}
        near = lambda idx, lab: next((s[j][2] for j in idx if s[j][3] == lab), None)
        for i, r in enumerate(s):
            g = by_id[r[2]]
            assert g.r == i + 1
            assert g.p == near(range(i - 1, -1, -1), "A")
            assert g.n == near(range(i + 1, len(s)), "B")
            assert g.s == sum(x[3] == "C" for x in s[:i])
            c = near(range(i + 1, len(s)), "C")
            if c is None:
                assert g.x is None
            else:
                j = ids.index(c)
                assert (g.x.at, g.x.n, g.x.p) == (c, near(range(j + 1, len(s)), "B"), near(range(j - 1, -1, -1), "A"))


@pytest.mark.parametrize("kind", ["uniform", "heavy", "ties", "one"])
def test_exact_quantiles(spark, kind):
    import numpy as np

    rnd = np.random.default_rng(1)
    v = {
        "uniform": rnd.random(999),
        "heavy": np.append(rnd.random(500) * 3, 1e12),
        "ties": rnd.integers(0, 4, 300).astype(float),
        "one": np.array([4.5]),
    }[kind]
    df = spark.createDataFrame([("g", float(x)) for x in v] + [("g", float("nan"))], "g string, v double")
    probs = {"a": 0.025, "b": 0.5, "c": 0.9, "d": 1.0}
    got = exact_quantiles(df, ["g"], "v", probs).first()
    for n, p in probs.items():
        assert got[n] == pytest.approx(np.quantile(v, p), rel=1e-12)
    whole = exact_quantiles(df, [], "v", probs).first()
    assert whole["b"] == pytest.approx(np.quantile(v, 0.5), rel=1e-12)


def test_definitions_share_one_scan(spark):
    """Any number of definitions reads the events once and shuffles them once."""
    ev = spark.range(100).selectExpr("id % 3 AS trial", "CAST(id AS double) AS t", "CASE id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS label", "id AS event_id")
    many = {f"d{i}": x for i, x in enumerate([["a", "b"], ["a", "a"], ["a", "b", "a"], ["b", "c"], ["b", "a", "c"]])}
    plans = [C.extract_cycles(ev, d, ["trial"], cell_width=5.0)._jdf.queryExecution().optimizedPlan().toString() for d in (dict([next(iter(many.items()))]), many)]
    assert plans[0].count("Range") == plans[1].count("Range") <= 2 and plans[1].count("Join") == plans[0].count("Join")
    together = sorted(map(tuple, C.extract_cycles(ev, many, ["trial"], cell_width=5.0).collect()), key=repr)
    apart = [tuple(r) for k, v in many.items() for r in C.extract_cycles(ev, {k: v}, ["trial"], cell_width=5.0).collect()]
    assert together == sorted(apart, key=repr)
