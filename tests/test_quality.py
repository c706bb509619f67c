"""Edge rules of quality checks, selections and statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadencia.operators import quality as Q
from cadencia.operators import stats as S


def so(spark, fy, mx, n=100, rate=200.0):
    rows = [(1, i, i / rate, 0.0, fy, 0.0, mx, 0.0, 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "c int, idx long, t double, FX double, FY double, FZ double, MX double, MY double, MZ double")


def bounds(spark, a, b, rate=200.0):
    return spark.createDataFrame([(1, a, b, rate)], "c int, t_off double, t_strike double, rate double")


def plate(spark, fz, n=201):
    rows = [(1, "p", c, i, fz) for c in ("Fx", "Fy", "Fz") for i in range(n)]
    return spark.createDataFrame(rows, "c int, plate string, comp string, idx long, v double")


def test_window_trim(spark):
    w = Q.support_windows(so(spark, 1.0, 1.0), bounds(spark, 0.0, 0.495), ["c"]).first()
    assert (w.i0, w.i1, w.status) == (20, 79, "ok")


@pytest.mark.parametrize(
    "a, b, want",
    [(None, 0.4, "event_missing"), (0.3, 0.2, "event_order"), (0.2, 0.3, "window_empty"), (float("nan"), 0.4, "event_not_finite")],
)
def test_window_errors(spark, a, b, want):
    assert Q.support_windows(so(spark, 1.0, 1.0), bounds(spark, a, b), ["c"]).first().status == want


def test_equal_to_limit_fails_for_forces_and_passes_for_moments(spark):
    rules = Q.QcRules(force_rms=("abs", 6.0), force_max=("pcGRF", 20.0))
    s = so(spark, 6.0, 50.0)
    w = Q.support_windows(s, bounds(spark, 0.0, 0.495), ["c"], rules)
    f = Q.so_flags(w, Q.force_stats(s, w, ["c"]), Q.plate_stats(plate(spark, 31.0), w, ["c"]), ["c"], rules).first()
    assert (f.SO_F_RMS_ok, f.SO_F_MAX_ok, f.SO_M_RMS_ok, f.SO_M_MAX_ok) == (False, True, True, True)


def test_body_weight_limit(spark):
    rules = Q.QcRules(force_rms=("pcBW", 1.0), force_max=("pcBW", 1.0))
    s = so(spark, 6.0, 1.0)
    w = Q.support_windows(s, bounds(spark, 0.0, 0.495), ["c"], rules)
    bm = spark.createDataFrame([(1, 70.0)], "c int, bodymass double")
    f = Q.so_flags(w, Q.force_stats(s, w, ["c"]), Q.plate_stats(plate(spark, 1.0), w, ["c"]), ["c"], rules, bm).first()
    assert f.SO_F_RMS_ok  # 6 N against 6.867 N


def test_missing_marker_errors_pass(spark):
    e = spark.createDataFrame([], "c int, marker_error_RMS double, marker_error_max double")
    r = Q.ik_flags(e, spark.createDataFrame([(1,)], "c int"), ["c"]).first()
    assert r.IK_RMS_ok and r.IK_MAX_ok


def test_history(spark):
    """push, push, undo, undo, redo, redo; then a branch that is dropped."""
    ops = ["push", "push", "undo", "undo", "redo", "redo"]
    log = spark.createDataFrame([("s", i + 1, o) for i, o in enumerate(ops)], "s string, seq long, op string")
    ed = spark.createDataFrame([("s", 1, "a", 1, 0), ("s", 1, "b", 1, 0), ("s", 2, "a", 0, 1)], "s string, seq long, k string, old int, new int")

    def state(n):
        return {r.k: r.state for r in Q.replay_selection_log(log, ed, "s", "k", upto=n).collect()}

    assert state(1) == {"a": 0, "b": 0} and state(2) == {"a": 1, "b": 0}
    assert state(3) == {"a": 0, "b": 0} and state(4) == {"a": 1, "b": 1}
    assert state(5) == {"a": 0, "b": 0} and state(6) == {"a": 1, "b": 0}
    log2 = spark.createDataFrame([("s", 1, "push"), ("s", 2, "undo"), ("s", 3, "push")], "s string, seq long, op string")
    ed2 = spark.createDataFrame([("s", 1, "a", 1, 0), ("s", 3, "b", 1, 0)], "s string, seq long, k string, old int, new int")
    assert {r.k: r.state for r in Q.replay_selection_log(log2, ed2, "s", "k").collect()} == {"a": 1, "b": 0}


def test_percent_nodes(spark):
    lo, hi = S.percent_to_nodes(F.lit(50.0), F.lit(50.0))
    assert tuple(spark.range(1).select(lo, hi).first()) == (49, 51)


def test_number_of_tests(spark):
    got = spark.createDataFrame([(1,), (2,), (3,)], "k int").select(S.tests_for_clusters(F.col("k"))).collect()
    assert [r[0] for r in got] == [0, 1, 4]


def kruskal_h(a, b):
    v = np.concatenate([a, b])
    n = len(v)
    order = np.argsort(v, kind="stable")
    r = np.empty(n)
    r[order] = np.arange(1, n + 1)
    tie = 0
    for x in np.unique(v):
        m = v == x
        r[m] = r[m].mean()
        tie += m.sum() ** 3 - m.sum()
    h = 12 / (n * (n + 1)) * (r[: len(a)].sum() ** 2 / len(a) + r[len(a) :].sum() ** 2 / len(b)) - 3 * (n + 1)
    return h / (1 - tie / (n**3 - n))


def test_two_groups(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, 40) / 4, rng.integers(1, 10, 50) / 4
    df = spark.createDataFrame([("m", 0, float(x)) for x in a] + [("m", 1, float(x)) for x in b], "m string, g int, v double")
    r = S.compare_two_groups(df, ["m"], "g", "v").first()
    assert r.h == pytest.approx(kruskal_h(a, b)) and r.median_0 == np.median(a) and r.sd_1 == pytest.approx(b.std())
    flat = spark.createDataFrame([("m", i % 2, 1.0) for i in range(8)], "m string, g int, v double")
    assert S.compare_two_groups(flat, ["m"], "g", "v").first().verdict == "Test Failed"
    few = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 2.0), ("m", 1, 3.0)], "m string, g int, v double")
    assert S.compare_two_groups(few, ["m"], "g", "v").first().verdict == "Insufficient Data for Test"


def test_p_of_one_tenth_times_18_is_capped(spark):
    from cadencia.operators.stats import chi2_1_tail

    h = 2.705543454095404
    p = spark.createDataFrame([(h,)], "h double").select(chi2_1_tail("h")).first()[0]
    assert p == pytest.approx(0.1) and min(p * 18, 1.0) == 1.0
