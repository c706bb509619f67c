"""Waves, distances, clustering and repair on small planted data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadencia import adapters as A
from cadencia.functions import arrays as X
from cadencia.functions import kernels as N
from cadencia.operators import cluster as C
from cadencia.operators import pairwise as P
from cadencia.operators import repair as R
from cadencia.operators import signal as S
from cadencia.operators import waves as V
from cadencia.plans import QUERIES


def frame(spark, rows, cols="sample_id long, label int, wave array<double>"):
    return spark.createDataFrame([(*r[:-1], [float(x) for x in r[-1]]) for r in rows], cols)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(7)
    t = np.linspace(0, 1, 40)
    base = [np.sin(2 * np.pi * t), np.cos(2 * np.pi * t) * 2]
    return [(i, i % 2, base[i % 2] + 0.05 * rng.normal(size=40)) for i in range(24)]


@pytest.mark.parametrize("metric", ["dtw", "euclidean"])
@pytest.mark.parametrize("blocks", [1, 3])
def test_sums_equal_the_matrix(spark, planted, metric, blocks):
    rows = planted[:12]
    x = np.stack([r[2] for r in rows])[:, :, None]
    d = np.array([[N.distance(metric, a[None], b[None])[0] for b in x] for a in x])
    got = P.cluster_sums(frame(spark, rows), metric, n_blocks=blocks).collect()
    lab = np.array([r[1] for r in rows])
    assert len(got) == 24
    for g in got:
        m = (lab == g.other) & (np.arange(12) != g.sample_id)
        v = d[g.sample_id][m]
        assert (g.n, g.total, g.low, g.high) == (len(v), pytest.approx(v.sum()), pytest.approx(v.min()), pytest.approx(v.max()))
    same = P.cluster_sums(frame(spark, rows), metric, n_blocks=blocks, same_only=True).collect()
    assert {(g.sample_id, g.other) for g in same} == {(i, l) for i, l in enumerate(lab)}


def test_soft_dtw_shift(spark, planted):
    rows = planted[:8]
    x = np.stack([r[2] for r in rows])[:, :, None]
    d = np.array([[N.distance("softdtw", a[None], b[None], 0.1)[0] for b in x] for a in x])
    d -= d.min()
    np.fill_diagonal(d, 0)
    lab = np.array([r[1] for r in rows])
    for g in P.soft_dtw_sums(frame(spark, rows), 0.1, n_blocks=2).collect():
        m = (lab == g.other) & (np.arange(8) != g.sample_id)
        v = d[g.sample_id][m]
        assert g.total == pytest.approx(v.sum()) and g.squares == pytest.approx((v**2).sum()) and g.low == pytest.approx(v.min())


def test_metrics_by_hand(spark):
    """Two tight pairs on a line: 0, 1 and 10, 11."""
    rows = [(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [10.0]), (3, 1, [11.0])]
    w = frame(spark, rows)
    s = P.cluster_sums(w, "euclidean", n_blocks=2)
    sil = {r.sample_id: r.s for r in C.silhouette(s).collect()}
    assert sil[0] == pytest.approx((10.5 - 1) / 10.5) and sil[1] == pytest.approx((9.5 - 1) / 9.5)
    m = {r.label: (r.medoid, r.scatter) for r in C.medoids(s).collect()}
    assert m == {0: (0, 0.5), 1: (2, 0.5)}
    assert C.davies_bouldin(C.medoids(s), w, "euclidean").first()[0] == pytest.approx(0.1)
    wb = {(r.kind, r.label): r for r in C.within_between(s).collect()}
    assert wb[("within", 0)].n == 1 and wb[("between", None)].mean == 10 and wb[("between", None)].min == 9


def test_cluster_of_one(spark):
    w = frame(spark, [(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [9.0])])
    s = P.cluster_sums(w, "euclidean", n_blocks=1)
    assert {r.sample_id: r.s for r in C.silhouette(s).collect()}[2] == 0.0
    assert {r.label: r.mean for r in C.within_between(s).where("kind = 'within'").collect()}[1] is None


def test_clusterings_find_planted_groups(spark, planted):
    w = frame(spark, planted)
    k = C.kmedoids(w, 2, "dtw", n_init=2).select("sample_id", "label")
    b = C.bisecting(w, [2]).select("sample_id", "label")
    for got in (k, b):
        lab = {r.sample_id: r.label for r in got.collect()}
        assert len({lab[i] for i in range(0, 24, 2)}) == 1 and len({lab[i] for i in range(24)}) == 2
    scores = C.grid_search(w, [2, 3], [0.05], n_init=1)
    assert C.choose_best(scores).first().k == 2


def test_own_sums_are_enough_for_medoids(spark):
    """Clusters of very different sizes, one of one wave, and waves without a cluster."""
    rng = np.random.default_rng(3)
    label = lambda i: None if i % 50 == 7 else 2 if i == 11 else int(i % 10 == 0)
    w = spark.createDataFrame([(i, label(i), rng.normal(size=5).tolist()) for i in range(300)], "sample_id long, label int, wave array<double>").cache()
    key = lambda df: {r.label: (r.medoid, pytest.approx(r.scatter), r["size"]) for r in df.collect()}
    assert key(C.medoids(C.own_sums(w, "euclidean"))) == key(C.medoids(P.cluster_sums(w, "euclidean")))
    blocks = {r.label: r._k for r in P._own_blocks(w).collect()}
    assert blocks[0] > 4 * blocks[1] > 0 and blocks[2] == 1 and None not in blocks


def test_kernels_get_a_bounded_number_of_points():
    from cadencia.operators.rows import POINTS, stacked

    one = pd.Series([np.full(64, float(i)) for i in range(3000)])
    two = pd.Series([np.full(64 if i % 3 else 10, -float(i)) for i in range(3000)])
    seen = []
    for at, (x, y) in stacked([one, two]):
        assert x.size + y.size <= POINTS and (x[:, 0] == at).all() and (y[:, 0] == -at).all()
        seen += at.tolist()
    assert sorted(seen) == list(range(3000))


def test_kmedoids_computes_a_set_of_members_once(spark):
    """Three planted groups and a lone wave against all pairs on the driver."""
    rng = np.random.default_rng(4)
    t = np.linspace(0, 1, 20)
    shapes = [np.sin(2 * np.pi * t), 2 * t, np.cos(6 * np.pi * t)]
    x = np.array([shapes[i % 3] + 0.2 * rng.standard_normal(20) for i in range(60)])
    ids = list(range(60))
    w = frame(spark, [(i, 0, x[i].tolist()) for i in ids])
    d = np.array([N.dtw(np.repeat(x[i : i + 1, :, None], 60, 0), x[:, :, None]) for i in ids])
    want = []
    for start in range(4):
        meds = [r[0] for r in w.orderBy(F.xxhash64("sample_id", F.lit(42 + start)), "sample_id").limit(3).select("sample_id").collect()]
        while True:
            lab = d[:, meds].argmin(axis=1)
            new = [np.flatnonzero(lab == c)[d[np.ix_(lab == c, lab == c)].sum(axis=1).argmin()] for c in range(3)]
            if new == meds:
                break
            meds = new
        want.append((d[:, meds].min(axis=1).sum(), lab, meds))
    cost, lab, meds = min(want, key=lambda r: round(r[0], 9))
    work = {}
    got = {r.sample_id: r for r in C.kmedoids(w, 3, "dtw", n_init=4, work=work).collect()}
    assert [got[i].label for i in ids] == lab.tolist()
    assert np.allclose([got[i].d for i in ids], d[ids, np.array(meds)[lab]])
    assert 0 < 2 * work["pairs"] <= work["all_pairs"]


def test_kmedoids_of_few_waves(spark):
    w = frame(spark, [(0, 0, [0.0, 1.0]), (1, 0, [0.0, 1.0])])
    assert {(r.sample_id, r.label, r.d) for r in C.kmedoids(w, 3, "dtw").collect()} == {(0, 0, 0.0), (1, 0, 0.0)}
    assert C.kmedoids(w.where("sample_id < 0"), 3, "dtw", n_blocks=1).count() == 0


def test_choose_best_ties_and_missing(spark):
    df = spark.createDataFrame([(3, 0.5), (2, 0.5), (4, None), (5, float("nan"))], "k int, silhouette double")
    assert C.choose_best(df).first().k == 2


def test_component_of_equal_waves_and_weights(spark, planted):
    w = frame(spark, [(i, 0, planted[0][2]) for i in range(5)])
    assert np.allclose(V.pca_wave(w, ["label"]).first().wave, planted[0][2])
    df = frame(spark, planted).repartition(5)
    got = {r.label: r.wave for r in V.pca_wave(df, ["label"]).collect()}
    for lab in (0, 1):
        x = np.stack([r[2] for r in planted if r[1] == lab])
        assert np.allclose(got[lab], N.first_component(x.T @ x, x.mean(axis=0)))
    twice = df.withColumn("q", F.lit(2))
    assert np.allclose(V.pca_wave(twice, ["label"], weight="q").where("label = 0").first().wave, got[0])


def test_many_waves_shrink(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) + 1
    df = frame(spark, [(i, 0, r) for i, r in enumerate(x)]).repartition(6)
    p = V.component_parts(df, ["label"]).first()
    assert p.n == 500 and len(p.rows) == 8
    assert np.allclose(V.pca_wave(df, ["label"]).first().wave, N.first_component(x.T @ x, x.mean(axis=0)))


def test_leave_one_out(spark, planted):
    rows = [r for r in planted if r[1] == 0]
    got = V.leave_one_out(frame(spark, rows), ["label"], "sample_id", per_task=4).collect()
    assert len(got) == len(rows)
    for g in got:
        others = np.stack([r[2] for r in rows if r[0] != g.sample_id])
        w = np.stack([r[2] for r in rows if r[0] == g.sample_id])
        want = N.first_component(others.T @ others, others.mean(axis=0))
        assert np.allclose(g.loo_wave, want) and g.mad == pytest.approx(N.mad_rows(w, want[None])[0])


def test_channels_that_change_halfway_are_not_validated(spark, monkeypatch):
    """One channel changes its shape after half of its waves, another holds one reversed wave."""
    rng = np.random.default_rng(2)
    t = np.linspace(0, 2 * np.pi, 64)
    rows = []
    for sid in range(6):
        for label in ("m0", "m1"):
            for k in range(20):
                shape = np.cos(9 * t) if (sid, label) == (2, "m1") and k >= 10 else np.sin(t)
                shape = -shape if (sid, label, k) == (1, "m0", 7) else shape
                rows.append((len(rows), sid, "L", label, 0, [float(x) for x in 2 + shape + 0.1 * rng.normal(size=64)]))
    w = spark.createDataFrame(rows, "sample_id long, subject long, side string, label string, cluster int, wave array<double>")
    cell = F.lit(0).cast("bigint")
    _, stats = V.homogeneity(w, ["subject", "label"], "sample_id", max_lag=3, cell=cell)
    got = {(r.subject, r.label): r for r in stats.collect()}
    assert [k for k, r in got.items() if r.homogeneity_flag] == [(2, "m1")]
    assert got[1, "m0"].n_outliers == 1 and got[1, "m0"].n_cycles == 19
    monkeypatch.setattr(A, "waves", lambda *_: w)
    done = {(r.sid, r.label): r for r in QUERIES["validate_channels"](spark, "").collect()}
    assert [k for k, r in done.items() if "homogeneity" in r.reasons] == [(2, "m1")]


def test_bootstrap_brackets_the_trace(spark, planted):
    b = V.bootstrap_waves(frame(spark, planted), ["label"], "sample_id", n_boot=30, seed=3, cell=F.lit(0).cast("bigint"))
    r = b.where("label = 0").first()
    assert np.allclose(r.mean, planted[0][2], atol=0.2) and (np.array(r.p2_5) <= np.array(r.p97_5)).all()
    again = V.bootstrap_waves(frame(spark, planted).repartition(7), ["label"], "sample_id", n_boot=30, seed=3, cell=F.lit(0).cast("bigint"))
    assert np.allclose(again.where("label = 0").first().mean, r.mean)


def test_bootstrap_query_runs_the_replicates_of_the_original(spark):
    """Limits of the query, and of blocks of 7 traces, against a plain bootstrap."""
    d = "/root/testdata/sf0.001"
    w = A.waves(spark, d).where("label = 'm0'")
    x = np.stack([r.wave for r in w.select("wave").collect()])
    rng = np.random.default_rng(5)
    plain = []
    for _ in range(4000):
        y = x[rng.integers(0, len(x), len(x))]
        plain.append(N.first_component(y.T @ y, y.mean(axis=0)))
    plain = np.array(plain)
    got = {r.idx: r for r in QUERIES["bootstrap"](spark, d).where("label = 'm0'").collect()}
    small = V.bootstrap_waves(w, ["label"], "sample_id", n_boot=4000, seed=2, cell=F.lit(0).cast("bigint"), block=7).first()
    for name, q in (("p2_5", 2.5), ("p97_5", 97.5)):
        off = np.array([[got[i][name], small[name][i]] for i in range(x.shape[1])]) - np.percentile(plain, q, axis=0)[:, None]
        assert (np.abs(off) < 0.25 * plain.std(axis=0)[:, None]).all()


def test_ramps_differ_at_both_ends(spark):
    rng = np.random.default_rng(0)
    t = np.linspace(0, 1, 101)
    rows = [(i, i % 2, (t if i % 2 else 1 - t) + 0.3 * rng.normal(size=101)) for i in range(100)]
    iv = V.curve_significance(frame(spark, rows), "label", 0, 1, "sample_id", alpha=0.05, n_perm=200).collect()
    assert any(r.pct_to < 50 for r in iv) and any(r.pct_from > 50 for r in iv) and all(0 <= r.p <= 0.06 for r in iv)


def test_array_rules(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, None],), ([0.0, 0.0],), ([None, None],)], "a array<double>")
    got = [r[0] for r in df.select(X.max_normalise("a")).collect()]
    assert got[0] == pytest.approx([100 / 3, 200 / 3, 100, 100]) and got[1] == [0, 0] and got[2] == [0, 0]
    c = spark.createDataFrame([([1.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0])], "a array<double>, b array<double>")
    assert c.select(X.pearson("a", "b")).first()[0] == 0.0
    assert spark.createDataFrame([([1.0] * 4,)], "a array<double>").select(X.snr("a")).first()[0] is None
    rolled = c.select(X.roll("b", 2), X.roll("b", -1)).first()
    assert rolled[0] == [4, 5, 1, 2, 3] and rolled[1] == [2, 3, 4, 5, 1]


def test_central_interval_needs_two(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", float("nan"))], "g string, v double")
    r = {x.g: x for x in V.central_interval(df, ["g"], "v").collect()}
    assert r["a"].low is None and r["a"].n == 1 and r["b"].low == pytest.approx(1.1)


def test_long_envelope_equals_whole_series(spark):
    """Filtering in chunks gives what filtering the whole series gives."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=6000) + 3
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "k string, idx long, v double")
    st = S.EnvelopeSettings()
    got = S.envelope_long(df, ["k"], "v", 1000.0, st, chunk=100).orderBy("idx").collect()
    want = S._envelope(x[None], 1000.0, st)[0]
    assert [r.idx for r in got] == list(range(6000))
    assert np.allclose([r.v for r in got], want, atol=1e-9)


def test_unknown_rate_and_other_channels_pass_through(spark):
    rows = [(t, ch, i, float(i % 7)) for t, ch in (("a", "EMG 1"), ("a", "Force"), ("b", "EMG 1")) for i in range(60)]
    s = spark.createDataFrame(rows, "trial_id string, channel string, idx long, v double")
    rates = spark.createDataFrame([("a", 1000.0), ("b", None)], "trial_id string, rate double")
    out = S.preprocess_before_split(s, rates, ["trial_id", "channel"], "v")
    j = out.join(s.withColumnRenamed("v", "old"), ["trial_id", "channel", "idx"])
    same = {(r.trial_id, r.channel): r.same for r in j.groupBy("trial_id", "channel").agg(F.bool_and(F.col("v") == F.col("old")).alias("same")).collect()}
    assert same == {("a", "EMG 1"): False, ("a", "Force"): True, ("b", "EMG 1"): True}


def test_swapped_sides_are_found(spark):
    """Subject 0 has left and right of one muscle exchanged."""
    t = np.arange(100)
    rng = np.random.default_rng(2)
    curve = lambda c: np.exp(-(((t - c + 50) % 100 - 50) ** 2) / 60.0)
    centre = {"R1": 20, "L1": 80, "R2": 45, "L2": 5}
    rows = []
    for sid in range(6):
        for lab, c in centre.items():
            real = {"R1": "L1", "L1": "R1"}.get(lab, lab) if sid == 0 else lab
            rows.append((sid, lab, curve(centre[real]) + 0.01 * rng.normal(size=100)))
    tr = frame(spark, rows, "sid int, label string, wave array<double>")
    g = frame(spark, [(lab, curve(c)) for lab, c in centre.items()], "label string, wave array<double>")
    facts = spark.createDataFrame([(lab, lab[0], lab[1], lab[1], None) for lab in centre], "label string, side string, muscle_key string, canon string, close_group int")
    fl = R.compare_to_global(tr, g, max_lag=3)
    sc = R.score_candidates(fl, g, R.candidates(facts), max_lag=3, lr_lags=(0, 3))
    dec = {(r.sid, r.label): r for r in R.suggest_remap(sc, fl).collect()}
    assert dec[(0, "R1")].decision == "suggest_lr" and dec[(0, "R1")].target == "L1"
    assert dec[(0, "L1")].target == "R1"
    assert all(r.decision == "unsure_ci" for k, r in dec.items() if k[0] != 0)
    mp = R.mapping_of(R.suggest_remap(sc, fl))
    fb = spark.createDataFrame([(0, "R1", "L1", "ok", 1), (3, "R2", "L2", "swap", 1), (0, "L1", "x", "unsure", 1)], "sid int, label string, candidate string, response string, seq int")
    assert sorted(tuple(r) for r in R.apply_feedback(mp, fb).collect()) == [(0, "L1", "R1"), (3, "R2", "L2")]
    exp = spark.createDataFrame([(0, "ok")], "sid int, mode string")
    tune = R.tune_thresholds(tr, g, facts, exp, fb, [0.1], [0.2], max_lag=3, lr_lags=(0, 3), iterations=2).collect()
    assert len(tune) == 1 and 0 <= tune[0].feedback_f1 <= 1 and tune[0].n_subjects == 6


def test_a_target_is_used_once(spark):
    cols = "sid int, label string, base_corr double, base_mad double"
    fl = spark.createDataFrame([(1, "a", 0.1, 1.0), (2, "a", 0.1, 1.0)], cols)
    sc = spark.createDataFrame(
        [(s, "a", 0.1, 1.0, "z", "close", 0.9, 0.0, 0.1, 0.8, 0.9, 1.7) for s in (1, 2)],
        cols + ", candidate string, stage string, corr double, lag double, mad double, corr_up double, mad_down double, score double",
    )
    got = {r.sid: r.decision for r in R.suggest_remap(sc, fl).collect()}
    assert got == {1: "suggest_close", 2: "unsure_target_used"}


def test_envelopes_of_several_rates_in_one_pass(spark):
    from cadencia.operators import signal as S

    rng = np.random.default_rng(3)
    fast, slow = rng.standard_normal(3000), rng.standard_normal(2000)
    rows = [("f", "EMG a", i, float(v)) for i, v in enumerate(fast)] + [("s", "EMG a", i, float(v)) for i, v in enumerate(slow)] + [("n", "EMG a", i, 1.0 + i) for i in range(8)]
    df = spark.createDataFrame(rows, "trial_id string, channel string, idx long, v double")
    rates = spark.createDataFrame([("f", 2000.0), ("s", 800.0), ("n", None)], "trial_id string, rate double")
    got = S.preprocess_before_split(df, rates, ["trial_id", "channel"], "v").toPandas().sort_values(["trial_id", "idx"])
    for trial, x, rate in (("f", fast, 2000.0), ("s", slow, 800.0)):
        one = spark.createDataFrame([(trial, i, float(v)) for i, v in enumerate(x)], "k string, idx long, v double")
        want = S.envelope_long(one, ["k"], "v", rate, chunk=10_000).toPandas().sort_values("idx")
        assert np.allclose(got[got["trial_id"] == trial]["v"], want["v"], atol=1e-9)
    assert got[got["trial_id"] == "n"]["v"].tolist() == [1.0 + i for i in range(8)]


def test_groups_of_few_cycles_get_no_trace(spark):
    """A group of one wave, or two, has no trace, no statistics and no part in the limits."""
    rng = np.random.default_rng(4)
    t = np.linspace(0, 2 * np.pi, 32)
    sizes = {(0, "m0"): 8, (1, "m0"): 1, (2, "m0"): 2, (3, "m0"): 3}
    rows = [(s, lab, 100 * s + k, [float(x) for x in 2 + np.sin(t) + 0.1 * rng.normal(size=32)]) for (s, lab), n in sizes.items() for k in range(n)]
    w = spark.createDataFrame(rows, "subject long, label string, sample_id long, wave array<double>")
    traces, stats = V.homogeneity(w, ["subject", "label"], "sample_id", max_lag=3, cell=F.lit(0).cast("bigint"))
    assert sorted(r.subject for r in traces.collect()) == sorted(r.subject for r in stats.collect()) == [0, 3]


def test_unknown_labels_do_not_lower_the_accuracy(spark):
    """A label of unknown muscle can't be expected to be swapped."""
    t = np.arange(100)
    rng = np.random.default_rng(2)
    curve = lambda c: np.exp(-(((t - c + 50) % 100 - 50) ** 2) / 60.0)
    centre = {"R1": 20, "L1": 80}
    swapped = [(0, a, curve(centre[b]) + 0.01 * rng.normal(size=100)) for a, b in (("R1", "L1"), ("L1", "R1"))]
    rows = swapped + [(s, a, curve(c) + 0.01 * rng.normal(size=100)) for s in range(1, 6) for a, c in centre.items()]
    cols = "sid int, label string, wave array<double>"
    g = frame(spark, [(a, curve(c)) for a, c in centre.items()] + [("X", curve(50))], "label string, wave array<double>")
    facts = spark.createDataFrame([(a, a[0], a[1], a[1], None) for a in centre], "label string, side string, muscle_key string, canon string, close_group int")
    fb = spark.createDataFrame([], "sid int, label string, candidate string, response string, seq int")
    exp = spark.createDataFrame([(0, "lr")], "sid int, mode string")

    def expected(more):
        out = R.tune_thresholds(frame(spark, rows + more, cols), g, facts, exp, fb, [0.1], [0.2], max_lag=3, lr_lags=(0, 3), iterations=1).collect()
        return out[0].expected_score

    assert expected([(0, "X", curve(50))]) == expected([]) > 5


def test_homogeneity_of_sources(spark):
    rng = np.random.default_rng(7)
    x = {("a", "p"): rng.standard_normal((9, 32)), ("a", "q"): rng.standard_normal((4, 32)), ("b", "p"): rng.standard_normal((1, 32))}
    x[("a", "q")][0] = 3.0  # flat: no correlation, lag 0
    rows = [(k, s, w.tolist()) for (k, s), ws in x.items() for w in ws]
    df = spark.createDataFrame(rows, "key string, source string, wave array<double>")
    got = {(r.key, r.source): r for r in V.source_homogeneity(df, ["key", "source"]).collect()}
    assert set(got) == {("a", "p"), ("a", "q")}
    for g, r in got.items():
        c, lag = N.convolution_best_rows(x[g], np.repeat(x[g].mean(axis=0)[None], len(x[g]), 0))
        assert (r.n, r.corr_med, r.corr_mean) == (len(c), pytest.approx(np.nanmedian(c)), pytest.approx(np.nanmean(c)))
        assert (r.lag_med, r.lag_mean) == (pytest.approx(np.median(lag)), pytest.approx(lag.mean()))


def test_relabelling_draws_the_share(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i >= 30), rng.standard_normal(8).tolist()) for i in range(120)]
    null = V.relabelled_max_t(frame(spark, rows).repartition(5), "label", 0, 1, "sample_id", n_perm=101, seed=0).toPandas()
    assert sorted(null["perm"]) == list(range(101)) and null["max_t"].between(0.5, 6).all()
    # one group only: nothing to compare
    alone = V.relabelled_max_t(frame(spark, rows[:30]), "label", 0, 1, "sample_id", n_perm=5, seed=0)
    assert [r.max_t for r in alone.collect()] == [0.0] * 5


def test_blocks_do_not_grow_with_the_waves(spark):
    """Waves are shuffled once per block until a block is full."""
    few, many = (spark.range(n).select(F.col("id").alias("sample_id"), F.lit(0).alias("label"), F.array(F.lit(1.0), F.lit(2.0)).alias("wave")) for n in (2_000, 60_000))
    assert P.n_blocks_for(few) == P.n_blocks_for(many)


def test_many_warped_waves_have_more_blocks(spark):
    """A pair of large blocks would be computed while the other cores wait."""
    n = 30_000
    w = spark.range(n).select(F.col("id").alias("sample_id"), F.lit(0).alias("label"), F.array(F.lit(1.0), F.lit(2.0)).alias("wave"))
    assert P.n_blocks_for(w, "softdtw") >= 1.9 * P.n_blocks_for(w) and P.n_blocks_for(w.limit(2000), "dtw") == P.n_blocks_for(w.limit(2000))


@pytest.fixture(scope="module")
def unclear(spark):
    """Waves without groups, an id that comes twice, one that is missing."""
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(3)), rng.normal(size=12)) for i in range(70)]
    rows += [rows[0], (5, rows[5][1], rng.normal(size=12)), (None, 1, rng.normal(size=12))]
    return frame(spark, rows)


def test_stored_distances_give_the_same_sums(spark, unclear):
    at = P.placed(unclear.select("sample_id", "wave"))
    stored = P.stored_distances(at, "softdtw", gamma=0.1)
    lab = at.withColumn("label", (F.coalesce("sample_id", F.lit(1)) % 3).cast("int"))
    for same in (False, True):
        want = P.cluster_sums(lab.select("sample_id", "label", "wave"), "softdtw", gamma=0.1, same_only=same, n_blocks=3)
        a, b = (s.toPandas().sort_values(["sample_id", "label", "other"], ignore_index=True)[want.columns] for s in (want, P.stored_sums(lab, stored, same_only=same)))
        assert len(a) == (71 if same else 71 * 3)
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-9)
    # two labellings at once
    two = lab.withColumn("_set", F.lit(0)).unionByName(lab.withColumns({"_set": F.lit(1), "label": F.lit(7)}))
    got = P.stored_sums(two, stored, same_only=True)
    assert got.where("label = 7").agg(F.sum("n")).first()[0] == 73 * 72 and got.where("label < 7").agg(F.sum("n")).first()[0] == a["n"].sum()
    stored.unpersist()


def test_grid_computes_pairs_once_per_gamma(spark, unclear, monkeypatch):
    """Every k, start, round and score reads the same distances, and finds what it
    finds without them."""
    made, sums = [], []
    monkeypatch.setattr(C, "stored_distances", lambda *a, **k: (made.append(k), P.stored_distances(*a, **k))[1])
    monkeypatch.setattr(C, "cluster_sums", lambda w, m, **k: (sums.append(m), P.cluster_sums(w, m, **k))[1])
    cols = ["k", "gamma", "silhouette", "davies_bouldin"]
    w = unclear.where("sample_id IS NOT NULL")
    got = C.grid_search(w, [2, 3], [0.1], n_init=1).toPandas()
    assert len(made) == 1 and "softdtw" not in sums
    monkeypatch.setattr(C, "placed", lambda w: None)
    want = C.grid_search(w, [2, 3], [0.1], n_init=1).toPandas()
    assert len(made) == 1 and "softdtw" in sums
    pd.testing.assert_frame_equal(got[cols], want[cols], rtol=1e-9)


def test_distances_that_take_too_much_disk_are_not_stored(unclear, monkeypatch):
    monkeypatch.setattr(P, "STORED_BYTES", 4 * 72 * 72)
    assert P.placed(unclear) is None and P.placed(unclear.where("sample_id > 5")) is not None


def test_folded_tiles_of_near_equal_and_unlabelled_waves(spark):
    """More waves than a tile holds, far from the origin, some alike to the tenth
    digit, some without a cluster."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4)) + 1e4
    x[1::50] = x[0::50] + 1e-6
    x[2::50] = x[0::50]
    labels = [None if i % 97 == 3 else int(i % 3) for i in range(len(x))]
    df = spark.createDataFrame([(i, l, v.tolist()) for i, (l, v) in enumerate(zip(labels, x))], "sample_id long, label int, wave array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for blocks in (1, 2):
        got = {(r.sample_id, r.other): r for r in P.cluster_sums(df, "euclidean", n_blocks=blocks).collect()}
        assert len(got) == 3 * len(x)
        for i in range(0, len(x), 7):
            for c in range(3):
                of = np.array([l == c for l in labels])
                of[i] = False
                r, v = got[i, c], d[i, of]
                assert r.n == len(v) and r.label == labels[i]
                assert np.allclose([r.total, r.squares, r.low, r.high], [v.sum(), (v * v).sum(), v.min(), v.max()], rtol=1e-9, atol=0)


def test_bootstrap_tasks_take_several_blocks(spark, planted):
    """A group of four blocks is one task's, so no products are shuffled."""
    w = frame(spark, planted[::2])
    b = V.bootstrap_waves(w, ["label"], "sample_id", n_boot=20, seed=3, cell=F.lit(0).cast("bigint"), block=3)
    real = V.N.first_component
    got = b.first()
    x = np.stack([r[2] for r in planted[::2]])
    n, h = len(x), spark.range(1).select(F.xxhash64(F.lit(0))).first()[0] % 2**64
    reps = np.zeros((20, n))
    for lo in range(0, n, 3):
        reps[:, lo : lo + 3] = V._draws([3, h, 0], n, lo, lo + 3, 3, 20)
    assert (reps.sum(axis=1) == n).all()
    want = np.mean([real((x * r[:, None]).T @ x, r @ x / n) for r in reps], axis=0)
    assert np.allclose(got["mean"], want, rtol=1e-9)


def test_fir_widens_a_wave_once(spark):
    """The taps read a widened wave; the mirroring isn't repeated per tap."""
    taps, y = N.fir_taps(13, 6.0, 100.0), np.random.default_rng(2).normal(size=20)
    df = spark.createDataFrame([(0, y.tolist()), (1, [1.5]), (2, [1.0, 2.0, 4.0]), (3, None)], "i int, wave array<double>")
    got = {r.i: r.v for r in df.select("i", S.fir_lowpass("wave", 100.0, 6.0).alias("v")).collect()}
    for i, w in ((0, y), (2, np.array([1.0, 2.0, 4.0]))):
        assert np.allclose(got[i], np.convolve(np.pad(w, 6, mode="reflect"), taps, mode="valid"), rtol=1e-12)
    assert got[1] == [pytest.approx(1.5 * taps.sum())] and got[3] is None
    assert str(S.fir_lowpass("wave", 100.0, 6.0)).count("pmod") <= 3
