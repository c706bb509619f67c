"""Kernels against closed forms and plain recomputation."""

import tracemalloc

import numpy as np
import pytest

from cadencia.functions import kernels as N


def test_lowpass_passes_constant_and_halves_at_cutoff():
    sec = N.butterworth(2, "low", 0.0, 50.0, 1000.0)
    assert np.allclose(N.zero_phase(sec, np.full((1, 300), 3.0)), 3.0)
    t = np.arange(4000) / 1000.0
    y = N.zero_phase(sec, np.sin(2 * np.pi * 50 * t)[None])[0, 1000:3000]
    assert np.max(np.abs(y)) == pytest.approx(0.5, abs=2e-3)  # -3 dB, twice


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_sections_have_unit_gain_and_3_db_at_the_edges(order):
    fs, lo, hi = 1000.0, 30.0, 300.0

    def gain(sec, f):
        z = np.exp(2j * np.pi * f / fs)
        return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, a1, a2 in sec]))

    band = N.butterworth(order, "band", lo, hi, fs)
    assert gain(band, lo) == pytest.approx(2**-0.5, rel=1e-6)
    assert gain(band, hi) == pytest.approx(2**-0.5, rel=1e-6)
    low = N.butterworth(order, "low", 0.0, hi, fs)
    assert gain(low, 1e-9) == pytest.approx(1.0)
    assert gain(low, hi) == pytest.approx(2**-0.5, rel=1e-6)


def test_zero_phase_is_symmetric_under_time_reversal():
    x = np.random.default_rng(0).normal(size=(3, 400))
    sec = N.lowpass_sections(1000.0, 30.0)
    mid = slice(150, 250)
    assert np.allclose(N.zero_phase(sec, x)[:, mid], N.zero_phase(sec, x[:, ::-1])[:, ::-1][:, mid], atol=1e-6)


def test_lowpass_only_on_nonzero_span():
    x = np.zeros((1, 50))
    x[0, 10:40] = 1.0 + np.arange(30) % 2
    y = N.lowpass_nonzero_span(N.lowpass_sections(100.0, 5.0), x)
    assert (y[0, :10] == 0).all() and (y[0, 40:] == 0).all() and y[0, 10:40].std() < x[0, 10:40].std()
    few = np.zeros((1, 50))
    few[0, 5:9] = 2.0
    assert (N.lowpass_nonzero_span(N.lowpass_sections(100.0, 5.0), few) == few).all()


def test_band_without_room_is_an_error():
    with pytest.raises(ValueError):
        N.bandpass_sections(20.0, 10.0, 490.0)


def test_spline_sine_and_fallbacks():
    x = np.sin(np.linspace(0, 2 * np.pi, 187))
    want = np.sin(np.linspace(0, 2 * np.pi, 101))
    assert np.abs(N.spline_resample_rows(x[None])[0] - want).max() < 2e-3
    assert np.allclose(N.spline_resample_rows(x[None])[0], N.spline_resample(x))
    assert np.allclose(N.spline_resample(np.array([0.0, 1.0, 4.0])), np.interp(np.linspace(0, 2, 101), [0, 1, 2], [0, 1, 4]))
    assert np.isnan(N.spline_resample(np.array([np.nan, 1.0, np.nan]))).all()
    dup = N.spline_resample(np.array([0.0, 2.0, 4.0, 6.0, 8.0]), np.array([0, 1, 1, 2, 3.0]))
    assert dup[0] == pytest.approx(0.0) and dup[-1] == pytest.approx(8.0)


def test_akima_is_exact_on_lines_and_at_nodes():
    assert np.allclose(N.akima_resample_rows(np.arange(11.0)[None])[0], np.linspace(0, 10, 101))
    x = np.random.default_rng(2).normal(size=(2, 11))
    assert np.allclose(N.akima_resample_rows(x)[:, ::10], x)


def test_roll_finds_lag():
    w = np.random.default_rng(0).normal(size=101)
    c, k = N.circular_best_rows(np.roll(w, 3)[None], w[None], range(-5, 6))
    assert k[0] == -3 and c[0] == pytest.approx(1.0, abs=1e-6)
    assert N.circular_best_rows(np.ones((1, 20)), np.arange(20.0)[None], [0])[0][0] == 0.0
    assert np.array_equal(N.roll_rows(w[None], np.array([7]))[0], np.roll(w, 7))


def test_xcorr_shift():
    x = np.random.default_rng(1).normal(size=120)
    c, k = N.xcorr_best_rows(x[None, 5:105], x[None, :100], 10)
    assert k[0] == 5 and c[0] > 0.999


def naive_dtw(a, b, soft=None):
    n, m = len(a), len(b)
    r = np.full((n + 1, m + 1), np.inf)
    r[0, 0] = 0
    for i in range(n):
        for j in range(m):
            v = np.array([r[i, j + 1], r[i + 1, j], r[i, j]])
            low = v.min() if soft is None else -soft * np.log(np.exp(-(v - v.min()) / soft).sum()) + v.min()
            r[i + 1, j + 1] = ((a[i] - b[j]) ** 2).sum() + low
    return r[n, m]


@pytest.mark.parametrize("features", [1, 3])
def test_warping_distances(features):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(5, 9, features)), rng.normal(size=(5, 7, features))
    assert np.allclose(N.distance("dtw", x, y), [naive_dtw(a, b) ** 0.5 for a, b in zip(x, y)])
    for gamma in (0.3, 1e3):  # both forms of the table
        assert np.allclose(N.distance("softdtw", x, y, gamma, batch=2), [naive_dtw(a, b, gamma) for a, b in zip(x, y)])
    assert np.allclose(N.distance("dtw", x, x), 0)


@pytest.mark.parametrize("features", [1, 2])
def test_all_warping_distances(features):
    """In steps of fewer rows than there are; each pair of a table with itself once."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(N.SIDE + 3, 6, features)), rng.normal(size=(4, 8, features))
    for metric, gammas in (("dtw", [1.0]), ("softdtw", [1e-4, 0.05, 0.3, 2.0, 1e3])):
        for gamma in gammas:
            soft = gamma if metric == "softdtw" else None
            want = np.array([[naive_dtw(a, b, soft) for b in y] for a in x])
            assert np.allclose(N.distances(metric, x, y, gamma), want if soft else want**0.5, rtol=1e-11, atol=1e-11)
            own = N.distances(metric, x, x, gamma)
            assert np.array_equal(own[: N.SIDE, N.SIDE :], own[N.SIDE :, : N.SIDE].T)
            assert np.allclose(own[:2, :5], [[N.distance(metric, a[None], b[None], gamma)[0] for b in x[:5]] for a in x[:2]], rtol=1e-11, atol=1e-11)
    bad = x.copy()
    bad[1, 2] = np.nan
    d = N.distances("softdtw", bad, y, 0.3)
    assert np.isnan(d[1]).all() and np.isfinite(d[[0, 2]]).all()


@pytest.mark.parametrize("n, m, features", [(64, 64, 1), (9, 7, 2), (7, 9, 1), (1, 5, 1), (1, 1, 1)])
def test_dtw_of_all_rows_is_that_of_pairs(n, m, features):
    """To the last digit, also beside values that are not finite."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(N.SIDE + 5, n, features)), rng.normal(size=(N.SIDE + 2, m, features))
    y[0], x[1, 0], y[2, -1], y[3] = x[0, :1], np.nan, -np.inf, y[3] * 1e200
    with np.errstate(all="ignore"):
        want = np.stack([N.dtw(np.repeat(r[None], len(y), axis=0), y) for r in x])
        assert np.array_equal(N.distances("dtw", x, y), want, equal_nan=True)


def test_dtw_of_all_rows_repeats_no_rows():
    """What a tile takes stays in a core's own cache: two tables of half the
    places each and the costs, no row per pair."""
    x = np.random.default_rng(9).normal(size=(N.SIDE, 64, 1))
    tracemalloc.start()
    N.distances("dtw", x, x.copy())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 64 * N.SIDE**2 * 8


def test_soft_dtw_of_all_rows_at_a_small_gamma():
    """As that of pairs, without a row per pair, also where some waves are equal."""
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=(2, N.SIDE, 64, 1)) / 8
    y[:5] = x[:5]
    want = np.stack([N.soft_dtw(np.repeat(r[None], len(y), axis=0), y, 5e-5) for r in x])
    tracemalloc.start()
    d = N.distances("softdtw", x, y, 5e-5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(d, want, rtol=1e-12, atol=1e-15)
    assert peak < 8 * 64 * N.SIDE**2 * 8


def test_soft_dtw_takes_few_exponentials(monkeypatch):
    """Not one per cell where a gamma is large enough, wherever the waves lie."""
    rng = np.random.default_rng(6)
    x = 100 + rng.normal(size=(N.SIDE, 64, 1)) / 8
    taken, exp = [], np.exp
    monkeypatch.setattr(N.np, "exp", lambda v, **k: (taken.append(np.size(v)), exp(v, **k))[1])
    d = N.distances("softdtw", x, x, 0.1)
    assert sum(taken) < 0.05 * len(x) ** 2 * 64 * 64
    monkeypatch.undo()
    assert np.allclose(d[:3, 5], [naive_dtw(a, x[5], 0.1) for a in x[:3]], rtol=1e-9, atol=1e-9)


def test_product_form_writes_the_tables_of_its_tile():
    """Cells and weights go to the tables made once for all tiles of a size."""
    x, y = np.random.default_rng(11).normal(size=(2, N.SIDE, 64)) / 8
    made = N._diagonals(64, 64, N.SIDE, N.SIDE)
    tracemalloc.start()
    d = N._soft_grid(x, y, 0.1, made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(d, N._soft_grid(x, y, 0.1, made))  # nothing is left of the tile before
    assert peak < 4 * 64 * N.SIDE**2 * 8


def test_first_component():
    w = np.sin(np.linspace(0, 3, 50)) + 0.2
    x = np.outer([1.0, 1.0, 1.0], w)
    assert np.allclose(N.first_component(x.T @ x, x.mean(axis=0)), w)
    y = np.random.default_rng(0).normal(size=(40, 6)) + 1
    r = N.shrink_rows(y)
    assert r.shape == (6, 6) and np.allclose(r.T @ r, y.T @ y)
    v = np.linalg.svd(y, full_matrices=False)[2][0]
    got = N.first_component(y.T @ y, y.mean(axis=0))
    assert abs(np.dot(got, v)) == pytest.approx(np.linalg.norm(got))


def test_fir_of_short_waves(spark):
    from cadencia.functions.kernels import fir_taps
    from cadencia.operators.signal import fir_lowpass

    for n in (1, 2, 5, 6, 7, 30):
        x = np.arange(n, dtype=float) ** 2
        got = spark.createDataFrame([(x.tolist(),)], "wave array<double>").select(fir_lowpass("wave", 100.0, 10.0)).first()[0]
        taps = fir_taps(13, 10.0, 100.0)
        padded = np.pad(x, 6, mode="reflect") if n > 1 else np.full(13, x[0])
        assert np.allclose(got, [padded[i : i + 13] @ taps[::-1] for i in range(n)])


def test_quantiles_leave_out_infinities_and_spread_outliers(spark):
    from pyspark.sql import functions as F

    from cadencia.operators.ordered import CELL, exact_quantiles, value_cells

    v = np.random.default_rng(0).standard_normal(20_000)
    rows = [(float(x),) for x in v] + [(1e12,), (-1e12,)]
    df = spark.createDataFrame(rows, "v double")
    most = value_cells(df, [], "v").groupBy(CELL).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert most < 0.01 * len(rows)
    some = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("inf"),)] * 3 + [(float("-inf"),)], "v double")
    got = exact_quantiles(some, [], "v", {"hi": 0.975, "lo": 0.0}).first()
    assert abs(got["hi"] - 8.775) < 1e-12 and got["lo"] == 0.0


@pytest.mark.parametrize("where", [0.5, 0.9])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_value_cells_of_a_crowd_off_the_median(spark, where, keys):
    """40 % of the values within 1e-4, and outliers on both sides: no cell is above 1 % of the rows."""
    from pyspark.sql import functions as F

    from cadencia.operators.ordered import CELL, exact_quantiles, value_cells

    n = 50_000
    rng = np.random.default_rng(4)
    v = np.concatenate([where * 100 + rng.random(int(n * 0.4)) * 1e-4, rng.choice([-1, 1], int(n * 0.1)) * 10.0 ** (rng.random(int(n * 0.1)) * 200), rng.random(n // 2) * 100])
    df = spark.createDataFrame([(1, float(x)) for x in v], "k int, v double")
    most = value_cells(df, keys, "v").groupBy(CELL).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert most <= n / 100
    got = exact_quantiles(df, keys, "v", {"a": 0.1, "b": 0.5, "c": 0.93}).select("a", "b", "c").first()
    assert np.allclose(list(got), np.quantile(v, [0.1, 0.5, 0.93]), rtol=1e-12)
