"""NumPy kernels on stacks of equally long waves, one wave per row.

Every kernel loops over points, lags or cells of a wave and is vectorised over
the waves of an Arrow batch.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

EPS = 1e-8

# --- filters ------------------------------------------------------------------


@lru_cache(maxsize=64)
def butterworth(order: int, kind: str, low: float, high: float, fs: float) -> tuple:
    """Butterworth sections (b0, b1, b2, a1, a2) by bilinear transform; ``kind``
    is ``low`` (cutoff ``high``) or ``band``."""
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    warp = lambda f: 2.0 * np.tan(np.pi * f / fs)
    if kind == "low":
        p = poles * warp(high)
        reference = 1.0
    else:
        w1, w2 = warp(low), warp(high)
        half = poles * (w2 - w1) / 2.0
        root = np.sqrt(half**2 - w1 * w2)
        p = np.concatenate([half + root, half - root])
        centre = 2.0 * np.arctan(np.sqrt(w1 * w2) / 2.0)
        reference = np.exp(1j * centre)
    pz = (2.0 + p) / (2.0 - p)
    upper = sorted(pz[pz.imag > 1e-12], key=lambda z: abs(z))
    real = sorted(pz[np.abs(pz.imag) <= 1e-12].real)
    pairs = [(-2.0 * z.real, abs(z) ** 2) for z in upper]
    while len(real) >= 2:
        a, b = real.pop(), real.pop()
        pairs.append((-(a + b), a * b))
    sections = []
    if kind == "low":
        for a1, a2 in pairs:
            sections.append([1.0, 2.0, 1.0, a1, a2])
        for r in real:
            sections.append([1.0, 1.0, 0.0, -r, 0.0])
    else:
        for a1, a2 in pairs:
            sections.append([1.0, 0.0, -1.0, a1, a2])
    out = []
    for b0, b1, b2, a1, a2 in sections:
        z = reference
        g = abs((b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2))
        out.append((b0 / g, b1 / g, b2 / g, a1, a2))
    return tuple(out)


def settle_samples(sections: tuple, tol: float = 1e-14) -> int:
    """Samples after which the memory of the filter has shrunk below ``tol``."""
    r = max(np.abs(np.roots([1.0, s[3], s[4]])).max() for s in sections)
    return int(np.ceil(np.log(tol) / np.log(r))) if r > 0 else 1


def _run(sections: tuple, x: np.ndarray) -> np.ndarray:
    """Filter rows of x forward, started in the steady state of the first value."""
    y = np.ascontiguousarray(x.T)
    for b0, b1, b2, a1, a2 in sections:
        dc = (b0 + b1 + b2) / (1.0 + a1 + a2)
        s2 = (b2 - a2 * dc) * y[0]
        s1 = (b1 - a1 * dc) * y[0] + s2
        out = np.empty_like(y)
        for i, v in enumerate(y):
            o = b0 * v + s1
            s1 = b1 * v - a1 * o + s2
            s2 = b2 * v - a2 * o
            out[i] = o
        y = out
    return y.T


def zero_phase(sections: tuple, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering of rows of one length."""
    return np.stack(zero_phase_ragged(sections, list(x))) if len(x) else x


def zero_phase_ragged(sections: tuple, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Forward and backward filtering with odd extension at both ends. Rows of
    different lengths are filtered together: each starts at the left of a common
    stack, and is turned round at its own end for the way back."""
    taps = 2 * len(sections) + 1
    if all(s[2] == 0.0 and s[4] == 0.0 for s in sections):
        taps -= 1
    out, ext = [], []
    for x in rows:
        pad = min(3 * taps, x.size - 1)
        if pad > 0:
            x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
        ext.append((x, pad))
    size = np.array([x.size for x, _ in ext])
    stack = np.zeros((len(ext), size.max()))
    for i, (x, _) in enumerate(ext):
        stack[i, : x.size] = x
    # position k of a turned row is its own last position minus k
    turn = np.clip(size[:, None] - 1 - np.arange(size.max())[None, :], 0, None)
    y = np.take_along_axis(_run(sections, stack), turn, axis=1)
    y = np.take_along_axis(_run(sections, y), turn, axis=1)
    for i, (x, pad) in enumerate(ext):
        out.append(y[i, pad : x.size - pad])
    return out


def bandpass_sections(fs: float, low: float, high: float, order: int = 4, floor: float = 1e-6) -> tuple:
    nyquist = 0.5 * fs
    low, high = max(floor, float(low)), min(float(high), 0.95 * nyquist)
    if high <= low:
        raise ValueError("band limits are empty after adjustment")
    return butterworth(order, "band", low, high, float(fs))


def lowpass_sections(fs: float, cutoff: float, order: int = 2, corrected: bool = True) -> tuple:
    # fixed value: cutoff correction of a second-order filter run both ways
    c = cutoff / 0.802 if corrected else min(cutoff, 0.95 * 0.5 * fs)
    return butterworth(order, "low", 0.0, float(c), float(fs))


def lowpass_nonzero_span(sections: tuple, x) -> np.ndarray | list[np.ndarray]:
    """Low-pass only between the first and last non-zero point of each wave, and
    only where enough points are non-zero; the rest is returned as it is."""
    need = 3 * 3 - 1
    out = [np.array(r) for r in x]
    spans = []
    for i, r in enumerate(out):
        nz = np.flatnonzero(r)
        if nz.size > need:
            spans.append((i, nz[0], nz[-1] + 1))
    if spans:
        done = zero_phase_ragged(sections, [out[i][a:b] for i, a, b in spans])
        for (i, a, b), y in zip(spans, done):
            out[i][a:b] = y
    return np.stack(out) if isinstance(x, np.ndarray) else out


def fir_taps(n: int, cutoff: float, fs: float) -> np.ndarray:
    """Hamming-windowed low-pass taps with unit gain at zero frequency."""
    m = np.arange(n) - (n - 1) / 2.0
    fc = cutoff / (0.5 * fs)
    h = fc * np.sinc(fc * m) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    return h / h.sum()


# --- resampling ---------------------------------------------------------------


@lru_cache(maxsize=256)
def spline_matrix(n: int, out: int) -> np.ndarray:
    """Matrix that takes n uniform points to ``out`` points of their natural cubic
    spline: the spline is linear in the values, so it is worked out once per n."""
    return np.stack([natural_spline(np.arange(n, dtype=float), e, np.linspace(0, n - 1, out)) for e in np.eye(n)], axis=1)


def natural_spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = t.size
    h = np.diff(t)
    m = np.zeros(n)
    if n > 2:
        diag = 2.0 * (h[:-1] + h[1:])
        rhs = 6.0 * np.diff(np.diff(y) / h)
        c = np.zeros(n - 2)
        d = np.zeros(n - 2)
        for i in range(n - 2):
            low = h[i] if i else 0.0
            den = diag[i] - low * (c[i - 1] if i else 0.0)
            c[i] = h[i + 1] / den
            d[i] = (rhs[i] - low * (d[i - 1] if i else 0.0)) / den
        for i in range(n - 3, -1, -1):
            m[i + 1] = d[i] - c[i] * m[i + 2]
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b = t[k + 1] - at, at - t[k]
    hk = h[k]
    return (
        m[k] * a**3 / (6 * hk)
        + m[k + 1] * b**3 / (6 * hk)
        + (y[k] / hk - m[k] * hk / 6) * a
        + (y[k + 1] / hk - m[k + 1] * hk / 6) * b
    )


def spline_resample(y: np.ndarray, t: np.ndarray | None = None, n: int = 101) -> np.ndarray:
    """One wave on its own times: sorted, equal times averaged, missing points left
    out; linear below four points, missing below two."""
    y = np.asarray(y, dtype=float)
    t = np.linspace(0.0, 1.0, y.size) if t is None else np.asarray(t, dtype=float)
    if y.size < 2:
        return np.repeat(y, n) if y.size == 1 else np.full(n, np.nan)
    order = np.argsort(t, kind="stable")
    t, y = t[order], y[order]
    u, inv = np.unique(t, return_inverse=True)
    if u.size != t.size:
        ok = np.isfinite(y)
        cnt = np.bincount(inv, weights=ok.astype(float))
        tot = np.bincount(inv, weights=np.where(ok, y, 0.0))
        y = np.where(cnt > 0, tot / np.maximum(cnt, 1.0), np.nan)
        t = u
    at = np.linspace(t[0], t[-1], n)
    ok = np.isfinite(y) & np.isfinite(t)
    t, y = t[ok], y[ok]
    if t.size < 2:
        return np.full(n, np.nan)
    return natural_spline(t, y, at) if t.size >= 4 else np.interp(at, t, y)


def spline_resample_rows(x: np.ndarray, n: int = 101) -> np.ndarray:
    if x.shape[1] >= 4 and np.isfinite(x).all():
        return x @ spline_matrix(x.shape[1], n).T
    return np.stack([spline_resample(r, None, n) for r in x])


def akima_resample_rows(x: np.ndarray, n: int = 101) -> np.ndarray:
    """Akima interpolation on the uniform axis, all rows at once."""
    k = x.shape[1]
    if k < 2:
        return np.full((x.shape[0], n), np.nan)
    m = np.diff(x, axis=1)
    if k == 2:
        return x[:, :1] + m * np.linspace(0, 1, n)
    left1 = 2 * m[:, :1] - m[:, 1:2]
    left2 = 2 * left1 - m[:, :1]
    right1 = 2 * m[:, -1:] - m[:, -2:-1]
    right2 = 2 * right1 - m[:, -1:]
    e = np.concatenate([left2, left1, m, right1, right2], axis=1)
    w = np.abs(np.diff(e, axis=1))
    w1, w2 = w[:, 2:], w[:, :-2]
    tot = w1 + w2
    flat = tot > 1e-9 * tot.max(initial=0.0)
    safe = np.where(flat, tot, 1.0)
    slope = np.where(flat, (w1 * e[:, 1:-2] + w2 * e[:, 2:-1]) / safe, 0.5 * (e[:, 1:-2] + e[:, 2:-1]))
    pos = np.linspace(0, k - 1, n)
    i = np.minimum(pos.astype(int), k - 2)
    d = pos - i
    s0, s1, dm = slope[:, i], slope[:, i + 1], m[:, i]
    return x[:, i] + d * (s0 + d * ((3 * dm - 2 * s0 - s1) + d * (s0 + s1 - 2 * dm)))


# --- similarity ---------------------------------------------------------------


def _corr(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = a - a.mean(axis=1, keepdims=True)
    b = b - b.mean(axis=1, keepdims=True)
    return (a * b).mean(axis=1) / (a.std(axis=1) * b.std(axis=1) + EPS)


def xcorr_rows(a: np.ndarray, b: np.ndarray, max_lag: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lags, correlation per row and lag); 0 where fewer than three points meet."""
    n = a.shape[1]
    top = n - 1 if max_lag is None else int(max_lag)
    lags = np.arange(-top, top + 1)
    out = np.zeros((a.shape[0], lags.size))
    for j, lag in enumerate(lags):
        m = n - abs(int(lag))
        if m < 3:
            continue
        x = a[:, -lag:] if lag < 0 else a[:, :m]
        y = b[:, :m] if lag < 0 else b[:, lag:]
        out[:, j] = _corr(x, y)
    return lags, out


def xcorr_best_rows(a: np.ndarray, b: np.ndarray, max_lag: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(best correlation, its lag) per row; the first lag wins ties."""
    n = a.shape[1]
    lags, c = xcorr_rows(a, b, max_lag)
    c = np.where(n - np.abs(lags) >= 3, c, -np.inf)
    k = c.argmax(axis=1)
    return c[np.arange(a.shape[0]), k], lags[k]


def circular_best_rows(a: np.ndarray, b: np.ndarray, lags) -> tuple[np.ndarray, np.ndarray]:
    """(best correlation, its lag) of a rolled against b over a list of lags."""
    # lags that are the same rotation would tie; the first named stands for them
    lags = np.array(list({int(k) % a.shape[1]: int(k) for k in reversed(list(lags))}.values())[::-1])
    c = np.stack([_corr(np.roll(a, int(k), axis=1), b) for k in lags], axis=1)
    c = np.where(np.isfinite(c), c, -np.inf)
    k = c.argmax(axis=1)
    return c[np.arange(a.shape[0]), k], lags[k]


def convolution_best_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(largest value, its lag) of the full convolution of two centred rows,
    divided by the product of their norms; NaN and 0 if a row is flat."""
    n = a.shape[1]
    x, y = (v - v.mean(axis=1, keepdims=True) for v in (a, b))
    size = 2 * n
    full = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    lags = np.arange(1 - n, n)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    good = norm > 0
    c = full[:, lags] / np.where(good, norm, 1.0)[:, None]
    k = c.argmax(axis=1)
    return np.where(good, c[np.arange(len(c)), k], np.nan), np.where(good, lags[k], 0)


def roll_rows(a: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Rows rolled right, each by its own lag."""
    n = a.shape[1]
    return np.take_along_axis(a, (np.arange(n)[None, :] - np.asarray(lags)[:, None]) % n, axis=1)


def mad_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a - b).mean(axis=1)


# --- first component ----------------------------------------------------------


def shrink_rows(x: np.ndarray) -> np.ndarray:
    """At most as many rows as columns with the same cross products."""
    return np.linalg.qr(x, mode="r") if x.shape[0] > x.shape[1] else x


#: a curve with a smaller range has no shape
FLAT = 1e-12


def first_component(gram: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """First right singular vector of the uncentred waves with this Gram matrix,
    turned to rise and fall with the mean wave, as long as that is. If either of
    the two is flat, the vector keeps the sign it has."""
    axis = np.linalg.eigh(gram)[1][:, -1]
    shape = mean - mean.mean()
    flat = min(np.ptp(axis), np.ptp(mean)) < FLAT
    return axis * np.copysign(np.sqrt(mean @ mean), 1.0 if flat else axis @ shape)


# --- warping distances --------------------------------------------------------


def _warp(x: np.ndarray, y: np.ndarray, step, outside: float = np.inf, start: float = 0.0) -> np.ndarray:
    """Last cell of the warping table for pairs of rows, antidiagonal by
    antidiagonal.

    x is (pairs, n, features), y (pairs, m, features). Points come first in
    memory and y is reversed, so a diagonal is a plain slice of both. Cell (i, j)
    sits at i + 1 of its diagonal; position 0 and all cells outside hold
    ``outside``. ``step(left, up, corner, cost, out)`` writes a cell.
    """
    p, n, f = x.shape
    m = y.shape[1]
    xs = np.ascontiguousarray(x.transpose(2, 1, 0))
    ys = np.ascontiguousarray(y.transpose(2, 1, 0)[:, ::-1])
    two, one, cur = (np.full((n + 1, p), outside) for _ in range(3))
    two[0] = start
    cost, part = np.empty((n, p)), np.empty((n, p))
    for s in range(n + m - 1):
        lo, hi = max(0, s - m + 1), min(n - 1, s)
        k, off = hi - lo + 1, m - 1 - s
        c = cost[:k]
        for q in range(f):
            d = c if q == 0 else part[:k]
            np.subtract(xs[q, lo : hi + 1], ys[q, off + lo : off + hi + 1], out=d)
            np.multiply(d, d, out=d)
            if q:
                c += d
        step(one[lo : hi + 1], one[lo + 1 : hi + 2], two[lo : hi + 1], c, cur[lo + 1 : hi + 2])
        # the next two diagonals read no farther than one beyond each end
        cur[lo] = outside
        cur[hi + 2 : hi + 3] = outside
        two, one, cur = one, cur, two
    return one[n].copy()


def dtw(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    def step(a, b, c, cost, out):
        np.minimum(a, b, out=out)
        np.minimum(out, c, out=out)
        out += cost

    return np.sqrt(_warp(x, y, step))


def _diagonals(n: int, m: int, a: int, b: int) -> tuple[list[np.ndarray], list[tuple]]:
    """Tables for warping ``a`` waves of n points with ``b`` of m, and per
    antidiagonal the points of the first, those of the reversed second, and the
    cells, with what is above and left of them and room for their costs.

    Cell (i, j) sits at place i - j, so it is written over the cell before both its
    points, which no other cell needs by then. Even and odd places are tables of
    their own, so all three views are plain slices. Places beyond the first row
    and column are only read.
    """
    tables = [np.empty(((n + m) // 2 + 1, a, b)) for _ in range(2)]
    costs = np.empty((min(n, m), a, b))
    steps = []
    for s in range(n + m - 1):
        lo, hi = max(0, s - m + 1), min(n - 1, s)
        k, off, at = hi - lo + 1, m - 1 - s, 2 * lo - s + m
        cells = (tables[v % 2][v // 2 : v // 2 + k] for v in (at, at - 1, at + 1))
        steps.append((slice(lo, hi + 1), slice(off + lo, off + hi + 1), *cells, costs[:k]))
    return tables, steps


def _cost_grid(x: np.ndarray, y: np.ndarray, made: tuple, step) -> np.ndarray:
    """Last cells of the tables of all rows of x with all rows of y, in the
    ``_diagonals`` made for them. ``step(out, up, left, cost)`` writes the cells.

    The differences of a cell's points are a product of (x, 1) and (1, -y): they
    are as exact as subtraction, and a product of small matrices is written once,
    where differences of repeated rows are read and written from far memory.
    """
    tables, steps = made
    a, n, f = x.shape
    b, m, _ = y.shape
    if not n or not m:
        return np.full((a, b), np.inf)
    one, two = np.ones((f, n, a, 2)), np.ones((f, m, 2, b))
    one[..., 0] = x.transpose(2, 1, 0)
    np.negative(y.transpose(2, 1, 0)[:, ::-1], out=two[:, :, 1])
    for t in tables:
        t.fill(np.inf)
    steps[0][2].fill(0.0)
    for i, j, out, up, left, cost in steps:
        np.matmul(one[0, i], two[0, j], out=cost)
        np.square(cost, out=cost)
        for q in range(1, f):
            cost += np.square(one[q, i] @ two[q, j])
        step(out, up, left, cost)
    return steps[-1][2][0].copy()


def _dtw_grid(x: np.ndarray, y: np.ndarray, made: tuple) -> np.ndarray:
    def step(out, up, left, cost):
        np.minimum(out, up, out=out)
        np.minimum(out, left, out=out)
        np.add(out, cost, out=out)

    return np.sqrt(_cost_grid(x, y, made, step))


def _room(n: int, m: int) -> float:
    """How many gamma a path through n x m points may cost if the product form of
    soft-DTW is to be exact: what falls out of the range of a double by then is
    under exp(-36) of the result, though there may be 3 ** (n + m) paths."""
    return 650.0 - (n + m) * math.log(3.0) - math.log(n * m)


def _some_path(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cost of one path per pair, straight through the table: none is dearer that
    soft-DTW could end at. A last axis has the features."""
    n, m = x.shape[-2], y.shape[-2]
    steps = np.arange(max(n, m)) / max(max(n, m) - 1, 1)
    d = x[..., np.rint(steps * (n - 1)).astype(int), :] - y[..., np.rint(steps * (m - 1)).astype(int), :]
    return (d * d).sum(axis=(-2, -1))


def soft_dtw(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """Soft-DTW. Pairs that have a path of few enough gamma are kept as exp(-cost /
    gamma), which needs one exponential per cell and loses nothing that counts;
    the others as costs with a smooth minimum. (Scaling the product form per
    antidiagonal would not do for a small gamma: the best path may run through
    cells that are far above their antidiagonal's minimum.)"""
    safe = _some_path(x, y) <= _room(x.shape[1], y.shape[1]) * gamma
    out = np.empty(len(x))
    for rows, fn in ((safe, _soft_product), (~safe, _soft_costs)):
        if rows.all():
            return fn(x, y, gamma)
        if rows.any():
            out[rows] = fn(x[rows], y[rows], gamma)
    return out


def _soft_product(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    def product(a, b, c, cost, out):
        np.add(a, b, out=out)
        out += c
        cost *= -1.0 / gamma
        np.exp(cost, out=cost)
        out *= cost

    return -gamma * np.log(_warp(x, y, product, 0.0, 1.0))


#: exp(-cost / gamma) is interpolated down to exp(-REACH), where it still has 12 digits
REACH = 5.0


def _soft_grid(x: np.ndarray, y: np.ndarray, gamma: float, made: tuple) -> np.ndarray | None:
    """Product form for all rows of x with all rows of y (one feature), in the
    ``_diagonals`` made for them and without an exponential per cell.
    exp(-(u - v)**2) is interpolated in u at Chebyshev nodes, so its values for all
    rows are a product of two matrices; where values spread wide a larger gamma is
    interpolated and squared. None if some pair has no path that is cheap enough or
    the spread is too wide."""
    (a, n), (b, m) = x.shape, y.shape
    low, high = min(x.min(), y.min()), max(x.max(), y.max())
    if not np.isfinite(high - low) or not (_some_path(x[:, None, :, None], y[None, :, :, None]) <= _room(n, m) * gamma).all():
        return None
    spread = (high - low) ** 2 / gamma
    squarings = max(0, math.ceil(math.log2(max(spread, REACH) / REACH)))
    if squarings > 4:
        return None
    scale = 1.0 / math.sqrt(gamma * 2.0**squarings)
    half = max((high - low) * scale / 2, 1e-3)
    u, v = ((w - (low + high) / 2) * scale for w in (x, y))
    # the error of k nodes is at most 2.2 (half / sqrt 2)**k / sqrt(k!)
    k = next(k for k in range(4, 64) if 2.2 * (half / math.sqrt(2.0)) ** k <= 1e-16 * math.sqrt(math.factorial(k)))
    angles = (np.arange(k) + 0.5) * np.pi / k
    nodes = np.cos(angles)
    # values at the nodes to coefficients of Chebyshev polynomials
    turn = np.cos(np.outer(np.arange(k), angles)) * (2.0 / k)
    turn[0] /= 2
    polys = np.cos(np.arange(k) * np.arccos(np.clip(u.T / half, -1, 1))[:, :, None])  # n, a, k
    coefs = turn @ np.exp(-((nodes[:, None] * half - v.T[::-1, None, :]) ** 2))  # m, k, b
    tables, steps = made
    for t in tables:
        t.fill(0.0)
    steps[0][2].fill(1.0)
    for i, j, out, up, left, weight in steps:
        np.matmul(polys[i], coefs[j], out=weight)
        for _ in range(squarings):
            np.square(weight, out=weight)
        np.add(out, up, out=out)
        np.add(out, left, out=out)
        np.multiply(out, weight, out=out)
    return -gamma * np.log(steps[-1][2][0])


#: what is farther from the minimum than NEAR gamma changes it by less than 1e-13 gamma
NEAR = 30.0


def _soft_costs(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """The smooth minimum differs from the minimum only where the second smallest
    of the three is near it; exponentials are taken there alone."""
    shape = (x.shape[1], len(x))
    room = [np.empty(shape) for _ in range(3)]
    flags = np.empty(shape, bool)

    def soft(a, b, c, cost, out):
        few, many, gap = (r[: len(cost)] for r in room)
        near = flags[: len(cost)]
        np.minimum(a, b, out=few)
        np.maximum(a, b, out=many)
        np.minimum(few, c, out=out)
        np.maximum(few, c, out=few)
        np.minimum(few, many, out=gap)  # the second smallest
        np.maximum(few, many, out=few)  # the largest
        np.subtract(out, gap, out=gap)
        np.greater(gap, -NEAR, out=near)  # false where all three are infinite
        at = np.flatnonzero(near)
        if len(at):
            low, total, top = (v.reshape(-1).take(at) for v in (out, gap, few))
            np.subtract(low, top, out=top)
            np.exp(total, out=total)
            third = np.flatnonzero(top > -NEAR)
            if len(third):
                total[third] += np.exp(top.take(third))
            total += 1.0
            low -= np.log(total, out=total)
            out.reshape(-1)[at] = low
        out += cost

    # in units of gamma
    scale = 1.0 / math.sqrt(gamma)
    with np.errstate(invalid="ignore"):
        return gamma * _warp(x * scale, y * scale, soft)


def _soft_cost_grid(x: np.ndarray, y: np.ndarray, gamma: float, made: tuple) -> np.ndarray:
    """``_soft_costs`` of all rows of x with all rows of y: the smooth minimum of
    two, twice, each with exponentials only where the two are near."""
    size = len(x) * len(y) * min(x.shape[1], y.shape[1])
    room, rest, flags = np.empty(size), np.empty(size), np.empty(size, bool)

    def lower(low, one, two):
        """low becomes the smooth minimum of one and two; it may be one of them."""
        gap, near = rest[: one.size], flags[: one.size]
        np.subtract(one, two, out=gap)
        np.minimum(one, two, out=low)
        np.abs(gap, out=gap)
        np.less(gap, NEAR, out=near)  # false where both are infinite
        at = np.flatnonzero(near)
        if len(at):
            by = gap.take(at)
            np.exp(np.negative(by, out=by), out=by)
            low[at] -= np.log1p(by, out=by)

    def step(out, up, left, cost):
        out, up, left, cost = (v.reshape(-1) for v in (out, up, left, cost))
        low = room[: out.size]
        lower(low, up, left)
        lower(out, out, low)
        np.add(out, cost, out=out)

    # in units of gamma
    scale = 1.0 / math.sqrt(gamma)
    with np.errstate(invalid="ignore"):
        return gamma * _cost_grid(x * scale, y * scale, made, step)


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x - y).reshape(x.shape[0], -1)
    return np.sqrt((d * d).sum(axis=1))


def euclidean_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y by their products.
    Those that are small beside the rows' norms, where digits cancel, and those
    that are not finite are taken from the differences."""
    with np.errstate(invalid="ignore", over="ignore"):
        nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
        out = x @ y.T
        out *= -2.0
        out += nx[:, None]
        out += ny
        near = 1e-4 * (nx.max(initial=0.0) + ny.max(initial=0.0))
        low, high = out.min(initial=np.inf), out.max(initial=0.0)
        if not (low > near and high < np.inf):
            # where all is finite one bound finds the few that are near
            few = out <= near if low > -np.inf and high < np.inf and near < np.inf else ~(out > 1e-4 * (nx[:, None] + ny)) | ~np.isfinite(out)
            i, k = np.divmod(np.flatnonzero(few), out.shape[1])
            for s in range(0, len(i), 4096):
                m = slice(s, s + 4096)
                diff = x[i[m]] - y[k[m]]
                out[i[m], k[m]] = (diff * diff).sum(axis=1)
    return out


def distance(metric: str, x: np.ndarray, y: np.ndarray, gamma: float = 1.0, batch: int = 1024) -> np.ndarray:
    """Distances of paired waves, as many pairs at a time as stay in the cache."""
    fn = {"dtw": dtw, "softdtw": lambda a, b: soft_dtw(a, b, gamma), "euclidean": euclidean}[metric]
    return np.concatenate([fn(x[k : k + batch], y[k : k + batch]) for k in range(0, len(x), batch)] or [np.zeros(0)])


def _soft_tile(x: np.ndarray, y: np.ndarray, gamma: float, made: tuple) -> np.ndarray:
    """Soft-DTW of all rows of x with all rows of y. A tile in which most pairs, but
    not all, have a cheap path is taken pair by pair."""
    d = _soft_grid(x[:, :, 0], y[:, :, 0], gamma, made) if x.shape[2] == 1 else None
    if d is None and (_some_path(x[:, None], y[None]) <= _room(x.shape[1], y.shape[1]) * gamma).mean() < 0.5:
        d = _soft_cost_grid(x, y, gamma, made)
    if d is None:
        pairs = np.repeat(x, len(y), axis=0), np.tile(y, (len(x), 1, 1))
        d = distance("softdtw", *pairs, gamma).reshape(len(x), len(y))
    return d


#: rows on each side that ``distances`` warps at a time
SIDE = 32


def distances(metric: str, x: np.ndarray, y: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Warping distances of all rows of x to all rows of y. If y is x, each pair
    is computed once."""
    out = np.zeros((len(x), len(y)))
    made = lru_cache(None)(lambda a, b: _diagonals(x.shape[1], y.shape[1], a, b))
    for p in range(0, len(x), SIDE):
        for q in range(p if y is x else 0, len(y), SIDE):
            a, b = x[p : p + SIDE], y[q : q + SIDE]
            if metric == "dtw":
                d = _dtw_grid(a, b, made(len(a), len(b)))
            elif metric == "softdtw":
                d = _soft_tile(a, b, gamma, made(len(a), len(b)))
            else:
                d = distance(metric, np.repeat(a, len(b), axis=0), np.tile(b, (len(a), 1, 1)), gamma).reshape(len(a), len(b))
            out[p : p + SIDE, q : q + SIDE] = d
            if y is x and p < q:
                out[q : q + SIDE, p : p + SIDE] = d.T
    return out
