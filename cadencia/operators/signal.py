"""Signal conditioning of series and waves.

Short waves are arrays, one per row; long series are rows (keys, idx, v) that
are filtered in overlapping chunks, so neither needs a whole series in a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as X
from ..functions import kernels as N
from .joins import interpolate_at
from .ordered import ordered_scan
from .rows import chunks_to_long, long_to_chunks, ragged_kernel, row_kernel


@dataclass(frozen=True)
class EnvelopeSettings:
    """Steps of the muscle envelope; the numbers are fixed values in Hz."""

    bp_low: float = 10.0
    bp_high: float = 490.0
    lp_cut: float = 15.0
    demean: bool = True
    rectify: bool = True
    non_negative: bool = True


# fixed values: settings of the superseded per-cycle envelope
LEGACY = EnvelopeSettings(bp_low=30.0, bp_high=300.0, lp_cut=6.0)


def bandpass(wave: str | Column, fs: float, low: float, high: float, order: int = 4) -> Column:
    sec = N.bandpass_sections(fs, low, high, order)
    return row_kernel(lambda x: N.zero_phase(sec, x), wave, min_points=2)


def lowpass(wave: str | Column, fs: float, cutoff: float) -> Column:
    """Second-order low-pass, both ways, with corrected cutoff, on the non-zero
    span of the wave."""
    sec = N.lowpass_sections(fs, cutoff)
    return row_kernel(lambda x: N.lowpass_nonzero_span(sec, x), wave)


def lowpass_plain(wave: str | Column, fs: float, cutoff: float) -> Column:
    sec = N.lowpass_sections(fs, cutoff, corrected=False)
    return row_kernel(lambda x: N.zero_phase(sec, x), wave, min_points=2)


def fir_lowpass(wave: str | Column, fs: float, cutoff: float, n_taps: int = 13) -> Column:
    """Hamming FIR with mirrored ends, as one native expression."""
    taps = [float(h) for h in N.fir_taps(n_taps, cutoff, fs)]
    a = F.col(wave) if isinstance(wave, str) else wave
    half = n_taps // 2
    last = F.size(a) - 1

    # mirrored at both ends, again and again for waves shorter than the taps
    def mirrored(i: Column) -> Column:
        j = F.when(last > 0, F.pmod(i, F.greatest(2 * last, F.lit(1)))).otherwise(0)
        return F.get(a, F.when(j > last, 2 * last - j).otherwise(j))

    def filtered(wide: Column) -> Column:
        def at(i: Column) -> Column:
            out = None
            for k, h in enumerate(taps):
                term = F.get(wide, i + (2 * half - k)) * h
                out = term if out is None else out + term
            return out

        return F.transform(F.sequence(F.lit(0), last), at)

    # the wave is widened once; as a variable it is not worked out again per point
    wide = F.transform(F.sequence(F.lit(-half), last + half), mirrored)
    return F.get(F.transform(F.array(wide), filtered), F.lit(0))


def _envelope(x: np.ndarray, fs: float, s: EnvelopeSettings) -> np.ndarray:
    if s.demean:
        x = x - np.nanmean(x, axis=1, keepdims=True)
    x = N.zero_phase(N.bandpass_sections(fs, s.bp_low, s.bp_high), x)
    if s.rectify:
        x = np.abs(x)
    x = N.lowpass_nonzero_span(N.lowpass_sections(fs, s.lp_cut), x)
    return np.maximum(x, 0.0) if s.non_negative else x


def envelope(wave: str | Column, fs: float, settings: EnvelopeSettings = EnvelopeSettings()) -> Column:
    """Muscle envelope of a short wave; NULL below five points or when nothing is
    finite."""
    N.bandpass_sections(fs, settings.bp_low, settings.bp_high)

    def run(x: np.ndarray) -> list:
        good = np.isfinite(x).any(axis=1)
        out: list = [None] * len(x)
        if good.any():
            for i, r in zip(np.flatnonzero(good), _envelope(x[good], fs, settings)):
                out[i] = r
        return out

    return row_kernel(run, wave, min_points=5)


def legacy_envelope(wave: str | Column, fs: float) -> Column:
    """Envelope with the older bands, as percent of its maximum."""

    def run(x: np.ndarray) -> np.ndarray:
        y = _envelope(x, fs, LEGACY)
        top = y.max(axis=1, keepdims=True)
        return np.where(top > 0, y / np.where(top > 0, top, 1.0) * 100.0, 0.0)

    return row_kernel(run, wave, min_points=5)


def envelope_long(
    samples: DataFrame, keys: Sequence[str], value: str, fs: float | str, settings: EnvelopeSettings = EnvelopeSettings(), *, chunk: int = 20_000
) -> DataFrame:
    """Envelope of long series (keys, idx, value), to be taken before cycles are
    cut. ``fs`` is the rate of all series or the column that has each one's. The
    mean and the non-zero span are those of the whole series; the filters run per
    chunk with a halo in which they settle to 1e-14 at the largest rate.
    """
    keys = list(keys)
    rate = F.lit(float(fs)) if isinstance(fs, (int, float)) else F.col(fs).cast("double")
    samples = samples.withColumn("_rate", rate)
    largest = float(fs) if isinstance(fs, (int, float)) else samples.agg(F.max("_rate")).first()[0]
    if largest is None:
        return samples.select(*keys, "idx", F.col(value).cast("double").alias(value)).limit(0)

    def filters(r: float) -> tuple:
        return N.bandpass_sections(r, settings.bp_low, settings.bp_high), N.lowpass_sections(r, settings.lp_cut)

    halo = sum(N.settle_samples(f) for f in filters(largest))
    chunk = max(chunk, halo)
    own = [*keys, "_rate"]
    fin = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    stat = samples.groupBy(*own).agg(F.avg(fin).alias("_mean"), F.count(F.lit(1)).alias("_n"))
    s = samples.select(*own, "idx", F.col(value).cast("double").alias("_x")).join(stat, own).where("_n >= 5")
    s = s.withColumn("_x", F.col("_x") - F.col("_mean") if settings.demean else F.col("_x"))
    chunks = long_to_chunks(s, own, "_x", chunk=chunk, halo=halo)

    def run(rows: list[np.ndarray], r: float) -> list[np.ndarray]:
        bp, lp = filters(r)
        y = N.zero_phase_ragged(bp, rows)
        y = [np.abs(v) for v in y] if settings.rectify else y
        y = N.lowpass_nonzero_span(lp, y)
        return [np.maximum(v, 0.0) for v in y] if settings.non_negative else y

    return chunks_to_long(
        chunks.withColumn("_y", ragged_kernel(run, "vs", "_rate")), keys, "_y", chunk=chunk, out=value
    )


def preprocess_before_split(samples: DataFrame, rates: DataFrame, keys: Sequence[str], value: str, settings: EnvelopeSettings = EnvelopeSettings()) -> DataFrame:
    """Envelope for muscle channels of whole trials before they are cut; other
    channels and trials without a rate pass through unchanged, as do those whose
    rate leaves no room for the band.

    ``rates`` is (trial_id, rate); any number of rates takes one pass.
    """
    keys = list(keys)
    ch = F.lower("channel")
    muscle = ch.contains("emg") & ~ch.contains("nfu")
    s = samples.join(rates, "trial_id", "left")
    hit = F.coalesce(muscle & (0.95 * 0.5 * F.col("rate") > settings.bp_low), F.lit(False))
    rest = s.where(~hit).select(*keys, "idx", F.col(value).cast("double").alias(value))
    return rest.unionByName(envelope_long(s.where(hit), keys, value, "rate", settings))


def spline_101(wave: str | Column) -> Column:
    return row_kernel(N.spline_resample_rows, wave)


def spline_101_timed(wave: str | Column, times: str | Column) -> Column:
    return row_kernel(lambda x, t: np.stack([N.spline_resample(a, b) for a, b in zip(x, t)]), wave, times)


def akima_101(wave: str | Column) -> Column:
    return row_kernel(N.akima_resample_rows, wave)


def percent_resample(points: DataFrame, keys: Sequence[str], t: str, v: str, n: int = 101, *, cell_width: float) -> DataFrame:
    """Waves from (keys, t, v) rows on their own time mapped to 0-100 %: missing
    values left out, linear, with a reason where fewer than two are valid.

    The n target times of a series are joined to its samples by interpolation, so
    a series of any length is spread over its time cells.
    """
    keys = list(keys)
    ok = F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")) & F.col(t).isNotNull()
    val = points.where(ok).select(*keys, F.col(t).alias("_ts"), F.col(v).cast("double").alias("_v"))
    span = points.groupBy(*keys).agg(
        F.count_if(ok).alias("_n"), F.min(F.when(ok, F.col(t))).alias("_a"), F.max(F.when(ok, F.col(t))).alias("_b")
    )
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx")
    at = span.where("_n >= 2").select(*keys, "_a", "_b", i)
    # the last target is the last time itself, whatever the rounding
    x = F.when(F.col("idx") == n - 1, F.col("_b")).otherwise(
        F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("idx") / F.lit(float(n - 1))
    )
    at = at.select(*keys, "idx", x.alias("_x"))
    got = interpolate_at(at, val, keys, "_x", "_ts", "_v", "_y", cell_width=cell_width)
    wave = got.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "_y"))).alias("_p"))
    wave = wave.select(*keys, F.col("_p").getField("_y").alias("wave"))
    return span.select(*keys, "_n").join(wave, keys, "left").select(
        *keys, "wave", F.when(F.col("_n") < 2, "missing_values").alias("reason")
    )


def extract_waves(channels: DataFrame, keys: Sequence[str], wanted: str, *, forced: dict[str, str] | None = None, n: int = 101) -> DataFrame:
    """One resampled wave per cycle for a side-free variable.

    ``channels`` holds (keys, side, channel, wave) with channel NULL for a cycle
    without any. The key is the forced one for the side, else the one with the
    side's letter in front, else the plain one. ``reason`` names what is missing.
    """
    keys = list(keys)
    force = F.lit(None).cast("string")
    for s, k in (forced or {}).items():
        force = F.when(F.col("side") == s, k).otherwise(force)
    rank = (
        F.when(F.col("channel") == force, 0)
        .when(force.isNotNull(), None)
        .when(F.col("channel") == F.concat("side", F.lit(wanted)), 1)
        .when(F.col("channel") == wanted, 2)
    )
    g = channels.groupBy(*keys, "side").agg(
        F.count("channel").alias("_n"), F.min_by("wave", rank).alias("_w"), F.min(rank).alias("_r")
    )
    full = F.filter("_w", lambda x: x.isNotNull() & ~F.isnan(x))
    reason = (
        F.when(F.col("_n") == 0, "no_point")
        .when(F.col("_r").isNull(), "missing_key")
        .when(F.col("_w").isNull() | (F.size(full) < 2), "missing_values")
    )
    return g.select(
        *keys, "side", F.when(reason.isNull(), X.resample_linear(full, n)).alias("wave"), reason.alias("reason")
    )


def fill_gaps_long(samples: DataFrame, keys: Sequence[str], t: str, v: str, *, cell: Column) -> DataFrame:
    """Missing values of long series interpolated between their neighbours, ends
    held."""
    val = F.when(F.col(v).isNotNull() & ~F.isnan(v), F.struct(F.col(t).alias("t"), F.col(v).alias("v")))
    s = ordered_scan(samples, keys, [t], prevs={"_p": val}, nexts={"_n": val}, cell=cell)
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(t) - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    good = F.when(~F.isnan(v), F.col(v))
    return s.withColumn(v, F.coalesce(good, line, F.col("_p.v"), F.col("_n.v"))).drop("_p", "_n")


def demean_long(samples: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """Series mean subtracted; the mean is a partial aggregate joined back."""
    m = samples.groupBy(*keys).agg(F.avg(v).alias("_m"))
    return samples.join(m, list(keys)).withColumn(v, F.col(v) - F.col("_m")).drop("_m")


def robust_amplitude_norm(waves: DataFrame, keys: Sequence[str], wave: str = "wave") -> DataFrame:
    """Waves of a key divided by mean + 3 SD of all their points (1 when not
    positive)."""
    w = waves.withColumns(
        {
            "_n": F.size(wave).cast("double"),
            "_s": X.total(wave),
            "_q": X.total(F.transform(wave, lambda x: x * x)),
        }
    )
    g = w.groupBy(*keys).agg(F.sum("_n").alias("_gn"), F.sum("_s").alias("_gs"), F.sum("_q").alias("_gq"))
    mu = F.col("_gs") / F.col("_gn")
    sd = F.sqrt(F.greatest(F.col("_gq") / F.col("_gn") - mu * mu, F.lit(0.0)))
    g = g.select(*keys, F.when(mu + 3 * sd > 0, mu + 3 * sd).otherwise(1.0).alias("amplitude"))
    return waves.join(g, list(keys)).withColumn(
        wave, F.transform(wave, lambda x: x / F.col("amplitude"))
    )


def body_normalise(values: DataFrame, subjects: DataFrame, key: str, *, forces: Sequence[str] = (), lengths: Sequence[str] = ()) -> DataFrame:
    """Forces as percent of body weight, lengths as percent of height."""
    j = values.join(subjects.select(key, "mass", "height"), key, "left")
    w = F.col("mass") * F.lit(9.81)
    cols = {c: F.try_divide(F.col(c), w) * 100 for c in forces}
    cols.update({c: F.try_divide(F.col(c), F.col("height")) * 100 for c in lengths})
    return j.withColumns(cols).drop("mass", "height")


def resultant(fx: str, fy: str, fz: str) -> Column:
    return F.sqrt(F.col(fx) * F.col(fx) + F.col(fy) * F.col(fy) + F.col(fz) * F.col(fz))


def medial_ratio(medial: str | Column, lateral: str | Column) -> Column:
    """Medial share of medial + lateral in percent, missing when both are 0."""
    m = F.col(medial) if isinstance(medial, str) else medial
    q = F.col(lateral) if isinstance(lateral, str) else lateral
    return F.try_divide(m, m + q) * 100


def first_existing(channels: DataFrame, keys: Sequence[str], channel: str, value: str, candidates: Sequence[str]) -> DataFrame:
    """Value of the first candidate channel a key has."""
    rank = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col(channel))
    return channels.where(rank > 0).groupBy(*keys).agg(
        F.min_by(value, rank).alias(value), F.min_by(channel, rank).alias(channel)
    )


def scale_columns(points: DataFrame, idx: str, v: str) -> DataFrame:
    """Standard and min-max scaling per time point across samples."""
    g = points.groupBy(idx).agg(
        F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi")
    )
    j = points.join(g, idx)
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    return j.withColumns(
        {
            "standard": (F.col(v) - F.col("_m")) / one(F.col("_s")),
            "minmax": (F.col(v) - F.col("_lo")) / one(F.col("_hi") - F.col("_lo")),
        }
    ).drop("_m", "_s", "_lo", "_hi")
