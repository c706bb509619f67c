"""Quality checks of cycles and the reviewer's selections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_scan

GRAVITY = 9.81


@dataclass(frozen=True)
class QcRules:
    """Thresholds; the defaults are fixed values. A force limit is a pair of kind
    (``abs``, ``pcGRF`` or ``pcBW``) and number."""

    ik_rms_max: float = 0.02
    ik_max_max: float = 0.04
    so_ms_tol: float = 100.0
    force_rms: tuple[str, float] = ("pcGRF", 6.0)
    force_max: tuple[str, float] = ("pcGRF", 20.0)
    moment_rms_max: float = 50.0
    moment_max_max: float = 75.0


# fixed values: which plate component limits which residual force
PLATE_OF_FORCE = {"FX": "Fy", "FY": "Fz", "FZ": "Fx"}


def ik_flags(errors: DataFrame, cycles: DataFrame, keys: Sequence[str], rules: QcRules = QcRules()) -> DataFrame:
    """Largest RMS and largest maximum marker error against their limits; a cycle
    without marker errors passes."""
    m = errors.groupBy(*keys).agg(
        F.max("marker_error_RMS").alias("_rms"), F.max("marker_error_max").alias("_max")
    )
    return (
        cycles.select(*keys)
        .join(m, list(keys), "left")
        .withColumns(
            {
                "IK_RMS_ok": F.coalesce(F.col("_rms") <= rules.ik_rms_max, F.lit(True)),
                "IK_MAX_ok": F.coalesce(F.col("_max") <= rules.ik_max_max, F.lit(True)),
            }
        )
        .drop("_rms", "_max")
    )


def support_windows(samples: DataFrame, bounds: DataFrame, keys: Sequence[str], rules: QcRules = QcRules()) -> DataFrame:
    """Index window between the contralateral foot off and strike, trimmed at
    both ends by the tolerance. ``bounds`` carries (keys, t_off, t_strike, rate);
    what makes a window impossible is named in ``status``."""
    keys = list(keys)
    b = bounds.withColumn(
        "_skip", F.floor(F.col("rate") * F.lit(max(0.0, rules.so_ms_tol)) / 1000.0).cast("bigint")
    )
    n = samples.join(b, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("t") < F.col("t_off")).alias("_before"),
        F.count_if(F.col("t") <= F.col("t_strike")).alias("_upto"),
    )
    w = b.join(n, keys, "left").withColumns(
        {
            "i0": F.greatest(F.lit(0), F.col("_before") + F.col("_skip")),
            "i1": F.least(F.col("n") - 1, F.col("_upto") - 1 - F.col("_skip")),
        }
    )
    status = (
        F.when(F.col("n").isNull(), "no_samples")
        .when(F.col("t_off").isNull() | F.col("t_strike").isNull(), "event_missing")
        .when(F.isnan("t_off") | F.isnan("t_strike"), "event_not_finite")
        .when(F.col("t_strike") <= F.col("t_off"), "event_order")
        .when(F.col("i1") < F.col("i0"), "window_empty")
        .when(F.col("n") < 2, "too_short")
        .otherwise("ok")
    )
    w = w.withColumn("status", status)
    ok = F.col("status") == "ok"
    return w.select(
        *keys,
        "n",
        F.when(ok, F.col("i0")).alias("i0"),
        F.when(ok, F.col("i1")).alias("i1"),
        "status",
    )


def _rms(c: str) -> Column:
    return F.sqrt(F.avg(F.col(c) * F.col(c)))


def force_stats(samples: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMS and largest absolute value of each force and moment in the window."""
    comps = ("FX", "FY", "FZ", "MX", "MY", "MZ")
    inside = samples.join(windows.where("status = 'ok'"), list(keys)).where(
        F.col("idx").between(F.col("i0"), F.col("i1"))
    )
    return inside.groupBy(*keys).agg(
        *[_rms(c).alias(f"rms_{c}") for c in comps],
        *[F.max(F.abs(c)).alias(f"max_{c}") for c in comps],
    )


def plate_stats(plates: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per plate component the RMS and maximum of the absolute force in the same
    *fraction* of the cycle, then the largest over the plates.

    ``plates`` carries (keys, plate, comp, idx, v), the index counted from 0
    within a plate's component.
    """
    keys = list(keys)
    per = [*keys, "plate", "comp"]
    size = plates.groupBy(*per).agg((F.max("idx") + 1).alias("_len"))
    w = windows.where("status = 'ok'").join(size, keys)
    last = F.col("_len") - 1
    frac = lambda c: F.col(c) / (F.col("n") - 1)
    w = w.select(
        *per,
        F.least(last, F.rint(frac("i0") * last)).cast("bigint").alias("_j0"),
        F.least(last, F.rint(frac("i1") * last)).cast("bigint").alias("_j1"),
    )
    s = (
        plates.join(w, per)
        .where(F.col("idx").between(F.col("_j0"), F.col("_j1")))
        .groupBy(*per)
        .agg(_rms("v").alias("_r"), F.max(F.abs("v")).alias("_m"))
    )
    return s.groupBy(*keys).agg(
        *[F.max(F.when(F.col("comp") == c, F.col("_r"))).alias(f"plate_rms_{c}") for c in ("Fx", "Fy", "Fz")],
        *[F.max(F.when(F.col("comp") == c, F.col("_m"))).alias(f"plate_max_{c}") for c in ("Fx", "Fy", "Fz")],
    )


def so_flags(windows: DataFrame, forces: DataFrame, plates: DataFrame, keys: Sequence[str], rules: QcRules = QcRules(), bodymass: DataFrame | None = None) -> DataFrame:
    """Force and moment flags. Only FY decides on forces, strictly below its
    limit; moments may equal theirs. Flags are NULL where the status is not ok."""
    keys = list(keys)
    j = windows.join(forces, keys, "left").join(plates, keys, "left")
    if bodymass is not None:
        j = j.join(bodymass, [c for c in bodymass.columns if c != "bodymass"], "left")

    def limit(spec: tuple[str, float], stat: str) -> Column:
        kind, x = spec
        if kind == "abs":
            return F.lit(float(x))
        if kind == "pcGRF":
            return F.lit(x / 100.0) * F.col(f"plate_{stat}_{PLATE_OF_FORCE['FY']}")
        if kind == "pcBW":
            return F.lit(x / 100.0 * GRAVITY) * F.col("bodymass")
        raise ValueError(f"unknown force limit {kind}")

    ok = F.col("status") == "ok"
    m = {s: F.greatest(*[F.col(f"{s}_{c}") for c in ("MX", "MY", "MZ")]) for s in ("rms", "max")}
    return j.select(
        *keys,
        F.when(ok & F.col("plate_rms_Fz").isNull(), "no_plate").otherwise(F.col("status")).alias("status"),
        F.when(ok, F.col("rms_FY") < limit(rules.force_rms, "rms")).alias("SO_F_RMS_ok"),
        F.when(ok, F.col("max_FY") < limit(rules.force_max, "max")).alias("SO_F_MAX_ok"),
        F.when(ok, m["rms"] <= rules.moment_rms_max).alias("SO_M_RMS_ok"),
        F.when(ok, m["max"] <= rules.moment_max_max).alias("SO_M_MAX_ok"),
    )


QC_FLAGS = ("IK_RMS_ok", "IK_MAX_ok", "SO_F_RMS_ok", "SO_F_MAX_ok", "SO_M_RMS_ok", "SO_M_MAX_ok")


def qc_all(ik: DataFrame, so: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All flags per cycle; one that could not be computed passes, its reason
    stays in ``status``."""
    j = ik.join(so, list(keys), "left").withColumn("status", F.coalesce("status", F.lit("no_samples")))
    return j.withColumns({f: F.coalesce(f, F.lit(True)) for f in QC_FLAGS})


def qc_bad(flags: DataFrame, columns: Sequence[str] = (*QC_FLAGS, "reconstruction_ok")) -> DataFrame:
    """``bad`` when any present flag is false."""
    have = [c for c in columns if c in flags.columns]
    return flags.withColumn(
        "bad", F.exists(F.array(*[F.col(c).cast("boolean") for c in have]), lambda x: F.coalesce(~x, F.lit(False)))
    )


def default_flags(cycles: DataFrame) -> DataFrame:
    """Selected and reconstruction ok unless set; the first selection is kept as
    ``initial_selected``."""
    return cycles.withColumns(
        {
            "selected": F.coalesce(F.col("selected").cast("int"), F.lit(1)),
            "reconstruction_ok": F.coalesce("reconstruction_ok", F.lit(True)),
        }
    ).withColumn("initial_selected", F.coalesce("initial_selected", "selected"))


def side_mode_filter(cycles: DataFrame, *, sides: Sequence[str] = ("L", "R"), kinetic: bool = True, kinematic: bool = True, hide_deselected: bool = False) -> DataFrame:
    """Cycles of the wanted sides and modes; a missing kinetic flag is kinematic."""
    kin = F.coalesce(F.col("kinetic").cast("boolean"), F.lit(False))
    out = cycles.where(F.col("side").isin(*sides) & ((kin & F.lit(kinetic)) | (~kin & F.lit(kinematic))))
    return out.where(F.coalesce(F.col("selected").cast("int"), F.lit(1)) == 1) if hide_deselected else out


def valid_cycles(samples: DataFrame, plates: DataFrame, flags: DataFrame, keys: Sequence[str], *, rms_limit: float = 0.05, max_limit: float = 0.1) -> DataFrame:
    """Cycles fit for study: FY relative to the largest plate Fz, over the open
    10-30 % of the cycle, below both limits, and selected and kinetic."""
    keys = list(keys)
    span = samples.groupBy(*keys).agg(F.min("t").alias("_t0"), F.max("t").alias("_t1"))
    fz = plates.groupBy(*keys).agg(F.max(F.abs("v")).alias("fz_max")).where(F.col("fz_max") != 0)
    rel, dur = F.col("t") - F.col("_t0"), F.col("_t1") - F.col("_t0")
    mid = (
        samples.join(span, keys)
        .where((rel > F.lit(0.1) * dur) & (rel < F.lit(0.3) * dur))
        .groupBy(*keys)
        .agg(_rms("FY").alias("_r"), F.max(F.abs("FY")).alias("_m"))
    )
    out = mid.join(fz, keys).join(flags, keys)
    return (
        out.withColumns({"rms_rel": F.col("_r") / F.col("fz_max"), "max_rel": F.col("_m") / F.col("fz_max")})
        .where((F.col("rms_rel") < rms_limit) & (F.col("max_rel") < max_limit))
        .where(F.col("selected").cast("boolean") & F.col("kinetic").cast("boolean"))
        .select(*keys, "rms_rel", "max_rel", "fz_max")
    )


def residual_filter(rows: DataFrame, rms: str, mx: str, rms_limit: float, max_limit: float) -> DataFrame:
    """Rows strictly below both limits."""
    return rows.where((F.col(rms) < rms_limit) & (F.col(mx) < max_limit))


def residual_shares(rows: DataFrame, rms: str, mx: str, rms_limit: float, max_limit: float, by: Sequence[str] = ()) -> DataFrame:
    """Percent excluded by each limit and percent valid."""
    pct = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    r, m = F.col(rms) >= rms_limit, F.col(mx) >= max_limit
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        pct(r).alias("excl_rms_pct"),
        pct(m).alias("excl_max_pct"),
        pct(~r & ~m).alias("valid_pct"),
    )


def dedupe(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key in a stated order, as a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("_r"))
        .select(*keys, "_r.*")
    )


def filter_clusters(rows: DataFrame, cluster: str, *, min_cycles: int = 1, include: Sequence | None = None, exclude: Sequence | None = None) -> DataFrame:
    """Rows of the wanted clusters that keep at least ``min_cycles`` rows."""
    out = rows.where(F.col(cluster).isNotNull())
    if include is not None:
        out = out.where(F.col(cluster).isin(*include))
    if exclude is not None:
        out = out.where(~F.col(cluster).isin(*exclude))
    big = out.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cycles)
    return out.join(big.select(cluster), cluster, "left_semi")


def box_select(points: DataFrame, cycles: DataFrame, keys: Sequence[str], box: tuple[float, float, float, float], value: int) -> DataFrame:
    """Selection changes made by a box (x0, x1, y0, y1): one per cycle with a
    finite point inside, none for cycles that have the value already."""
    x0, x1, y0, y1 = box
    lo_x, hi_x, lo_y, hi_y = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    inside = F.col("x").between(lo_x, hi_x) & F.col("y").between(lo_y, hi_y)
    hit = points.where(inside).select(*keys).distinct()
    return (
        cycles.join(hit, list(keys), "left_semi")
        .where(F.col("selected").cast("int") != value)
        .select(*keys, F.col("selected").cast("int").alias("old"), F.lit(value).alias("new"))
    )


def apply_changes(cycles: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        cycles.join(changes.select(*keys, "new"), list(keys), "left")
        .withColumn("selected", F.coalesce("new", F.col("selected").cast("int")))
        .drop("new")
    )


def selection_diff(current: DataFrame, baseline: DataFrame, keys: Sequence[str], by: Sequence[str] = ("side", "kinetic")) -> DataFrame:
    """Number of cycles per group whose selection differs from the baseline; a
    cycle without a baseline counts as selected before."""
    b = baseline.select(*keys, F.col("selected").cast("int").alias("_b"))
    j = current.join(b, list(keys), "left").withColumn("_b", F.coalesce("_b", F.lit(1)))
    new = F.coalesce(F.col("selected").cast("int"), F.lit(1))
    return j.groupBy(*by).agg(
        F.count_if((F.col("_b") == 0) & (new == 1)).alias("n_added"),
        F.count_if((F.col("_b") == 1) & (new == 0)).alias("n_removed"),
        F.count_if(F.col("_b") != new).alias("n_changed"),
    )


def replay_selection_log(log: DataFrame, edits: DataFrame, session: str, key: str, *, upto: int | None = None, cell: Column | None = None) -> DataFrame:
    """State of every touched cycle after replaying a log of push, undo and redo.

    ``log`` is (session, seq, op) of operations that took effect; ``edits`` is
    (session, seq, key, old, new) of the pushes. The depth after an operation is
    a running sum. A push counts when its depth is within the final depth and no
    later push reached the same depth; a cycle touched only by undone pushes
    keeps its first old value.
    """
    lg = log if upto is None else log.where(F.col("seq") <= upto)
    step = F.when(F.col("op") == "undo", F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    lg = ordered_scan(lg.withColumn("_step", step), [session], ["seq"], totals={"_d": F.col("_step")}, cell=cell)
    lg = lg.withColumn("_d", F.col("_d") + F.col("_step"))
    final = lg.groupBy(session).agg(F.max_by("_d", "seq").alias("_final"))
    live = (
        lg.where("op = 'push'")
        .groupBy(session, "_d")
        .agg(F.max("seq").alias("seq"))
        .join(final, session)
        .where(F.col("_d") <= F.col("_final"))
        .select(session, "seq", F.lit(True).alias("_live"))
    )
    ed = edits if upto is None else edits.where(F.col("seq") <= upto)
    e = ed.join(live, [session, "seq"], "left")
    return e.groupBy(session, key).agg(
        F.coalesce(
            F.max_by(F.when(F.col("_live"), F.col("new")), F.when(F.col("_live"), F.col("seq"))),
            F.min_by("old", "seq"),
        ).alias("state")
    )


def merge_flags(cycles: DataFrame, edits: DataFrame, keys: Sequence[str], defaults: Mapping[str, int]) -> DataFrame:
    """Edited flags written back to the cycles: only the known ones and names
    that end in ``_ok``, as 0/1, with a default where neither side has one."""
    flags = [c for c in edits.columns if c not in keys and (c in defaults or c.endswith("_ok"))]
    e = edits.select(*keys, *[F.col(f).cast("int").alias(f"_n_{f}") for f in flags])
    j = cycles.join(e, list(keys), "left")
    cols = {}
    for f in flags:
        old = F.col(f).cast("int") if f in cycles.columns else F.lit(None).cast("int")
        cols[f] = F.coalesce(F.col(f"_n_{f}"), old, F.lit(defaults.get(f)).cast("int"))
    return j.withColumns(cols).drop(*[f"_n_{f}" for f in flags])


def valid_id_counts(valid: DataFrame, ident: str = "subject", side: str = "side") -> DataFrame:
    """Valid cycles per id and per id and side; side NULL is the id's total."""
    return valid.rollup(ident, side).agg(F.count(F.lit(1)).alias("n_valid")).where(F.col(ident).isNotNull())
