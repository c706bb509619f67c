"""Events, cycles and time axes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import nearest_asof, slice_intervals
from .ordered import exact_quantiles, ordered_scan, time_cell

ORDER = ("t", "label", "event_id")


def build_events(raw: DataFrame, keys: Sequence[str], *, cell_width: float) -> DataFrame:
    """(keys, t, context, label, event_id) rows to events in time order, with
    the context put before the label and ``seq`` numbered from 1."""
    ev = raw.withColumn("label", F.trim(F.concat_ws(" ", F.trim("context"), F.trim("label"))))
    return ordered_scan(ev, keys, ORDER, row_no="seq", cell=time_cell("t", cell_width))


def filter_events(events: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Events whose label contains any keyword; no keywords keep everything."""
    if not keywords:
        return events
    cond = F.lit(False)
    for k in keywords:
        cond = cond | F.lower("label").contains(k.lower())
    return events.where(cond)


def choose_time_row(times: DataFrame, key: str) -> DataFrame:
    """Of two stored time rows (row 0 and 1) keep row 1 when its absolute sum
    is at least that of row 0. Input (key, row, pos, t)."""
    s = times.groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("row") == 1, F.abs("t"))), F.lit(-1.0)).alias("_s1"),
        F.coalesce(F.sum(F.when(F.col("row") == 0, F.abs("t"))), F.lit(0.0)).alias("_s0"),
    )
    pick = s.select(key, F.when(F.col("_s1") >= F.col("_s0"), 1).otherwise(0).alias("row"))
    return times.join(pick, [key, "row"], "left_semi").drop("row")


def strikes_by_side(events: DataFrame, action: str, keys: Sequence[str], side: str = "side") -> DataFrame:
    """Distinct times of one action per series and side."""
    return events.where(F.lower("label") == action.lower()).select(*keys, side, "t").distinct()


def extract_cycles(
    events: DataFrame,
    definitions: Mapping[str, Sequence[str]],
    keys: Sequence[str],
    *,
    order: Sequence[str] = ORDER,
    cell_width: float,
    contra_off: tuple[str, str] | None = None,
    contra_strike: tuple[str, str] | None = None,
) -> DataFrame:
    """Cycles of two or three events, numbered from 1 per series and type.

    Two equal labels pair consecutive occurrences. Two different labels take,
    for each start, the first end after it in event order. Three labels take the
    first central after the start, then the first end after that. Ends may be
    shared; a start without central or end makes no cycle.

    ``contra_off``/``contra_strike`` are (pattern, expected label): the event
    before the central one / after the start one that contains the pattern is
    reported when it is the expected one, the strike only inside the cycle; its
    place in the cycle is given in per cent. All definitions are found in one scan.
    """
    keys, order = list(keys), list(order)
    each = {name: (labels[0], labels[1] if len(labels) == 3 else None, labels[-1]) for name, labels in definitions.items()}
    here = F.struct(F.col("t").alias("t"))
    kept = sorted({x for labels in each.values() for x in labels if x is not None})
    keep = F.col("label").isin(*kept)
    for c in (contra_off, contra_strike):
        if c:
            keep = keep | F.col("label").contains(c[0])

    def numbered(what: str, found: set) -> dict:
        return {x: f"_{what}{i}" for i, x in enumerate(sorted(found))}

    # definitions share a scan, and in it what they have in common
    ends = numbered("end", {end for _, _, end in each.values()})
    starts = numbered("starts", {start for start, _, _ in each.values()})
    mids = numbered("mid", {(central, end) for _, central, end in each.values() if central is not None})
    prevs = {}
    nexts = {c: F.when(F.col("label") == end, here) for end, c in ends.items()}
    if contra_off:
        prevs["_off"] = F.when(F.col("label").contains(contra_off[0]), F.struct("label", F.col("t").alias("t")))
    if contra_strike:
        nexts["_strike"] = F.when(F.col("label").contains(contra_strike[0]), F.struct("label", F.col("t").alias("t")))
    ev = ordered_scan(
        events.where(keep),
        keys,
        order,
        prevs=prevs,
        nexts=nexts,
        chained={
            c: (F.when(F.col("label") == central, F.col("t")), [ends[end], *prevs]) for (central, end), c in mids.items()
        },
        # a start with an end makes every earlier start complete as well, so
        # the number of a cycle is the number of its start
        totals={c: F.when(F.col("label") == start, F.lit(1).cast("bigint")).otherwise(0) for start, c in starts.items()},
        cell=time_cell("t", cell_width),
    )
    none = F.lit(None).cast("double")
    found = []
    for name, (start, central, end) in each.items():
        mid = F.col(mids[central, end]) if central is not None else None
        t_end = mid[ends[end]]["t"] if mid is not None else F.col(ends[end])["t"]
        t_central = mid["at"] if mid is not None else none
        dur = t_end - F.col("t")
        pct = F.when(dur == 0, 0.0).otherwise((t_central - F.col("t")) / dur * 100)
        row = {
            "cycle_type": F.lit(name),
            "cycle_no": (F.col(starts[start]) + 1).cast("bigint"),
            "t_start": F.col("t"),
            "t_central": t_central,
            "t_end": t_end,
            "central_pct": F.when(t_central.isNotNull(), pct),
        }
        if contra_off and mids:
            got = none if mid is None else F.when(mid["_off"]["label"] == contra_off[1], mid["_off"]["t"])
            row |= contra_columns("off", got, F.col("t"), t_end)
        if contra_strike:
            hit = F.col("_strike")["t"]
            inside = (hit >= F.col("t")) & (hit <= t_end)
            got = F.when((F.col("_strike")["label"] == contra_strike[1]) & inside, hit)
            row |= contra_columns("strike", got, F.col("t"), t_end)
        one = F.struct(*[v.alias(k) for k, v in row.items()])
        found.append(F.when((F.col("label") == start) & t_end.isNotNull(), one))
    return ev.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("_c")).select(*keys, "_c.*")


def contra_columns(kind: str, t: Column, t_start: Column, t_end: Column) -> dict[str, Column]:
    """Time of a contralateral event and where it lies in the cycle, in per cent
    (null in a cycle without duration)."""
    dur = t_end - t_start
    return {f"t_contra_{kind}": t, f"contra_{kind}_pct": F.when(dur != 0, (t - t_start) / dur * 100)}


def slice_cycles(samples: DataFrame, cycles: DataFrame, keys: Sequence[str], *, cell_width: float) -> DataFrame:
    """All samples of each cycle, both ends inclusive; a sample on a shared
    border belongs to both cycles."""
    return slice_intervals(
        samples, cycles, keys, "t", "t_start", "t_end", cell_width=cell_width
    )


def central_frames(
    cycles: DataFrame, frames: DataFrame, keys: Sequence[str], *, cell_width: float, time: str = "t_central", out: str = "frame"
) -> DataFrame:
    """Cycles with the point frame nearest to the event at ``time``, null where
    there is no such event."""
    at = cycles.withColumn("_at", F.coalesce(time, "t_start"))
    found = nearest_asof(at, frames, keys, "_at", "t", ["frame"], cell_width=cell_width, tie_order=["frame"])
    return found.withColumn("frame", F.when(F.col(time).isNotNull(), F.col("frame"))).drop("_at").withColumnRenamed("frame", out)


def cycle_flag(cycles: DataFrame, events: DataFrame, keys: Sequence[str], flag: str, *, cell_width: float) -> DataFrame:
    """Cycles with the flag of the event nearest to the cycle start; among
    events of one time the first in event order decides."""
    return nearest_asof(
        cycles, events, keys, "t_start", "t", [flag], cell_width=cell_width, tie_order=["label", "event_id"]
    )


def has_sequence(events: DataFrame, keys: Sequence[str], order: str, pattern: Sequence[str], *, cell: Column | None = None) -> DataFrame:
    """Per series: does the label list contain the pattern as consecutive
    entries? An empty pattern is always contained."""
    keys = list(keys)
    if not pattern:
        return events.select(*keys).distinct().withColumn("matched", F.lit(True))
    ev = ordered_scan(
        events.select(*keys, order, "label"), keys, [order], row_no="_seq", cell=cell
    )
    # a row that equals pattern entry k votes for a match that began k rows ago
    ks = F.array(*[F.when(F.col("label") == p, F.lit(k)) for k, p in enumerate(pattern)])
    votes = (
        ev.select(*keys, "_seq", F.explode(F.array_compact(ks)).alias("_k"))
        .groupBy(*keys, (F.col("_seq") - F.col("_k")).alias("_from"))
        .agg(F.count(F.lit(1)).alias("_hits"))
        .where(F.col("_hits") == len(pattern))
        .select(*keys)
        .distinct()
        .withColumn("matched", F.lit(True))
    )
    return (
        events.select(*keys)
        .distinct()
        .join(votes, keys, "left")
        .withColumn("matched", F.coalesce("matched", F.lit(False)))
    )


def missing_required(present: DataFrame, keys: Sequence[str], label: str, expected: Sequence[str]) -> DataFrame:
    """Expected labels a series lacks, as one sorted list per series."""
    have = present.groupBy(*keys).agg(
        F.collect_set(F.when(F.col(label).isin(*expected), F.col(label))).alias("_have")
    )
    want = F.array(*[F.lit(e) for e in expected])
    return (
        have.withColumn("missing", F.array_sort(F.array_except(want, F.col("_have"))))
        .where(F.size("missing") > 0)
        .drop("_have")
    )


def missing_sections(sections: DataFrame, trials: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Trials that lack a required section, also trials with none at all."""
    have = sections.where(F.col("section").isin(*required)).groupBy(key).agg(
        F.collect_set("section").alias("_have")
    )
    want = F.array(*[F.lit(r) for r in required])
    lack = F.array_sort(F.array_except(want, F.coalesce("_have", F.array().cast("array<string>"))))
    return (
        trials.select(key)
        .join(have, key, "left")
        .select(key, lack.alias("missing"))
        .where(F.size("missing") > 0)
    )


def detect_scheme(
    events: DataFrame,
    keys: Sequence[str],
    left: Column,
    right: Column,
    action: Column,
    *,
    tolerance: float,
    cell_width: float,
    share: float = 0.5,
) -> DataFrame:
    """``exercise`` when at least ``share`` of the left events have a right event
    of the same action strictly closer than ``tolerance``, else ``locomotion``."""
    keys = list(keys)
    ev = events.withColumns({"_act": action, "_left": left, "_right": right})
    hit = F.when(F.col("_right"), F.struct(F.col("t").alias("t")))
    ev = ordered_scan(
        ev.where(F.col("_left") | F.col("_right")),
        [*keys, "_act"],
        ["t", "event_id"],
        prevs={"_p": hit},
        nexts={"_n": hit},
        cell=time_cell("t", cell_width),
    )
    near = (F.coalesce(F.col("t") - F.col("_p.t"), F.lit(float("inf"))) < tolerance) | (
        F.coalesce(F.col("_n.t") - F.col("t"), F.lit(float("inf"))) < tolerance
    )
    per = (
        ev.where("_left")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_left"),
            F.count_if(near).alias("n_matched"),
        )
    )
    return per.withColumn("share", F.col("n_matched") / F.col("n_left")).withColumn(
        "scheme", F.when(F.col("share") >= share, "exercise").otherwise("locomotion")
    )


def strike_intervals(
    strikes: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    *,
    sample_keys: Sequence[str],
    min_samples: int = 50,
    cell_width: float,
) -> DataFrame:
    """Intervals between consecutive strikes of a series that hold at least
    ``min_samples`` samples; strikes that do not increase are skipped."""
    keys = list(keys)
    nx = ordered_scan(
        strikes.select(*keys, "t").distinct(),
        keys,
        ["t"],
        nexts={"_n": F.struct(F.col("t").alias("t"))},
        cell=time_cell("t", cell_width),
    )
    iv = nx.where(F.col("_n.t") > F.col("t")).select(
        *keys, F.col("t").alias("t_start"), F.col("_n.t").alias("t_end")
    )
    inside = slice_intervals(
        samples.select(*sample_keys, F.col("t").alias("_ts")),
        iv,
        sample_keys,
        "_ts",
        "t_start",
        "t_end",
        cell_width=cell_width,
    )
    return (
        inside.groupBy(*keys, "t_start", "t_end")
        .agg(F.count(F.lit(1)).alias("n_samples"))
        .where(F.col("n_samples") >= min_samples)
    )


def time_axes(arrays: DataFrame, kind: str, rate: Column, start: Column) -> DataFrame:
    """Explode a value array with its time axis. Point time is
    ``frame/rate - 1/rate`` from the first frame; analog time counts on from the
    first point time."""
    ex = arrays.select("*", F.posexplode("values").alias("idx", "v")).drop("values")
    if kind == "point":
        frame = start + F.col("idx")
        return ex.withColumns({"frame": frame.cast("bigint"), "t": frame / rate - F.lit(1.0) / rate})
    return ex.withColumns({"frame": (F.col("idx") + 1).cast("bigint"), "t": F.col("idx") / rate + start})


def sampling_rate(samples: DataFrame, keys: Sequence[str], *, cell_width: float, default: float | None = None) -> DataFrame:
    """1 / median time step per series, ``default`` where there is no step."""
    keys = list(keys)
    d = ordered_scan(
        samples.select(*keys, "t").distinct(),
        keys,
        ["t"],
        prevs={"_p": F.struct(F.col("t").alias("t"))},
        cell=time_cell("t", cell_width),
    ).withColumn("_dt", F.col("t") - F.col("_p.t"))
    q = exact_quantiles(d, keys, "_dt", {"median_dt": 0.5})
    rate = F.when(F.col("median_dt") > 0, 1 / F.col("median_dt"))
    if default is None:
        return q.withColumn("rate", rate)
    series = samples.select(*keys).distinct()
    return series.join(q, keys, "left").withColumn("rate", F.coalesce(rate, F.lit(default)))


def trial_header(trials: DataFrame) -> DataFrame:
    """Typed header columns; the subject is the first listed name or UNKNOWN."""
    first = F.get(F.filter("subjects", lambda s: F.length(F.trim(s)) > 0), 0)
    return trials.withColumn("subject", F.coalesce(F.trim(first), F.lit("UNKNOWN")))


def list_cycles(cycles: DataFrame, cycle_groups: DataFrame, flags: DataFrame, keys: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """One row per cycle with the groups it holds and its flags.

    Groups are the expected ones that are present, or all present ones when no
    expected one is. Flags default to selected and reconstruction ok; a cluster
    that is not an integer is missing.
    """
    keys = list(keys)
    g = cycle_groups.groupBy(*keys).agg(F.sort_array(F.collect_set("group")).alias("_all"))
    hit = F.array_intersect(F.col("_all"), F.array(*[F.lit(e) for e in expected]))
    g = g.select(*keys, F.when(F.size(hit) > 0, hit).otherwise(F.col("_all")).alias("groups"))
    return (
        cycles.join(g, keys, "left")
        .join(flags, keys, "left")
        .withColumns(
            {
                "groups": F.coalesce("groups", F.array().cast("array<string>")),
                "selected": F.coalesce(F.col("selected").cast("int"), F.lit(1)),
                "reconstruction_ok": F.coalesce(F.col("reconstruction_ok"), F.lit(True)),
                "cluster": F.expr("try_cast(cluster as int)"),
            }
        )
    )


def kinetic_validity(
    events: DataFrame,
    points: DataFrame,
    plates: DataFrame,
    keys: Sequence[str],
    targets: Mapping[str, Sequence[tuple[str, float, float, float]]],
    *,
    cell_width: float,
) -> DataFrame:
    """Did the foot of an event hit a plate of its own side?

    The target marker at the frame nearest to the event must lie within half the
    plate's extent plus the x and y thresholds, and within the z threshold, of
    the plate centre. ``targets`` maps a side to (marker, dx, dy, dz); ``plates``
    holds (keys, plate, side, corner, x, y, z); ``points`` holds
    (keys, marker, frame, t, x, y, z).
    """
    keys = list(keys)
    ev = events.withColumn(
        "side",
        F.when(F.lower("label").contains("left"), "left").when(
            F.lower("label").contains("right"), "right"
        ),
    )
    spec = F.create_map(
        *[
            x
            for s, marks in targets.items()
            for x in (
                F.lit(s.lower()),
                F.array(
                    *[
                        F.struct(
                            F.lit(m).alias("marker"),
                            F.lit(float(a)).alias("dx"),
                            F.lit(float(b)).alias("dy"),
                            F.lit(float(c)).alias("dz"),
                        )
                        for m, a, b, c in marks
                    ]
                ),
            )
        ]
    )
    aimed = ev.where(F.col("side").isNotNull()).select(
        *keys, "event_id", "side", "t", F.explode(spec[F.col("side")]).alias("_m")
    )
    aimed = aimed.select(*keys, "event_id", "side", "t", F.col("_m.marker").alias("marker"), "_m.dx", "_m.dy", "_m.dz")
    at = nearest_asof(
        aimed,
        points.withColumnRenamed("t", "_pt"),
        [*keys, "marker"],
        "t",
        "_pt",
        ["x", "y", "z"],
        cell_width=cell_width,
        tie_order=["frame"],
    )
    centre = plates.groupBy(*keys, "plate").agg(
        F.first(F.lower("side")).alias("side"),
        *[F.avg(c).alias(f"c{c}") for c in "xyz"],
        *[F.min(c).alias(f"lo_{c}") for c in "xy"],
        *[F.max(c).alias(f"hi_{c}") for c in "xy"],
    )
    # the corner farthest from the centre along an axis is its minimum or maximum
    centre = centre.withColumns(
        {
            f"half_{c}": F.greatest(
                F.col(f"hi_{c}") - F.col(f"c{c}"), F.col(f"c{c}") - F.col(f"lo_{c}")
            )
            for c in "xy"
        }
    )
    hit = at.join(centre, [*keys, "side"]).where(
        (F.abs(F.col("x") - F.col("cx")) <= F.col("half_x") + F.col("dx"))
        & (F.abs(F.col("y") - F.col("cy")) <= F.col("half_y") + F.col("dy"))
        & (F.abs(F.col("z") - F.col("cz")) <= F.col("dz"))
    )
    ok = hit.select(*keys, "event_id").distinct().withColumn("_k", F.lit(True))
    return (
        ev.join(ok, [*keys, "event_id"], "left")
        .withColumn("kinetic", F.coalesce("_k", F.lit(False)))
        .drop("_k", "side")
    )
