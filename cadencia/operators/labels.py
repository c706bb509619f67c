"""Channel labels: harmonising, patching, swapping and choosing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import partial
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_key, natural_key, safe_name, short_label, side_free_key


class _Namer:
    """Names of one trial. A taken stem is numbered, from a counter of its own;
    a number that would pass ``limit`` replaces the end of the stem. With
    ``strict``, a stem longer than the limit is numbered too."""

    def __init__(self, limit: int, strict: bool):
        self.limit, self.strict = limit, strict
        self.taken: set[str] = set()
        self.turns: dict[str, count] = {}

    def __call__(self, stem: str) -> str:
        free = stem not in self.taken and not (self.strict and len(stem) > self.limit)
        turns = self.turns.setdefault(stem, count(1))
        name = stem if free else next(n for n in map(partial(self.numbered, stem), turns) if n not in self.taken)
        self.taken.add(name)
        return name

    def numbered(self, stem: str, k: int) -> str:
        return f"{stem[: self.limit - len(str(k)) - 1]}_{k}"


def _unique(df: DataFrame, trial: str, order: str, candidate: Column, limit: int, out: str, strict: bool) -> DataFrame:
    """Number equal candidates of a trial. Only trials where a numbered name
    meets another name go through the step-by-step rule; a trial's channel list
    is bounded by the recording format."""
    df = df.withColumn("_cand", candidate)
    k = F.row_number().over(Window.partitionBy(trial, "_cand").orderBy(order)) - 1
    tail = F.concat(F.lit("_"), k.cast("string"))
    tried = df.withColumn("_tail", tail).withColumn("_k", k).withColumn(
        out,
        F.when(F.col("_k") == 0, F.col("_cand")).otherwise(
            F.concat(F.expr(f"left(_cand, {limit} - length(_tail))"), F.col("_tail"))
        ),
    )
    clash = (
        tried.groupBy(trial, out)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) | (F.lit(strict) & (F.length(out) > limit)))
        .select(trial)
        .distinct()
    )
    fine = tried.join(clash, trial, "left_anti").select(*df.columns, out)
    redo = df.join(clash, trial, "left_semi")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, namer = None, None
        for b in batches:
            names = []
            for t, stem in zip(b.column(trial).to_pylist(), b.column("_cand").to_pylist()):
                if namer is None or t != now:
                    now, namer = t, _Namer(limit, strict)
                names.append(None if stem is None else namer(stem))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string())], names=[*b.schema.names, out])

    # trials are short and many: a task takes one after the other from its sorted rows
    schema = redo.withColumn(out, F.lit("")).schema
    fixed = redo.repartition(trial).sortWithinPartitions(trial, F.col(order).asc_nulls_last()).mapInArrow(named, schema)
    return fine.unionByName(fixed.select(*fine.columns)).drop("_cand")


def unique_labels(df: DataFrame, trial: str, label: str, order: str, *, limit: int = 31, out: str = "channel") -> DataFrame:
    """Short labels; equal ones of a trial are numbered. A label whose tokens
    are cut may still be longer than ``limit``; only a number has to fit."""
    return _unique(df, trial, order, short_label(label, limit), limit, out, strict=False)


def safe_field_names(
    df: DataFrame, trial: str, label: str, order: str, *, translation: DataFrame | None = None, limit: int = 63, out: str = "field"
) -> DataFrame:
    """Safe names from an optional (label, short) translation table."""
    if translation is None:
        return _unique(df, trial, order, safe_name(label, limit), limit, out, strict=True)
    t = translation.select(F.col("label").alias(label), F.col("short").alias("_short"))
    df = df.join(t, label, "left").withColumn("_short", F.coalesce("_short", label))
    return _unique(df, trial, order, safe_name("_short", limit), limit, out, strict=True).drop("_short")


def whitelist_points(df: DataFrame, label: str, wanted: Sequence[str], targets: Sequence[str] = ()) -> DataFrame:
    """Points named in the list or used as targets; ``listed`` marks those to
    keep in the output. Labels that start with ``*`` are dropped."""
    low = F.lower(F.trim(F.col(label)))
    named = low.isin(*[w.lower() for w in wanted]) if wanted else F.lit(True)
    aimed = low.isin(*[t.lower() for t in targets]) if targets else F.lit(False)
    return df.where(~low.startswith("*") & (named | aimed)).withColumn("listed", named)


def whitelist_analog(df: DataFrame, label: str, keywords: Sequence[str]) -> DataFrame:
    """Analog channels whose label contains any keyword."""
    cond = F.lit(not keywords)
    for k in keywords:
        cond = cond | F.lower(label).contains(k.lower())
    return df.where(cond)


def filter_sections(params: DataFrame, keywords: Sequence[str], already: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Parameters whose key contains any keyword, less those held elsewhere."""
    out = whitelist_analog(params, key, keywords)
    if already is not None:
        on = [c for c in already.columns if c in params.columns]
        out = out.join(already.select(*on).distinct(), on, "left_anti")
    return out


def label_inventory(labels: DataFrame, label: str, *, skip_star: bool = True) -> DataFrame:
    """Per alias group the most frequent spelling (smallest on ties), counts,
    and whether the group has more than one spelling."""
    src = labels.where(~F.col(label).startswith("*")) if skip_star else labels
    spell = src.groupBy(alias_key(label).alias("group_key"), F.col(label).alias("_lab")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return spell.groupBy("group_key").agg(
        F.min_by("_lab", F.struct((-F.col("_n")).alias("n"), F.col("_lab").alias("l"))).alias("canonical"),
        F.sum("_n").alias("n_labels"),
        F.count(F.lit(1)).alias("n_spellings"),
        (F.count(F.lit(1)) > 1).alias("mutable"),
    )


def patch_labels(labels: DataFrame, label: str, inventory: DataFrame, *, out: str = "patched") -> DataFrame:
    """Canonical spelling for labels of mutable groups; empty labels and labels
    that start with ``*`` stay as they are."""
    inv = inventory.where("mutable").select("group_key", "canonical")
    lab = F.col(label)
    j = labels.withColumn("group_key", alias_key(label)).join(inv, "group_key", "left")
    skip = (F.trim(lab) == "") | lab.startswith("*") | F.col("canonical").isNull()
    return (
        j.withColumn(out, F.when(skip, lab).otherwise(F.col("canonical")))
        .withColumn("changed", F.col(out) != lab)
        .drop("group_key", "canonical")
    )


def _block_positions(blocks: DataFrame, trial: str) -> DataFrame:
    """Rows (trial, block, pos) with their position over all blocks of a trial.
    Block lengths are summed first, so only one row per block is ordered."""
    sizes = blocks.groupBy(trial, "block").agg(F.count(F.lit(1)).alias("_len"))
    w = Window.partitionBy(trial)
    sizes = sizes.withColumns(
        {
            "_off": F.coalesce(
                F.sum("_len").over(w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
            "_total": F.sum("_len").over(w),
            "_blocks": F.count(F.lit(1)).over(w),
        }
    )
    return blocks.join(sizes, [trial, "block"]).withColumn("_at", F.col("_off") + F.col("pos"))


def condense_blocks(blocks: DataFrame, trial: str, *, limit: int = 255) -> DataFrame:
    """Merge the label blocks of a trial into block 1 when there are several and
    all labels fit the limit. ``pos`` counts from 0 inside a block."""
    b = _block_positions(blocks, trial)
    merge = (F.col("_blocks") > 1) & (F.col("_total") <= limit)
    return b.withColumns(
        {
            "block": F.when(merge, F.lit(1).cast(blocks.schema["block"].dataType)).otherwise(F.col("block")),
            "pos": F.when(merge, F.col("_at")).otherwise(F.col("pos")).cast("bigint"),
            "merged": merge,
        }
    ).drop("_len", "_off", "_total", "_blocks", "_at")


def trim_to_labels(descriptions: DataFrame, labels: DataFrame, trial: str) -> DataFrame:
    """Descriptions beyond the number of labels are cut."""
    n = labels.groupBy(trial).agg(F.count(F.lit(1)).alias("_n"))
    return descriptions.join(n, trial).where(F.col("pos") < F.col("_n")).drop("_n")


def reconcile_counts(blocks: DataFrame, counts: DataFrame, trial: str) -> DataFrame:
    """Labels cut from the end so that as many stay as there are data channels
    (``n_channels``); too few labels give status ``too_few_labels``."""
    b = _block_positions(blocks, trial).join(counts, trial)
    status = F.when(F.col("_total") < F.col("n_channels"), "too_few_labels").when(
        F.col("_total") > F.col("n_channels"), "trimmed"
    ).otherwise("ok")
    return (
        b.where(F.col("_at") < F.col("n_channels"))
        .withColumn("status", status)
        .drop("_len", "_off", "_total", "_blocks", "_at", "n_channels")
    )


def discover_keys(channels: DataFrame, key: str) -> DataFrame:
    """Distinct side-free keys with the number of channels behind each; numbered
    force channels also give their wildcard."""
    k = F.col(key)
    wild = F.when(
        k.rlike(r"(?i)^Force_F[xyz][0-9]+$"), F.concat(F.regexp_extract(k, r"(?i)^(Force_F[xyz])", 1), F.lit("*"))
    )
    shown = F.explode(F.array_compact(F.array(side_free_key(k), wild)))
    return channels.select(shown.alias("display")).groupBy("display").agg(F.count(F.lit(1)).alias("n_channels"))


def wildcard_channels(channels: DataFrame, key: str, glob: str) -> DataFrame:
    """Channels that match ``prefix*suffix``."""
    prefix, _, suffix = glob.partition("*")
    return channels.where(F.col(key).startswith(prefix) & F.col(key).endswith(suffix))


# fixed values: groups a channel is looked up in, first hit wins
GROUP_ORDER = ("point", "IK_markerErr", "SO_forces", "analog", "grf", "jrf", "residual", "JRL")


def resolve_channel(channels: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Of the groups that hold a channel keep the first in lookup order."""
    rank = F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), F.col(group))
    return (
        channels.where(rank > 0)
        .groupBy(*keys)
        .agg(
            F.min_by(F.struct(group, value), F.struct(rank.alias("r"), F.col(value).alias("v"))).alias("_h")
        )
        .select(*keys, "_h.*")
    )


def normalise_swaps(mapping: DataFrame) -> DataFrame:
    """(sid, src, dst) with identities dropped and a reciprocal pair kept once,
    smaller label first."""
    m = mapping.where(F.col("src") != F.col("dst"))
    back = m.select("sid", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_r"))
    return (
        m.join(back, ["sid", "src", "dst"], "left")
        .where(F.col("_r").isNull() | (F.col("src") < F.col("dst")))
        .drop("_r")
    )


def apply_swaps(labels: DataFrame, mapping: DataFrame, key: str, label: str = "label", out: str = "new_label") -> DataFrame:
    """Per subject, exchange two labels when the target exists among the
    subject's labels, else rename. ``mapping`` is (key, src, dst) with
    reciprocal pairs normalised."""
    fwd = mapping.select(key, F.col("src").alias(label), F.col("dst").alias("_to"))
    present = labels.select(key, label).distinct()
    real = mapping.join(present.withColumnRenamed(label, "src"), [key, "src"], "left_semi")
    back = real.groupBy(key, F.col("dst").alias(label)).agg(F.min("src").alias("_from"))
    return (
        labels.join(fwd, [key, label], "left")
        .join(back, [key, label], "left")
        .withColumn(out, F.coalesce("_to", "_from", label))
        .drop("_to", "_from")
    )


def pick_active_side(values: DataFrame, sample: str, active: DataFrame, key: str, side: str, *, fixed_left: Sequence[str] = ()) -> DataFrame:
    """Per sample the rows of the leg named for it; ``fixed_left`` keys always
    come from the left."""
    want = F.when(F.col(key).isin(*fixed_left), "L").otherwise(F.col("active_side")) if fixed_left else F.col("active_side")
    return values.join(active, sample).where(F.col(side) == want).drop("active_side")


def strip_exercise_prefix(events: DataFrame, scheme: str, cycle_type: str, event_key: str) -> DataFrame:
    """In the exercise scheme cycles are called ``exercise`` and event keys lose
    ``Left_``."""
    ex = F.col(scheme) == "exercise"
    return events.withColumns(
        {
            cycle_type: F.when(ex, "exercise").otherwise(F.col(cycle_type)),
            event_key: F.when(ex, F.regexp_replace(F.col(event_key), "^Left_", "")).otherwise(F.col(event_key)),
        }
    )


def derive_columns(
    df: DataFrame,
    *,
    weight: str,
    height_mm: str,
    ident: str,
    cluster: str,
    path: str,
    roots: Mapping[str, str],
    hundredfold: Mapping[str, str] | None = None,
) -> DataFrame:
    """BMI, upper-case ids, replaced path roots, cluster letters, and columns
    times 100 (metres to centimetres, shares to percent) under new names."""
    p = F.col(path)
    for old, new in roots.items():
        p = F.replace(p, F.lit(old), F.lit(new))
    h = F.col(height_mm) / 1000.0
    return df.withColumns(
        {
            "bmi": F.col(weight) / (h * h),
            ident: F.upper(ident),
            path: p,
            "cluster_letter": F.char(F.lit(65) + F.col(cluster)),
            **{new: F.col(old) * 100 for old, new in (hundredfold or {}).items()},
        }
    )


def natural_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(natural_key(column), column)
