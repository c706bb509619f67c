"""Join shapes shared by the operators: nearest in time, interval, bracket,
interpolation, overlay, prefix and tolerance-aligned joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import CELL, ordered_scan, time_cell


def bracket(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    payload: Sequence[str],
    *,
    cell_width: float,
    tie_order: Sequence[str] = (),
) -> DataFrame:
    """Each left row with the last right row at or before its time (``_prev``)
    and the first right row after it (``_next``), as structs.

    Both sides go through one ordered scan instead of a range join. Right rows
    that share a time are first reduced to the lowest ``tie_order``.
    """
    keys = list(keys)
    lcols = [c for c in left.columns if c not in keys]
    val = F.struct(F.col(right_t).alias("t"), *payload)
    right = right.where(F.col(right_t).isNotNull())
    if tie_order:
        right = right.groupBy(*keys, F.col(right_t).alias("_t")).agg(
            F.min_by(val, F.struct(*tie_order)).alias("_r")
        )
    else:
        right = right.groupBy(*keys, F.col(right_t).alias("_t")).agg(F.min(val).alias("_r"))
    lrow = left.select(
        *keys,
        F.col(left_t).cast("double").alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*lcols).alias("_l"),
    )
    rrow = right.select(*keys, F.col("_t").cast("double"), F.lit(0).alias("_side"), "_r")
    both = rrow.unionByName(lrow, allowMissingColumns=True)
    # left rows of one time carry no right payload, so their mutual order is free
    scanned = ordered_scan(
        both,
        keys,
        ["_t", "_side"],
        prevs={"_prev": F.col("_r")},
        nexts={"_next": F.col("_r")},
        cell=time_cell("_t", cell_width),
    )
    return scanned.where(F.col("_side") == 1).select(*keys, "_l.*", "_prev", "_next")


def nearest_asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    payload: Sequence[str],
    *,
    ties: str = "earlier",
    tolerance: float | Column | None = None,
    cell_width: float,
    tie_order: Sequence[str] = (),
) -> DataFrame:
    """Left join to the right row nearest in time.

    Equal distances go to the ``earlier`` or ``later`` right row. A hit farther
    than ``tolerance`` counts as no hit. Adds the payload and ``gap``.
    """
    b = bracket(
        left, right, keys, left_t, right_t, payload, cell_width=cell_width, tie_order=tie_order
    )
    back = F.col(left_t) - F.col("_prev.t")
    ahead = F.col("_next.t") - F.col(left_t)
    closer = back < ahead if ties == "later" else back <= ahead
    hit = F.when(F.col("_next").isNull() | closer, F.col("_prev")).otherwise(F.col("_next"))
    b = b.withColumn("_hit", hit).withColumn("gap", F.abs(F.col("_hit.t") - F.col(left_t)))
    if tolerance is not None:
        tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))
        b = b.withColumn("_hit", F.when(F.col("gap") <= tol, F.col("_hit")))
    return b.withColumns({p: F.col(f"_hit.{p}") for p in payload}).drop("_hit", "_prev", "_next")


def interpolate_at(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    value: str,
    out: str,
    *,
    cell_width: float,
) -> DataFrame:
    """Right values linearly interpolated at left times, missing outside."""
    b = bracket(left, right, keys, left_t, right_t, [value], cell_width=cell_width)
    t0, t1 = F.col("_prev.t"), F.col("_next.t")
    v0, v1 = F.col(f"_prev.{value}"), F.col(f"_next.{value}")
    t = F.col(left_t)
    y = F.when(t == t0, v0).otherwise(v0 + (v1 - v0) * (t - t0) / (t1 - t0))
    return b.withColumn(out, y).drop("_prev", "_next")


def slice_intervals(
    samples: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    t: str,
    start: str,
    end: str,
    *,
    cell_width: float,
) -> DataFrame:
    """Samples inside each interval, both ends included.

    Equi-join on (keys, time cell): an interval is repeated for the cells it
    covers and a sample has one cell, so no pair is produced twice and a long
    series is spread over its cells.
    """
    keys = list(keys)
    w = float(cell_width)
    spread = intervals.where(F.col(start) <= F.col(end)).withColumn(
        CELL, F.explode(F.sequence(time_cell(start, w), time_cell(end, w)))
    )
    s = samples.withColumn(CELL, time_cell(t, w))
    return s.join(spread, [*keys, CELL]).where(F.col(t).between(F.col(start), F.col(end))).drop(CELL)


def overlay_merge(
    base: DataFrame,
    patch: DataFrame,
    cycle_keys: Sequence[str],
    block: str,
    leaf: str,
    value: str,
    *,
    replace_blocks: Sequence[str] = ("point",),
    merge_prefixes: Sequence[str] = ("SO_", "IK", "ID", "JRL"),
) -> DataFrame:
    """Base leaves overlaid by patch leaves for the cycles both sides have.

    Blocks to replace lose every base leaf when the patch has the block; merged
    blocks keep base-only leaves; blocks of other names are never copied. Cycles
    of one side only are passed by. ``source`` tells where a value came from.
    """
    ck = list(cycle_keys)
    both = base.select(*ck).distinct().join(patch.select(*ck).distinct(), ck, "left_semi")
    merged = F.lit(False)
    for p in merge_prefixes:
        merged = merged | F.col(block).startswith(p)
    usable = F.col(block).isin(*replace_blocks) | merged
    src = patch.where(usable).join(both, ck, "left_semi").withColumnRenamed(value, "_src")
    replaced = src.where(F.col(block).isin(*replace_blocks)).select(*ck, block).distinct()
    dst = (
        base.join(both, ck, "left_semi")
        .join(replaced, [*ck, block], "left_anti")
        .withColumnRenamed(value, "_dst")
    )
    on = [*ck, block, leaf]
    return (
        dst.select(*on, "_dst", F.lit(1).alias("_d"))
        .join(src.select(*on, "_src", F.lit(1).alias("_s")), on, "full_outer")
        .select(
            *on,
            F.when(F.col("_s").isNotNull(), F.col("_src")).otherwise(F.col("_dst")).alias(value),
            F.when(F.col("_s").isNotNull(), "patch").otherwise("base").alias("source"),
        )
    )


def one_sided_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], names=("only_a", "only_b")) -> DataFrame:
    """Keys of one table without a partner in the other."""
    keys = list(keys)
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    return (
        ka.join(kb, keys, "left_anti")
        .withColumn("side", F.lit(names[0]))
        .unionByName(kb.join(ka, keys, "left_anti").withColumn("side", F.lit(names[1])))
    )


def outer_counts(a: DataFrame, b: DataFrame, keys: Sequence[str], names=("n_a", "n_b")) -> DataFrame:
    """Row counts of two sources per key, zero where one has none."""
    keys = list(keys)
    ca = a.groupBy(*keys).agg(F.count(F.lit(1)).alias(names[0]))
    cb = b.groupBy(*keys).agg(F.count(F.lit(1)).alias(names[1]))
    return ca.join(cb, keys, "full_outer").select(
        *keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def _heads(bases: DataFrame, right: DataFrame, right_key: str) -> DataFrame:
    """Right rows once per beginning (``_head``) that may be one of ``bases``."""
    rc = right.columns
    bases = bases.withColumn("_len", F.length("_base")).where("_len IS NOT NULL").distinct()
    # the power of two that a length reaches stands for its class
    bases = bases.withColumn("_class", F.length(F.bin("_len")))
    shortest = bases.groupBy("_class").agg(F.min("_len").alias("_from"))
    classes = shortest.agg(F.collect_list(F.struct("_class", "_from"))).scalar()
    own = F.get(F.filter("_all", lambda c: c["_class"] == F.col("_class")), F.lit(0))
    start = F.substring("_base", F.lit(1), own["_from"]).alias("_start")
    starts = bases.withColumn("_all", classes).groupBy("_class", start).agg(F.collect_set("_len").alias("_lens"))
    looked = (
        right.withColumn("_all", classes)
        .select(*rc, F.explode(F.filter("_all", lambda c: c["_from"] <= F.length(right_key))).alias("_c"))
        .select(*rc, F.col("_c._class").alias("_class"), F.substring(F.col(right_key), F.lit(1), F.col("_c._from")).alias("_start"))
    )
    cut = F.transform(F.filter("_lens", lambda n: n <= F.length(right_key)), lambda n: F.substring(F.col(right_key), F.lit(1), n))
    return looked.join(starts, ["_class", "_start"]).select(*rc, F.explode(cut).alias("_head"))


def exact_or_prefix(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    left_base: str,
    right_key: str,
    right_cols: Sequence[str],
    *,
    per: Sequence[str] = (),
) -> DataFrame:
    """Exact match on a key; a left key with no exact match at all takes the
    first right row whose key starts with its base.

    The prefix join is an equi-join. Base lengths that lie within a factor of two
    form a class; a right key is looked up once per class by as many characters as
    the shortest base of the class has, and only where bases begin so is it cut to
    the lengths of those bases. So it moves once per class and not once per length.
    ``per`` picks one fallback for each value of those right columns.

    Both sides are dealt by key into a fixed number of tasks: equal keys make far
    more pairs than rows, and a number chosen by bytes would be too small.
    """
    spark = left.sparkSession
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    rc = [right_key, *[c for c in right_cols if c != right_key]]
    dealt = left.repartition(n_tasks, left_key)
    r = right.select(*rc).repartition(n_tasks, right_key)
    exact = dealt.join(r, dealt[left_key] == r[right_key]).withColumn("match", F.lit("exact"))
    rest = dealt.join(r.select(right_key).distinct(), dealt[left_key] == F.col(right_key), "left_anti")

    heads = _heads(rest.select(F.col(left_base).alias("_base")), right.select(*rc), right_key)
    grp = list(dict.fromkeys([*left.columns, *per]))
    others = [c for c in rc if c not in grp]
    # one candidate per head suffices, which keeps a popular head small
    heads = heads.groupBy("_head", *per).agg(F.min(F.struct(*others)).alias("_b"))
    best = rest.join(heads, F.col(left_base) == F.col("_head"))
    best = best.select(*grp, "_b.*").withColumn("match", F.lit("prefix"))
    return exact.select(*left.columns, *rc, "match").unionByName(
        best.select(*left.columns, *rc, "match")
    )


def align_window(
    long: DataFrame,
    short: DataFrame,
    keys: Sequence[str],
    *,
    tol: float = 1e-6,
) -> DataFrame:
    """Start index of the contiguous run of a long time vector that equals a
    short one within ``tol``. Both sides carry (keys, idx, t)."""
    keys = list(keys)
    n = short.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    probe = short.select(
        *keys,
        F.col("idx").alias("_si"),
        F.col("t").alias("_st"),
        F.explode(
            F.array(*[F.floor(F.col("t") / tol) + F.lit(k) for k in (-1, 0, 1)])
        ).alias("_b"),
    )
    hit = (
        long.select(
            *keys, F.col("idx").alias("_li"), F.col("t").alias("_lt"), F.floor(F.col("t") / tol).alias("_b")
        )
        .join(probe, [*keys, "_b"])
        .where(F.abs(F.col("_lt") - F.col("_st")) <= tol)
    )
    runs = hit.groupBy(*keys, (F.col("_li") - F.col("_si")).alias("offset")).agg(
        F.countDistinct("_si").alias("_hits")
    )
    return (
        runs.join(n, keys)
        .where(F.col("_hits") == F.col("_n"))
        .groupBy(*keys)
        .agg(F.min("offset").alias("start_idx"), F.first("_n").alias("n"))
    )
