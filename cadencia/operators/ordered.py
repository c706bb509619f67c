"""Ordered scans over long series that never need a whole series in one task.

A window partitioned by series alone puts the longest series on one core. Here
a series is cut into *cells* (consecutive stretches of its order). Rows are
shuffled once, by (series, cell); each cell is scanned with ordinary windows;
one summary row per cell is scanned per series; and the carry from the earlier
or later cells is joined back on (series, cell), which needs no further shuffle
of the rows. Results do not depend on where the cell borders lie.

Both directions are read as "rows before the current one", the second under a
descending order. Frames that end at ``unbounded following`` would rescan the
rest of the partition for every row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = "_cell"


def time_cell(t: str | Column, width: float) -> Column:
    """Cell number of a time: stretches of ``width`` in the units of ``t``."""
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(float(width))).cast("bigint")


def value_cells(
    df: DataFrame, keys: Sequence[str], value: str, bins: int = 128, *, total: tuple[str, str] | None = None
) -> DataFrame:
    """Add order-preserving cells of a numeric value per key.

    Cells hold about equally many rows: their borders are approximate quantiles,
    whose error is a ten-thousandth of the rows. However the values are spread, a
    cell of distinct values is little larger than its share; equal values share
    a cell. ``bins`` is a power of two. ``total`` is (column, name): the sum of a
    column per key, added in the same pass.
    """
    x = F.col(value).cast("double")
    aggs = [F.percentile_approx(x, [i / bins for i in range(1, bins)], 10_000).alias("_borders")]
    if total:
        aggs.append(F.sum(total[0]).alias(total[1]))
    if keys:
        df = df.join(df.groupBy(*keys).agg(*aggs), list(keys))
    else:
        one = df.agg(F.struct(*aggs)).scalar()
        df = df.withColumn("_l", one).select("*", "_l.*").drop("_l")
    # how many borders are not above the value, by halving the steps
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bins.bit_length() - 1))])
    cell = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.col("_borders"), at + step - 1) <= x, at + step).otherwise(at))
    return df.withColumn(CELL, cell.cast("bigint")).drop("_borders")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    prevs: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    row_no: str | None = None,
    chained: Mapping[str, tuple[Column, Sequence[str]]] | None = None,
    cell: Column | None = None,
) -> DataFrame:
    """Per row, what lies before and after it in its series.

    ``prevs``/``nexts``  nearest non-null value of an expression strictly before
                         / after the row;
    ``totals``           sum of an expression over the rows strictly before it;
    ``row_no``           1-based position in the series;
    ``chained``          name -> (payload, links): the next row whose payload is
                         not null, as ``struct(at, <links>)`` where each link is
                         what that row itself sees under a ``prevs``/``nexts``
                         name.

    ``order`` must be total within a series. ``cell`` must not decrease along
    the order; without it a series is one cell, which suits groups of a known
    small size only. An existing ``_cell`` column is used when present.
    """
    prevs, nexts, totals = dict(prevs or {}), dict(nexts or {}), dict(totals or {})
    chained = dict(chained or {})
    if row_no:
        totals[row_no] = F.lit(1).cast("bigint")
    split = cell is not None or CELL in df.columns
    had_cell = CELL in df.columns
    if cell is not None:
        df = df.withColumn(CELL, cell)
        had_cell = False
    kinds = {**{n: "p" for n in prevs}, **{n: "n" for n in nexts}, **{n: "t" for n in totals}}
    exprs = {**prevs, **nexts, **totals}
    df = df.withColumns({f"_e_{n}": e for n, e in exprs.items()})
    df = df.withColumns({f"_e_{n}": p for n, (p, _) in chained.items()})

    part = [*keys, CELL] if split else list(keys)
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = (
        Window.partitionBy(*part)
        .orderBy(*[F.desc(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = {}
    for n, k in kinds.items():
        if k == "t":
            local[f"_l_{n}"] = F.coalesce(F.sum(f"_e_{n}").over(before), F.lit(0))
        else:
            local[f"_l_{n}"] = F.last(f"_e_{n}", ignorenulls=True).over(
                before if k == "p" else after
            )
    out = df.withColumns(local)
    for n, (_, links) in chained.items():
        seen = F.struct(F.col(f"_e_{n}").alias("at"), *[F.col(f"_l_{x}").alias(x) for x in links])
        out = out.withColumn(f"_x_{n}", F.when(F.col(f"_e_{n}").isNotNull(), seen))
        out = out.withColumn(f"_l_{n}", F.last(f"_x_{n}", ignorenulls=True).over(after))

    def resolve(struct_col: str, links: Sequence[str]) -> Column:
        """Fill a chained struct's open links from the carry of its own cell."""
        c = F.col(struct_col)
        fields = [F.coalesce(c[x], F.col(f"_c_{x}")).alias(x) for x in links]
        return F.when(c.isNotNull(), F.struct(c["at"].alias("at"), *fields))

    if split:
        pos = F.struct(*order)
        aggs = []
        for n, k in kinds.items():
            e = f"_e_{n}"
            have = F.when(F.col(e).isNotNull(), pos)
            if k == "t":
                aggs.append(F.coalesce(F.sum(e), F.lit(0)).alias(f"_s_{n}"))
            else:
                aggs.append((F.max_by if k == "p" else F.min_by)(e, have).alias(f"_s_{n}"))
        for n in chained:
            have = F.when(F.col(f"_x_{n}").isNotNull(), pos)
            aggs.append(F.min_by(f"_x_{n}", have).alias(f"_s_{n}"))
        cb = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
        ca = (
            Window.partitionBy(*keys)
            .orderBy(F.desc(CELL))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = (out if chained else df).groupBy(*part).agg(*aggs)
        picked = {}
        for n, k in kinds.items():
            if k == "t":
                picked[f"_c_{n}"] = F.coalesce(F.sum(f"_s_{n}").over(cb), F.lit(0))
            else:
                picked[f"_c_{n}"] = F.last(f"_s_{n}", ignorenulls=True).over(
                    cb if k == "p" else ca
                )
        carry = carry.withColumns(picked)
        for n, (_, links) in chained.items():
            carry = carry.withColumn(f"_s_{n}", resolve(f"_s_{n}", links))
            carry = carry.withColumn(f"_c_{n}", F.last(f"_s_{n}", ignorenulls=True).over(ca))
        carry = carry.select(*part, *[f"_c_{n}" for n in [*kinds, *chained]])
        out = out.join(carry, part)

    final = {}
    for n, k in kinds.items():
        c = F.col(f"_l_{n}")
        if split:
            c = c + F.col(f"_c_{n}") if k == "t" else F.coalesce(c, F.col(f"_c_{n}"))
        final[n] = c + F.lit(1) if n == row_no else c
    for n, (_, links) in chained.items():
        final[n] = (
            F.coalesce(resolve(f"_l_{n}", links), F.col(f"_c_{n}")) if split else F.col(f"_l_{n}")
        )
    every = [*kinds, *chained]
    out = out.withColumns(final)
    out = out.drop(*[f"_{x}_{n}" for n in every for x in "elcx"])
    return out if had_cell else out.drop(CELL)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    bins: int = 128,
) -> DataFrame:
    """Exact linearly interpolated quantiles of the finite values of groups of any size.

    The built-in exact ``percentile`` keeps every distinct value of a group in
    one buffer. Here values are counted per value cell, the cells that
    hold the wanted ranks are found from the counts, and only those cells are
    ordered. One row per group; a group without a value is absent.
    """
    keys = list(keys)
    v = df.where(F.abs(F.col(value).cast("double")) < float("inf"))
    v = v.select(*keys, F.col(value).cast("double").alias("_v"))
    v = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    # all three uses of the counts read the same columns, so that Spark can reuse
    # their shuffle instead of running what lies before it again
    v = value_cells(v, keys, "_v", bins, total=("_n", "_total"))
    cells = v.groupBy(*keys, CELL).agg(F.sum("_n").alias("_cn"), F.max("_total").alias("_total"))
    gw = Window.partitionBy(*keys)
    cells = cells.withColumn(
        "_start",
        F.coalesce(
            F.sum("_cn").over(gw.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    ranks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        lo = F.floor(at)
        frac = at - lo
        ranks.append(F.struct(F.lit(name).alias("q"), lo.alias("r"), (1 - frac).alias("w")))
        ranks.append(
            F.struct(
                F.lit(name).alias("q"),
                F.least(lo + 1, F.col("_total") - 1).alias("r"),
                frac.alias("w"),
            )
        )
    want = cells.select(*keys, CELL, "_start", "_cn", F.explode(F.array(*ranks)).alias("_k"))
    want = want.where(
        (F.col("_k.r") >= F.col("_start")) & (F.col("_k.r") < F.col("_start") + F.col("_cn"))
    )
    want = want.groupBy(*keys, CELL).agg(
        F.first("_start").alias("_start"), F.collect_list("_k").alias("_ks")
    )
    cw = Window.partitionBy(*keys, CELL).orderBy("_v")
    hit = v.join(want, [*keys, CELL]).withColumn(
        "_from",
        F.col("_start")
        + F.coalesce(F.sum("_n").over(cw.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    hit = hit.withColumn(
        "_k",
        F.explode(
            F.filter(
                "_ks", lambda k: (k["r"] >= F.col("_from")) & (k["r"] < F.col("_from") + F.col("_n"))
            )
        ),
    )
    return hit.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("_k.q") == n, F.col("_v") * F.col("_k.w"))).alias(n)
            for n in probs
        ]
    )
