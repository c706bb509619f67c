"""Expressions on one wave held as an array of doubles. They work row by row,
so no statistic over the points of a wave needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(a: str | Column) -> Column:
    return F.col(a) if isinstance(a, str) else a


def let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` worked out once. An expression that is repeated
    inside a lambda would otherwise be worked out again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: str | Column) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def mean(a: str | Column) -> Column:
    return F.try_divide(total(a), F.size(_c(a)).cast("double"))


def std(a: str | Column) -> Column:
    """Population standard deviation."""
    return let(mean(a), lambda m: F.sqrt(mean(F.transform(_c(a), lambda x: (x - m) * (x - m)))))


def rms(a: str | Column) -> Column:
    return F.sqrt(mean(F.transform(_c(a), lambda x: x * x)))


def norm(a: str | Column) -> Column:
    return F.sqrt(total(F.transform(_c(a), lambda x: x * x)))


def quantile(a: str | Column, p: float) -> Column:
    """Linearly interpolated quantile."""

    def pick(s: Column) -> Column:
        pos = F.lit(float(p)) * (F.size(s) - 1)
        lo = F.floor(pos).cast("int")
        w = pos - lo
        return F.get(s, lo) * (1 - w) + F.get(s, F.least(lo + 1, F.size(s) - 1)) * w

    return let(F.array_sort(_c(a)), pick)


def median(a: str | Column) -> Column:
    return quantile(a, 0.5)


def area(a: str | Column, step: float = 1.0) -> Column:
    """Signed trapezoid area of evenly spaced points."""
    a = _c(a)
    return (total(a) - (F.get(a, F.lit(0)) + F.get(a, F.size(a) - 1)) / 2) * F.lit(float(step))


def pearson(a: str | Column, b: str | Column) -> Column:
    """Correlation with 1e-8 added to the product of the deviations, so that a
    constant wave gives 0."""
    a, b = _c(a), _c(b)
    cov = let(
        F.struct(mean(a).alias("a"), mean(b).alias("b")),
        lambda m: mean(F.zip_with(a, b, lambda x, y: (x - m["a"]) * (y - m["b"]))),
    )
    return cov / (std(a) * std(b) + F.lit(1e-8))


def mad(a: str | Column, b: str | Column) -> Column:
    """Mean absolute difference."""
    return mean(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y)))


def roll(a: str | Column, lag: int) -> Column:
    """Rotate right by ``lag`` points."""
    a = _c(a)
    n = F.size(a)
    k = F.pmod(F.lit(int(lag)), n)
    return F.concat(F.slice(a, n - k + 1, k), F.slice(a, F.lit(1), n - k))


def resample_linear(a: str | Column, n: int = 101) -> Column:
    """n points on the uniform axis of the wave; NULL below two points."""
    a = _c(a)
    last = F.size(a) - 1

    def at(i: Column) -> Column:
        pos = i * last / F.lit(float(n - 1))
        lo = F.least(F.floor(pos).cast("int"), last - 1)
        w = pos - lo
        return F.get(a, lo) * (1 - w) + F.get(a, lo + 1) * w

    return F.when(F.size(a) >= 2, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def demean(a: str | Column) -> Column:
    present = F.filter(_c(a), lambda x: x.isNotNull())
    return let(mean(present), lambda m: F.transform(_c(a), lambda x: x - m))


def zscore(a: str | Column) -> Column:
    """Mean 0 and variance 1; a constant wave becomes zeros."""
    sd = std(a)
    return let(
        F.struct(mean(a).alias("m"), F.when(sd == 0, 1.0).otherwise(sd).alias("s")),
        lambda z: F.transform(_c(a), lambda x: (x - z["m"]) / z["s"]),
    )


def fill_gaps(a: str | Column) -> Column:
    """Missing points interpolated by index, edges held; NULL when none is there."""
    a = _c(a)
    have = F.filter(
        F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].isNotNull()
    )
    empty = F.lit(None).cast("struct<i:int,x:double>")

    def fill(x: Column, i: Column, known: Column) -> Column:
        # the known points are in index order, so folds find the two neighbours
        lo = F.aggregate(known, empty, lambda s, p: F.when(p["i"] < i, p).otherwise(s))
        hi = F.aggregate(known, empty, lambda s, p: F.when(s.isNull() & (p["i"] > i), p).otherwise(s))
        at = lambda q: F.coalesce(
            q["lo"]["x"] + (q["hi"]["x"] - q["lo"]["x"]) * (i - q["lo"]["i"]) / (q["hi"]["i"] - q["lo"]["i"]),
            q["lo"]["x"],
            q["hi"]["x"],
        )
        return F.when(x.isNotNull(), x).otherwise(let(F.struct(lo.alias("lo"), hi.alias("hi")), at))

    return let(
        have, lambda known: F.when(F.size(known) > 0, F.transform(a, lambda x, i: fill(x, i, known)))
    )


def max_normalise(a: str | Column) -> Column:
    """Gaps filled, then percent of the maximum; zeros when the maximum is 0 or
    nothing is there."""
    a = _c(a)
    zero = F.transform(a, lambda x: F.lit(0.0))

    def scale(full: Column) -> Column:
        return let(
            F.array_max(full),
            lambda top: F.when(top.isNull() | (top == 0), zero).otherwise(
                F.transform(full, lambda x: x / top * 100)
            ),
        )

    return let(fill_gaps(a), scale)


def rectify(a: str | Column) -> Column:
    return F.transform(_c(a), lambda x: F.abs(x))


def clamp_non_negative(a: str | Column) -> Column:
    return F.transform(_c(a), lambda x: F.greatest(x, F.lit(0.0)))


def snr(a: str | Column) -> Column:
    """Mean over the deviation of the points at or below the 20th percentile;
    NULL below five points."""
    a = _c(a)
    low = let(quantile(a, 0.2), lambda cut: F.filter(a, lambda x: x <= cut))
    return F.when(F.size(a) >= 5, mean(a) / (std(low) + F.lit(1e-8)))


def boundary(a: str | Column) -> Column:
    """How well the end of a wave meets its start, as a struct; NULL below three
    points."""
    a = _c(a)
    n = F.size(a)
    g = lambda i: F.get(a, i)
    diff = F.abs(g(n - 1) - g(F.lit(0)))
    jump = F.abs((g(n - 1) - g(n - 2)) - (g(F.lit(1)) - g(F.lit(0))))
    sd = std(a) + F.lit(1e-8)
    half = F.floor(n / 2).cast("int")
    return F.when(
        n >= 3,
        F.struct(
            diff.alias("diff"),
            (diff / sd).alias("diff_n"),
            jump.alias("ddiff"),
            (jump / sd).alias("ddiff_n"),
            F.abs(g(half - 1) - g(half)).alias("diff_shift50"),
        ),
    )
