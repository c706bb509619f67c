"""Where a pattern matches in a text, as native array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,kind:int,end:int>"
#: matches whose places are added up in one go
BLOCK = 256


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """array<SPAN> of the leftmost non-overlapping matches; code points, end exclusive.

    ``keep`` says of a matched string whether it stays. The pattern must not
    match the empty string. What lies between the matches comes from splitting
    at them, so places are running sums of lengths. They are summed in blocks,
    since growing one array by each match would copy it as often.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) == 0, no_spans()).otherwise(_placed(text, pattern, kind, keep, h)))


def _placed(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None, hits: Column) -> Column:
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    lengths = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("l")))
    empty = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc, x):
        s = acc["pos"] + x["g"]
        e = s + x["l"]
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    def chain(acc, c):
        moved = F.transform(c["out"], lambda x: F.struct((x["s"] + acc["base"]).alias("s"), (x["e"] + acc["base"]).alias("e")))
        return F.struct((acc["base"] + c["pos"]).alias("base"), F.concat(acc["outs"], F.array(moved)).alias("outs"))

    zero = F.struct(F.lit(0).alias("pos"), empty.alias("out"))
    start = F.struct(F.lit(0).alias("base"), F.array().cast("array<array<struct<s:int,e:int>>>").alias("outs"))
    blocks = F.sequence(F.lit(0), ((F.size(hits) - 1) / BLOCK).cast("int"))
    summed = let(lengths, lambda n: F.transform(blocks, lambda b: F.aggregate(F.slice(n, b * BLOCK + 1, F.lit(BLOCK)), zero, step)))
    places = F.flatten(F.aggregate(summed, start, chain, lambda acc: acc["outs"]))
    found = F.zip_with(places, hits, lambda p, h: F.struct(p["s"].alias("start"), F.lit(kind).alias("kind"), p["e"].alias("end"), h.alias("hit")))
    if keep is not None:
        found = F.filter(found, lambda x: keep(x["hit"]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def written(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """``kind:start:end`` of each span, comma-joined, by kind or by start first."""
    first, second = ("kind", "start") if by_kind else ("start", "kind")
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x[first].alias("a"), x[second].alias("b"), x["end"].alias("e"))))
    kind, start = ("a", "b") if by_kind else ("b", "a")
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", names[x[kind]], x[start].cast("string"), x["e"].cast("string"))), ",")


def counted(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
