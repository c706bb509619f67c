"""Shards from a hierarchical weighted hash tree of regions, racks and shards.

A row descends the tree; at each level every child draws ``ln(u) / weight`` with
``u`` hashed from the row's key and the child's name, and the largest draw wins.
A node weighs what its shards weigh. When a weight changes, only the draws of
that shard and the nodes above it change, so rows move into or out of those
subtrees alone. A further shard opens a region of its own, hence it only takes
rows for itself.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, hex_number

#: slots are ordered in 16**SLOT_DIGITS buckets of a shard
SLOT_DIGITS = 3


class Shard(NamedTuple):
    """A leaf: the names on its path, its number and its weight."""

    region: str
    rack: str
    number: int
    weight: float = 1.0


def tree(shards: int = 8) -> list[Shard]:
    """Two regions of two racks of two shards; beyond eight, a region each."""
    return [
        Shard(f"r{i // 4}", f"k{i // 2}", i) if i < 8 else Shard(f"r{i - 6}", f"k{i - 4}", i) for i in range(shards)
    ]


def draw(key: Column, node: str, weight: float) -> Column:
    """The draw of a node for a key; always under or at 0, the largest wins."""
    u = (hex_number(F.concat(key, F.lit(f":{node}")), 13).cast("double") + 1.0) / float(2**52)
    return F.log(u) / F.lit(float(weight))


def _pick(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the largest draw; the first named wins a tie."""
    if len(children) == 1:
        return children[0][2]
    draws = F.array(*[F.struct(draw(key, n, w).alias("d"), F.lit(-i).alias("o")) for i, (n, w, _) in enumerate(children)])
    won = -F.array_max(draws).getField("o")
    return reduce(lambda other, i: F.when(won == i, children[i][2]).otherwise(other), range(len(children)), F.lit(None).cast("int"))


def shard_of(key: Column, leaves: list[Shard]) -> Column:
    """The shard number of a key. Leaves of weight 0 or less take no rows."""
    leaves = [x for x in leaves if x.weight > 0]
    if not leaves:
        raise ValueError("no shard has a weight")

    def group(items, name):
        out: dict[str, list[Shard]] = {}
        for x in items:
            out.setdefault(name(x), []).append(x)
        return out

    regions = []
    for region, inside in group(leaves, lambda x: x.region).items():
        racks = []
        for rack, own in group(inside, lambda x: x.rack).items():
            picks = [(f"{region}/{rack}/{x.number}", x.weight, F.lit(x.number).cast("int")) for x in own]
            racks.append((f"{region}/{rack}", sum(x.weight for x in own), _pick(key, picks)))
        regions.append((region, sum(x.weight for x in inside), _pick(key, racks)))
    return _pick(key, regions)


def key_text(key: str) -> Column:
    """Keys as text; every null key is the same key."""
    return F.coalesce(F.col(key).cast("string"), F.lit("null"))


def assign(df: DataFrame, key: str, leaves: list[Shard], out: str = "shard") -> DataFrame:
    """Add the shard of each row, from its key alone; no shuffle. Replaces a column named ``out``."""
    return df.withColumn(out, shard_of(key_text(key), leaves))


def placed(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    ``size`` is the text's UTF-8 bytes plus 1, ``grown_shard`` the shard with one
    more. Null texts count as empty, null keys as one key. Repeated rows share a
    shard and get a slot each. Slots are gapless from 0 in each shard, by a
    bucket hashed from the key, then key, size, checksum. Other columns are
    dropped; an empty table gives no rows.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
    )
    rows = assign(assign(rows, "doc_id", tree(shards)), "doc_id", tree(shards + 1), "grown_shard")
    bucket = hex_number(F.concat(F.lit("slot:"), key_text("doc_id")), SLOT_DIGITS)
    ranked = gapless_rank(rows, ["shard"], ["doc_id", "size", "text_crc32", "grown_shard"], bucket, "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def placed_sql(shards: int = 8) -> str:
    """DuckDB SQL of ``placed`` over documents."""

    def draw_sql(node, weight):
        return f"ln((('0x' || substr(md5(k || ':{node}'), 1, 13))::BIGINT + 1.0) / 4503599627370496.0) / {float(weight)}"

    def pick(children):
        if len(children) == 1:
            return children[0][2]
        draws = [draw_sql(n, w) for n, w, _ in children]
        best = f"greatest({', '.join(draws)})"
        return "CASE " + " ".join(f"WHEN {d} = {best} THEN {v}" for d, (_, _, v) in zip(draws[:-1], children)) + f" ELSE {children[-1][2]} END"

    def shard_sql(n):
        regions: dict[str, dict[str, list[Shard]]] = {}
        for x in tree(n):
            regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
        tops = []
        for r, racks in regions.items():
            inner = [(f"{r}/{k}", sum(x.weight for x in xs), pick([(f"{r}/{k}/{x.number}", x.weight, str(x.number)) for x in xs])) for k, xs in racks.items()]
            tops.append((r, sum(w for _, w, _ in inner), pick(inner)))
        return f"CAST({pick(tops)} AS INTEGER)"

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM documents),
byte AS (SELECT i, list_reduce([i] || range(1, 9), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
         FROM (SELECT unnest(range(0, 256)) AS i)),
tab AS (SELECT list(v ORDER BY i) AS tb FROM byte),
s AS (SELECT doc_id, k, strlen(t) + 1 AS size, {shard_sql(shards)} AS shard, {shard_sql(shards + 1)} AS grown_shard,
        xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT),
            lambda c, b: xor(c >> 8, tb[xor(c, b) % 256 + 1])), 4294967295) AS text_crc32
      FROM d, tab)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot:' || k), 1, {SLOT_DIGITS}))::BIGINT, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  grown_shard
FROM s"""
