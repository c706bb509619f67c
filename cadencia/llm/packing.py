"""Best-fit packing planned on the histogram of piece lengths.

Documents become pieces of at most ``size`` tokens. Only the counts of the
lengths (at most ``size`` of them, whatever the corpus) reach the driver, which
runs best-fit decreasing on counts: equal sequences are one group. The plan says
which ranks of a length go to which sequences, and pieces take their slots by
joining on their rank within their length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, hex_number, slices
from .tokens import codec, tree_encoded, vocabulary

PLAN = "length long, rank_from long, rank_to long, per_sequence long, sequence_from long, offset_from long"


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN for so many pieces of each length.

    Groups are runs of sequences with equal room, kept by room. A length takes
    the group with the least sufficient room first, as often into each of its
    sequences as fits; what is left opens new sequences.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[tuple[int, int, int]] = []  # room, first sequence, sequences
    total = 0

    def put(length, rank, room, first, n, left):
        """Fill up to ``n`` sequences of a room; what remains of them goes back."""
        each = room // length
        full = min(n, left // each)
        if full:
            rows.append((length, rank, rank + full * each, each, first, size - room))
            if room - each * length:
                bisect.insort(rooms, (room - each * length, first, full))
        rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
        if n and left and left < each:
            rows.append((length, rank, rank + left, left, first, size - room))
            if room - left * length:
                bisect.insort(rooms, (room - left * length, first, 1))
            rank, left, first, n = rank + left, 0, first + 1, n - 1
        if n:
            bisect.insort(rooms, (room, first, n))
        return rank, left

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect.bisect_left(rooms, (length, -1, -1))
            if i < len(rooms):
                room, first, n = rooms.pop(i)
            else:
                n = -(-left // (size // length))
                room, first, total = size, total, total + n
            rank, left = put(length, rank, room, first, n, left)
    return rows


def pieces(docs: DataFrame, size: int = 2048, path: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", leaf_chars: int = 1 << 16) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document; ids little-endian 32-bit.

    A document is its text's ids and then ``end_id``; null and empty texts are
    that one id. Longer ones are cut so that the first piece is the shorter one
    and all others are full. Repeated rows give repeated pieces.
    """
    vocab = vocabulary(docs, path)

    def cut(doc_ids, arrays):
        cols = ([], [], [], [], [])
        for d, ids in zip(doc_ids, arrays):
            ids = np.append(ids, np.uint32(end_id)).astype("<u4")
            first = len(ids) % size or size
            edges = [0, *range(first, len(ids) + 1, size)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                for c, v in zip(cols, (d, k, a, b - a, ids[a:b].tobytes())):
                    c.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab.value)
        for b in (part for whole in batches for part in slices(whole, 1)):
            ids, at = c.batch(b.column(1))
            yield cut(b.column(0).to_pylist(), (ids[i:j] for i, j in zip(at[:-1], at[1:])))

    def long(batches):
        for b in batches:
            for d, ids in zip(b.column(0).to_pylist(), b.column(1)):
                yield cut([d], [ids.values.to_numpy(zero_copy_only=False).astype("<u4")])

    schema = "doc_id long, piece int, start long, length long, ids binary"
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    n = F.coalesce(F.length("_text"), F.lit(0))
    few = docs.where(n <= leaf_chars).mapInArrow(short, schema)
    many = docs.where(n > leaf_chars).withColumn("_text_key", F.sha2("_text", 256))
    coded = tree_encoded(many.select("_text_key", "_text"), vocab, leaf_chars)
    many = many.select("doc_id", "_text_key").join(coded, "_text_key").select("doc_id", "ids")
    return few.unionByName(many.mapInArrow(long, schema))


def pack(cut: DataFrame, size: int = 2048, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, *carry, sequence_id, offset) of every piece.

    ``carry`` names small columns to keep. Equal rows are told apart by their
    place only. Pieces must be 1 to ``size`` long; no pieces give no rows.
    """
    spark = cut.sparkSession
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("piece").cast("string"))
    ranked = gapless_rank(cut, ["length"], ["doc_id", "piece", "start", *carry], hex_number(key, 2), "_rank")
    # at most ``size`` rows, as lengths are at most that
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = spark.createDataFrame(plan(counts, size), PLAN)
    # the plan has a few rows for each length, so its size is bounded by ``size`` too
    step = F.broadcast(steps)
    r = F.col("_rank") - F.col("rank_from")
    joined = ranked.join(step.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
    return joined.select(
        "doc_id", "piece", "start", "length", *carry,
        (F.col("sequence_from") + F.floor(r / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + r % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )
