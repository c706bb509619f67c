"""Near-duplicate documents by SuperMinHash, banding, exact checks and union-find.

Each distinct set of shingles is signed once. Signatures share a value per slot
with the probability of their sets' similarity; a band of slots is a bucket. In
a bucket every set is compared with its smallest member first, so a bucket of
near copies costs as many checks as it has members. Sets of buckets that still
hold different components are then compared across these, if they share a
shingle among their rarest ones, as similar sets must. Links are confirmed on
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices, stored
from .components import components
from .secret_scan import keyed

#: at a similarity of 0.8, 40 bands of 6 slots miss a pair with probability 5e-6
BANDS, ROWS = 40, 6
SLOTS = BANDS * ROWS
#: of the SLOTS one-bit values, so many may differ; at 0.8 that is 6.4 standard deviations off
MAX_BITS = 54
#: elements signed at once
CHUNK = 20_000
#: buckets in which shingles are counted to tell rare ones, a power of two
RARITY = 1 << 18
#: nodes without a doc_id are numbered from here, from their set
NO_ID = 1 << 62
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of ``x`` reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    A-Z are lower-cased, words are parted by white space of ASCII. With fewer
    than ``k`` words the whole sequence is one shingle; without words, none.
    """
    words: list[bytes] = []
    counts = []
    for t in texts:
        own = (t or "").encode("utf-8", "surrogatepass").lower().split()
        words += own
        counts.append(len(own))
    if not words:
        return [np.zeros(0, np.uint64)] * len(texts)
    hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    weights = [mix(np.array([i + 1], np.uint64) * GOLDEN)[0] | np.uint64(1) for i in range(k)]
    padded = np.concatenate([hashed, np.zeros(k, np.uint64)])
    with np.errstate(over="ignore"):
        runs = sum((padded[i : i + len(hashed)] * w for i, w in enumerate(weights)), np.zeros(len(hashed), np.uint64))
        runs = mix(runs)
        out, at = [], 0
        for n in counts:
            if n >= k:
                out.append(np.unique(runs[at : at + n - k + 1]))
            elif n:
                short = sum((hashed[at + i] * weights[i] for i in range(n)), np.uint64(n) * GOLDEN)
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def superminhash(sets: list[np.ndarray], m: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` values per set; sets must not be empty.

    An element deals out its own permutation of the slots step by step; the
    value of step j lies in [j, j+1), so a set is done once all its slots hold
    values below the next step.
    """
    out = np.full((len(sets), m), np.inf)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    parts = [(i, sets[i][a : a + CHUNK]) for i in order for a in range(0, len(sets[i]), CHUNK)]
    while parts:
        size, n = 0, 0
        while n < len(parts) and (n == 0 or size + len(parts[n][1]) <= CHUNK):
            size += len(parts[n][1])
            n += 1
        own, parts = parts[:n], parts[n:]
        got = _signed([e for _, e in own], m)
        for (i, _), g in zip(own, got):
            np.minimum(out[i], g, out=out[i])
    return out


def _signed(sets: list[np.ndarray], m: int) -> np.ndarray:
    lengths = np.array([len(s) for s in sets])
    state = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), lengths)
    h = np.full(len(sets) * m, np.inf)
    table = h.reshape(len(sets), m)
    deal = np.tile(np.arange(m, dtype=np.int16), (len(state), 1))
    with np.errstate(over="ignore"):
        for j in range(m):
            x = mix(state + np.uint64(j + 1) * GOLDEN)
            value = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
            k = (j + (((x & np.uint64(0xFFFFF)) * np.uint64(m - j)) >> np.uint64(20))).astype(np.int64)
            rows = np.arange(len(state))
            slot = deal[rows, k]
            deal[rows, k] = deal[:, j]
            np.minimum.at(h, owner * m + slot, value)
            going = table.max(axis=1) >= j + 1
            stay = going[owner]
            if not stay.any():
                break
            if stay.mean() < 0.7:
                state, owner, deal = state[stay], owner[stay], deal[stay]
    return table


SIGNED = "doc_id long, k1 long, k2 long, node long, n long, a long, b long, bands array<long>, bits array<long>"


def sign(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """SIGNED rows, one per document; (k1, k2) hashes its text and (a, b) its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(one, slices(batch, 1, 2 << 20))

    def one(b):
        ids = b.column(0).to_pylist()
        sets = shingle_sets(b.column(1).to_pylist(), k)
        both = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        low = np.array([x & (2**64 - 1) for x in both], np.uint64).astype(np.int64)
        high = np.array([x >> 64 for x in both], np.uint64).astype(np.int64)
        node = [NO_ID | (int(a) & (NO_ID - 1)) if d is None else d for d, a in zip(ids, low)]
        full = [i for i, s in enumerate(sets) if len(s)]
        bands, bits = [[]] * len(sets), [[]] * len(sets)
        if full:
            h = mix(superminhash([sets[i] for i in full]).view(np.uint64))
            with np.errstate(over="ignore"):
                w = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
                keys = mix((h.reshape(len(full), BANDS, ROWS) * w).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * GOLDEN)
            packed = np.packbits(np.pad((h & np.uint64(1)).astype(np.uint8), ((0, 0), (0, 256 - SLOTS))), axis=1).view(np.int64)
            for i, key, bit in zip(full, keys.astype(np.int64), packed):
                bands[i], bits[i] = key, bit
        cols = [pa.array(ids, pa.int64()), b.column(2), b.column(3), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(low), pa.array(high), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "k1", "k2", "node", "n", "a", "b", "bands", "bits"])

    body = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long"), body.alias("_text"), *keyed(body)).mapInArrow(run, SIGNED)


def differing(x: str, y: str) -> Column:
    """How many of the slots' one-bit values differ."""
    words = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(4)]
    return words[0] + words[1] + words[2] + words[3]


def full_sets(docs: DataFrame, nodes: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(node, shingles) of the documents of ``nodes`` (node long)."""

    def run(batches):
        for b in batches:
            for part in slices(b, 1, 2 << 20):
                sets = shingle_sets(part.column(1).to_pylist(), k)
                low = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                node = [NO_ID | (a & (NO_ID - 1)) if d is None else d for d, a in zip(part.column(0).to_pylist(), low)]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    d = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    named = d.where("_id IS NOT NULL").join(nodes, F.col("_id") == F.col("node"), "left_semi")
    return named.union(d.where("_id IS NULL")).mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (x, y) of ``pairs`` whose full sets are similar enough."""
    x, y = sets.toDF("x", "sx"), sets.toDF("y", "sy")
    joined = pairs.join(x, "x").join(y, "y").withColumn("_both", F.size(F.array_intersect("sx", "sy")))
    enough = 100 * F.col("_both") >= percent * (F.size("sx") + F.size("sy") - F.col("_both"))
    return joined.where(enough).select("x", "y")


def across(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(x, y) of different components that may be similar enough; no such pair is missed.

    Sets with at least T shingles in common share one among the first n - T + 1
    of each, whatever the order of shingles, here the rarer first. Rarity is
    counted in hashed buckets, so the counts are of fixed size. In a shingle's
    group, members of its most frequent component are not compared with one
    another.
    """

    def count(batches):
        seen = np.zeros(RARITY, np.int64)
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            seen += np.bincount(flat & (RARITY - 1), minlength=RARITY)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    counted = sets.select("shingles").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(RARITY, np.int64)
    rarity[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(rarity)

    def lead(batches):
        rank = shared.value
        for b in batches:
            cols = ([], [], [], [])
            for node, values in zip(b.column("node").to_pylist(), b.column("shingles")):
                own = values.values.to_numpy(zero_copy_only=False)
                n = len(own)
                first = own[np.lexsort((own, rank[own & (RARITY - 1)]))][: n - -(-percent * n // 100) + 1]
                for c, v in zip(cols, (np.full(len(first), node), np.full(len(first), n), np.arange(len(first)), first)):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], names=["node", "n", "place", "shingle"])

    heads = sets.mapInArrow(lead, "node long, n long, place long, shingle long").join(roots, "node")
    per_root = heads.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"))
    groups = per_root.groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("top"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    groups = groups.where("lo < hi").select("shingle", F.col("top.root").alias("top"))
    heads = stored(heads.join(groups, "shingle").withColumn("main", F.col("root") == F.col("top")).drop("top"))
    x, y = heads.where("NOT main").toDF(*[f"{c}_x" for c in heads.columns]), heads.toDF(*[f"{c}_y" for c in heads.columns])
    least = F.ceil(F.lit(percent) * (F.col("n_x") + F.col("n_y")) / F.lit(100.0 + percent) - 1e-9)
    near = (F.col("place_x") <= F.col("n_x") - least) & (F.col("place_y") <= F.col("n_y") - least)
    once = F.col("main_y") | (F.col("node_x") < F.col("node_y"))
    pairs = x.join(y, (F.col("shingle_x") == F.col("shingle_y")) & (F.col("root_x") != F.col("root_y")) & once & near)
    return pairs.select(F.least("node_x", "node_y").alias("x"), F.greatest("node_x", "node_y").alias("y")).distinct()


def linked(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, k1, k2, node, n and root of every document; nodes of a component share its root."""
    signed = stored(sign(docs, k, doc_id, text))
    some = signed.where("n > 0")
    classes = cut_lineage(some.groupBy("a", "b").agg(F.min("node").alias("node")))
    reps = some.join(classes.select("node").distinct(), "node", "left_semi")
    members = reps.select("node", F.explode("bands").alias("band"))
    least = members.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    shared = stored(members.join(least.where("first < last").select("band", "first"), "band"))
    sketch = stored(reps.join(shared.select("node").distinct(), "node", "left_semi").select("node", "n", "bits").dropDuplicates(["node", "n", "bits"]))
    sx, sy = sketch.toDF("x", "nx", "bx"), sketch.toDF("y", "ny", "by")
    sized = (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & (differing("bx", "by") <= MAX_BITS)

    star = shared.where("node > first").select(F.col("first").alias("x"), F.col("node").alias("y")).distinct()
    star = cut_lineage(star.join(sx, "x").join(sy, "y").where(sized).select("x", "y").distinct())
    ends = star.select(F.col("x").alias("node")).union(star.select("y")).distinct()
    links = cut_lineage(confirmed(star, full_sets(docs, ends, k, doc_id, text), percent).distinct())
    found = components(links.toDF("a", "b"))

    rooted = shared.join(found, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    open_bands = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    apart = stored(rooted.join(open_bands, "band", "left_semi").select("node", "root").distinct())
    sets = stored(full_sets(docs, apart.select("node"), k, doc_id, text).join(apart.select("node"), "node", "left_semi"))
    rest = cut_lineage(across(sets, apart, percent))
    more = cut_lineage(confirmed(rest, sets, percent).distinct())
    found = components(links.union(more).toDF("a", "b"))

    of_class = classes.join(found, "node", "left").select("a", "b", F.coalesce("root", "node").alias("root"))
    done = signed.drop("bands", "bits").join(of_class, ["a", "b"], "left")
    return done.withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents are linked if their sets of ``k``-word shingles share ``percent``
    per cent of their union; component_id is the smallest doc_id reachable and
    ``kept`` marks the document that has it. Null texts and texts without words
    are linked with nothing and kept. Repeated rows share their component; rows
    that share a doc_id count as one document. Rows without a doc_id take part,
    but lend no component_id: a component of such rows alone has a null one and
    all rows of its smallest set are kept. Other columns are dropped; no rows
    give none.
    """
    return linked(docs, k, percent, doc_id, text).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("root") < NO_ID, F.col("root")).alias("component_id"),
        (F.col("node") == F.col("root")).alias("kept"),
    )


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of near duplicates, all columns kept.

    It is the one that ``near_duplicates`` keeps; of repeated rows, and of rows
    without a doc_id, one stays. Texts without words are no duplicates, and all
    of their rows stay.
    """
    found = stored(linked(docs, k, percent, doc_id, text))
    key = F.struct("doc_id", "k1", "k2")
    one = found.where((F.col("n") > 0) & (F.col("node") == F.col("root"))).groupBy("root").agg(F.min(key).alias("key")).select("key.*")
    repeated = found.where("n > 0").groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    bare = found.where("n = 0").select("doc_id", "k1", "k2").distinct()
    one = one.union(bare).toDF("_id", "_o1", "_o2")
    k1, k2 = keyed(F.col(text).cast("string"))
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")  # apart from the columns added here
    keyed_docs = docs.select(own, F.col(doc_id).alias("_doc"), k1.alias("_k1"), k2.alias("_k2"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_k1") == F.col("_o1")) & (F.col("_k2") == F.col("_o2"))
    kept = keyed_docs.join(one, same, "left_semi")
    if not repeated.isEmpty():
        wordless = ~F.coalesce(F.col("_row").getField(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
        kept = kept.where(wordless).union(kept.where(~wordless).dropDuplicates(["_doc", "_k1", "_k2"]))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
