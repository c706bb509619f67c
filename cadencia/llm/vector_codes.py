"""Product codes of vectors, learned and assigned in whole numbers.

A component x becomes the integer floor(4096 * x), and a vector is cut into
eight consecutive parts. Every part position has a codebook of at most 16
entries. A round assigns each part to its nearest entry (squared distance, ties
to the lower index) and replaces an entry by the floor of its parts' mean.

Most distances are never computed (LAESA): the distances of every part to a few
fixed pivots are computed once and stored. In a round, the distances of pivots
to entries give |d(part, pivot) - d(pivot, entry)| <= d(part, entry). A part
tries its entries by growing lower bound and stops when the bound exceeds the
best distance so far. What is tried is evaluated exactly in integers; bounds are
floats, lowered by more than their rounding error, so nothing is pruned wrongly.

Left out are rows whose vector is null or holds null or non-finite components.
A row with a null id is coded, but starts no entry; of several vectors with one
id the smallest starts it. Repeated rows are coded each. Vectors shorter than the
longest are filled up with zeros, as is a width that eight does not divide. With
fewer ids than entries the codebooks are smaller; an empty table gives no rows.
Components of magnitude 2**80 and more (after scaling) raise an error, as do
squared distances beyond a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: fixed pivots of a part position
PIVOTS = 4
#: below this magnitude squared distances and sums of a batch fit 64 bits
SMALL = 1 << 26
#: relative allowance for the rounding of bounds
SLACK = 1e-9
#: a label with more than a 64th of all rows is hot; there are fewer than 64
HOT = 64


def whole(values: np.ndarray) -> np.ndarray:
    """Integral floats as 64-bit integers, or as Python integers where those might overflow."""
    if not values.size or np.abs(values).max() < SMALL:
        return values.astype(np.int64)
    if np.abs(values).max() >= 2.0**80:
        raise ValueError("a component is too large for exact codes")
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def far_apart(entries: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the entries: the first, then always the one farthest from those taken."""
    taken = [0]
    near = squared(entries, entries[0])
    while len(taken) < min(most, len(entries)):
        taken.append(int(np.argmax(near)))
        near = np.minimum(near, squared(entries, entries[taken[-1]]))
    return entries[taken]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of ``a`` to rows of ``b`` as floats."""
    return np.sqrt(squared(a[:, None, :], b[None, :, :]).astype(np.float64))


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivot_entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of each part, and how many were evaluated."""
    n = len(parts)
    bound = np.zeros((n, len(entries)))
    for p in range(pivot_entry.shape[0]):
        a, b = to_pivots[:, p, None], pivot_entry[None, p, :]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.zeros(n, dtype=parts.dtype)
    at = np.full(n, -1, dtype=np.int64)
    left, tried = np.arange(n), 0
    for j in range(len(entries)):
        e = order[left, j]
        go = (at[left] < 0) | (bound[left, e] <= best[left])
        left, e = left[go], e[go]
        if not len(left):
            break
        d = squared(parts[left], entries[e])
        tried += len(left)
        better = (at[left] < 0) | (d < best[left]) | ((d == best[left]) & (e < at[left]))
        best[left[better]], at[left[better]] = d[better], e[better]
    return at, best, tried


@dataclass(frozen=True)
class Codebooks:
    """``entries[part][index]`` is a tuple of integers; so is ``pivots[part][number]``."""

    entries: tuple
    pivots: tuple

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        flat = (str(x) for part in self.entries for e in part for x in e)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """A list column as rows x parts x width; all lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1)


def _arrays(books: Codebooks) -> list[tuple[np.ndarray, np.ndarray]]:
    """Entries and pivot-entry distances of each part position."""
    out = []
    for entries, pivots in zip(books.entries, books.pivots):
        e, p = (whole(np.array(x, dtype=np.float64)) for x in (entries, pivots))
        out.append((e, distances(p, e)))
    return out


def _assigned(batch: pa.RecordBatch, tables: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(parts, index, squared distance) of each part position; v and pivots are the last columns."""
    v = whole(_matrix(batch.column(batch.num_columns - 2), len(tables)))
    to_pivots = _matrix(batch.column(batch.num_columns - 1), len(tables))
    for i, (entries, pivot_entry) in enumerate(tables):
        at, best, _ = nearest(v[:, i], to_pivots[:, i], entries, pivot_entry)
        yield v[:, i], at, best


def prepared(table: DataFrame, vec_id: str, vector: str, label: str | None, parts: int, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, and the width of ``v``."""
    raw = F.col(vector).cast("array<double>")
    good = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(
        F.col(vec_id).alias("vec_id"),
        (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
        F.when(good, F.transform(raw, lambda x: x * F.lit(float(scale)))).alias("v"),
    ).where("v IS NOT NULL")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(-(-width // parts), 1) * parts
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v")))), width


def _floored(rows: DataFrame, pivots: tuple, width: int) -> DataFrame:
    """Rows with floored components and the distances of their parts to the pivots."""
    parts = len(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = [whole(np.array(p, dtype=np.float64)) for p in pivots]
        for b in batches:
            v = np.floor(_matrix(b.column(2), parts))
            exact = whole(v)
            far = np.concatenate([distances(exact[:, i], fixed[i]) for i in range(parts)], axis=1)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) for x in (v.reshape(len(v), width), far)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["vec_id", "label", "v", "pivots"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<double>, pivots array<double>")


def _means(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one more round; what reaches the driver is one codebook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _arrays(books)
        sums: dict[tuple[int, int], list] = {}
        for b in batches:
            for i, (x, at, _) in enumerate(_assigned(b, tables)):
                for e in np.unique(at).tolist():
                    mine = x[at == e]
                    n, s = sums.get((i, e), (0, 0))
                    sums[i, e] = [n + len(mine), s + mine.sum(axis=0).astype(object)]
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int32()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([sums[k][0] for k in keys], pa.int64()),
                    pa.array([[str(x) for x in sums[k][1]] for k in keys], pa.list_(pa.string())),
                ],
                names=["part", "entry", "n", "sums"],
            )

    partial = rows.select("v", "pivots").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    each = partial.select("part", "entry", "n", F.posexplode("sums").alias("i", "s"))
    total = each.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = {(r.part, r.entry, r.i): int(r.s) // r.n for r in total.collect()}
    entries = tuple(tuple(tuple(new.get((p, e, i), x) for i, x in enumerate(entry)) for e, entry in enumerate(part)) for p, part in enumerate(books.entries))
    return Codebooks(entries, books.pivots)


def learn(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> tuple[DataFrame, Codebooks]:
    """Stored rows with pivot distances, and the codebooks after all rounds."""
    ids = [r[0] for r in rows.select("vec_id").where("vec_id IS NOT NULL").distinct().orderBy("vec_id").limit(entries).collect()]
    first = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    if not first:  # only null ids, or no rows
        first = rows.select("v").distinct().orderBy("v").limit(entries).collect()
    start = np.floor(np.array([r["v"] for r in first], dtype=np.float64).reshape(len(first), parts, width // parts))
    cut = [whole(start[:, i]) for i in range(parts)]
    as_tuples = lambda m: tuple(tuple(int(x) for x in e) for e in m)
    pivots = tuple(as_tuples(far_apart(c, PIVOTS)) if len(c) else () for c in cut)
    books = Codebooks(tuple(as_tuples(c) for c in cut), pivots)
    if not len(start):
        return rows, books
    kept = stored(_floored(rows, pivots, width))
    for _ in range(rounds):
        books = _means(kept, books)
    return kept, books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of the stored rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _arrays(books)
        for b in batches:
            found = [(at, d) for _, at, d in _assigned(b, tables)]
            at = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            code = pa.array([row.tobytes().hex() for row in at], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, pa.array(error.tolist(), pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the errors summed over equal labels, null labels together.

    Labels with more than a 64th of the rows are fewer than 64, so their sums
    may be broadcast; the other labels join on the label.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    sums = stored(sums.withColumnRenamed("label", "_label"))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    same = F.col("label").eqNullSafe(F.col("_label"))
    hot = sums.where(F.col("_n") * HOT > total).drop("_n")
    rest = sums.where(F.col("_n") * HOT <= total).drop("_n")
    marked = coded.join(F.broadcast(hot), same, "left")
    done = marked.where("label_error IS NOT NULL").drop("_label")
    cold = marked.where("label_error IS NULL").drop("_label", "label_error").join(rest, same).drop("_label")
    return done.unionByName(cold)


def compress(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of all vectors, and the codebooks."""
    if entries > 256:
        raise ValueError("an index has two hex digits")
    rows, width = prepared(table, vec_id, vector, label, parts, scale)
    kept, books = learn(rows, width, parts, entries, rounds)
    if not books.entries[0]:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty, books
    return with_label_error(stored(encode(kept, books))), books


def compress_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of the query over embeddings, one step per round."""

    def assign(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT rid, part, min(struct_pack(d := d, e := e)) AS m FROM (
  SELECT p.rid, p.part, c.e, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{i} c USING (part)) GROUP BY 1, 2)"""

    def update(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (SELECT c.part, c.e, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (
  SELECT part, e, list(s ORDER BY i) AS x FROM (
    SELECT part, e, i, floor(sum(v) / count(*)) AS s FROM (SELECT p.part, a.m.e AS e, unnest(p.x) AS v, unnest(range(len(p.x))) AS i FROM p JOIN a{i} a USING (rid, part)) GROUP BY 1, 2, 3)
  GROUP BY 1, 2) n ON n.part = c.part AND n.e = c.e)"""

    steps = ",\n".join(f"{assign(i)},\n{update(i)}" for i in range(rounds))
    return f"""WITH k AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, vec_id, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) AS x FROM k, range({parts}) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p
  WHERE vec_id IN (SELECT DISTINCT vec_id FROM k ORDER BY vec_id LIMIT {entries})),
{steps},
{assign(rounds)},
f AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error
  FROM a{rounds} JOIN k USING (rid) GROUP BY k.rid, k.vec_id, k.label),
h AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS s FROM (SELECT part, e, unnest(x) AS v, unnest(range(len(x))) AS i FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM f, h"""
