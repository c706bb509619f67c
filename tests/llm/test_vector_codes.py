"""Vector codes against a plain Python version in whole numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadencia.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _label string, _n long"


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{vec_id: [(code, error, label)]} and the digest, step by step as the contract has it."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = [(i, [v[p * w : (p + 1) * w] for p in range(parts)], lab) for i, v, lab in kept]
    first = {}
    for i, v, _ in cut:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    books = [[first[i][p] for i in sorted(first)[:entries]] for p in range(parts)]

    def assign(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for _, v, _ in cut:
                mine.setdefault(assign(v[p], books[p])[0], []).append(v[p])
            books[p] = [[sum(c) // len(mine[e]) for c in zip(*mine[e])] if e in mine else b for e, b in enumerate(books[p])]
    out = []
    for i, v, lab in cut:
        found = [assign(v[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{f[0]:02x}" for f in found), sum(f[1] for f in found)))
    total = {}
    for _, lab, _, e in out:
        total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, lab, c, e, total[lab]) for i, lab, c, e in out), key=repr), digest


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA)


def found(df):
    return sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in df.collect()), key=repr)


def vectors(n, width, seed, clusters=6):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(clusters, width))
    v = (mid[r.integers(0, clusters, n)] + 0.1 * r.normal(size=(n, width))).astype(np.float32)
    return [[float(x) for x in row] for row in v]


def test_equal_to_plain_version(spark):
    v = vectors(240, 32, 1)
    rows = [(7 * i % 241, v[i], None if i % 5 == 0 else 0 if i % 3 else i) for i in range(240)]
    # repeated rows, ties, null, non-finite, null components, a null id, negative and large values
    rows += [rows[3], rows[3], (500, v[3], 1), (501, None, 1), (502, [float("nan")] * 32, 1), (503, [float("inf")] + [0.0] * 31, 1), (504, [None] + [0.0] * 31, 1)]
    rows += [(None, v[5], 2), (505, [0.0] * 32, None), (506, [1e6] * 32, 3), (507, [-1e6] * 32, 3)]
    coded, books = vc.compress(rows_of(spark, rows))
    want, digest = plain(rows)
    assert found(coded) == want
    assert books.digest() == digest


def test_few_rows_and_none(spark):
    rows = [(2, [0.5] * 8, 1), (1, [-0.25] * 8, 1), (2, [0.5] * 8, 1)]
    coded, books = vc.compress(rows_of(spark, rows))
    want, digest = plain(rows)
    assert found(coded) == want and books.digest() == digest
    empty, books = vc.compress(rows_of(spark, rows).where("vec_id > 9"))
    assert empty.collect() == [] and books.digest() == hashlib.sha256(b"").hexdigest()
    assert empty.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_lengths_are_filled_up(spark):
    coded, _ = vc.compress(rows_of(spark, [(1, [1.0] * 9, 0), (2, [1.0] * 3, 0), (3, [], 0)]))
    assert [r[0] for r in found(coded)] == [1, 2, 3] and all(len(r[2]) == 16 for r in found(coded))


def test_bounds_prune_and_are_exact():
    r = np.random.default_rng(3)
    mid = r.integers(-4000, 4000, (16, 8))
    parts = mid[r.integers(0, 16, 3000)] + r.integers(-40, 40, (3000, 8))
    pivots = vc.far_apart(mid, vc.PIVOTS)
    at, best, tried = vc.nearest(parts, vc.distances(parts, pivots), mid, vc.distances(pivots, mid))
    all_ = ((parts[:, None, :] - mid[None]) ** 2).sum(-1)
    assert (at == all_.argmin(1)).all() and (best == all_.min(1)).all()
    assert tried < 3000 * 16 / 4


@pytest.mark.parametrize("size", [1, 1 << 27, 1 << 40])
def test_ties_go_to_the_lower_index(size):
    entries = np.array([[size], [-size], [size], [3 * size]]).astype(object if size > 1 << 26 else np.int64)
    parts = np.array([[0], [2 * size], [size]]).astype(entries.dtype)
    pivots = entries[:2]
    at, best, _ = vc.nearest(parts, vc.distances(parts, pivots), entries, vc.distances(pivots, entries))
    assert at.tolist() == [0, 0, 0] and best.tolist() == [size**2, size**2, 0]


def test_label_errors_of_hot_and_rare_labels(spark):
    coded = spark.range(400).select(
        F.col("id").alias("vec_id"), F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") + 1000).alias("label"), F.lit("00").alias("code"), F.col("id").alias("error")
    )
    got = {r.vec_id: r.label_error for r in vc.with_label_error(coded).collect()}
    assert len(got) == 400
    assert got[0] == sum(range(0, 400, 2)) and got[3] == sum(i for i in range(400) if i % 2 and i % 3 == 0) and got[5] == 5
