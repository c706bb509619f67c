"""Vector searches against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadencia.llm import ann, exact_topk
from cadencia.llm import vectors as V


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 12))
    x = centres[rng.integers(0, 6, 1200)] + 0.4 * rng.standard_normal((1200, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True) / rng.uniform(0.5, 2, (1200, 1))
    x[100:400] = x[100]  # a third of one vector
    out = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(x)]
    bad = [(2000, None), (2020, [float("nan")] * 12), (2040, [float("inf")] + [0.0] * 11), (2060, [0.0] * 12), (2080, [None] + [1.0] * 11), (None, [1.0] * 12), (2100, [])]
    return out + bad + [out[40], out[41]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(4)


def clean(rows, zero_too):
    out = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and (zero_too or any(v)):
            out[i] = np.array(list(v) + [0.0] * (12 - len(v)), dtype=np.float32).astype(float)
    return out


def best(vectors, q, k=20):
    ids = np.array(sorted(i for i in vectors if i != q))
    s = np.array([vectors[i] @ vectors[q] for i in ids])
    at = np.lexsort((ids, -s))[:k]
    return list(zip(ids[at].tolist(), s[at].tolist()))


@pytest.mark.parametrize("block", [64, 4096])
def test_exact(spark, rows, block, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", block)
    vectors = {i: np.floor(64 * v) for i, v in clean(rows, True).items()}
    got = exact_topk.search(frame(spark, rows), F.col("vec_id") % 20 == 0).toPandas()
    queries = sorted(i for i in vectors if i % 20 == 0)
    assert sorted(set(got["query_id"])) == queries
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert list(zip(own["vec_id"], own["score"].astype(float))) == best(vectors, q)


def test_approximate(spark, rows, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 128)
    vectors = clean(rows, False)
    got = ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0).toPandas()
    queries = sorted(i for i in vectors if i % 20 == 0)
    assert sorted(set(got["query_id"])) == queries
    hits = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        want = best(vectors, q)
        hits += len({v for v, _ in want} & set(own["vec_id"]))
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own["vec_id"])
        assert np.allclose(own["score"], [vectors[v] @ vectors[q] for v in own["vec_id"]], rtol=1e-12, atol=1e-12)
        assert own.sort_values(["score", "vec_id"], ascending=[False, True])["vec_id"].tolist() == own["vec_id"].tolist()
    assert hits >= 0.9 * 20 * len(queries)


@pytest.mark.parametrize("search", [exact_topk.search, ann.search])
def test_few_and_none(spark, search):
    few = frame(spark, [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])])
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search(few, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1): 3, (0, 2): 20, (20, 1): 3, (20, 2): 0}
    assert search(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert search(frame(spark, [(0, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_quantile_and_tree():
    assert abs(ann.quantile(0.95, 16) - 26.296) < 1e-3 and abs(ann.quantile(0.9, 2) - 4.605) < 1e-3
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 4))
    x[:200] = x[0]
    root, nodes, low, high = ann.grown(x, 16)
    cell = ann.cells_of(x, root, nodes)
    assert ((x >= low[cell]) & (x <= high[cell])).all() and len(set(cell)) > 8
