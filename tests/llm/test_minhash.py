"""Near duplicates against brute force; components; signatures."""

import random

import numpy as np
import pytest

from cadencia.llm import minhash
from cadencia.llm.components import components


def words(t):
    return [w for w in (t or "").encode().lower().split()]


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 6, 40, 150, 400]))]
        texts.append(" ".join(base))
        for change in (0, 1, 2, 4, 8):
            other = list(base)
            for _ in range(change):
                other[rng.randrange(len(other))] = rng.choice(vocab)
            texts.append(" ".join(other).title() if change == 2 else " \t".join(other))
    chain = [f"c{i}" for i in range(60)]
    texts += [" ".join(chain[s : s + 40]) for s in range(0, 16, 2)]  # neighbours are linked, ends are not
    hot = "the very same text of many rows"
    texts += [hot] * 40 + [None, "", " \t\n ", "one", "One", "x" * 100_000]
    return list(enumerate(texts))


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(spark, corpus, k):
    docs = spark.createDataFrame([(i, t, True) for i, t in corpus], "doc_id long, text string, kept boolean")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, k=k).collect()}
    want = brute(corpus, k)
    assert len(got) == len(corpus)
    for i, (n, root) in want.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, root, i == root), i


def test_one_of_each_group_stays(spark, corpus):
    rows = [*corpus, corpus[3], corpus[3], (None, corpus[3][1]), (None, "alone without an id"), (None, "alone without an id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string")
    got = minhash.deduplicated(docs, k=2)
    assert got.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    want = {i for i, (n, root) in brute(corpus, 2).items() if i == root}
    assert sorted(i for i, _ in got if i is not None) == sorted(want)
    assert [t for i, t in got if i is None and t is not None] == ["alone without an id"]
    assert len([1 for i, t in got if i is None and t is None]) == 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 0
    assert minhash.deduplicated(docs).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in minhash.near_duplicates(only).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(300)] + [(9, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == root(x) for x in up)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_vary_less_than_independent_ranks():
    rng = np.random.default_rng(4)
    pairs = []
    for _ in range(150):
        u = rng.integers(0, 2**63, 300).astype(np.uint64)
        pairs.append((u[:200], u[100:]))
    a, b = minhash.superminhash([x for x, _ in pairs]), minhash.superminhash([y for _, y in pairs])
    share = (a == b).mean(1)
    assert abs(share.mean() - 1 / 3) < 0.01
    assert share.std() < 0.9 * np.sqrt(1 / 3 * 2 / 3 / minhash.SLOTS)
    assert np.isfinite(a).all()


def test_order_and_blocks_do_not_matter():
    rng = np.random.default_rng(6)
    big = rng.integers(0, 2**63, 3 * minhash.CHUNK).astype(np.uint64)
    small = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 2, 30)]
    one = minhash.superminhash([*small, big])
    two = minhash.superminhash([rng.permutation(big), *small[::-1]])
    assert (one == np.vstack([two[3], two[2], two[1], two[0]])).all()
