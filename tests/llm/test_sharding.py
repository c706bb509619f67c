"""Shards: laws of the hash tree, slots, odd rows."""

import zlib

import pytest

from cadencia.llm import sharding


@pytest.fixture(scope="module")
def placed(spark):
    texts = [None, "", "é" * 5, "x" * 20_000, "same", "same"]
    rows = [(i, texts[i % 6], -1) for i in range(3000)] + [(7, texts[1], -1)] * 400 + [(None, "a", -1), (None, None, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    return docs, rows, sharding.placed(docs).toPandas()


def test_rows_sizes_checksums(placed):
    _, rows, got = placed
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["size"], got["text_crc32"])) == want
    assert set(got["law"]) == {"key"}


def test_slots_are_gapless(placed):
    for _, own in placed[2].groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_only_the_key_decides(placed):
    got = placed[2]
    assert (got.groupby(got["doc_id"].fillna(-1))["shard"].nunique() == 1).all()
    assert set(got["shard"]) == set(range(8))


def test_one_more_shard_only_takes(placed):
    got = placed[2].drop_duplicates("doc_id")
    moved = got["grown_shard"] != got["shard"]
    assert (got.loc[moved, "grown_shard"] == 8).all()
    assert abs(moved.mean() - 1 / 9) < 0.03


def test_every_growth_only_takes(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = sharding.assign(docs, "doc_id", sharding.tree(1), "s1")
    for n in range(2, 12):
        before = sharding.assign(before, "doc_id", sharding.tree(n), f"s{n}")
    got = before.toPandas()
    for n in range(9, 12):
        moved = got[f"s{n}"] != got[f"s{n - 1}"]
        assert (got.loc[moved, f"s{n}"] == n - 1).all() and moved.any()


def test_weights_move_rows_only_at_their_subtree(spark):
    leaves = sharding.tree(8)
    heavier = [x._replace(weight=3.0) if x.number == 5 else x for x in leaves]
    docs = spark.range(6000).withColumnRenamed("id", "doc_id")
    got = sharding.assign(sharding.assign(docs, "doc_id", leaves, "a"), "doc_id", heavier, "b").toPandas()
    other = got["a"].isin([0, 1, 2, 3])
    assert (got.loc[other & got["b"].isin([0, 1, 2, 3]), "a"] == got.loc[other & got["b"].isin([0, 1, 2, 3]), "b"]).all()
    assert abs((got["b"] == 5).mean() - 0.3) < 0.03
    # inside the rack that gained, its other shard only loses
    assert not ((got["a"] == 5) & (got["b"] != 5)).any()
    gone = [x._replace(weight=0.0) if x.number == 2 else x for x in leaves]
    assert 2 not in set(sharding.assign(docs, "doc_id", gone, "c").toPandas()["c"])


def test_empty(spark):
    assert sharding.placed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
