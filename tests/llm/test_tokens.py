"""Encoding, decoding and packing against the tokenizer library and plain Python."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadencia.llm import packing, tokens

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "!", "...", "1", "23", "é", "中文字", "　", "\xa0", "<|endoftext|>", "<|end", "oftext|>", "😀", "I'll", "\r\n", "ж", "́"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


@pytest.fixture(scope="module")
def codec():
    with open(tokens.default_vocabulary(), encoding="utf-8") as f:
        return tokens.Codec(f.read())


def made(rng, n, parts=PARTS):
    return "".join(rng.choice(parts) for _ in range(n))


def test_batches_equal_the_library(library, codec):
    rng = random.Random(3)
    texts = [made(rng, rng.randint(0, 50)) for _ in range(1500)] + ["", " ", "x ", " x", "a  b", None]
    ids, at = codec.batch(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == want
    assert [codec.decode(w) for w in want] == [library.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80), st.integers(1, 30))
def test_tree_equals_whole(text, leaf):
    with open(tokens.default_vocabulary(), encoding="utf-8") as f:
        c = tokens.codec(f.read())
    level = [(p, c.whole(p)) for p in tokens.halves(text, leaf)] or [("", c.whole(""))]
    while len(level) > 1:
        level = [c.join(*level[i : i + 2], reach=4) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert level[0][0] == text
    assert level[0][1].tolist() == c.whole(text).tolist()


@pytest.mark.parametrize("text", ["a" * 30_000, "中文" * 8_000, " " * 9_000 + "x", "!?" * 9_000, "then" * 9_000])
def test_long_unsplit_texts(codec, library, text):
    level = [(p, codec.whole(p)) for p in tokens.halves(text, 1000)]
    while len(level) > 1:
        level = [codec.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert level[0][1].tolist() == library.encode(text, add_special_tokens=False).ids


def test_operator_rows(spark, library):
    rng = random.Random(4)
    texts = [made(rng, 200) for _ in range(20)] + [None, "", "short", "short"]
    rows = [(i, t, "was there", 7) for i, t in enumerate(texts)] + [(0, texts[0], "was there", 7), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, _id int")
    got = tokens.decode(tokens.encode(docs, leaf_chars=100)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == (r["text"] or "")
        assert r["_id"] == (None if r["doc_id"] is None else 7)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.decode(tokens.encode(empty)).count() == 0


def placed_right(pdf, size):
    for _, own in pdf.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == np.concatenate([[0], np.cumsum(own["length"])[:-1]]).tolist()
        assert own["length"].sum() <= size


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 200), max_size=25))
def test_plan_places_every_rank_once(counts):
    size = 40
    used, ranks = {}, {}
    for length, a, b, each, seq, off in packing.plan(counts, size):
        for j in range(b - a):
            s, o = seq + j // each, off + j % each * length
            used.setdefault(s, []).append((o, length))
            ranks.setdefault(length, []).append(a + j)
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    for own in used.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= size
    assert set(used) == set(range(len(used)))
    # best-fit decreasing over single pieces opens as many sequences
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [i for i, r in enumerate(rooms) if r >= length]
            i = min(fit, key=lambda i: rooms[i]) if fit else len(rooms)
            if not fit:
                rooms.append(size)
            rooms[i] -= length
    assert len(used) == len(rooms)


def test_packing_rows(spark, library):
    rng = random.Random(5)
    texts = [made(rng, rng.randint(0, 120)) for _ in range(60)] + [None, "", "same", "same"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    cut = packing.pieces(docs, size=16, leaf_chars=150)
    cut = cut.withColumn("crc", F.crc32("ids")).drop("ids")
    got = packing.pack(cut, size=16, carry=("crc",)).toPandas()
    placed_right(got, 16)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = got[got["doc_id"] == i].sort_values(["piece", "sequence_id"]).drop_duplicates("piece")
        assert own["length"].sum() == len(ids) and own["piece"].tolist() == list(range(len(own)))
        assert (own["length"].iloc[1:] == 16).all()
        for r in own.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.crc
    assert (got["doc_id"] == 0).sum() == 2 * (got[got["doc_id"] == 0]["piece"].nunique())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(empty)).count() == 0
