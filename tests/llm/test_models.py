"""Language identification and the quality classifier."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadencia.llm import langid, quality

SYLLABLES = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["sch", "eng", "ung", "ter"], "ru": ["про", "ни", "ско", "ве"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.randint(3, 60)), lang, "was"))
    rows += [(1000, None, "aa", "x"), (1001, "", "aa", "x"), (1002, "123 !!", "aa", "x"), (1003, prose(rng, "aa", 5), None, "x"), (5, rows[5][1], "aa" if False else rows[5][2], "x")]
    rows += [(1004, prose(rng, "bb", 30_000), "bb", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_predictions(documents):
    model = langid.learn(documents)
    assert model.languages == ["aa", "bb", "ru"]
    got = langid.predict(documents, model).collect()
    assert len(got) == documents.count()
    for r in got:
        if r["doc_id"] in (1000, 1001, 1002):
            assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, [])
        else:
            assert r["lang_pred"] == (r["lang"] or "aa") and 0 < r["score"] <= 1


def test_training_part(documents):
    got = documents.select("doc_id", langid.in_training("doc_id").alias("t")).collect()
    assert all(r["t"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2) for r in got)
    # labels of the held-out part change nothing
    flipped = documents.withColumn("lang", F.when(langid.in_training("doc_id"), F.col("lang")).otherwise("zz"))
    a, b = langid.learn(documents), langid.learn(flipped)
    assert a.languages == b.languages and (a.scores == b.scores).all()


def test_spans_of_mixed_text(spark, documents):
    rng = random.Random(7)
    text = prose(rng, "aa", 20) + " 12 . " + prose(rng, "bb", 30) + " " + prose(rng, "ru", 10)
    got = langid.predict(spark.createDataFrame([(text,)], "text string"), langid.learn(documents)).first()
    assert [tuple(s) for s in got["spans"]] == [(0, 20, "aa"), (20, 30, "bb"), (50, 10, "ru")]
    assert got["lang_pred"] == "bb" and got["score"] < 1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 8, (18, 3)).astype(np.float32)
    at = np.array([0, 6, 6, 12, 13, 18])
    labels = langid.viterbi(scores, at, switch=6.0)
    from itertools import product

    for a, b in zip(at, at[1:]):
        if b > a:
            value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 6 * sum(x != y for x, y in zip(p, p[1:]))
            most = max(value(p) for p in product(range(3), repeat=b - a))
            assert abs(value(labels[a:b]) - most) < 1e-3


def test_accepted(spark, documents):
    kept = langid.accepted(documents)
    assert kept.columns == documents.columns
    assert {r["score"] for r in kept.collect()} <= {"was", "x"}  # a column that the prediction also has
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in documents.collect() if r["doc_id"] not in (1000, 1001, 1002))
    empty = documents.limit(0)
    assert langid.accepted(empty).count() == 0
    unlabelled = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(unlabelled, langid.learn(unlabelled)).collect()} == {"und"}


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(900):
        good = rng.random() < 0.7
        t = prose(rng, "aa", rng.randint(20, 80)).capitalize() + "."
        t = t if good else " ".join(w + rng.choice(["###", "%%%", "$$$"]) for w in t.split())
        rows.append((i, t, "aa", f"src{rng.randrange(5)}", len(t)))
        if i < 500:
            marks.append((i, int(good), 0))
    rows += [(2000, None, None, None, None), (2001, "", "aa", "s", 0), (None, "no id here", "aa", "s", 5), (3, rows[3][1], "aa", "s", 4)]
    truth = {i: "###" not in t and "%%%" not in t and "$$$" not in t for i, t, *_ in rows[:900]}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("keep", F.lit("was"))
    labels = spark.createDataFrame(marks + [(0, marks[0][1], 0), (None, 1, 0), (7777, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, truth


def test_quality(pages):
    docs, labels, truth = pages
    got = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(got) == docs.count()
    right = [r["keep"] == truth[r["doc_id"]] for r in got if r["doc_id"] in truth and r["doc_id"] >= 500]
    assert np.mean(right) > 0.98
    assert all(0 <= r["quality_score"] <= 1 and 0 <= r["p_page"] <= 1 for r in got)


def test_accepted_pages(pages):
    docs, labels, truth = pages
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r["keep"] for r in rows} == {"was"}
    assert sum(truth.get(r["doc_id"], True) for r in rows) >= 0.98 * len(rows)


def test_without_labels_all_stay(spark, pages):
    docs, labels, _ = pages
    for few in (labels.limit(0), labels.where("quality = 1")):
        got = quality.score(docs, quality.learn(docs, few)).collect()
        assert all(r["keep"] and r["quality_score"] is None for r in got)
    assert quality.score(docs.limit(0), quality.learn(docs, labels)).count() == 0


def test_views_exchange_labels():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400).astype(float)
    a = np.stack([y + rng.normal(0, 0.2, 400), rng.normal(size=400)], axis=1)
    b = np.stack([y + rng.normal(0, 0.2, 400), rng.normal(size=400)], axis=1)
    hidden = rng.integers(0, 2, 300).astype(float)
    pool = tuple(np.stack([hidden + rng.normal(0, 0.2, 300), rng.normal(size=300)], axis=1) for _ in range(2))
    done, combined = quality.cotrain((a, b), y, np.arange(400) % 5 == 0, pool)
    both = np.stack([quality.odds(quality.odds(v, w)[:, None], c) for v, (w, c) in zip(pool, done)], axis=1)
    assert ((quality.share(quality.odds(both, combined)) >= 0.5) == hidden).mean() > 0.98
