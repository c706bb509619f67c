"""Columns of a table keep their values, whatever their names."""

import pytest

from cadencia.llm import langid, minhash, pii, quality

NAMES = ["_h1", "_h2", "_k1", "_k2", "_id", "_o1", "_o2", "_more", "_row", "_doc", "_text_key", "_long_ids", "_own_score", "_own_keep", "_found", "score", "keep", "spans", "lang_pred", "k1", "node"]


@pytest.fixture(scope="module")
def docs(spark):
    words = [f"the cat sat on mat number {i} and looked at bird {i} in tree {i} while the sun went down over hill {i}" for i in range(30)]
    rows = [(i, w + f" mail me at a{i}@b{i}.org", "en", "web", len(w), *[f"{n}-{i}" for n in NAMES]) for i, w in enumerate(words)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")


def own(rows):
    return sorted(tuple(r[n] for n in ["doc_id", *NAMES]) for r in rows)


def test_names(docs, labels):
    want = own(docs.collect())
    sanitised = pii.sanitise(docs)
    assert sanitised.columns == docs.columns and own(sanitised.collect()) == want
    assert "@" not in "".join(r.text for r in sanitised.collect())
    unique = minhash.deduplicated(docs)
    assert unique.columns == docs.columns and own(unique.collect()) == sorted(set(want))
    spoken = langid.accepted(docs)
    assert spoken.columns == docs.columns and own(spoken.collect()) == want
    good = quality.accepted(docs, labels)
    assert good.columns == docs.columns and set(own(good.collect())) <= set(want)


def test_unlabelled_documents_are_all_scored(spark):
    """The surest of all unlabelled documents are picked, of every source, and no more than asked for."""
    rows = []
    for i in range(240):
        bad = i % 2
        text = " ".join((f"w{i}### %%% $$$" if bad else "some plain words of a story") for _ in range(6 + i % 5))
        rows.append((i, text, "rare" if i in (201, 200) else "web", "en", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int")
    centre, done, _ = quality.learn(docs, labels, picked=4)
    sure = quality._sure(docs, labels, centre, done, 4)
    text = [r for r in sure if r["view"] == 0]
    assert all(r["doc_id"] >= 120 and r["y"] == 1 - r["doc_id"] % 2 for r in text)
    assert {200, 201} <= {r["doc_id"] for r in text}
    assert sum(r["y"] for r in text) == 4 and len(text) == 8


def test_language_of_few_texts_is_learned(spark):
    rows = [(i, "the house and the garden of my friend are near", "en") for i in range(400)] + [(1000 + i, "das haus und der garten meines freundes sind nah", "de") for i in range(8)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=20)
    assert model.languages == ["de", "en"]
