"""Quality of documents by co-training on two views.

One classifier sees the text's words, by their shapes, and how they repeat; the
other sees the page around them: source, language, size and layout. Each is
fitted on a bounded sample of labelled documents. In each round both score all
unlabelled documents; those on which a view's calibrated probability is most
extreme, of every source, get its label in the other one's training set. Both are
calibrated on
labelled documents held out from fitting, their log-odds are combined on the
same ones, and all documents are scored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import concatenated, hashed_into, slices, unused
from .minhash import GOLDEN, mix

SHAPES, SOURCES, LANGS = 256, 64, 16
TEXT_WIDTH, PAGE_WIDTH = SHAPES + 4, SOURCES + LANGS + 6
#: labelled documents in the sample, in expectation
LABELLED = 6_000
ROUNDS = 2
#: a pseudo-label needs a calibrated probability so near 0 or 1
CONFIDENT = 0.97
#: documents that a view labels as good, and as bad, for the other one; twice as many in the second round, and so on
PICKED = 300
#: that, where the unlabelled documents are given as arrays, as a share of them
GROWTH = 0.1


def shape_codes(known: list[str]) -> np.ndarray:
    """A bucket for each word's shape: classes of its characters, repeats run together."""
    points = W.letters(known)[:-1]
    kind = W.shapes()[points]
    space = points == W.SPACE
    word = np.cumsum(space) - 1
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    kind, word, space = kind[fresh], word[fresh], space[fresh]
    starts = np.flatnonzero(space)
    place = np.minimum(np.arange(len(kind)) - starts[word], 63).astype(np.uint64)
    with np.errstate(over="ignore"):
        value = np.where(space, np.uint64(0), mix(kind * GOLDEN + place))
        total = np.add.reduceat(value, starts) if len(starts) else np.zeros(0, np.uint64)
        return (mix(total) % np.uint64(SHAPES)).astype(np.int64)


def text_view(texts: list[str]) -> np.ndarray:
    """Per text: roots of the shares of word shapes, words, repetition, length of words, the commonest word."""
    codes, known, at = W.coded([t.split() for t in texts])
    n = len(texts)
    out = np.zeros((n, TEXT_WIDTH), np.float32)
    count = np.diff(at)
    some = np.maximum(count, 1)
    if known:
        owner = np.repeat(np.arange(n), count)
        bucket = shape_codes(known)
        out[:, :SHAPES] = np.sqrt(np.bincount(owner * SHAPES + bucket[codes], minlength=n * SHAPES).reshape(n, -1) / some[:, None])
        pairs, times = np.unique(owner * len(known) + codes, return_counts=True)
        different = np.bincount(pairs // len(known), minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, pairs // len(known), times)
        lengths = np.array([len(w) for w in known])
        out[:, SHAPES] = different / some
        out[:, SHAPES + 1] = most / some
        out[:, SHAPES + 2] = np.log1p(np.bincount(owner, weights=lengths[codes], minlength=n) / some)
    out[:, SHAPES + 3] = np.log1p(count)
    return out


def page_view(texts, sources, langs, sizes) -> np.ndarray:
    """Per text: hashed source and language, stated size and how it differs, lines and their length."""
    out = np.zeros((len(texts), PAGE_WIDTH), np.float32)
    for i, (t, s, g, c) in enumerate(zip(texts, sources, langs, sizes)):
        out[i, zlib.crc32(s.encode()) % SOURCES if s is not None else SOURCES - 1] = 1
        out[i, SOURCES + (zlib.crc32(g.encode()) % LANGS if g is not None else LANGS - 1)] = 1
        lines = t.count("\n") + 1
        size = len(t) if c is None else max(c, 0)
        out[i, -6:] = np.log1p(size), np.log1p(abs(size - len(t))), np.log1p(lines), np.log1p(len(t) / lines), t.count("\n\n") / lines, c is None
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic weights, the last one for the constant, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x.astype(float) @ w[:-1] + w[-1], -30, 30)


def share(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def from_arrays(pool: tuple[np.ndarray, np.ndarray]):
    """What each view labels for the other one, from documents given as features."""

    def exchange(done, turn: int):
        out = []
        for i, (w, c) in enumerate(done):
            p = share(odds(odds(pool[i], w)[:, None], c))
            sure = np.flatnonzero(np.maximum(p, 1 - p) >= CONFIDENT)
            sure = sure[np.argsort(-np.abs(p[sure] - 0.5), kind="stable")][: max(1, int(GROWTH * len(p))) * turn]
            out.append((pool[1 - i][sure], p[sure] >= 0.5))
        return out

    return exchange


def cotrain(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, held: np.ndarray, pool, rounds: int = ROUNDS):
    """(weights, calibration) of each view and the weights of their combination; all arrays.

    ``held`` marks the labelled rows kept for calibration. ``pool`` is a pair of
    arrays of unlabelled documents or a function of the fitted views and the
    round (from 1) that gives, for each view, features for the other view and the
    labels for them.
    """
    exchange = pool if callable(pool) else from_arrays(pool) if len(pool[0]) else None
    extra: list = [None, None]
    done = []
    for turn in range(rounds + 1):
        done = []
        for v, more in zip(views, extra):
            x, t = v[~held], y[~held]
            if more is not None and len(more[0]):
                x, t = np.vstack([x, more[0]]), np.append(t, more[1])
            w = fit(x, t)
            done.append((w, fit(odds(v[held], w)[:, None], y[held], ridge=1e-2)))
        if turn == rounds or exchange is None:
            break
        first, second = exchange(done, turn + 1)
        extra = [second, first]
    both = np.stack([odds(odds(v[held], w)[:, None], c) for v, (w, c) in zip(views, done)], axis=1)
    return done, fit(both, y[held], ridge=1e-2)


META = (("text", "string"), ("source", "string"), ("lang", "string"), ("n_chars", "long"))


def _given(docs: DataFrame) -> list:
    """text, source, lang and n_chars as columns; those that are missing are null."""
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind) for c, kind in META]


def _views(b: pa.RecordBatch, at: int):
    texts = [t or "" for t in b.column(at).to_pylist()]
    return text_view(texts), page_view(texts, *[b.column(at + i).to_pylist() for i in (1, 2, 3)])


def _features(docs: DataFrame, marked: DataFrame) -> pa.Table:
    """doc_id, y and both views of the documents in ``marked`` (doc_id, y), by doc_id.

    ``marked`` is bounded; of several documents with one id the least is taken.
    """
    rows = docs.select("doc_id", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(_given(docs))]).alias("d")).join(marked, "doc_id")
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "y").agg(F.min("d").alias("d")).select("doc_id", "y", "d.*")

    def run(batches):
        for b in (s for whole in batches for s in slices(whole, 2)):
            lists = [pa.array(list(v), pa.list_(pa.float32())) for v in _views(b, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=["doc_id", "y", "x", "z"])

    return rows.mapInArrow(run, "doc_id long, y double, x array<float>, z array<float>").toArrow().sort_by([("doc_id", "ascending")])


def _matrices(got: pa.Table, centre) -> list[np.ndarray]:
    raw = [got.column(c).combine_chunks().flatten().to_numpy().reshape(got.num_rows, width) for c, width in (("x", TEXT_WIDTH), ("z", PAGE_WIDTH))]
    return raw if centre is None else [(v - m) / s for v, (m, s) in zip(raw, centre)]


def _judge(spark: SparkSession, centre, done, combined):
    """A function of text, source, lang and n_chars that gives struct<p_text, p_page, quality_score>.

    Texts go to Python once: it counts as non-deterministic, so that a filter on
    its result is not answered by running it a second time.
    """
    kept = spark.sparkContext.broadcast((centre, done, combined))  # as many numbers as there are features
    names = ["p_text", "p_page", "quality_score"]

    @F.arrow_udf("struct<p_text:double,p_page:double,quality_score:double>")
    def judge(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        centre, done, combined = kept.value
        for columns in batches:
            parts = []
            for b in slices(pa.RecordBatch.from_arrays(list(columns), names=[c for c, _ in META]), 0, 1 << 20):
                views = [(v - m) / s for v, (m, s) in zip(_views(b, 0), centre)]
                both = np.stack([odds(odds(v, w)[:, None], c) for v, (w, c) in zip(views, done)], axis=1)
                p = [share(both[:, 0]), share(both[:, 1]), share(odds(both, combined))]
                parts.append(pa.StructArray.from_arrays([pa.array(x) for x in p], names=names))
            yield concatenated(parts, pa.struct([(n, pa.float64()) for n in names]))

    return judge.asNondeterministic()


def _sure(docs: DataFrame, marks: DataFrame, centre, done, quota: int) -> list:
    """(doc_id, view, y) of unlabelled documents of which a view is surest.

    All unlabelled documents are scored. Of each view and class the surest of
    every source come first; at most ``quota`` rows are returned of either.
    """
    p = F.col("p.p")
    found = docs.where("doc_id IS NOT NULL").select("doc_id", *[c.alias(f"c{i}") for i, c in enumerate(_given(docs))])
    judge = _judge(docs.sparkSession, centre, done, np.zeros(3))
    found = found.select("doc_id", F.col("c1").alias("source"), judge("c0", "c1", "c2", "c3").alias("j"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("view"), F.col(f"j.{c}").alias("p")) for i, c in enumerate(("p_text", "p_page"))]))
    rows = found.select("doc_id", "source", each.alias("p")).where(F.greatest(p, 1 - p) >= CONFIDENT)
    rows = rows.select("doc_id", "source", "p.view", (p >= 0.5).cast("double").alias("y"), F.abs(p - 0.5).alias("far")).join(marks.select("doc_id"), "doc_id", "left_anti")
    order = [F.desc("far"), F.xxhash64("doc_id"), "doc_id"]
    inner = F.row_number().over(Window.partitionBy("view", "y", "source").orderBy(*order))
    rows = rows.withColumn("k", inner).where(F.col("k") <= quota)
    outer = F.row_number().over(Window.partitionBy("view", "y").orderBy("k", *order))
    return rows.withColumn("n", outer).where(F.col("n") <= quota).select("doc_id", "view", "y").distinct().collect()


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, picked: int = PICKED):
    """The fitted model, or None if the sample lacks good or bad documents.

    ``labels`` has doc_id and quality (0 or 1); several of one document count by
    their mean. ``labelled`` bounds the sample of labelled documents, taken by a
    hash of doc_id; ``picked`` the documents that a view labels for the other one
    in a round. Their features reach the driver, no texts do.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    got = _features(docs, marks.where(hashed_into("doc_id", min(1.0, labelled / max(marks.count(), 1)), 23)))
    y = got.column("y").to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return None
    raw = _matrices(got, None)
    centre = [(v.mean(0), v.std(0) + 0.05) for v in raw]
    x, z = _matrices(got, centre)
    with np.errstate(over="ignore"):
        held = (mix(got.column("doc_id").to_numpy().astype(np.uint64) + GOLDEN) % np.uint64(5)) == 0
    t = y
    for side in (held, ~held):
        if not (t[side] == 1).any() or not (t[side] == 0).any():
            held = np.zeros(len(t), bool) if not (t[~held] == 1).any() or not (t[~held] == 0).any() else held
            break
    if not held.any() or len(set(t[held])) < 2:
        # too few labels to hold some out; calibrate on those that were fitted
        views, t, held = (np.vstack([x] * 2), np.vstack([z] * 2)), np.append(t, t), np.arange(2 * len(t)) >= len(t)
    else:
        views = (x, z)

    def exchange(done, turn: int):
        sure = _sure(docs, marks, centre, done, picked * turn)
        if not sure:
            return [(v[:0], np.zeros(0)) for v in (z, x)]
        # of a document that the views see otherwise, both labels count, each for the other view
        ids = docs.sparkSession.createDataFrame(sorted({(r["doc_id"], -1.0) for r in sure}), "doc_id long, y double")
        more = _features(docs, F.broadcast(ids))
        at = {d: i for i, d in enumerate(more.column("doc_id").to_pylist())}
        features = _matrices(more, centre)
        out = []
        for view in (0, 1):
            mine = sorted((at[r["doc_id"]], r["y"]) for r in sure if r["view"] == view)
            out.append((features[1 - view][[i for i, _ in mine]], np.array([t for _, t in mine])))
        return out

    done, combined = cotrain(views, t, held, exchange)
    return centre, done, combined


def score(docs: DataFrame, model, least: float = 0.5) -> DataFrame:
    """``docs`` with p_text, p_page, quality_score (0 to 1) and keep (boolean).

    Null texts count as empty, null columns as missing. Without a model all
    documents are kept with null probabilities. Rows and other columns stay;
    columns named like the new ones are replaced.
    """
    docs = docs.drop("p_text", "p_page", "quality_score", "keep")
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("*", none.alias("p_text"), none.alias("p_page"), none.alias("quality_score"), F.lit(True).alias("keep"))
    found = unused(docs.columns, "_found")
    judged = docs.withColumn(found, _judge(docs.sparkSession, *model)(*_given(docs)))
    names = ["p_text", "p_page", "quality_score"]
    return judged.select(*docs.columns, *[F.col(f"{found}.{c}").alias(c) for c in names], (F.col(f"{found}.quality_score") >= least).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that the fitted classifier keeps.

    Null texts are judged as empty ones, repeated rows are each judged alike; all
    are kept where no model can be fitted. All columns and their values stay as
    they are, whatever their names.
    """
    model = learn(docs, labels)
    if model is None:
        return docs
    found = unused(docs.columns, "_found")
    judged = docs.withColumn(found, _judge(docs.sparkSession, *model)(*_given(docs)))
    return judged.where(F.col(f"{found}.quality_score") >= least).select(*docs.columns)
