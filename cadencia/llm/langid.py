"""Language of whole texts, and of spans inside mixed ones.

A word is scored by its letter trigrams under each language's smoothed counts.
The word's script narrows the languages to those that use it. Viterbi over the
words of a text, with a penalty for each switch, labels runs of words; the
language of most letters is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import concatenated, hashed_into, slices, unused
from .minhash import GOLDEN, mix

#: trigrams are counted in so many buckets
BUCKETS = 1 << 15
#: nats that a switch of language costs
SWITCH = 10.0
#: a language uses a script if it has such a share of its letters
SHARE = 0.01
#: what a language loses on a word whose script it does not use
FOREIGN = 60.0
UNKNOWN = "und"
# fixed values: first code points of script ranges; what lies between is mixed or Latin
SCRIPTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x4E00, 0xA000, 0xAC00, 0xD7B0]
RANGES = np.array(SCRIPTS)


class Model(NamedTuple):
    """Languages by name, log-probabilities (bucket, language), and scripts (range, language)."""

    languages: list[str]
    scores: np.ndarray
    uses: np.ndarray


def split(texts) -> list[list[str]]:
    return [(t or "").lower().split() for t in texts]


def trigrams(known: list[str]):
    """Buckets of the letter trigrams of the words, the word of each, and letters and script per word."""
    points = W.letters(known)
    points = points[(points == W.SPACE) | W.alphabetic()[points]]
    inner = np.flatnonzero(points != W.SPACE)
    word = np.cumsum(points == W.SPACE)[inner] - 1
    p = points.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = mix(p[inner - 1] * GOLDEN + p[inner] * np.uint64(0xC2B2AE3D27D4EB4F) + p[inner + 1] * np.uint64(0x165667B19E3779F9))
    count = np.bincount(word, minlength=len(known))
    script = np.zeros(len(known), np.int64)
    script[word[::-1]] = np.searchsorted(RANGES, points[inner][::-1], side="right") - 1  # the first letter's
    return (h % np.uint64(BUCKETS)).astype(np.int64), word, count, script


def in_training(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = 100_000) -> Model:
    """The model of documents with a language whose id hashes into the training part.

    Of these, ``most`` in expectation are used, an equal number of each language
    that has as many, all of a rarer one, by a hash of the id; their whole texts
    are counted. Counts are summed in Spark, and at most ``BUCKETS`` and the
    script ranges per language reach the driver.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & in_training(doc_id))
    sizes = {r["_lang"]: r["_n"] for r in known.groupBy(F.col(lang).cast("string").alias("_lang")).agg(F.count(F.lit(1)).alias("_n")).collect()}
    each = most / max(len(sizes), 1)
    common = {name: each / n for name, n in sizes.items() if n > each}
    if common:
        taken = F.lit(True)
        for name, share in common.items():
            taken = F.when(F.col(lang).cast("string") == name, hashed_into(doc_id, share, 5)).otherwise(taken)
        known = known.where(taken)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in (part for whole in batches for part in slices(whole, 0)):
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            codes, vocab, at = W.coded(split(b.column(0).to_pylist()))
            if not vocab:
                continue
            bucket, word, count, script = trigrams(vocab)
            owner = np.repeat(np.arange(len(langs)), np.diff(at))
            for name in sorted(set(langs)):
                times = np.bincount(codes[(langs == name)[owner]], minlength=len(vocab)).astype(float)
                own = sums.setdefault(name, np.zeros(BUCKETS + len(RANGES)))
                own[:BUCKETS] += np.bincount(bucket, weights=times[word], minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(script, weights=times * count, minlength=len(RANGES))
        for name, own in sums.items():
            where = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(where), pa.string()), pa.array(where, pa.int64()), pa.array(own[where])], names=["lang", "at", "n"])

    rows = known.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(run, "lang string, at long, n double")
    summed = rows.groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(summed.column("lang").to_pylist(), dtype=object)
    at, n = summed.column("at").to_numpy(), summed.column("n").to_numpy()
    languages = sorted(set(names))
    table = np.zeros((BUCKETS + len(RANGES), len(languages)))
    for i, name in enumerate(languages):
        table[at[names == name], i] = n[names == name]
    grams, scripts = table[:BUCKETS] + 0.5, table[BUCKETS:]
    uses = scripts >= SHARE * np.maximum(scripts.sum(0), 1)
    uses[~uses.any(1)] = True  # a script that nobody uses narrows nothing
    return Model(languages, np.log(grams / grams.sum(0)).astype(np.float32), uses)


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; ``at`` says where each text's words begin.

    Texts advance together, the longest first, so a step is one operation for
    all that still have words.
    """
    n, width = scores.shape
    labels = np.zeros(n, np.int64)
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = at[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with more than t words
    best = np.zeros((len(starts), width), np.float32)
    moved = np.zeros((n, width), bool)
    source = np.zeros(n, np.int64)
    for t in range(longest):
        a = alive[t]
        at_t = starts[:a] + t
        if t == 0:
            best[:a] = scores[at_t]
            continue
        b = best[:a]
        top = b.argmax(1)
        high = b[np.arange(a), top][:, None] - np.float32(switch)
        source[at_t] = top
        moved[at_t] = high > b
        best[:a] = np.maximum(b, high) + scores[at_t]
    now = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = alive[t]
        at_t = starts[:a] + t
        labels[at_t] = now[:a]
        if t:
            now[:a] = np.where(moved[at_t, now[:a]], source[at_t], now[:a])
    return labels


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ``spans`` array<struct<word, words, lang>>.

    ``score`` is the share of letters in lang_pred; spans count words that have
    a letter. Texts that are null or have no letter are ``und`` with score 0 and
    no spans, and so are all if no language was learned. Rows and other columns
    stay; columns named like the new ones are replaced.
    """
    docs = docs.drop(*[c for c in ("lang_pred", "score", "spans") if c != text])
    found = unused(docs.columns, "_found")
    with_found = docs.withColumn(found, labeller(docs.sparkSession, model)(F.col(text).cast("string")))
    return with_found.select(*docs.columns, *[F.col(f"{found}.{c}").alias(c) for c in ("lang_pred", "score", "spans")])


def labeller(spark: SparkSession, model: Model):
    """A function of a text column that gives struct<lang_pred, score, spans>.

    Only texts go to Python, and only once: it counts as non-deterministic, so
    that a filter on its result is not answered by running it a second time.
    """
    kept = spark.sparkContext.broadcast(tuple(model))  # BUCKETS x languages numbers
    arrow_span = pa.struct([("word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])
    arrow_found = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(arrow_span))])

    def label(texts):
        names, table, uses = kept.value
        codes, vocab, at = W.coded(split(texts))
        n = len(texts)
        if not vocab or not names:
            return [UNKNOWN] * n, [0.0] * n, pa.array([[]] * n, pa.list_(arrow_span))
        bucket, word, count, script = trigrams(vocab)
        each = np.stack([np.bincount(word, weights=table[bucket, i], minlength=len(vocab)) for i in range(len(names))], axis=1)
        each = (each - np.where(uses[script], 0, FOREIGN)).astype(np.float32)
        some = count[codes] > 0
        codes = codes[some]
        at = np.concatenate([[0], np.cumsum(some)])[at]
        labels = viterbi(each[codes], at)
        owner = np.repeat(np.arange(n), np.diff(at))
        weight = np.bincount(owner * len(names) + labels, weights=count[codes], minlength=n * len(names)).reshape(n, -1)
        total = weight.sum(1)
        won = weight.argmax(1)
        pred = [names[w] if t else UNKNOWN for w, t in zip(won, total)]
        score = np.where(total > 0, weight.max(1) / np.maximum(total, 1), 0.0)
        begins = np.ones(len(labels), bool)
        begins[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(begins)
        runs = pa.StructArray.from_arrays(
            [pa.array((first - at[owner[first]]).astype(np.int32)), pa.array(np.diff(np.append(first, len(labels))).astype(np.int32)), pa.array([names[i] for i in labels[first]], pa.string())],
            fields=list(arrow_span),
        )
        edges = np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32)
        return pred, score, pa.ListArray.from_arrays(pa.array(edges), runs)

    @F.arrow_udf("struct<lang_pred:string,score:double,spans:array<struct<word:int,words:int,lang:string>>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for b in slices(pa.RecordBatch.from_arrays([texts], ["t"]), 0):
                pred, score, spans = label(b.column(0).to_pylist())
                parts.append(pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), spans], fields=list(arrow_found)))
            yield concatenated(parts, arrow_found)

    return found.asNondeterministic()


def accepted(docs: DataFrame, least: float = 1 / 3) -> DataFrame:
    """The documents whose text has a language, one of at least ``least`` of its letters.

    Null and empty texts and those without letters are rejected, repeated rows
    are each judged alike, an empty table stays empty; all columns and their
    values stay as they are, whatever their names.
    """
    found = unused(docs.columns, "_found")
    judged = docs.withColumn(found, labeller(docs.sparkSession, learn(docs))(F.col("text").cast("string")))
    return judged.where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= least)).select(*docs.columns)
