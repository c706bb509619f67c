"""Byte-pair encoding and decoding of whole texts, long ones by tree concatenation.

A text is cut only where the vocabulary's splitting pattern always ends a piece,
so equal words of a batch are merged once. Texts above ``leaf_chars`` are halved
into leaves that are encoded in parallel rows and then joined in a tree: around
each join a window is encoded anew and grows until its edges lie on boundaries
that the encodings of both sides share.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import process_cache, slices

# fixed value: the splitting pattern of the vocabulary, in an equivalent possessive form
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: a single space before white space or the end: cutting there could change pieces
UNSAFE = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
#: places where every splitting of a text has a boundary, whatever lies farther off
SAFE = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)"


def default_vocabulary() -> str:
    """Path of the public vocabulary; callers may pass any other of its format."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary; encodes and decodes batches of texts."""

    def __init__(self, content: str):
        import regex
        import tiktoken

        spec = json.loads(content)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.text = tiktoken.Encoding("text", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self._piece = None
        size = max([*self.ranks.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for b, i in self.ranks.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.safe = regex.compile(SAFE)
        self.odd = "|".join([UNSAFE, *map(re.escape, self.special)])

    def piece(self, text: str) -> list[int]:
        """Ids of a text that is one piece; made when first asked for, as few texts need it."""
        if self._piece is None:
            import tiktoken

            self._piece = tiktoken.Encoding("piece", pat_str=r"(?s:.)+", mergeable_ranks=self.ranks, special_tokens={})
        return self._piece.encode_ordinary(text)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.text.encode(text, allowed_special=set(self.special)), dtype=np.uint32)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.text.encode_ordinary(text), dtype=np.uint32)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's begin."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        ids, starts = self._worded(texts.filter(pa.array(~odd)))
        if not odd.any():
            return ids, starts
        parts, j = [], 0
        for i, o in enumerate(odd):
            if o:
                parts.append(self.whole(texts[i].as_py()))
            else:
                parts.append(ids[starts[j] : starts[j + 1]])
                j += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def _worded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts in which every space is followed by a character other than white space."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        words = pc.split_pattern(texts, " ")
        at = words.offsets.to_numpy().astype(np.int64)
        at, flat = at - at[0], words.flatten()
        firsts = [self.plain(t) for t in flat.take(pa.array(at[:-1])).to_pylist()]
        coded = pc.dictionary_encode(flat)
        known = coded.dictionary
        pool = self.plain(" " + " ".join(known.to_pylist()))
        ends = np.cumsum(pc.binary_length(known).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        reach = np.cumsum(self.lengths[pool])
        stop = np.searchsorted(reach, ends) + 1
        if not np.array_equal(reach[stop - 1], ends):
            raise AssertionError("a word was not encoded apart from its neighbours")
        begin = np.concatenate([[0], stop[:-1]])
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        start, length = begin[codes], (stop - begin)[codes]
        first_len = np.array([len(f) for f in firsts], dtype=np.int64)
        start[at[:-1]] = len(pool) + np.cumsum(first_len) - first_len
        length[at[:-1]] = first_len
        pool = np.concatenate([pool, *firsts])
        done = np.concatenate([[0], np.cumsum(length)])
        index = np.repeat(start - done[:-1], length)
        index += np.arange(done[-1])
        return pool[index], done[at]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def merged(self, data: bytes) -> list[int]:
        """Merges of a short run of bytes, lowest rank first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            i = int(np.argmin(rank))
            if rank[i] == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the two ids may follow one another inside a piece.

        A sequence of ids is the encoding of its bytes exactly if this holds for
        every two that are adjacent.
        """
        return self.merged(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, a: tuple[str, np.ndarray], b: tuple[str, np.ndarray], reach: int = 256) -> tuple[str, np.ndarray]:
        """Encoding of two adjacent texts from the encodings of both."""
        (left, x), (right, y) = a, b
        if not left or not right:
            return left + right, np.concatenate([x, y])
        text = left + right
        wide = max(map(len, self.special), default=0)
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            around = left[max(0, i - 1 - wide) :] + right[: j + 1 + wide]
            if any(s in around for s in self.special):
                return text, self.whole(text)  # a special token has boundaries of its own
            # one more character on each outer side, which the pattern may look at
            seen_l, seen_r = left[max(0, i - 1) :], right[: j + 1]
            skip = 1 if i > 0 else 0
            marks = [m.start() for m in self.safe.finditer(seen_l) if skip <= m.start() < len(seen_l)]
            lo = 0 if i == 0 else (max(0, i - 1) + marks[0] if marks else None)
            marks = [m.start() for m in self.safe.finditer(seen_r) if 0 < m.start() <= j]
            hi = len(right) if j == len(right) else (marks[-1] if marks else None)
            if lo is not None and hi is not None:
                break
            if (ids := self._inside(left, x, right, y, reach)) is not None:
                return text, ids
            reach *= 2
        keep = self._count(x[::-1], len(left[lo:].encode()))
        drop = self._count(y, len(right[:hi].encode()))
        window = self.whole(left[lo:] + right[:hi])
        return text, np.concatenate([x[: len(x) - keep], window, y[drop:]])

    def _count(self, ids: np.ndarray, size: int) -> int:
        """How many of the ids make up exactly ``size`` bytes."""
        reach = np.cumsum(self.lengths[ids])
        k = int(np.searchsorted(reach, size)) + 1 if size else 0
        if size and (k > len(reach) or reach[k - 1] != size):
            raise AssertionError("a boundary is no boundary of ids")
        return k

    def _inside(self, left, x, right, y, reach) -> np.ndarray | None:
        """A join inside one long run of letters: windows of ids that fit both sides."""
        near = left[-reach:] + right[:reach]
        if not near.isalpha() or any(ord(c) < 128 and not c.isalpha() for c in near):
            return None
        for w in (8, 16, 32, 64):
            if len(x) <= w or len(y) <= w or self.lengths[x[-w - 1 :]].sum() > len(left[-reach:].encode()) or self.lengths[y[: w + 1]].sum() > len(right[:reach].encode()):
                return None
            data = b"".join(self.bytes[i] for i in (*x[-w:], *y[:w]))
            try:
                ids = self.piece(data.decode())
            except UnicodeDecodeError:
                continue
            if self.neighbours(int(x[-w - 1]), ids[0]) and self.neighbours(ids[-1], int(y[w])):
                return np.concatenate([x[:-w], np.array(ids, np.uint32), y[w:]])
        return None


def codec(content: str) -> Codec:
    """The codec of a vocabulary file's content, made once in a process."""
    kept = process_cache().setdefault("codecs", {})
    key = hash(content)
    if key not in kept:
        kept[key] = Codec(content)
    return kept[key]


def vocabulary(df: DataFrame, path: str | None):
    """The vocabulary file as a broadcast: of fixed size, read on the driver."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def halves(text: str, leaf_chars: int) -> list[str]:
    """Leaves of a text that is halved until no part is longer than ``leaf_chars``."""
    done, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf_chars:
            done.append(text[a:b])
        else:
            m = (a + b) // 2
            todo += [(m, b), (a, m)]
    return done


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, leaf_chars: int = 1 << 16) -> DataFrame:
    """``docs`` with ``out`` array<int>, the ids of the whole text.

    Every row stays, repeated ones too; null and empty texts get no ids. Other
    columns pass through, and one that is named ``out`` is replaced. Strings of
    special tokens in a text become their ids.
    """
    docs = docs.drop(out) if out in docs.columns and out != text else docs
    vocab = vocabulary(docs, path)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    where = docs.columns.index(text)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab.value)
        for b in (part for whole in batches for part in slices(whole, where)):
            ids, at = c.batch(b.column(where))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, out])

    size = F.coalesce(F.length(text), F.lit(0))
    few = docs.where(size <= leaf_chars).mapInArrow(short, schema)
    many = docs.where(size > leaf_chars).withColumn("_text_key", F.sha2(F.col(text).cast("string"), 256))
    joined = tree_encoded(many.select("_text_key", F.col(text).cast("string").alias("_text")), vocab, leaf_chars)
    many = many.join(joined.withColumnRenamed("ids", "_long_ids"), "_text_key").drop("_text_key")
    return few.unionByName(many.withColumnRenamed("_long_ids", out))


def tree_encoded(texts: DataFrame, vocab, leaf_chars: int) -> DataFrame:
    """(_text_key, _text) rows as one (_text_key, ids) row per text."""
    texts = texts.groupBy("_text_key").agg(F.first("_text").alias("_text"))

    def cut(batches):
        for b in batches:
            for key, text in zip(b.column("_text_key").to_pylist(), b.column("_text").to_pylist()):
                for i, part in enumerate(halves(text, leaf_chars)):
                    yield pa.RecordBatch.from_pydict({"_text_key": [key], "leaf": pa.array([i], pa.int32()), "part": [part]})

    def leaf(batches):
        c = codec(vocab.value)
        for b in batches:
            parts = b.column("part").to_pylist()
            got = [c.whole(p).astype(np.int32) for p in parts]
            yield pa.RecordBatch.from_pydict({"_text_key": b.column("_text_key"), "leaf": b.column("leaf"), "part": b.column("part"), "ids": pa.array(got, pa.list_(pa.int32()))})

    def grow(key, pdf):
        import pandas as pd

        c = codec(vocab.value)
        level = [(p, np.asarray(i, dtype=np.uint32)) for _, p, i in sorted(zip(pdf["leaf"], pdf["part"], pdf["ids"]), key=lambda r: r[0])]
        while len(level) > 1:
            level = [c.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return pd.DataFrame({"_text_key": [key[0]], "ids": [level[0][1].astype(np.int32)]})

    leaves = texts.mapInArrow(cut, "_text_key string, leaf int, part string").repartition(F.col("_text_key"), F.col("leaf"))
    leaves = leaves.mapInArrow(leaf, "_text_key string, leaf int, part string, ids array<int>")
    return leaves.groupBy("_text_key").applyInPandas(grow, "_text_key string, ids array<int>")


def decode(coded: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``coded`` with ``out`` string, the text of the ids, special tokens included.

    Null ids give an empty text; bytes that are no UTF-8 become U+FFFD.
    """
    coded = coded.drop(out) if out in coded.columns and out != ids else coded
    vocab = vocabulary(coded, path)
    schema = T.StructType([*coded.schema.fields, T.StructField(out, T.StringType())])
    where = coded.columns.index(ids)

    def run(batches):
        c = codec(vocab.value)
        for b in batches:
            col = b.column(where)
            at = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False)
            texts = [c.decode(flat[i:j].tolist()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return coded.mapInArrow(run, schema)
