"""Secret scans through a trigram inverted index, with native expressions only.

Each rule's pattern yields a Boolean query of trigrams that any match must hold.
One pass over the texts writes the postings of those trigrams; intersecting them
gives the candidates of each rule, and only candidates are verified with the
pattern. Rules without mandatory trigrams scan every text in the first pass.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import stored

#: a trigram query with more alternatives than this asks for less instead
MAX_ALTERNATIVES = 64
#: a character class of more letters than this is no literal
MAX_CLASS = 8


class Rule(NamedTuple):
    """A kind of secret. ``keep`` drops matched strings that don't count."""

    kind: str
    pattern: str
    keep: Callable[[Column], Column] | None = None


# fixed values: the patterns of the contract, with possessive quantifiers where
# giving characters back could not lead to a match
KEYWORDS = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = KEYWORDS + r"""["']?+\x20*+[:=]\x20*+["']?+[A-Za-z0-9+/_.=-]++"""
ASSIGN_HEAD = "^" + KEYWORDS + r"""["']?+\x20*+[:=]\x20*+["']?+"""

RULES = [
    Rule("assign", ASSIGN, lambda hit: F.length(F.regexp_replace(hit, ASSIGN_HEAD, "")) >= 6),
    Rule("access", r"AKIA[A-Z0-9]++", lambda hit: F.length(hit) >= 20),
    # maximal runs of 24 and more, as shorter ones are dropped
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("forge_token", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat_token", r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("payment_key", r"(?<![A-Za-z0-9_])[rs]k_live_[A-Za-z0-9]{20,}+"),
]
#: kinds that the base columns of the query count
BASE = 3


def alternatives(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams; a match holds all of at least one set.

    None if a match need not hold any trigram.
    """
    from re import _parser as parser

    def cross(xs, ys):
        return None if xs is None or ys is None or len(xs) * len(ys) > MAX_ALTERNATIVES else [x + y for x in xs for y in ys]

    def grams(words):
        """What must hold if one of these literals does."""
        sets = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words}
        return [frozenset()] if frozenset() in sets else sorted(sets, key=sorted)

    def both(a, b):
        return [x | y for x, y in product(a, b)] if len(a) * len(b) <= MAX_ALTERNATIVES else min(a, b, key=len)

    def walk(items):
        """(literals or None, query) of a sequence of parsed items."""
        run, query, exact = [""], [frozenset()], True
        for op, arg in items:
            words, inner = one(str(op), arg)
            joined = cross(run, words)
            if joined is None:
                query, exact = both(query, grams(run)), False
                run = [""] if words is None else words
                query = both(query, inner) if words is None else query
            else:
                run = joined
        return (run if exact else None), both(query, grams(run))

    def one(op, arg):
        if op == "LITERAL":
            return [chr(arg).lower()], [frozenset()]
        if op == "IN":
            letters = {chr(v).lower() if str(o) == "LITERAL" else None for o, v in arg}
            return (sorted(letters) if None not in letters and len(letters) <= MAX_CLASS else None), [frozenset()]
        if op == "SUBPATTERN":
            return walk(arg[3])
        if op == "ATOMIC_GROUP":
            return walk(arg)
        if op == "BRANCH":
            each = [walk(x) for x in arg[1]]
            words = None if any(w is None for w, _ in each) else [x for w, _ in each for x in w]
            return words, [q for _, inner in each for q in inner]
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = arg
            words, inner = walk(body)
            if (least, most) == (0, 1) and words is not None:
                return ["", *words], [frozenset()]
            return (words if (least, most) == (1, 1) else None), inner if least else [frozenset()]
        if op in ("AT", "ASSERT", "ASSERT_NOT"):
            return [""], [frozenset()]
        return None, [frozenset()]

    found = walk(parser.parse(pattern))[1]
    found = [a for a in found if not any(b < a for b in found)]
    return None if frozenset() in found else found


def keyed(text: Column) -> tuple[Column, Column]:
    """128 bits of hash of a text."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(11), text).alias("k2")


def scan(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ``spans`` array<struct<start, kind, end>> of every document.

    ``kind`` is the rule's place in ``rules``, places count code points. Null
    texts count as empty, repeated rows each get their spans. Other columns are
    dropped; no rows give none.
    """
    spark = docs.sparkSession
    queries = {i: alternatives(r.pattern) for i, r in enumerate(rules)}
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    asked = [(i, j, g, len(alt)) for i, alts in queries.items() if alts for j, alt in enumerate(alts) for g in sorted(alt)]
    grams = sorted({g for _, _, g, _ in asked})
    full = [S.matches(F.col("_text"), r.pattern, i, r.keep) for i, r in enumerate(rules) if queries[i] is None]

    folded = F.lower("_text")
    held = F.filter(F.array(*[F.lit(g) for g in grams]).cast("array<string>"), lambda g: F.contains(folded, g))
    first = body.select("doc_id", *keyed(F.col("_text")), F.concat(S.no_spans(), *full).alias("spans"), held.alias("grams"))
    first = stored(first)

    postings = first.select("k1", "k2", F.explode("grams").alias("gram")).distinct()
    # as many rows as the rules have trigrams
    wanted = F.broadcast(spark.createDataFrame(asked, "rule int, alternative int, gram string, of long"))
    met = postings.join(wanted, "gram").groupBy("k1", "k2", "rule", "alternative", "of").agg(F.count(F.lit(1)).alias("n"))
    candidates = met.where("n = of").groupBy("k1", "k2").agg(F.collect_set("rule").alias("rules"))  # at most all rules
    candidates = stored(candidates)

    texts = body.select("_text", *keyed(F.col("_text"))).join(candidates, ["k1", "k2"])
    checked = [F.when(F.array_contains("rules", i), S.matches(F.col("_text"), r.pattern, i, r.keep)).otherwise(S.no_spans()) for i, r in enumerate(rules) if queries[i]]
    verified = texts.select("k1", "k2", F.concat(S.no_spans(), *checked).alias("more")).where(F.size("more") > 0)
    verified = stored(verified.groupBy("k1", "k2").agg(F.first("more").alias("more")))
    done = first.drop("grams").join(verified, ["k1", "k2"], "left")
    return done.select("doc_id", F.array_sort(F.concat("spans", F.coalesce("more", S.no_spans()))).alias("spans"))
