"""Information-theoretic sanitisation of personal data, native expressions only.

Patterns find the protected entities. Over all documents, a term that shares a
text with an entity is weighed by the share of the entity's information that it gives away:
PMI(term; entity) / IC(entity), with PMI = ln(n both / (n term * n entity)) and
IC = ln(n / n entity), counted in documents. Terms at or above ``remove`` of it
are removed, those at or above ``generalise`` are replaced by what kind of word
they are, wherever they stand in a text that holds the entity. A document
without an entity is never changed. An entity in too few texts for an estimate
is weighed as its class (domain of the address, first digits of the number), or
as its kind if its class is in too few as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import spans as S
from .common import stored
from .secret_scan import keyed

# fixed values: the patterns of the contract, with possessive quantifiers where
# giving characters back could not lead to a match. A run of mail characters
# can only match from its start or from the end of the previous match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: the entities, then what the method adds
KINDS = ["email", "ip", "card", "phone", "remove", "generalise"]
BASE = 4
REMOVE, GENERALISE = 4, 5
LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]
#: digits that make the class of a card, its issuer, and of a phone, country and area
CARD_PREFIX, PHONE_PREFIX = 6, 5
#: terms are runs of letters or digits
TERM = r"[\p{L}\p{N}]++"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass Luhn's check."""

    def step(total, i):
        d = F.substr(number, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def _card(hit: Column) -> Column:
    return S.let(digits(hit), lambda n: F.when(F.length(n).between(13, 19), luhn(n)).otherwise(F.lit(False)))


def base_spans(text: Column) -> Column:
    """array<SPAN> of the protected entities of a text, each kind on its own."""
    found = [
        F.when(F.contains(text, F.lit("@")), S.matches(text, EMAIL, 0)),
        S.matches(text, IP, 1, lambda h: h.rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        S.matches(text, CARD, 2, _card),
        F.when(F.contains(text, F.lit("+")), S.matches(text, PHONE, 3, lambda h: F.length(digits(h)).between(9, 15))),
    ]
    return F.concat(*[F.coalesce(x, S.no_spans()) for x in found])


def masked(text: Column, then, patterns: tuple[str, ...] = (EMAIL, IP, PHONE, CARD)) -> Column:
    """``then`` of the text with all that looks like an entity blanked, places kept."""
    if not patterns:
        return then(text)

    def blank(t, hits):
        gaps = F.split(t, patterns[0], -1)
        return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(F.repeat(F.lit(" "), F.length(h)), F.lit("")))), "")

    hits = F.regexp_extract_all(text, F.lit(patterns[0]), F.lit(0))
    return S.let(blank(text, hits), lambda t: masked(t, then, patterns[1:]))


def term_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def class_of(kind: Column, hit: Column) -> Column:
    """What an entity has in common with others: mail domain, first two parts of an IP, first digits."""
    return (
        F.when(kind == 0, F.substring_index(hit, "@", -1))
        .when(kind == 1, F.substring_index(hit, ".", 2))
        .when(kind == 2, F.substring(digits(hit), 1, CARD_PREFIX))
        .otherwise(F.substring(digits(hit), 1, PHONE_PREFIX))
    )


def entities(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, k1, k2, spans, ents, terms of every document, stored.

    ``ents`` holds the distinct entities of a document as hashes of value, class
    and kind, ``terms`` the distinct hashes of the terms outside of them. ``masked`` is its text without entities, kept
    where there are any.
    """
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    t = F.col("_text")

    def ent(s):
        hit = F.lower(F.substr(t, s["start"] + 1, s["end"] - s["start"]))
        levels = [F.xxhash64(F.lit(0), s["kind"], hit), F.xxhash64(F.lit(1), s["kind"], class_of(s["kind"], hit)), F.xxhash64(F.lit(2), s["kind"])]
        return F.struct(*[x.alias(c) for x, c in zip(levels, ("value", "class", "kind"))])

    both = S.let(base_spans(t), lambda s: F.struct(s.alias("spans"), F.array_distinct(F.transform(s, ent)).alias("ents")))
    words = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("masked", F.lit(TERM), F.lit(0))), term_hash))
    found = body.select("doc_id", *keyed(t), both.alias("both"), masked(t, lambda m: m).alias("masked"))
    kept = F.when(F.size("both.ents") > 0, F.col("masked")).alias("masked")
    return stored(found.select("doc_id", "k1", "k2", "both.spans", "both.ents", words.alias("terms"), kept))


def disclosing(found: DataFrame, support: int, remove: float, generalise: float) -> DataFrame:
    """(k1, k2, more): the added spans of each text that has any.

    A term and an entity meet where one text holds both, however far apart, and
    must do so in ``support`` different texts at least, as fewer are no estimate.
    An entity is weighed at the narrowest level, value, class or kind, that
    stands in so many texts.
    """
    # equal texts are one, with the number of their rows
    firsts = [F.first(c).alias(c) for c in ("ents", "terms", "masked")]
    texts = stored(found.where(F.size("ents") > 0).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"), *firsts))
    levels = F.array_distinct(F.flatten(F.transform("ents", lambda e: F.array(e["value"], e["class"], e["kind"]))))
    held = texts.select("rows", F.explode(levels).alias("ent")).groupBy("ent")
    held = stored(held.agg(F.sum("rows").alias("n_ent"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).drop("texts"))
    # a kind needs no look-up here: one in too few texts meets no term often enough
    ents = texts.select("k1", "k2", F.inline("ents"))
    for c in ("value", "class"):
        ents = ents.join(held.select(F.col("ent").alias(c), F.col("ent").alias(f"_{c}")), c, "left")
    met = F.array_compact(F.array("_value", "_class", "kind"))
    used = ents.groupBy("k1", "k2").agg(F.collect_set(met).alias("met"), F.collect_set(met[0]).alias("ents"))
    texts = stored(texts.drop("ents").join(used, ["k1", "k2"]).withColumn("met", F.array_distinct(F.flatten("met"))))
    # a level is counted in all texts that hold it, and applied where it is the narrowest
    pairs = texts.select("rows", "terms", F.explode("met").alias("ent")).select("rows", "ent", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("ent", "term").agg(F.sum("rows").alias("both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    # all terms are counted, and only counts are joined: how many rows pass a join
    # with the terms in question would grow faster than the corpus
    terms = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n = found.agg(F.count(F.lit(1)).alias("n_docs"))
    weighed = pairs.join(held, "ent").join(terms, "term").withColumn("n_docs", F.lit(n.first()["n_docs"]))
    share = F.log(F.col("both") * F.col("n_docs") / (F.col("n_term") * F.col("n_ent"))) / F.log(F.col("n_docs") / F.col("n_ent"))
    share = F.when(F.col("n_ent") < F.col("n_docs"), share).otherwise(0.0)
    level = F.when(share >= remove, REMOVE).when(share >= generalise, GENERALISE)
    flagged = cut_lineage(weighed.select("ent", "term", level.alias("kind")).where("kind IS NOT NULL"))
    said = texts.select("k1", "k2", "terms", F.explode("ents").alias("ent")).select("k1", "k2", "ent", F.explode("terms").alias("term"))
    hits = stored(said.join(flagged, ["ent", "term"]).groupBy("k1", "k2", "term").agg(F.min("kind").alias("kind")))
    # each place of a flagged term in the whole text
    words = F.regexp_extract_all("masked", F.lit(TERM), F.lit(0))
    place = F.zip_with(S.matches(F.col("masked"), TERM, 0), words, lambda m, w: F.struct(term_hash(w).alias("term"), m["start"].alias("start"), m["end"].alias("end")))
    places = texts.join(hits.select("k1", "k2").distinct(), ["k1", "k2"]).select("k1", "k2", F.explode(place).alias("x")).select("k1", "k2", "x.*")
    span = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    more = places.join(hits, ["k1", "k2", "term"]).groupBy("k1", "k2").agg(F.collect_list(span).cast(f"array<{S.SPAN}>").alias("more"))
    return stored(more)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = 3, remove: float = 0.9, generalise: float = 0.75) -> DataFrame:
    """doc_id and ``spans`` array<struct<start, kind, end>> of every document.

    ``kind`` is the place in KINDS, places count code points. Null texts count
    as empty, repeated rows each get their spans. Other columns are dropped; no
    rows give none.
    """
    found = entities(docs, doc_id, text)
    more = disclosing(found, support, remove, generalise)
    done = found.select("doc_id", "k1", "k2", "spans").join(more, ["k1", "k2"], "left")
    return done.select("doc_id", F.array_sort(F.concat("spans", F.coalesce("more", S.no_spans()))).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its label; spans that overlap become one."""
    labels = F.array(*[F.lit(x) for x in LABELS])

    def shape(word):
        return F.when(word.rlike(r"^\p{N}+$"), "[NUMBER]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")

    def step(acc, x):
        word = F.substr(text, x["start"] + 1, x["end"] - x["start"])
        label = F.when(x["kind"] < BASE, labels[x["kind"]]).when(x["kind"] == REMOVE, "").otherwise(shape(word))
        before = F.substr(text, acc["pos"] + 1, x["start"] - acc["pos"])
        more = F.when(x["start"] >= acc["pos"], F.concat(acc["out"], F.array(before, label))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), more.alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.array_sort(spans), zero, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substr(text, acc["pos"] + 1))), ""))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = 3, remove: float = 0.9, generalise: float = 0.75) -> DataFrame:
    """``docs`` with entities and disclosing terms of ``text`` replaced.

    All rows stay, and so do the other columns and their values, whatever their
    names. Null texts stay null, empty ones empty; repeated rows count as many
    times and are changed alike; an empty table stays empty.
    """
    found = entities(docs, doc_id, text)
    more = disclosing(found, support, remove, generalise).withColumnsRenamed({"k1": "_k1", "k2": "_k2", "more": "_more"})
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")  # apart from the columns added here
    k1, k2 = keyed(F.coalesce(F.col(text).cast("string"), F.lit("")))
    joined = docs.select(own, k1.alias("_h1"), k2.alias("_h2")).join(more, (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2")), "left")
    given = F.col("_row").getField(text).cast("string")
    every = F.concat(base_spans(F.coalesce(given, F.lit(""))), F.coalesce("_more", S.no_spans()))
    clean = S.let(every, lambda spans: replaced(given, spans))
    return joined.select(*[(clean if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns])
