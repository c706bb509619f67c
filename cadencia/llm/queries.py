"""The queries of the training-data operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, exact_topk, langid, main_text, minhash, packing, pii, quality, repair_turns, secret_scan, sharding, spans, tokens, vector_codes
from .registry import query, table


@query("op2_bpe")
def op2_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = tokens.decode(tokens.encode(docs).select("doc_id", "ids"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


NEAR_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh FROM w),
one AS (SELECT doc_id, unnest(sh) AS g FROM sh),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN sh a ON a.doc_id = x JOIN sh b ON b.doc_id = y WHERE 100 * n >= 80 * (len(a.sh) + len(b.sh) - n)),
sides AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM sh UNION SELECT reach.doc_id, sides.y FROM reach JOIN sides ON sides.x = reach.r)
SELECT sh.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(r) AS component_id, min(r) = sh.doc_id AS kept
FROM sh JOIN reach USING (doc_id) GROUP BY sh.doc_id, sh"""


@query("op3_minhash", NEAR_SQL)
def op3_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2)


@query("op4_sharding", sharding.placed_sql())
def op4_sharding(spark, sf_dir):
    return sharding.placed(table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6_packing(spark, sf_dir):
    cut = packing.pieces(table(spark, sf_dir, "documents"))
    cut = cut.withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
    return packing.pack(cut, carry=("ids_crc32",))


@query("op7_secrets")
def op7_secrets(spark, sf_dir):
    kinds = [r.kind for r in secret_scan.RULES]
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < secret_scan.BASE)
    return found.select(
        "doc_id",
        *[spans.counted(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(kinds[: secret_scan.BASE])],
        F.sha2(spans.written(base, kinds, by_kind=False), 256).alias("base_sha256"),
        spans.written(F.col("spans"), kinds, by_kind=False).alias("spans"),
    )


@query("op1_pii")
def op1_pii(spark, sf_dir):
    found = pii.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < pii.BASE)
    return found.select(
        "doc_id",
        *[spans.counted(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[: pii.BASE])],
        F.sha2(spans.written(base, pii.KINDS, by_kind=True), 256).alias("base_sha256"),
        spans.written(F.col("spans"), pii.KINDS, by_kind=True).alias("spans"),
    )


@query("op5_ann")
def op5_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


TOP_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""


@query("op9_exact_topk", TOP_SQL)
def op9_exact_topk(spark, sf_dir):
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op8_langid")
def op8_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(~langid.in_training("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_quality")
def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "p_text", "p_page", "quality_score", "keep")


@query("op12_vector_codes", vector_codes.compress_sql())
def op12_vector_codes(spark, sf_dir):
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


@query("op13_repair_turns", repair_turns.repaired_sql())
def op13_repair_turns(spark, sf_dir):
    return repair_turns.repaired(table(spark, sf_dir, "conversations"))


@query("op11_main_text")
def op11_main_text(spark, sf_dir):
    found = main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
