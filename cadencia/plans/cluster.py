"""Clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import cluster as C
from ..operators import pairwise as P
from ..session import cut_lineage
from .registry import query, r6, r6s

D_SQL = """e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
pr AS (SELECT a.id, a.label, b.label AS other, b.id AS id2, list_distance(a.w, b.w) AS d FROM e a JOIN e b ON a.id <> b.id),
cs AS (SELECT id, label, other, count(*) AS n, sum(d) AS total, min(d) AS low, max(d) AS high FROM pr GROUP BY id, label, other)"""


def labelled(spark, d):
    return A.waves(spark, d).select("sample_id", F.col("cluster").alias("label"), "wave")


def _l2(spark, d):
    return P.cluster_sums(labelled(spark, d), "euclidean")


@query("l2_cluster_stats", f"WITH {D_SQL} SELECT id AS sample_id, label, other, n, {r6s('total / n')} AS mean, {r6s('low')} AS low, {r6s('high')} AS high FROM cs")
def l2_cluster_stats(spark, d):
    return _l2(spark, d).select("sample_id", "label", "other", "n", r6(F.col("total") / F.col("n")).alias("mean"), r6("low").alias("low"), r6("high").alias("high"))


SIL_SQL = f"""{D_SQL}, ab AS (SELECT id, label, max(CASE WHEN other = label THEN total / n END) AS a, min(CASE WHEN other <> label THEN total / n END) AS b FROM cs GROUP BY id, label),
sl AS (SELECT id, label, a, b, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query("silhouette", f"WITH {SIL_SQL} SELECT id AS sample_id, label, {r6s('a')} AS a, {r6s('b')} AS b, {r6s('s')} AS s FROM sl")
def silhouette(spark, d):
    s = C.silhouette(_l2(spark, d))
    return s.select("sample_id", "label", r6("a").alias("a"), r6("b").alias("b"), r6("s").alias("s"))


MED_SQL = f"""{D_SQL}, mm AS (SELECT id, label, sum(CASE WHEN other = label THEN total END) AS t, sum(CASE WHEN other = label THEN n END) AS n FROM cs GROUP BY id, label),
md AS (SELECT label, arg_min(id, (round(coalesce(t, 0) / (coalesce(n, 0) + 1), 12), id)) AS medoid, min(coalesce(t, 0) / (coalesce(n, 0) + 1)) AS scatter, CAST(max(coalesce(n, 0) + 1) AS BIGINT) AS size FROM mm GROUP BY label)"""


@query("medoids", f"WITH {MED_SQL} SELECT label, medoid, {r6s('scatter')} AS scatter, size FROM md")
def medoids(spark, d):
    m = C.medoids(C.own_sums(labelled(spark, d), "euclidean"))
    return m.select("label", "medoid", r6("scatter").alias("scatter"), "size")


@query(
    "davies_bouldin",
    f"""WITH {MED_SQL}, mp AS (SELECT a.label, (a.scatter + b.scatter) / list_distance(ea.w, eb.w) AS r FROM md a JOIN md b ON a.label <> b.label JOIN e ea ON ea.id = a.medoid JOIN e eb ON eb.id = b.medoid),
mx AS (SELECT label, max(r) AS r FROM mp GROUP BY label) SELECT {r6s('avg(r)')} AS davies_bouldin FROM mx""",
)
def davies_bouldin(spark, d):
    w = labelled(spark, d)
    m = C.medoids(C.own_sums(w, "euclidean"))
    return C.davies_bouldin(m, w, "euclidean").select(r6("davies_bouldin").alias("davies_bouldin"))


@query(
    "within_between",
    f"""WITH {D_SQL}, h AS (SELECT * FROM pr WHERE id < id2), st AS (SELECT label, 'within' AS kind, count(*) AS n, avg(d) AS mean, stddev_pop(d) AS sd, min(d) AS min, max(d) AS max FROM h WHERE label = other GROUP BY label
UNION ALL SELECT NULL, 'between', count(*), avg(d), stddev_pop(d), min(d), max(d) FROM h WHERE label <> other) SELECT label, kind, n, {r6s('mean')} AS mean, {r6s('sd')} AS sd, {r6s('min')} AS min, {r6s('max')} AS max FROM st""",
)
def within_between(spark, d):
    s = C.within_between(_l2(spark, d))
    return s.select("label", "kind", "n", *[r6(c).alias(c) for c in ("mean", "sd", "min", "max")])


@query("sizes", "SELECT label - 1 AS label, count(*) AS size FROM embeddings WHERE label <> 0 GROUP BY label")
def sizes(spark, d):
    return C.cluster_sizes(labelled(spark, d).withColumn("label", F.col("label") - 1))


@query(
    "final_gamma",
    """WITH e AS (SELECT CAST(vec_id % 12 AS INTEGER) AS k, vec_id / 1000.0 AS gamma, CASE WHEN label <> 4 THEN label / 10.0 END AS silhouette FROM embeddings),
g AS (SELECT k, arg_max(gamma, (coalesce(silhouette, -1e300), -gamma)) AS gamma FROM e WHERE k BETWEEN 3 AND 9 GROUP BY k),
f AS (SELECT k, min(gamma) / 2 AS gamma FROM e WHERE k < 6 GROUP BY k)
SELECT DISTINCT e.k, CAST(coalesce(f.gamma, g.gamma, 0.05) AS DOUBLE) AS gamma FROM e LEFT JOIN f USING (k) LEFT JOIN g USING (k)""",
)
def final_gamma(spark, d):
    """Of twelve k the first have a searched gamma, the middle ones a grid, the others none."""
    e = A.waves(spark, d).select((F.col("sample_id") % 12).cast("int").alias("k"), (F.col("sample_id") / 1000.0).alias("gamma"), F.when(F.col("cluster") != 4, F.col("cluster") / 10.0).alias("silhouette"))
    searched = e.where("k < 6").select("k", (F.col("gamma") / 2).alias("gamma"))
    return C.final_gamma(e, searched, e.where("k BETWEEN 3 AND 9"), [0.05])


@query(
    "choose_best",
    """WITH s AS (SELECT CAST(vec_id % 20 AS BIGINT) AS g, 2 + CAST(vec_id // 20 AS BIGINT) AS k, CASE WHEN label <> 4 THEN round(label / 10.0, 1) END AS silhouette FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY silhouette DESC NULLS LAST, k) AS rn FROM s) SELECT g, k, silhouette FROM r WHERE rn = 1""",
)
def choose_best(spark, d):
    w = A.waves(spark, d)
    s = w.select(
        F.col("subject").alias("g"),
        (F.floor(F.col("sample_id") / 20) + 2).cast("bigint").alias("k"),
        F.when(F.col("cluster") != 4, F.round(F.col("cluster") / 10.0, 1)).alias("silhouette"),
    )
    return C.choose_best(s, ["g"])


@query(
    "attach_clusters",
    """SELECT e.vec_id AS sample_id, l.quality AS cluster, 'cycle' AS kind FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id UNION ALL
SELECT doc_id, quality, 'missing' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""",
)
def attach_clusters(spark, d):
    cyc = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"))
    lab = A.table(spark, d, "labels").select(F.col("doc_id").alias("sample_id"), F.col("quality").alias("cluster"))
    got, lost = C.attach_clusters(cyc, lab, ["sample_id"])
    return got.withColumn("kind", F.lit("cycle")).unionByName(lost.withColumn("kind", F.lit("missing")))


@query("dtw_cluster_stats")
def dtw_cluster_stats(spark, d):
    s = P.cluster_sums(P.zscore_waves(labelled(spark, d)), "dtw")
    return s.select("sample_id", "label", "other", "n", r6(F.col("total") / F.col("n")).alias("mean"), r6("low").alias("low"), r6("high").alias("high"))


@query("soft_dtw_cluster_stats")
def soft_dtw_cluster_stats(spark, d):
    s = P.soft_dtw_sums(labelled(spark, d), 5e-5)
    return s.select("sample_id", "label", "other", "n", r6(F.col("total") / F.col("n")).alias("mean"), r6("low").alias("low"), r6("high").alias("high"))


@query("score_clustering")
def score_clustering(spark, d):
    return C.score_clustering(labelled(spark, d), "dtw")


@query("kmedoids")
def kmedoids(spark, d):
    k = C.kmedoids(A.waves(spark, d), 3, "dtw")
    return k.select("sample_id", "label", r6("d").alias("d"))


@query("bisecting")
def bisecting(spark, d):
    return C.bisecting(A.waves(spark, d), [2, 3, 4, 5, 6])


@query("grid")
def grid(spark, d):
    return C.grid_search(A.waves(spark, d), [2, 3], [0.1], refine=2)


@query("result_tables")
def result_tables(spark, d):
    """Sizes and distance tables of one run as typed rows."""
    w = labelled(spark, d)
    sums = cut_lineage(P.cluster_sums(w, "dtw"))
    scores = C.silhouette(sums).groupBy("label").agg(F.avg("s").alias("silhouette")).withColumnRenamed("label", "k")
    t = C.result_tables(scores, w, sums)
    dist = t["distances"].select("kind", F.col("label").cast("string").alias("label"), "mean")
    return dist.unionByName(t["distribution"].select(F.lit("size").alias("kind"), F.col("label").cast("string").alias("label"), F.col("size").cast("double").alias("mean")))
