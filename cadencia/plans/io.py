"""Queries over the ingest operators on data taken from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..sources import files as S
from ..sources import sinks as K
from .registry import EV, query


@query(
    "profile_dataset",
    f"WITH {EV} SELECT label, kinetic, count(*) AS n, count(CASE WHEN event_id % 4 <> 0 THEN 1 END) AS n_valid, min(t) AS t_min, max(t) AS t_max, min(CASE WHEN event_id % 4 <> 0 THEN value END) AS v_min, max(CASE WHEN event_id % 4 <> 0 THEN value END) AS v_max FROM ev GROUP BY label, kinetic",
)
def profile_dataset(spark, d):
    ev = A.events(spark, d).withColumn("value", F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("value")))
    return K.profile_samples(ev, ["label", "kinetic"], "t", "value")


@query(
    "isolate_bad_records",
    """WITH x AS (SELECT doc_id, CASE WHEN NOT n_chars >= 100 THEN 'too short' WHEN NOT lang IN ('en', 'fr') THEN 'unknown language' WHEN NOT doc_id % 9 <> 0 THEN 'unreadable' END AS message FROM documents)
SELECT doc_id, message, CASE WHEN message IS NULL THEN 'ok' ELSE 'error' END AS status FROM x""",
)
def isolate_bad_records(spark, d):
    docs = A.table(spark, d, "documents")
    checks = {
        "too short": F.col("n_chars") >= 100,
        "unknown language": F.col("lang").isin("en", "fr"),
        "unreadable": F.col("doc_id") % 9 != 0,
    }
    return S.with_status(docs, checks).select("doc_id", "message", "status")


@query(
    "flatten_trial_document",
    "SELECT user_id AS trial_id, epoch_us(ts) / 1e6 AS t, event_type AS label, value > 50 AS kinetic FROM events",
)
def flatten_trial_document(spark, d):
    """Documents of at most a thousand events of one user each."""
    ev = A.events(spark, d).withColumn("part", F.floor(F.col("event_id") / 1000))
    z = F.array_sort(F.collect_list(F.struct("t", F.concat(F.lit(" "), "label").alias("label"), "kinetic")))
    docs = ev.groupBy("trial_id", "part").agg(z.alias("_z"))
    docs = docs.select(
        "trial_id",
        F.struct(
            F.col("_z.t").alias("event_times"), F.col("_z.label").alias("event_labels"), F.col("_z.kinetic").alias("kinetic")
        ).alias("events"),
    )
    return S.flatten_events(docs).drop("event_id")


@query(
    "check_names",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN n || '_CHECK.MAT' ELSE n || '_check.mat' END AS checked, '/out/' || p_brand || '/' || n || '.mat' AS mirrored
FROM (SELECT p_partkey, p_brand, replace(p_name, ' ', '_') AS n FROM part)""",
)
def check_names(spark, d):
    n = F.replace("p_name", F.lit(" "), F.lit("_"))
    p = A.table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit("_CHECK.MAT"))).otherwise(F.concat(n, F.lit(".mat"))).alias("name"),
        F.concat(F.lit("/in/"), "p_brand", F.lit("/"), n, F.lit(".mat")).alias("path"),
    )
    return p.select("p_partkey", K.check_name("name").alias("checked"), K.mirrored_path("path", "/in", "/out/").alias("mirrored"))


@query(
    "audit_rows",
    """WITH x AS (SELECT 'p' || CAST(c_nationkey AS VARCHAR) AS pid, c_mktsegment AS trial_type, CASE WHEN c_custkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN c_acctbal > 3000 THEN 'kinetic' ELSE 'kinematic' END AS mode,
 c_custkey % 5 <> 0 AS sel, c_custkey % 11 = 0 AS changed FROM customer)
SELECT '2024-01-01T00:00:00' AS iso_datetime, 'rev' AS username, pid, trial_type,
count(*) FILTER (WHERE side = 'left' AND mode = 'kinetic' AND changed) AS left_kinetic_changed, count(*) FILTER (WHERE side = 'left' AND mode = 'kinematic' AND changed) AS left_kinematic_changed,
count(*) FILTER (WHERE side = 'right' AND mode = 'kinetic' AND changed) AS right_kinetic_changed, count(*) FILTER (WHERE side = 'right' AND mode = 'kinematic' AND changed) AS right_kinematic_changed,
count(*) FILTER (WHERE side = 'left' AND mode = 'kinetic' AND sel) AS left_kinetic_sel, count(*) FILTER (WHERE side = 'left' AND mode = 'kinetic' AND NOT sel) AS left_kinetic_unsel,
count(*) FILTER (WHERE side = 'left' AND mode = 'kinematic' AND sel) AS left_kinematic_sel, count(*) FILTER (WHERE side = 'left' AND mode = 'kinematic' AND NOT sel) AS left_kinematic_unsel,
count(*) FILTER (WHERE side = 'right' AND mode = 'kinetic' AND sel) AS right_kinetic_sel, count(*) FILTER (WHERE side = 'right' AND mode = 'kinetic' AND NOT sel) AS right_kinetic_unsel,
count(*) FILTER (WHERE side = 'right' AND mode = 'kinematic' AND sel) AS right_kinematic_sel, count(*) FILTER (WHERE side = 'right' AND mode = 'kinematic' AND NOT sel) AS right_kinematic_unsel
FROM x GROUP BY pid, trial_type HAVING count(*) FILTER (WHERE changed) > 0""",
)
def audit_rows(spark, d):
    c = A.table(spark, d, "customer").select(
        F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("pid"),
        F.col("c_mktsegment").alias("trial_type"),
        F.when(F.col("c_custkey") % 2 == 0, "left").otherwise("right").alias("side"),
        F.when(F.col("c_acctbal") > 3000, "kinetic").otherwise("kinematic").alias("mode"),
        (F.col("c_custkey") % 5 != 0).cast("int").alias("selected"),
        (F.col("c_custkey") % 5 == 0).cast("int").alias("unselected"),
        (F.col("c_custkey") % 11 == 0).cast("int").alias("changed"),
    )
    return K.audit_rows(c, c, "rev", "2024-01-01T00:00:00")


@query(
    "mapping_json",
    """WITH x AS (SELECT DISTINCT CAST(vec_id % 20 AS BIGINT) AS sid, 'm' || CAST(label AS VARCHAR) AS src, 'm' || CAST((label + 1) % 10 AS VARCHAR) AS dst FROM embeddings)
SELECT sid, '{' || string_agg('"' || src || '":"' || dst || '"', ',' ORDER BY src) || '}' AS doc FROM x GROUP BY sid""",
)
def mapping_json(spark, d):
    m = A.waves(spark, d).select(
        F.col("subject").alias("sid"), F.col("label").alias("src"), F.concat(F.lit("m"), ((F.col("cluster") + 1) % 10).cast("string")).alias("dst")
    ).distinct()
    return K.mapping_json(m)


@query(
    "key_value_lines",
    r"""WITH l AS (SELECT doc_id AS path, unnest(regexp_split_to_array(text, '\r?\n')) AS line, unnest(range(len(regexp_split_to_array(text, '\r?\n')))) AS line_no FROM documents)
SELECT path, line_no, trim(split_part(line, '=', 1)) AS key, trim(substr(line, strpos(line, '=') + 1)) AS value FROM l WHERE contains(line, '=')""".replace("\\r", "\r").replace("\\n", "\n"),
)
def key_value_lines(spark, d):
    return S.key_values(S.text_lines(A.table(spark, d, "documents"), "doc_id", "text"))


@query(
    "dollar_param_lines",
    """SELECT o_custkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'Mass' ELSE ' Height' END AS key, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderpriority || '=x' END AS value FROM orders WHERE o_orderkey % 3 <> 1""",
)
def dollar_param_lines(spark, d):
    """Parameter files of customers, with a line per order."""
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("$Mass="), k.cast("string"))).when(k % 3 == 1, F.lit("Note=1")).otherwise(F.concat(F.lit("$ Height = "), "o_orderpriority", F.lit("=x ")))
    return S.dollar_params(A.table(spark, d, "orders").select(F.col("o_custkey").alias("path"), k.alias("position"), line.alias("line")))


@query(
    "sim_table_lines",
    f"""WITH {EV}, x AS (SELECT *, max(CASE WHEN event_id % 50 = 0 THEN event_id END) OVER (PARTITION BY trial_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM ev),
y AS (SELECT *, h // 50 % 2 = 0 AS even FROM x WHERE event_id % 50 <> 0 AND h IS NOT NULL)
SELECT trial_id AS path, CAST(event_id AS DOUBLE) AS t, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'force' END AS "column", CASE WHEN event_id % 7 = 0 THEN NULL WHEN even THEN value ELSE CAST(event_id % 10 AS DOUBLE) END AS v,
 CASE WHEN event_id % 7 = 0 THEN 'field_count' ELSE 'ok' END AS status FROM y""",
)
def sim_table_lines(spark, d):
    """Tables of users whose header changes every fifty events; every seventh row is short."""
    e, num = F.col("event_id"), F.col("event_id").cast("string")
    header = F.when(F.floor(e / 50) % 2 == 0, "time  force\tcode").otherwise("Time code  FORCE")
    row = F.when(e % 7 == 0, num).otherwise(F.concat_ws("\t", num, F.col("value").cast("string")))
    line = F.when(e % 50 == 0, header).otherwise(F.concat(row, F.lit("  "), (e % 10).cast("string")))
    lines = A.events(spark, d).select(F.col("trial_id").alias("path"), e.alias("position"), line.alias("line"))
    return S.sim_tables(lines, ["force"], with_status=True).withColumn("column", F.lower("column"))


@query(
    "marker_table_lines",
    f"""WITH {EV}, x AS (SELECT *, max(CASE WHEN event_id % 40 = 0 THEN event_id END) OVER (PARTITION BY trial_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM ev),
c AS (SELECT *, unnest(range(6)) AS i FROM x WHERE event_id % 40 <> 0 AND h IS NOT NULL)
SELECT trial_id AS path, event_id AS frame, CAST(event_id AS DOUBLE) / 4 AS t, CASE WHEN i < 3 THEN 'RANK' ELSE 'HEEL' || CAST(h // 40 % 3 AS VARCHAR) END AS marker, ['x', 'y', 'z'][i % 3 + 1] AS comp, value FROM c WHERE NOT (i = 4 AND event_id % 5 = 0)""".replace("comp, value FROM", "comp, value AS v FROM"),
)
def marker_table_lines(spark, d):
    """Marker files of users; the name of the second marker changes every forty events, some cells are empty."""
    e, v = F.col("event_id"), F.col("value").cast("string")
    header = F.concat(F.lit("Frame#\tTime\tRANK\t\t\tHEEL"), (F.floor(e / 40) % 3).cast("string"), F.lit("\t\t"))
    gap = F.when(e % 5 == 0, F.lit("")).otherwise(v)
    line = F.when(e % 40 == 0, header).otherwise(F.concat_ws("\t", e.cast("string"), (e / 4).cast("string"), v, v, v, v, gap, v))
    return S.marker_tables(A.events(spark, d).select(F.col("trial_id").alias("path"), e.alias("position"), line.alias("line")))
