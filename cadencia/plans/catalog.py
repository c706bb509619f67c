"""Catalogue and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import text as X
from ..operators import catalog as K
from ..operators import labels as L
from ..operators.ordered import ordered_scan
from .registry import n64, query, r6, r6s

# file names in the engine's naming scheme, composed from orders; one in seven is malformed
NAME = """CASE WHEN o_orderkey % 7 = 0 THEN 'notes' || CAST(o_orderkey AS STRING) || '.txt' ELSE
'Rd' || lpad(CAST(o_custkey AS STRING), 5, '0') || '_Rd' || lpad(CAST(o_custkey AS STRING), 5, '0') || '_' ||
substr(CAST(o_orderdate AS STRING), 1, 4) || '-01-01_13-52-18_Dynamic' || CAST(o_orderkey % 3 AS STRING) || '_Walk' ||
CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END || '0' || CAST(o_orderkey % 2 AS STRING) || '_fp0_splitCycles' ||
CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '_osim' WHEN 2 THEN '_check' ELSE '_osim_check' END || '.mat' END"""

NAMES_SQL = f"""f AS (SELECT 'd' || CAST(o_orderkey % 5 AS STRING) || '/' || ({NAME}) AS path, ({NAME}) AS name FROM orders),
p AS (SELECT path, name, split_part(name, '_', 1) AS pid, split_part(name, '_', 3) || '_' || split_part(name, '_', 4) AS datetime,
 split_part(name, '_', 5) AS session, split_part(name, '_', 6) AS trial_full, regexp_replace(split_part(name, '_', 6), '[0-9]+$', '') AS trial_base,
 CASE WHEN lower(name) LIKE '%\\_splitcycles\\_osim\\_check.mat' ESCAPE '\\' THEN 4 WHEN lower(name) LIKE '%\\_splitcycles\\_check.mat' ESCAPE '\\' THEN 3
 WHEN lower(name) LIKE '%\\_splitcycles\\_osim.mat' ESCAPE '\\' THEN 2 WHEN lower(name) LIKE '%\\_splitcycles.mat' ESCAPE '\\' THEN 1 ELSE 0 END AS priority
 FROM f WHERE name LIKE 'Rd%'),
bv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid, trial_base, datetime, trial_full ORDER BY priority DESC, path) AS rn FROM p) WHERE rn = 1)"""


def _names(spark, d):
    o = A.table(spark, d, "orders").withColumn("name", F.expr(NAME))
    o = o.select(F.concat(F.lit("d"), (F.col("o_orderkey") % 5).cast("string"), F.lit("/"), "name").alias("path"), "name")
    p = K.parse_trial_names(o, "name")
    prio, var = K.variant_priority("name")
    return p.withColumns({"priority": prio, "variant": var})


@query("parse_names", f"WITH {NAMES_SQL} SELECT path, pid, datetime, session, trial_full, trial_base, CAST(priority AS BIGINT) AS priority FROM p")
def parse_names(spark, d):
    return _names(spark, d).select(
        "path", "pid", "datetime", "session", "trial_full", "trial_base", n64("priority").alias("priority")
    )


@query("best_variant", f"WITH {NAMES_SQL} SELECT pid, datetime, trial_full, path, CAST(priority AS BIGINT) AS priority FROM bv")
def best_variant(spark, d):
    b = K.best_variant(_names(spark, d), ["pid", "trial_base", "datetime", "trial_full"], "priority", "path")
    return b.select("pid", "datetime", "trial_full", "path", n64("priority").alias("priority"))


@query(
    "trial_index",
    f"WITH {NAMES_SQL} SELECT pid, trial_base, path, row_number() OVER (PARTITION BY pid, trial_base ORDER BY datetime, trial_full, path) AS pos FROM bv",
)
def trial_index(spark, d):
    b = K.best_variant(_names(spark, d), ["pid", "trial_base", "datetime", "trial_full"], "priority", "path")
    return K.trial_index(b).select("pid", "trial_base", "path", "pos")


@query(
    "trial_core",
    f"""WITH {NAMES_SQL}, s AS (SELECT path, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM f)
SELECT path, regexp_replace(stem, '_splitCycles$', '') AS core, regexp_replace(regexp_replace(stem, '_splitCycles$', ''), '_fp0$', '') AS base
FROM s WHERE stem LIKE 'Rd%' AND stem LIKE '%splitCycles'""",
)
def trial_core(spark, d):
    core, base = K.trial_core(F.regexp_replace("name", r"\.[^.]*$", ""))
    return _names(spark, d).select("path", core.alias("core"), base.alias("base")).where("core is not null")


@query(
    "match_sidecars",
    """WITH r AS (SELECT o_custkey AS dir, 'Walk' || CAST(o_orderkey AS VARCHAR) AS stem FROM orders),
s AS (SELECT o_custkey AS dir, CASE WHEN o_orderkey % 3 = 0 THEN 'RUN' ELSE 'WALK' END || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 4 = 1 THEN '.enf' ELSE '.Trial.enf' END AS name FROM orders
UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'walk' ELSE 'jump' END || CAST(o_orderkey AS VARCHAR) || '.enf' FROM orders),
x AS (SELECT dir, name, lower(replace(regexp_replace(name, '\\.enf$', ''), '.Trial', '')) AS base FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY dir, base ORDER BY NOT contains(name, '.Trial'), name) AS rn FROM x)
SELECT r.dir, r.stem, k.name AS sidecar FROM r LEFT JOIN k ON k.dir = r.dir AND k.base = lower(r.stem) AND k.rn = 1""",
)
def match_sidecars(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("dir"), F.col("o_orderkey").alias("k"))
    num = F.col("k").cast("string")
    rec = o.select("dir", F.concat(F.lit("Walk"), num).alias("stem"))
    # a third and a half of the sidecars belong to no recording
    first = F.when(F.col("k") % 3 == 0, "RUN").otherwise("WALK")
    one = o.select("dir", F.concat(first, num, F.when(F.col("k") % 4 == 1, ".enf").otherwise(".Trial.enf")).alias("name"))
    second = F.when(F.col("k") % 2 == 0, "walk").otherwise("jump")
    two = o.select("dir", F.concat(second, num, F.lit(".enf")).alias("name"))
    return K.match_sidecars(rec, one.unionByName(two)).select("dir", "stem", "sidecar")


DESC_SQL = "replace(trim(lower(text)), ' ', '_')"


def _docs(spark, d):
    return A.table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("name"), F.col("text").alias("description")
    )


@query("keyword_filter", f"SELECT doc_id, 'enf' AS mode FROM documents WHERE (starts_with({DESC_SQL}, 'the') OR starts_with({DESC_SQL}, 'is_a')) AND NOT contains(lower(text), 'static') UNION ALL SELECT doc_id, 'filename' FROM documents WHERE contains(lower(source), 'rc1') UNION ALL SELECT doc_id, 'all' FROM documents")
def keyword_filter(spark, d):
    docs = _docs(spark, d)
    a = K.filter_trials(docs, "enf", ["The", "is_a"], static="static").select("doc_id", F.lit("enf").alias("mode"))
    b = K.filter_trials(docs, "filename", ["RC1"]).select("doc_id", F.lit("filename").alias("mode"))
    return a.unionByName(b).unionByName(docs.select("doc_id", F.lit("all").alias("mode")))


@query("match_task", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ing')")
def match_task(spark, d):
    return K.match_task(_docs(spark, d), "ING").select("doc_id")


@query("limit_matched", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'ing') ORDER BY doc_id LIMIT 25")
def limit_matched(spark, d):
    docs = _docs(spark, d).withColumnRenamed("name", "source")
    return K.limit_matched(docs, "ing", 25, path="doc_id").select("doc_id", "source")


@query(
    "check_reason",
    """WITH x AS (SELECT d.doc_id, l.doc_id AS sidecar, CASE WHEN d.doc_id % 11 <> 0 THEN lower(d.text) END AS description, d.n_chars < 5000 AS loadable
FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN sidecar IS NULL THEN 'no_sidecar' WHEN description IS NULL THEN 'no_description'
WHEN NOT (starts_with(description, 't') OR starts_with(description, 'a')) THEN 'keyword_miss' WHEN contains(description, 'ed') THEN 'static'
WHEN NOT loadable THEN 'load_error' ELSE 'checked' END AS reason FROM x""",
)
def check_reason(spark, d):
    docs = A.table(spark, d, "documents").join(
        A.table(spark, d, "labels").select("doc_id", F.lit(1).alias("sidecar")), "doc_id", "left"
    )
    files = docs.select(
        "doc_id",
        "sidecar",
        F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("description"),
        (F.col("n_chars") < 5000).alias("loadable"),
    )
    return K.check_reasons(files, ["T", "A"], "ED").select("doc_id", "reason")


@query(
    "subject_params",
    """WITH t AS (SELECT c_custkey AS trial_id, c_custkey // 12 AS folder, right(c_name, 1) AS subject FROM customer),
s AS (SELECT c_custkey // 12 AS folder, CASE WHEN c_custkey % 36 = 0 OR c_custkey % 6 <> 0 AND c_custkey % 5 <> 0 THEN 'kiste' ELSE lower(c_name) END AS base FROM customer),
j AS (SELECT t.trial_id, s.base, contains(s.base, t.subject) AS hit FROM t JOIN s USING (folder)),
c AS (SELECT trial_id, count(DISTINCT base) AS every, min(base) AS a, count(DISTINCT base) FILTER (WHERE hit) AS hits, count(DISTINCT base) FILTER (WHERE hit AND base <> 'kiste') AS named,
 min(base) FILTER (WHERE hit) AS one, min(base) FILTER (WHERE hit AND base <> 'kiste') AS one_named FROM j GROUP BY trial_id),
r AS (SELECT *, CASE WHEN hits = 1 THEN one WHEN hits > 1 AND named = 1 THEN one_named WHEN hits = 0 AND every = 1 THEN a END AS base FROM c)
SELECT t.trial_id, r.base, CASE WHEN r.trial_id IS NULL THEN 'none' WHEN r.base IS NOT NULL THEN 'ok' WHEN hits > 1 OR every > 1 THEN 'ambiguous' ELSE 'none' END AS status FROM t LEFT JOIN r USING (trial_id)""",
)
def subject_params(spark, d):
    c = A.table(spark, d, "customer").withColumn("folder", F.floor(F.col("c_custkey") / 12).cast("bigint"))
    trials = c.select(
        F.col("c_custkey").alias("trial_id"), "folder", F.array(F.expr("right(c_name, 1)")).alias("subjects")
    )
    # some customers stand for a parameter set of their own, the others for the common one
    k = F.col("c_custkey")
    common = (k % 36 == 0) | ((k % 6 != 0) & (k % 5 != 0))
    sets = c.select("folder", F.when(common, "kiste").otherwise(F.lower("c_name")).alias("base"))
    return K.resolve_subject_params(trials, sets)


CORE = """'Rd' || CAST(o_custkey AS STRING) || '_Rd' || CAST(o_custkey AS STRING) || '_' || substr(CAST(o_orderdate AS STRING), 1, 10) || '_10-00-00_Dyn_Walk0' ||
CAST(o_orderkey % 2 AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN '_fp0' ELSE '' END"""
SIM_NAME = f"""CASE o_orderkey % 9 WHEN 0 THEN 'IK_' || ({CORE}) || '.mot' WHEN 1 THEN 'IK_filt_' || ({CORE}) || '.mot' WHEN 2 THEN 'ik_marker_errors_' || ({CORE}) || '.sto'
WHEN 3 THEN 'ID_' || ({CORE}) || '.sto' WHEN 4 THEN 'SO_' || ({CORE}) || '_StaticOptimization_activation.sto' WHEN 5 THEN 'SO_' || ({CORE}) || '_StaticOptimization_forces.sto'
WHEN 6 THEN 'JRL_' || ({CORE}) || '_JointReaction_ReactionLoads.sto' WHEN 7 THEN 'EXTRA_' || ({CORE}) || '.sto' ELSE 'IK_' || ({CORE}) || '.txt' END"""
SIM_SQL = f"""sm AS (SELECT lower({CORE}) AS core, o_orderkey % 9 AS kind, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '/' || ({SIM_NAME}) AS path FROM orders),
ix AS (SELECT core, k.key, max(path) AS path FROM sm JOIN (VALUES (0, 'IK'), (1, 'IK_filt'), (2, 'IK_markerErr'), (3, 'ID'), (4, 'SO_activation'), (5, 'SO_forces'), (6, 'JRL')) AS k(kind, key)
 ON k.kind = sm.kind GROUP BY core, k.key)"""


def _sim_index(spark, d):
    o = A.table(spark, d, "orders").withColumn("name", F.expr(SIM_NAME))
    o = o.withColumn("path", F.concat(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit("/"), "name"))
    return K.index_sim_files(o, "name", "path")


@query("sim_index", f"WITH {SIM_SQL} SELECT core, key, path FROM ix")
def sim_index(spark, d):
    return _sim_index(spark, d)


TRIALS_SQL = f"""tr AS (SELECT o_orderkey AS trial_id, lower({CORE}) AS core, regexp_replace(lower({CORE}), '_fp0$', '') AS base FROM orders)"""


def _core_trials(spark, d):
    core = F.lower(F.expr(CORE))
    return (
        A.table(spark, d, "orders")
        .select(F.col("o_orderkey").alias("trial_id"), core.alias("core"), F.regexp_replace(core, "_fp0$", "").alias("base"))
    )


MATCH_SQL = f"""{SIM_SQL}, {TRIALS_SQL},
m AS (SELECT tr.trial_id, ix.key, ix.core, ix.path, 'exact' AS match FROM tr JOIN ix ON ix.core = tr.core
UNION ALL SELECT trial_id, key, b[1] AS core, b[2] AS path, 'prefix' FROM (SELECT tr.trial_id, ix.key, min((ix.core, ix.path)) AS b FROM tr JOIN ix ON starts_with(ix.core, tr.base)
 WHERE tr.core NOT IN (SELECT core FROM ix) GROUP BY tr.trial_id, ix.key))"""


@query("match_cores", f"WITH {MATCH_SQL} SELECT trial_id, key, core, path, match FROM m")
def match_cores(spark, d):
    return K.match_cores(_core_trials(spark, d), _sim_index(spark, d))


@query(
    "missing_log",
    f"""WITH {MATCH_SQL} SELECT tr.trial_id, k.key, 'no matching file found' AS reason FROM tr, (SELECT unnest(['IK', 'ID', 'JRL']) AS key) k
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.trial_id = tr.trial_id AND m.key = k.key)""",
)
def missing_log(spark, d):
    t = _core_trials(spark, d)
    return K.missing_files(t, K.match_cores(t, _sim_index(spark, d)), ["IK", "ID", "JRL"])


@query(
    "missing_columns",
    """WITH h AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda s: lower(s)) AS cols FROM documents),
w AS (SELECT unnest(['AND', 'Of', 'the']) AS c), x AS (SELECT h.doc_id, w.c FROM h, w WHERE NOT list_contains(h.cols, lower(w.c)))
SELECT doc_id, string_agg(c, ',' ORDER BY c) AS missing FROM x GROUP BY doc_id""",
)
def missing_columns(spark, d):
    h = _docs(spark, d).withColumn("cols", F.split("description", " "))
    return K.missing_columns(h, ["doc_id"], "cols", ["AND", "Of", "the"]).withColumn("missing", F.array_join("missing", ","))


@query(
    "stitch_sources",
    f"""WITH t AS (SELECT o_orderkey AS trial_id, CAST(o_custkey AS VARCHAR) || 'w' || CAST(o_orderkey % 4 AS VARCHAR) AS stem FROM orders),
c AS (SELECT CAST(o_custkey AS VARCHAR) || 'w' || CAST(o_orderkey % 4 AS VARCHAR) AS stem, min(lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS source FROM orders
 WHERE o_orderstatus <> 'P' AND o_orderkey % 3 > 0 GROUP BY 1)
SELECT t.trial_id, t.stem, c.source FROM t LEFT JOIN c USING (stem)""",
)
def stitch_sources(spark, d):
    o = A.table(spark, d, "orders")
    stem = F.concat(F.col("o_custkey").cast("string"), F.lit("w"), (F.col("o_orderkey") % 4).cast("string"))
    t = o.select(F.col("o_orderkey").alias("trial_id"), F.concat(stem, F.lit("_splitCycles_osim.mat")).alias("name"))
    c = o.select(
        F.concat(stem, F.lit(".mat")).alias("name"),
        F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("path"),
        (F.col("o_orderstatus") != "P").alias("has_time"),
        (F.col("o_orderkey") % 3).alias("n_emg"),
    )
    return K.match_stitch_sources(t, c).drop("name")


IDS = ["Customer#000000012", "CUSTOMER#00000012", "0000013", "nobody"]


@query(
    "resolve_ids",
    """WITH q AS (SELECT unnest(['Customer#000000012', 'CUSTOMER#00000012', '0000013', 'nobody']) AS request),
h AS (SELECT q.request, c.c_name AS id, lower(c.c_name) = lower(q.request) AS ex FROM q JOIN customer c ON contains(lower(c.c_name), lower(q.request)))
SELECT request, arg_min(id, (NOT ex, id)) AS id, CASE WHEN bool_or(ex) THEN 'exact' ELSE 'substring' END AS match FROM h GROUP BY request""",
)
def resolve_ids(spark, d):
    return K.resolve_ids(A.table(spark, d, "customer"), "c_name", IDS)


@query("sample_ids", "SELECT c_custkey FROM customer GROUP BY c_custkey ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey LIMIT 50")
def sample_ids(spark, d):
    return K.sample_ids(A.table(spark, d, "customer"), "c_custkey", 50, 42)


@query("distinct_users", "SELECT DISTINCT trim(split_part(p_name, ' ', 2)) AS username FROM part WHERE p_partkey % 5 <> 0")
def distinct_users(spark, d):
    p = A.table(spark, d, "part").select(
        F.when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("username")
    )
    return K.distinct_users(p)


# --- labels -------------------------------------------------------------------

SPELL = """CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '_') WHEN 3 THEN '*' || p_name ELSE p_name || '. ' || p_brand || ' ' || lower(p_brand) END"""


@query(
    "normalise_label",
    f"""WITH x AS (SELECT p_partkey, list_filter(regexp_split_to_array(trim({SPELL}), '[ \\._]+'), lambda s: s <> '') AS t FROM part)
SELECT p_partkey, array_to_string(list_filter(t, lambda s, i: i = 1 OR lower(s) <> lower(t[i - 1])), '_') AS label FROM x""",
)
def normalise_label(spark, d):
    return A.table(spark, d, "part").select("p_partkey", X.normalise_label(F.expr(SPELL)).alias("label"))


@query(
    "unique_labels",
    f"""WITH r AS (SELECT p_partkey, p_partkey // 20 AS trial, replace(p_name || '_' || p_type || CASE WHEN p_partkey % 5 = 0 THEN repeat('_x_' || p_name || '_' || p_type, 4) ELSE '' END, ' ', '_') AS n FROM part),
x AS (SELECT p_partkey, trial, CASE WHEN length(n) > 31 THEN array_to_string(list_transform(string_split(n, '_'), lambda t: left(t, 3)), '_') ELSE n END AS c FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY trial, c ORDER BY p_partkey) - 1 AS k FROM x)
SELECT trial, p_partkey, CASE WHEN k = 0 THEN c ELSE left(c, 30 - length(CAST(k AS VARCHAR))) || '_' || CAST(k AS VARCHAR) END AS channel FROM k""",
)
def unique_labels(spark, d):
    p = A.table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 20).cast("bigint").alias("trial"),
        "p_partkey",
        F.concat(F.concat_ws(" ", "p_name", "p_type"), F.when(F.col("p_partkey") % 5 == 0, F.repeat(F.concat(F.lit(" x "), F.concat_ws(" ", "p_name", "p_type")), F.lit(4))).otherwise("")).alias("raw"),
    )
    return L.unique_labels(p, "trial", "raw", "p_partkey").drop("raw")


LONG = "repeat(p_name || '/', 1 + CAST(p_size AS INT) % 9)"


@query(
    "safe_field_names",
    f"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '7' ELSE '' END || {LONG} AS n FROM part),
y AS (SELECT p_partkey, CASE WHEN length(n) <= 63 THEN n ELSE left(n, 56) || '_' || left(md5(n), 6) END AS s FROM x),
z AS (SELECT p_partkey, left(regexp_replace(CASE WHEN regexp_matches(s, '^[A-Za-z]') THEN s ELSE 'f_' || s END, '[^A-Za-z0-9_]', '_', 'g'), 99) AS f FROM y)
SELECT p_partkey, CASE WHEN length(f) > 63 THEN left(f, 61) || '_1' ELSE f END AS field FROM z""",
)
def safe_field_names(spark, d):
    raw = F.concat(F.when(F.col("p_partkey") % 3 == 0, "7").otherwise(""), F.expr(LONG))
    p = A.table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("trial"), raw.alias("raw"))
    return L.safe_field_names(p, "trial", "raw", "p_partkey").select("p_partkey", "field")


@query(
    "strip_subject",
    """WITH x AS (SELECT p_partkey, p_name || ':' || p_type || ':x' AS l, split_part(p_name, ' ', 2) AS s FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN substr(l, strpos(l, ':') + 1) ELSE l END AS marker FROM x""",
)
def strip_subject(spark, d):
    subj = F.array(F.when(F.col("p_partkey") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise("nobody"))
    lab = F.concat_ws(":", "p_name", "p_type", F.lit("x"))
    return A.table(spark, d, "part").select("p_partkey", X.strip_subject(lab, subj).alias("marker"))


@query(
    "whitelist_channels",
    f"""WITH x AS (SELECT p_partkey, {SPELL} AS l FROM part)
SELECT p_partkey, 'point' AS kind, lower(trim(l)) IN ('small ring', 'red widget') AS listed FROM x WHERE NOT starts_with(l, '*') AND lower(trim(l)) IN ('small ring', 'red widget', 'hot gear')
UNION ALL SELECT p_partkey, 'analog', true FROM x WHERE contains(lower(l), 'ring') OR contains(lower(l), 'hot')""",
)
def whitelist_channels(spark, d):
    x = A.table(spark, d, "part").select("p_partkey", F.expr(SPELL).alias("l"))
    pt = L.whitelist_points(x, "l", ["Small ring", "red widget"], ["HOT gear"]).select("p_partkey", F.lit("point").alias("kind"), "listed")
    an = L.whitelist_analog(x, "l", ["RING", "hot"]).select("p_partkey", F.lit("analog").alias("kind"), F.lit(True).alias("listed"))
    return pt.unionByName(an)


@query(
    "filter_sections",
    """SELECT p_partkey, p_name AS key FROM part WHERE (contains(lower(p_name), 'blue') OR contains(lower(p_name), 'gizmo'))
AND p_name NOT IN (SELECT p_name FROM part WHERE p_size < 2)""",
)
def filter_sections(spark, d):
    p = A.table(spark, d, "part")
    have = p.where("p_size < 2").select(F.col("p_name").alias("key"))
    return L.filter_sections(p.select("p_partkey", F.col("p_name").alias("key")), ["Blue", "gizmo"], have)


CHANNEL = """CASE p_partkey % 8 WHEN 0 THEN 'Force.Fx' || CAST(p_size AS STRING) WHEN 1 THEN 'EMG.NFU ' || CAST(p_size AS STRING)
WHEN 2 THEN 'EMG.EMG_' || lpad(CAST(p_size AS STRING), 2, '0') || '_R M.soleus' WHEN 3 THEN 'emg ' || CAST(p_size AS STRING) || ' L M. gastroc med.'
WHEN 4 THEN 'EMG' || CAST(p_size AS STRING) || '_L vastus lat' WHEN 5 THEN 'EMG-' || CAST(p_size AS STRING)
WHEN 6 THEN 'EMG.EMG_' || lpad(CAST(p_size AS STRING), 2, '0') || '_R ' || p_name ELSE p_name END"""


@query(
    "alias_key",
    f"""WITH x AS (SELECT p_partkey, {CHANNEL} AS l FROM part),
y AS (SELECT p_partkey, l, TRY_CAST(regexp_extract(lower(l), 'emg[\\.\\s_\\-]*([0-9]{{1,2}})', 1) AS INTEGER) AS n FROM x)
SELECT p_partkey, CASE WHEN contains(lower(l), 'emg') AND n BETWEEN 1 AND 99 THEN 'emg#' || CAST(n AS VARCHAR) ELSE lower(regexp_replace(l, '[^0-9a-zA-Z]', '', 'g')) END AS group_key FROM y""",
)
def alias_key(spark, d):
    return A.table(spark, d, "part").select("p_partkey", X.alias_key(F.expr(CHANNEL)).alias("group_key"))


INV_SQL = f"""x AS (SELECT p_partkey, {SPELL} AS l FROM part),
s AS (SELECT lower(regexp_replace(l, '[^0-9a-zA-Z]', '', 'g')) AS group_key, l, count(*) AS n FROM x WHERE NOT starts_with(l, '*') GROUP BY 1, 2),
inv AS (SELECT group_key, arg_min(l, (-n, l)) AS canonical, CAST(sum(n) AS BIGINT) AS n_labels, count(*) AS n_spellings, count(*) > 1 AS mutable FROM s GROUP BY group_key)"""


@query("inventory", f"WITH {INV_SQL} SELECT * FROM inv")
def inventory(spark, d):
    return L.label_inventory(A.table(spark, d, "part").select(F.expr(SPELL).alias("l")), "l")


@query(
    "patch_labels",
    f"""WITH {INV_SQL}, j AS (SELECT x.p_partkey, x.l, CASE WHEN starts_with(l, '*') OR NOT coalesce(mutable, false) THEN l ELSE canonical END AS patched
FROM x LEFT JOIN inv ON inv.group_key = lower(regexp_replace(l, '[^0-9a-zA-Z]', '', 'g')))
SELECT p_partkey, patched, patched <> l AS changed FROM j""",
)
def patch_labels(spark, d):
    x = A.table(spark, d, "part").select("p_partkey", F.expr(SPELL).alias("l"))
    return L.patch_labels(x, "l", L.label_inventory(x, "l")).select("p_partkey", "patched", "changed")


BLOCKS_SQL = """b AS (SELECT o_custkey AS trial, 1 + o_orderkey % 3 AS block, o_orderkey AS id,
 row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) - 1 AS pos FROM orders),
t AS (SELECT trial, count(*) AS total, count(DISTINCT block) AS nb FROM b GROUP BY trial),
g AS (SELECT b.*, row_number() OVER (PARTITION BY b.trial ORDER BY block, pos) - 1 AS gpos, total, nb FROM b JOIN t USING (trial))"""


def _blocks(spark, d):
    b = A.table(spark, d, "orders").select(
        F.col("o_custkey").alias("trial"), (F.col("o_orderkey") % 3 + 1).alias("block"), F.col("o_orderkey").alias("id")
    )
    b = ordered_scan(b, ["trial", "block"], ["id"], row_no="_k", cell=F.floor(F.col("id") / 100_000).cast("bigint"))
    return b.withColumn("pos", F.col("_k") - 1).drop("_k")


@query("condense_blocks", f"WITH {BLOCKS_SQL} SELECT trial, id, CASE WHEN nb > 1 AND total <= 12 THEN 1 ELSE block END AS block, CASE WHEN nb > 1 AND total <= 12 THEN gpos ELSE pos END AS pos, nb > 1 AND total <= 12 AS merged FROM g")
def condense_blocks(spark, d):
    return L.condense_blocks(_blocks(spark, d), "trial", limit=12)


@query(
    "trim_descriptions",
    f"WITH {BLOCKS_SQL}, n AS (SELECT o_custkey AS trial, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT g.trial, g.id, gpos AS pos FROM g JOIN n USING (trial) WHERE gpos < n",
)
def trim_descriptions(spark, d):
    desc = L.condense_blocks(_blocks(spark, d), "trial", limit=10**9).select("trial", "id", "pos")
    labels = A.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("trial"))
    return L.trim_to_labels(desc, labels, "trial")


@query(
    "reconcile_counts",
    f"""WITH {BLOCKS_SQL} SELECT g.trial, id, block, pos, CASE WHEN total < c_custkey % 14 THEN 'too_few_labels' WHEN total > c_custkey % 14 THEN 'trimmed' ELSE 'ok' END AS status
FROM g JOIN customer ON c_custkey = trial WHERE gpos < c_custkey % 14""",
)
def reconcile_counts(spark, d):
    n = A.table(spark, d, "customer").select(F.col("c_custkey").alias("trial"), (F.col("c_custkey") % 14).alias("n_channels"))
    return L.reconcile_counts(_blocks(spark, d), n, "trial")


CH_SQL = f"""x AS (SELECT p_partkey, trim({CHANNEL}) AS l FROM part),
y AS (SELECT *, TRY_CAST(regexp_extract(l, '(?i)emg[_\\.\\s-]*([0-9]{{1,2}})', 1) AS INTEGER) AS n,
 upper(regexp_extract(l, '(?i)emg[_\\.\\s-]*[0-9]{{1,2}}[_\\.\\s-]*([LR])\\b', 1)) AS sd, trim(regexp_extract(l, '(?i)emg[_\\.\\s-]*[0-9]{{1,2}}[_\\.\\s-]*[LR]\\s*(.*)$', 1)) AS mu FROM x),
ch AS (SELECT p_partkey, contains(lower(l), 'nfu') AS is_nfu, n, CASE WHEN sd <> '' THEN sd END AS sd, mu, regexp_replace(lower(mu), '[^a-z0-9]', '', 'g') AS mk FROM y
WHERE contains(lower(l), 'emg') AND (contains(lower(l), 'nfu') OR (n IS NOT NULL AND NOT (sd = 'R' AND n NOT BETWEEN 1 AND 13) AND NOT (sd = 'L' AND NOT (n BETWEEN 17 AND 27 OR n IN (31, 32))))))"""


@query("parse_channel", f"WITH {CH_SQL} SELECT p_partkey, CASE WHEN NOT is_nfu THEN n END AS number, CASE WHEN NOT is_nfu THEN sd END AS side, CASE WHEN NOT is_nfu THEN mu END AS muscle, CASE WHEN NOT is_nfu THEN mk END AS muscle_key, is_nfu FROM ch")
def parse_channel(spark, d):
    p = A.table(spark, d, "part").withColumn("i", X.channel_info(F.expr(CHANNEL)))
    return p.where("i is not null").select("p_partkey", "i.*")


@query(
    "canonical_muscle",
    f"""WITH {CH_SQL}, k AS (SELECT p_partkey, regexp_replace(mk, '^m', '') AS k FROM ch WHERE NOT is_nfu)
SELECT p_partkey, CASE WHEN contains(k, 'gastrocmed') THEN 'gastro_med' WHEN contains(k, 'soleus') THEN 'soleus' WHEN contains(k, 'vastuslat') THEN 'vastus_lat' WHEN k = '' THEN 'unknown' ELSE k END AS canon,
CASE WHEN contains(k, 'gastrocmed') OR contains(k, 'soleus') THEN 0 WHEN contains(k, 'vastuslat') THEN 1 END AS close_group FROM k""",
)
def canonical_muscle(spark, d):
    p = A.table(spark, d, "part").withColumn("i", X.channel_info(F.expr(CHANNEL))).where("i is not null and not i.is_nfu")
    p = p.withColumn("canon", X.canonical_muscle("i.muscle_key"))
    return p.select("p_partkey", "canon", X.close_group("canon").alias("close_group"))


SIDED = """CASE p_partkey % 6 WHEN 0 THEN 'EMG_' || CAST(p_size AS STRING) || '_L_' || p_type WHEN 1 THEN 'RKnee' || p_type WHEN 2 THEN 'hip_l_' || p_type
WHEN 3 THEN 'knee_angle_' || CASE WHEN p_size % 2 = 0 THEN 'r' ELSE 'l' END WHEN 4 THEN 'Force_Fx' || CAST(p_size % 4 AS STRING) ELSE p_type END"""
SIDE_FREE_SQL = f"""x AS (SELECT p_partkey, p_size, p_type, {SIDED} AS k FROM part),
y AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'EMG_*_' || p_type WHEN 1 THEN 'Knee' || p_type WHEN 2 THEN 'hip_' || p_type WHEN 3 THEN 'knee_angle' WHEN 4 THEN 'Force_Fx' || CAST(p_size % 4 AS VARCHAR)
 ELSE CASE WHEN starts_with(p_type, 'L') THEN substr(p_type, 2) ELSE p_type END END AS display FROM x)"""


@query(
    "side_free_key",
    f"""WITH {SIDE_FREE_SQL} SELECT p_partkey, display, CASE p_partkey % 6 WHEN 0 THEN replace(k, '_L_', '_R_') WHEN 2 THEN replace(k, '_l_', '_r_') WHEN 3 THEN 'knee_angle_r'
WHEN 5 THEN CASE WHEN starts_with(k, 'L') THEN 'R' || substr(k, 2) ELSE k END ELSE k END AS right_key FROM y""",
)
def side_free_key(spark, d):
    k = F.expr(SIDED)
    return A.table(spark, d, "part").select(
        "p_partkey", X.side_free_key(k).alias("display"), X.key_for_side(k, F.lit(False)).alias("right_key")
    )


@query("discover_keys", f"WITH {SIDE_FREE_SQL}, z AS (SELECT display FROM y UNION ALL SELECT 'Force_Fx*' FROM y WHERE p_partkey % 6 = 4) SELECT display, count(*) AS n_channels FROM z GROUP BY display")
def discover_keys(spark, d):
    return L.discover_keys(A.table(spark, d, "part").select(F.expr(SIDED).alias("k")), "k")


@query("wildcard_channels", f"WITH {SIDE_FREE_SQL} SELECT p_partkey, k FROM y WHERE starts_with(k, 'EMG_') AND suffix(k, 'Y')")
def wildcard_channels(spark, d):
    return L.wildcard_channels(A.table(spark, d, "part").select("p_partkey", F.expr(SIDED).alias("k")), "k", "EMG_*Y")


GROUP = "CASE l_linenumber WHEN 1 THEN 'JRL' WHEN 2 THEN 'analog' WHEN 3 THEN 'point' WHEN 4 THEN 'SO_forces' WHEN 5 THEN 'grf' ELSE 'other' END"


@query(
    "resolve_channel",
    f"""WITH x AS (SELECT l_orderkey, l_returnflag AS channel, {GROUP} AS grp, l_quantity FROM lineitem),
r AS (SELECT *, list_position(['point', 'IK_markerErr', 'SO_forces', 'analog', 'grf', 'jrf', 'residual', 'JRL'], grp) AS p FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, channel ORDER BY p, l_quantity) AS rn FROM r WHERE p > 0)
SELECT l_orderkey, channel, grp, l_quantity FROM k WHERE rn = 1""",
)
def resolve_channel(spark, d):
    x = A.table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_returnflag").alias("channel"), F.expr(GROUP).alias("grp"), "l_quantity"
    )
    return L.resolve_channel(x, ["l_orderkey", "channel"], "grp", "l_quantity")


SWAPS_SQL = """mp AS (SELECT DISTINCT CAST(vec_id % 20 AS BIGINT) AS sid, 'm' || CAST(label AS VARCHAR) AS src, 'm' || CAST((label * 3) % 10 AS VARCHAR) AS dst FROM embeddings),
np AS (SELECT m.* FROM mp m LEFT JOIN mp b ON b.sid = m.sid AND b.src = m.dst AND b.dst = m.src WHERE m.src <> m.dst AND (b.sid IS NULL OR m.src < m.dst))"""


def _swaps(spark, d):
    return A.waves(spark, d).select(
        F.col("subject").alias("sid"),
        F.col("label").alias("src"),
        F.concat(F.lit("m"), ((F.col("cluster") * 3) % 10).cast("string")).alias("dst"),
    ).distinct()


@query("swap_pairs", f"WITH {SWAPS_SQL} SELECT sid, src, dst FROM np")
def swap_pairs(spark, d):
    return L.normalise_swaps(_swaps(spark, d))


@query(
    "swap_labels",
    """WITH la AS (SELECT vec_id, CAST(vec_id % 20 AS BIGINT) AS sid, 'm' || CAST(label AS VARCHAR) AS label FROM embeddings),
mp AS (SELECT DISTINCT sid, CASE WHEN sid % 2 = 0 THEN 'm1' ELSE 'm5' END AS src, CASE WHEN sid % 3 = 0 THEN 'x9' ELSE 'm7' END AS dst FROM la)
SELECT la.vec_id, CASE WHEN la.label = f.src THEN f.dst WHEN la.label = f.dst AND EXISTS (SELECT 1 FROM la q WHERE q.sid = la.sid AND q.label = f.src) THEN f.src ELSE la.label END AS new_label
FROM la JOIN mp f USING (sid)""",
)
def swap_labels(spark, d):
    la = A.waves(spark, d).select(F.col("sample_id").alias("vec_id"), F.col("subject").alias("sid"), "label")
    mp = la.select(
        "sid",
        F.when(F.col("sid") % 2 == 0, "m1").otherwise("m5").alias("src"),
        F.when(F.col("sid") % 3 == 0, "x9").otherwise("m7").alias("dst"),
    ).distinct()
    return L.apply_swaps(la, mp, "sid").select("vec_id", "new_label")


@query(
    "active_side",
    f"""WITH e AS (SELECT vec_id AS sample, CASE WHEN vec_id % 3 = 0 THEN 'R' ELSE 'L' END AS active, embedding[1] AS kl, embedding[2] AS kr, embedding[3] AS tl FROM embeddings)
SELECT sample, 'Knee' AS key, {r6s("CAST(CASE active WHEN 'R' THEN kr ELSE kl END AS DOUBLE)")} AS v FROM e UNION ALL SELECT sample, 'Thorax', {r6s('CAST(tl AS DOUBLE)')} FROM e""",
)
def active_side(spark, d):
    w = A.waves(spark, d).select(F.col("sample_id").alias("sample"), "wave")
    vals = w.select(
        "sample",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("key"), F.lit(s).alias("side"), F.get("wave", F.lit(i)).alias("v"))
                    for k, s, i in (("Knee", "L", 0), ("Knee", "R", 1), ("Thorax", "L", 2), ("Thorax", "R", 3))
                ]
            )
        ),
    )
    act = w.select("sample", F.when(F.col("sample") % 3 == 0, "R").otherwise("L").alias("active_side"))
    return L.pick_active_side(vals, "sample", act, "key", "side", fixed_left=["Thorax"]).select("sample", "key", r6("v").alias("v"))


@query(
    "exercise_prefix",
    "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'exercise' ELSE 'left_stride' END AS cycle_type, CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'Left_' || event_type END AS event_key FROM events",
)
def exercise_prefix(spark, d):
    e = A.table(spark, d, "events").select(
        "event_id",
        F.when(F.col("user_id") % 2 == 0, "exercise").otherwise("locomotion").alias("scheme"),
        F.lit("left_stride").alias("cycle_type"),
        F.concat(F.lit("Left_"), "event_type").alias("event_key"),
    )
    return L.strip_exercise_prefix(e, "scheme", "cycle_type", "event_key").drop("scheme")


@query(
    "derive_columns",
    f"""SELECT c_custkey, {r6s('(60 + c_custkey % 40) / ((1500.0 + c_custkey % 400) / 1000.0 * (1500.0 + c_custkey % 400) / 1000.0)')} AS bmi, {r6s('c_acctbal * 100')} AS acctbal_pc,
upper(c_name) AS c_name, replace('/old/' || c_mktsegment, '/old', '/new') AS path, chr(CAST(65 + c_nationkey AS INTEGER)) AS cluster_letter FROM customer""",
)
def derive_columns(spark, d):
    c = A.table(spark, d, "customer").select(
        "c_custkey",
        "c_name",
        "c_acctbal",
        (F.lit(60) + F.col("c_custkey") % 40).alias("w"),
        (F.lit(1500.0) + F.col("c_custkey") % 400).alias("h"),
        F.col("c_nationkey").alias("cl"),
        F.concat(F.lit("/old/"), "c_mktsegment").alias("path"),
    )
    out = L.derive_columns(c, weight="w", height_mm="h", ident="c_name", cluster="cl", path="path", roots={"/old": "/new"}, hundredfold={"c_acctbal": "acctbal_pc"})
    return out.select("c_custkey", r6("bmi").alias("bmi"), r6("acctbal_pc").alias("acctbal_pc"), "c_name", "path", "cluster_letter")


@query(
    "natural_sort",
    """WITH x AS (SELECT DISTINCT p_brand, TRY_CAST(split_part(p_brand, '#', 2) AS INTEGER) AS n FROM part) SELECT p_brand, 'brand#' || lpad(CAST(length(CAST(n AS VARCHAR)) AS VARCHAR), 10, '0') || CAST(n AS VARCHAR) AS sort_key FROM x""",
)
def natural_sort(spark, d):
    p = A.table(spark, d, "part").select("p_brand").distinct()
    return L.natural_sorted(p, "p_brand").withColumn("sort_key", X.natural_key("p_brand"))
