"""Trial catalogue: names, variants, matching of files, file-level filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import exact_or_prefix
from .ordered import ordered_scan

# fixed values: file name patterns
TRIAL_NAME = r"^([^_]+)_([^_]+)_([^_]+)_([^_]+)_([^_]+)_([^_]+)_(.*)$"
CORE_BODY = (
    r"([A-Za-z]+\d+_[A-Za-z]+\d+_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}_[^_]+_[A-Za-z][A-Za-z0-9]*)((?:_[A-Za-z0-9-]+)*)"
)
CORE_NAME = rf"(?i)^{CORE_BODY}_splitCycles$"

# fixed values: suffix, priority, variant
VARIANTS = (
    ("_splitcycles_osim_check.mat", 4, "osim_check"),
    ("_splitcycles_check.mat", 3, "check"),
    ("_splitcycles_osim.mat", 2, "osim"),
    ("_splitcycles.mat", 1, "base"),
)

_SIM_BODY = (
    r"([A-Za-z]+\d+)_\1_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}_[^_]+_[A-Za-z][A-Za-z0-9]*\d+(?:_[A-Za-z0-9-]+)*"
)
# fixed values: simulation output key -> (prefix, whole-name pattern after it, tail to cut)
SIM_KEYS = {
    "IK": ("IK_", _SIM_BODY + r"\.mot", r"\.[^.]*$"),
    "IK_filt": ("IK_filt_", _SIM_BODY + r"\.mot", r"\.[^.]*$"),
    "IK_markerErr": ("ik_marker_errors_", _SIM_BODY + r"(?:\.[A-Za-z0-9]+)?", r"\.[^.]*$"),
    "ID": ("ID_", _SIM_BODY + r"\.sto", r"(?i)\.sto$"),
    "SO_activation": ("SO_", _SIM_BODY + r"_StaticOptimization_activations?\.sto", r"(?i)_StaticOptimization_activations?\.sto$"),
    "SO_forces": ("SO_", _SIM_BODY + r"_StaticOptimization_forces?\.sto", r"(?i)_StaticOptimization_forces?\.sto$"),
    "JRL": ("JRL_", _SIM_BODY + r"_JointReaction_ReactionLoads\.sto", r"(?i)_JointReaction_ReactionLoads\.sto$"),
}


def parse_trial_names(files: DataFrame, name: str) -> DataFrame:
    """Name parts as columns; names of another form are dropped."""
    n = F.col(name)
    # the pattern has been met, so the first six underscores part the fields
    f = files.where(n.rlike(TRIAL_NAME)).withColumn("_p", F.split(n, "_", 7))
    part = lambda i: F.get("_p", F.lit(i))
    return f.withColumns(
        {
            "pid": part(0),
            "pid2": part(1),
            "datetime": F.concat_ws("_", part(2), part(3)),
            "session": part(4),
            "trial_full": part(5),
            "trial_base": F.regexp_replace(part(5), r"\d+$", ""),
            "rest": part(6),
        }
    ).drop("_p")


def trial_core(stem: str | Column) -> tuple[Column, Column]:
    """(core, base) of a cycle file stem, NULL when the name does not fit. The
    base leaves the processing steps out."""
    s = F.col(stem) if isinstance(stem, str) else stem
    fits = s.rlike(CORE_NAME)
    base = F.regexp_extract(s, CORE_NAME, 1)
    core = F.concat(base, F.regexp_extract(s, CORE_NAME, 2))
    return F.when(fits, core), F.when(fits, base)


def variant_priority(name: str | Column) -> tuple[Column, Column]:
    """(priority, variant) of a file name."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    prio, var = F.lit(0), F.lit("other")
    for suffix, p, v in reversed(VARIANTS):
        prio = F.when(n.endswith(suffix), p).otherwise(prio)
        var = F.when(n.endswith(suffix), v).otherwise(var)
    return prio, var


def best_variant(files: DataFrame, keys: Sequence[str], priority: str, path: str) -> DataFrame:
    """The file of highest priority per key; the first path on ties. One partial
    aggregate instead of a ranking window."""
    rest = [c for c in files.columns if c not in keys]
    return (
        files.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct((-F.col(priority)).alias("p"), F.col(path).alias("f"))).alias("_b"))
        .select(*keys, "_b.*")
    )


def trial_index(files: DataFrame) -> DataFrame:
    """Files numbered per participant and trial type in order of time and trial.
    A participant's files are split by month before they are ordered."""
    month = F.regexp_replace(F.substring("datetime", 1, 7), "[^0-9]", "").try_cast("bigint")
    return ordered_scan(
        files,
        ["pid", "trial_base"],
        ["datetime", "trial_full", "path"],
        row_no="pos",
        cell=F.coalesce(month, F.lit(0)),
    )


def match_sidecars(recordings: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Recordings (dir, stem) left-joined to the sidecar (dir, name) of the same
    folder and base name; ``.Trial`` names are preferred."""
    base = F.regexp_replace(F.col("name"), r"(?i)\.enf$", "")
    s = sidecars.where(F.lower("name").endswith(".enf")).select(
        "dir", F.lower(F.replace(base, F.lit(".Trial"), F.lit(""))).alias("_base"), F.col("name").alias("_side")
    )
    s = s.groupBy("dir", "_base").agg(
        F.min_by("_side", F.struct((~F.col("_side").contains(".Trial")).alias("p"), F.col("_side").alias("n"))).alias("sidecar")
    )
    return recordings.withColumn("_base", F.lower("stem")).join(s, ["dir", "_base"], "left").drop("_base")


def filter_trials(trials: DataFrame, mode: str, keywords: Sequence[str] = (), *, description: str = "description", name: str = "name", static: str | None = None) -> DataFrame:
    """all | enf (description starts with a keyword) | filename (name contains
    one). ``["__all"]`` keeps all; ``static`` drops descriptions holding it."""
    out = trials
    if mode not in ("all", "enf", "filename"):
        raise ValueError(f"unknown filter mode {mode}")
    if mode != "all" and list(keywords) != ["__all"]:
        desc = F.replace(F.trim(F.lower(F.col(description))), F.lit(" "), F.lit("_"))
        cond = F.lit(False)
        for k in keywords:
            cond = cond | (desc.startswith(k.lower()) if mode == "enf" else F.lower(name).contains(k.lower()))
        out = out.where(cond)
    if static:
        out = out.where(~F.contains(F.lower(F.col(description)), F.lit(static.lower())))
    return out


def match_task(trials: DataFrame, task: str, description: str = "description") -> DataFrame:
    """Trials whose description contains the task text."""
    return trials.where(F.contains(F.lower(F.col(description)), F.lit(task.lower())))


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of ``text``, itself if it is shorter."""
    n = F.char_length(text)
    some = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    return F.array_distinct(some)


def containing(needles: DataFrame, texts: DataFrame, keys: Sequence[str], needle: str, text: str, *, size: int = 3) -> DataFrame:
    """Pairs of rows with equal ``keys`` of which ``text`` contains ``needle``.

    Texts are indexed by their runs of up to ``size`` characters. A needle is
    looked up by that of its own runs which the fewest texts have, and what is
    found is verified, so no pair is made without a shared run. An empty needle is
    in every text; null is in none. Columns of both sides but the keys must differ.
    """
    keys = list(keys)
    runs = F.array_union(F.array_union(_grams(F.col(text), size), F.array(F.lit(""))), F.flatten(F.array(*[_grams(F.col(text), i) for i in range(1, size)])))
    index = texts.where(F.col(text).isNotNull()).withColumn("_gram", F.explode(runs))
    counts = index.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    words = needles.where(F.col(needle).isNotNull()).select(*keys, needle).distinct()
    each = words.withColumn("_gram", F.explode(_grams(F.col(needle), size))).join(counts, [*keys, "_gram"], "left")
    rare = F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram")
    chosen = each.groupBy(*keys, needle).agg(rare)
    found = chosen.join(index, [*keys, "_gram"]).where(F.contains(text, needle)).drop("_gram")
    return needles.join(found, [*keys, needle])


def resolve_subject_params(trials: DataFrame, sets: DataFrame) -> DataFrame:
    """Which parameter set of the folder belongs to a trial.

    Trials carry (trial_id, folder, subjects), sets (folder, base). Kept are the
    sets whose name contains a subject; ``kiste`` loses against others; without
    a hit the only set of the folder is taken; more than one left is an error.
    """
    named = sets.where("base IS NOT NULL").select("folder", "base").distinct()
    folders = named.groupBy("folder").agg(F.count(F.lit(1)).alias("_all"), F.min("base").alias("_any"))
    subjects = trials.select("trial_id", "folder", F.explode(F.array_distinct(F.transform("subjects", lambda s: F.lower(s)))).alias("_subject"))
    hits = containing(subjects, named.withColumn("_low", F.lower("base")), ["folder"], "_subject", "_low")
    # fixed value: name of the calibration object
    own = F.when(F.lower("base") != "kiste", F.col("base"))
    c = hits.groupBy("trial_id").agg(
        F.countDistinct("base").alias("_hits"),
        F.countDistinct(own).alias("_named"),
        F.min("base").alias("_one"),
        F.min(own).alias("_one_named"),
    )
    c = trials.select("trial_id", "folder").join(c, "trial_id", "left").join(folders, "folder", "left").fillna(0, ["_hits", "_named", "_all"])
    base = (
        F.when(F.col("_hits") == 1, F.col("_one"))
        .when((F.col("_hits") > 1) & (F.col("_named") == 1), F.col("_one_named"))
        .when((F.col("_hits") == 0) & (F.col("_all") == 1), F.col("_any"))
    )
    status = F.when(base.isNotNull(), "ok").when(
        (F.col("_hits") > 1) | (F.col("_all") > 1), "ambiguous"
    ).otherwise("none")
    return c.select("trial_id", base.alias("base"), status.alias("status"))


def index_sim_files(files: DataFrame, name: str, path: str) -> DataFrame:
    """(core, key, path) of the simulation outputs among the files, the core in
    lower case. Of several files for one core and key the last path stays."""
    n = F.col(name)
    options = []
    for key, (prefix, body, tail) in SIM_KEYS.items():
        core = F.regexp_replace(F.substr(n, F.lit(len(prefix) + 1)), tail, "")
        options.append(
            F.when(n.rlike(f"(?i)^{prefix}{body}$"), F.struct(F.lit(key).alias("key"), F.lower(core).alias("core")))
        )
    hit = files.select(F.col(path).alias("path"), F.explode(F.array_compact(F.array(*options))).alias("_k"))
    return hit.groupBy(F.col("_k.core").alias("core"), F.col("_k.key").alias("key")).agg(F.max("path").alias("path"))


def match_cores(trials: DataFrame, index: DataFrame) -> DataFrame:
    """Trials (trial_id, core, base) with their simulation files: exact core, or
    per key the first core that starts with the base when nothing is exact."""
    t = trials.select("trial_id", F.lower("core").alias("_core"), F.lower("base").alias("_base"))
    m = exact_or_prefix(t, index, "_core", "_base", "core", ["key", "path"], per=["key"])
    return m.select("trial_id", "key", "core", "path", "match")


def missing_files(trials: DataFrame, matched: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row per trial and expected key without a file."""
    want = trials.select("trial_id", F.explode(F.array(*[F.lit(e) for e in expected])).alias("key"))
    return want.join(matched.select("trial_id", "key").distinct(), ["trial_id", "key"], "left_anti").withColumn(
        "reason", F.lit("no matching file found")
    )


def missing_columns(headers: DataFrame, keys: Sequence[str], columns: str, wanted: Sequence[str]) -> DataFrame:
    """Wanted columns, whatever the case, that a header lacks."""
    have = F.transform(columns, F.lower)
    lack = F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: ~F.array_contains(have, F.lower(w)))
    return headers.select(*keys, F.array_sort(lack).alias("missing")).where(F.size("missing") > 0)


def match_stitch_sources(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """Full-trial file for each cycle file (``name``): same stem before
    ``_splitCycles``, first path that has time and a muscle channel."""
    stem = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), r"_splitCycles.*$", "")
    t = targets.withColumn("stem", stem)
    c = candidates.where(
        ~F.lower("name").contains("_splitcycles") & F.col("has_time") & (F.col("n_emg") > 0)
    ).select(F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), "path")
    first = c.join(t.select("stem").distinct(), "stem", "left_semi").groupBy("stem").agg(F.min("path").alias("source"))
    return t.join(first, "stem", "left")


def check_reasons(files: DataFrame, keywords: Sequence[str], static: str) -> DataFrame:
    """Why a file is or is not checked, from ``sidecar``, ``description`` and
    ``loadable``."""
    desc = F.lower("description")
    match = F.lit(list(keywords) == ["__all"])
    for k in keywords:
        match = match | desc.startswith(k.lower())
    reason = (
        F.when(F.col("sidecar").isNull(), "no_sidecar")
        .when(F.col("description").isNull(), "no_description")
        .when(~match, "keyword_miss")
        .when(F.contains(desc, F.lit(static.lower())), "static")
        .when(~F.col("loadable"), "load_error")
        .otherwise("checked")
    )
    return files.withColumn("reason", reason)


def resolve_ids(ids: DataFrame, column: str, requests: Sequence[str]) -> DataFrame:
    """Requested ids matched exactly whatever the case, else by substring; the
    request is the name to export under. Among substring hits the smallest id
    is taken."""
    low = F.lower(F.col(column).cast("string"))
    hits = ids.select(
        F.col(column).alias("id"),
        F.explode(
            F.filter(F.array(*[F.lit(r) for r in requests]), lambda r: F.contains(low, F.lower(r)))
        ).alias("request"),
    ).withColumn("_exact", F.lower(F.col("id").cast("string")) == F.lower("request"))
    return (
        hits.groupBy("request")
        .agg(F.min(F.struct((~F.col("_exact")).alias("x"), "id")).alias("_b"))
        .select("request", "_b.id", F.when(F.col("_b.x"), "substring").otherwise("exact").alias("match"))
    )


def sample_ids(ids: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """A repeatable sample of n ids (all when fewer), ordered by a seeded hash."""
    drawn = F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(seed)))
    return ids.select(column).distinct().orderBy(drawn, column).limit(n)


def limit_matched(files: DataFrame, task: str, n: int, *, description: str = "description", path: str = "path") -> DataFrame:
    """The first n files by path among those that match the task."""
    return match_task(files, task, description).orderBy(path).limit(n)


def distinct_users(audit: DataFrame, column: str = "username") -> DataFrame:
    """Trimmed, non-empty user names, once each, sorted."""
    return (
        audit.select(F.trim(F.col(column)).alias(column)).where(F.col(column) != "").distinct().orderBy(column)
    )
