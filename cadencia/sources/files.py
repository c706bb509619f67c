"""Reading recordings' companions: listings, sidecars, parameters, tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_scan


def _any_case(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)


def _path_parts(path: Column) -> list[Column]:
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    return [
        F.regexp_replace(path, r"/[^/]+$", "").alias("dir"),
        base.alias("basename"),
        F.regexp_replace(base, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(base, r"(\.[^.]*)$", 1)).alias("ext"),
    ]


def scan_files(spark: SparkSession, root: str, ext: str, *, prefix: str = "", suffix: str = "", contains: str = "") -> DataFrame:
    """files(path, dir, basename, stem, ext, length, mtime) below ``root`` with an
    extension in any case. File contents are not read."""
    glob = f"{prefix}*{suffix}{_any_case(ext)}"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    f = f.select("path", *_path_parts(F.col("path")), "length", F.col("modificationTime").alias("mtime"))
    return f.where(F.lower("basename").contains(contains.lower())) if contains else f


def _small_files(spark: SparkSession, paths: Sequence[str] | str, glob: str | None) -> DataFrame:
    r = spark.read.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    whole = r.text(paths, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: rows of a cell when lines carry their header along
LINES = 100_000


def text_lines(texts: DataFrame, path: str, text: str) -> DataFrame:
    """(path, position, line) of whole texts; either kind of line end."""
    lines = F.posexplode(F.split(text, r"\r?\n")).alias("position", "line")
    return texts.select(F.col(path).alias("path"), lines).withColumn("position", F.col("position").cast("bigint"))


def key_values(lines: DataFrame) -> DataFrame:
    """(path, line_no, key, value) of the KEY=VALUE lines among (path, position, line)."""
    kv = F.split("line", "=", 2)
    return lines.where(F.col("line").contains("=")).select(
        "path", F.col("position").alias("line_no"), F.trim(kv[0]).alias("key"), F.trim(kv[1]).alias("value")
    )


def read_key_values(spark: SparkSession, paths: Sequence[str] | str, *, glob: str | None = None) -> DataFrame:
    """(path, line_no, key, value) of the KEY=VALUE lines of sidecars."""
    return key_values(text_lines(_small_files(spark, paths, glob), "path", "text"))


def sidecar_facts(kv: DataFrame) -> DataFrame:
    """Per sidecar the first description, the first subject list (split at comma
    or space) and the foot of each force plate."""
    first = lambda k: F.min_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line_no")))
    plate = F.col("key").rlike(r"^FP\d+$")
    g = kv.groupBy("path").agg(
        first("DESCRIPTION").alias("description"),
        first("SUBJECTS").alias("_s"),
        F.array_sort(F.collect_set(F.when(plate, F.struct(F.col("key").alias("plate"), F.col("value").alias("side"))))).alias("plates"),
    )
    subjects = F.filter(F.split(F.lower("_s"), r"[,\s]+"), lambda x: x != "")
    return g.select("path", "description", subjects.alias("subjects"), "plates")


def dollar_params(lines: DataFrame) -> DataFrame:
    """(path, key, value) of the $KEY=VALUE lines among (path, position, line)."""
    kv = key_values(lines)
    return kv.where(F.col("key").startswith("$")).select("path", F.substr("key", F.lit(2)).alias("key"), "value")


def read_dollar_params(spark: SparkSession, paths: Sequence[str] | str, *, glob: str | None = None) -> DataFrame:
    """(path, key, value) of the $KEY=VALUE lines of subject parameter files."""
    return dollar_params(text_lines(_small_files(spark, paths, glob), "path", "text"))


def _lines(spark: SparkSession, paths: Sequence[str] | str, glob: str | None) -> DataFrame:
    """(path, block, position, line): a large file is read in splits, whose
    beginnings and the order of rows inside order its lines."""
    r = spark.read.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    block = F.col("_metadata.file_block_start").alias("block")
    return r.text(paths).select(
        F.col("_metadata.file_path").alias("path"), block, F.monotonically_increasing_id().alias("position"), F.col("value").alias("line")
    )


def _under_headers(rows: DataFrame, is_header: Column, is_data: Column) -> DataFrame:
    """Data rows with ``names``, the tokens of the header line last seen before
    them. Rows under no header are left out."""
    split = "block" in rows.columns
    cell = F.col("block") if split else F.floor(F.col("position") / LINES).cast("bigint")
    order = ["block", "position"] if split else ["position"]
    rows = rows.withColumns({"_head": F.coalesce(is_header, F.lit(False)), "_data": F.coalesce(is_data, F.lit(False))}).where("_head OR _data")
    found = ordered_scan(rows, ["path"], order, prevs={"names": F.when(F.col("_head"), F.col("tok"))}, cell=cell)
    return found.where("_data AND NOT _head AND names IS NOT NULL").drop("_head", "_data")


def _spaced(lines: DataFrame) -> DataFrame:
    return lines.withColumn("tok", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")).drop("line")


def sim_tables(lines: DataFrame, columns: Sequence[str] | None = None, *, with_status: bool = False) -> DataFrame:
    """Simulation tables among (path, position, line) as rows (path, t, column, v).

    A header row starts with ``time`` and holds until the next one; a data row
    starts with a number and has as many fields. Wanted columns are compared
    without case. A row of another number of fields has no values; ``with_status``
    keeps it, with its time, and adds ``status``: ok or field_count.
    """
    first = F.get("tok", F.lit(0))
    data = _under_headers(_spaced(lines), F.lower(first) == "time", first.try_cast("double").isNotNull() & (F.size("tok") > 1))
    fits = F.size("tok") == F.size("names")
    none = F.array(F.struct(F.lit(None).cast("string").alias("n"), F.lit(None).cast("string").alias("v")))
    j = data.select(
        "path",
        first.try_cast("double").alias("t"),
        F.when(fits, "ok").otherwise("field_count").alias("status"),
        F.explode(F.when(fits, F.arrays_zip(F.col("names").alias("n"), F.col("tok").alias("v"))).otherwise(none)).alias("_z"),
    )
    long = j.select("path", "t", F.col("_z.n").alias("column"), F.col("_z.v").try_cast("double").alias("v"), "status")
    wanted = F.lower("column") != "time"
    if columns is not None:
        wanted = wanted & F.lower("column").isin(*[c.lower() for c in columns])
    if with_status:
        return long.where(wanted | (F.col("status") != "ok"))
    return long.where(wanted).drop("status")


def read_sim_tables(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str] | None = None, *, glob: str | None = None, with_status: bool = False) -> DataFrame:
    """``sim_tables`` of files, which are read in splits."""
    return sim_tables(_lines(spark, paths, glob), columns, with_status=with_status)


def sim_headers(spark: SparkSession, paths: Sequence[str] | str, *, glob: str | None = None) -> DataFrame:
    """(path, columns) of simulation tables, for checks before they are read; of
    several headers of a file the first."""
    rows = _spaced(_lines(spark, paths, glob)).where(F.lower(F.get("tok", F.lit(0))) == "time")
    return rows.groupBy("path").agg(F.min_by("tok", F.struct("block", "position")).alias("columns"))


def marker_tables(lines: DataFrame) -> DataFrame:
    """Marker tables among (path, position, line) as rows (path, frame, t, marker,
    comp, v). A header row starts with ``Frame`` and holds until the next one; a
    marker's name stands over the first of its three columns and holds until the
    next name."""
    rows = lines.withColumn("tok", F.split("line", "\t")).drop("line")
    number = F.trim(F.get("tok", F.lit(0))).try_cast("bigint").isNotNull() & F.trim(F.get("tok", F.lit(1))).try_cast("double").isNotNull()
    cells = _under_headers(rows, F.get("tok", F.lit(0)).startswith("Frame"), number).select(
        "path",
        F.trim(F.get("tok", F.lit(0))).try_cast("bigint").alias("frame"),
        F.trim(F.get("tok", F.lit(1))).try_cast("double").alias("t"),
        "names",
        F.posexplode("tok").alias("pos", "_v"),
    ).where("pos >= 2")
    named = F.filter(F.slice("names", F.lit(3), F.greatest(F.col("pos") - 1, F.lit(0))), lambda n: F.trim(n) != "")
    comp = F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.pmod(F.col("pos") - 2, F.lit(3)) + 1).cast("int"))
    return cells.select(
        "path", "frame", "t", F.get(named, F.size(named) - 1).alias("marker"), comp.alias("comp"), F.trim("_v").try_cast("double").alias("v")
    ).where(F.col("marker").isNotNull() & F.col("v").isNotNull())


def read_marker_tables(spark: SparkSession, paths: Sequence[str] | str, *, glob: str | None = None) -> DataFrame:
    """``marker_tables`` of files."""
    return marker_tables(_lines(spark, paths, glob))


def read_result_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Flat per-cycle results with a header; unreadable fields become missing."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def flatten_events(docs: DataFrame) -> DataFrame:
    """Trial documents (trial_id, events{event_times, event_labels, kinetic}) to
    event rows, labels trimmed."""
    z = F.arrays_zip(
        F.col("events.event_times").alias("t"), F.col("events.event_labels").alias("label"), F.col("events.kinetic").alias("kinetic")
    )
    return docs.select("trial_id", F.posexplode(z).alias("event_id", "_e")).select(
        "trial_id", "event_id", F.col("_e.t").alias("t"), F.trim("_e.label").alias("label"), F.col("_e.kinetic").cast("boolean").alias("kinetic")
    )


def flatten_channels(docs: DataFrame, group: str) -> DataFrame:
    """One group of a trial document (time array and a map of channel arrays) to
    sample rows (trial_id, group, channel, idx, t, v). NaN becomes missing."""
    ex = docs.select("trial_id", F.col(f"{group}.time").alias("_t"), F.explode(f"{group}.channels").alias("channel", "_v"))
    s = ex.select("trial_id", "channel", F.posexplode(F.arrays_zip(F.col("_t").alias("t"), F.col("_v").alias("v"))).alias("idx", "_s"))
    v = F.col("_s.v").cast("double")
    return s.select("trial_id", F.lit(group).alias("group"), F.trim("channel").alias("channel"), "idx", F.col("_s.t").alias("t"), F.when(~F.isnan(v), v).alias("v"))


def with_status(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``status`` ok or error and the first failed check as ``message``. A check is
    a condition that must be true."""
    msg = F.lit(None).cast("string")
    for name, cond in reversed(list(checks.items())):
        msg = F.when(~F.coalesce(cond, F.lit(False)), name).otherwise(msg)
    return df.withColumn("message", msg).withColumn("status", F.when(F.col("message").isNull(), "ok").otherwise("error"))


def split_status(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows): one bad record never stops the others."""
    return df.where("status = 'ok'").drop("status", "message"), df.where("status <> 'ok'")
