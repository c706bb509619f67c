"""Writing trials, reports, data sets and the audit trail."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: columns of the audit trail
COUNT_COLUMNS = [
    "left_kinetic_changed",
    "left_kinematic_changed",
    "right_kinetic_changed",
    "right_kinematic_changed",
    "left_kinetic_sel",
    "left_kinetic_unsel",
    "left_kinematic_sel",
    "left_kinematic_unsel",
    "right_kinetic_sel",
    "right_kinetic_unsel",
    "right_kinematic_sel",
    "right_kinematic_unsel",
]
AUDIT_COLUMNS = ["iso_datetime", "username", "pid", "trial_type", *COUNT_COLUMNS]


def check_name(name: str | Column) -> Column:
    """Name of the reviewed copy; a name that is one already stays."""
    n = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(n, r"(?i)\.mat$", "")
    return F.when(F.lower(n).endswith("_check.mat"), n).otherwise(F.concat(stem, F.lit("_check.mat")))


def stage_name(name: str | Column, suffix: str) -> Column:
    """Name of a stage's output: the suffix goes before the extension."""
    n = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(n, r"(?i)\.[^./]*$", f"_{suffix}.mat")


def mirrored_path(path: str | Column, source_root: str, target_root: str) -> Column:
    """The same relative folder under another root."""
    p = F.col(path) if isinstance(path, str) else path
    rel = F.substr(p, F.lit(len(source_root.rstrip("/")) + 1))
    return F.when(p.startswith(source_root.rstrip("/") + "/"), F.concat(F.lit(target_root.rstrip("/")), rel))


def write_trial_outputs(df: DataFrame, root: str, *, keys: Sequence[str] = ("pid", "trial_id"), salt: str | None = None, salts: int = 1) -> None:
    """One folder per trial; only the folders of trials in ``df`` are replaced.

    ``salt`` is a column whose hash spreads a large trial over several files.
    """
    by = [F.col(k) for k in keys]
    if salt:
        by.append(F.pmod(F.xxhash64(salt), F.lit(salts)))
    (
        df.repartition(*by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(root)
    )


def write_report_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """One folder per table: parquet, csv with header, or json lines."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(f"{root.rstrip('/')}/{name}")


def mapping_json(mapping: DataFrame) -> DataFrame:
    """(sid, doc): the swaps of a subject as one JSON object, for a file per
    subject. A subject has as many swaps as channels at most."""
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "dst"))))
    return mapping.groupBy("sid").agg(F.to_json(m).alias("doc"))


def write_dataset(waves: DataFrame, root: str, run_id: str) -> None:
    """Waves with their row facts under a run; earlier runs stay."""
    (
        waves.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(root)
    )


def read_newest(spark: SparkSession, root: str) -> DataFrame:
    """The waves of the latest run. Run ids sort by time."""
    df = spark.read.parquet(root).withColumn("run_id", F.col("run_id").cast("string"))
    newest = df.agg(F.max("run_id")).scalar()
    return df.where(F.col("run_id") == newest)


def audit_rows(counts: DataFrame, changes: DataFrame, username: str, stamp: str) -> DataFrame:
    """Audit rows of a save: (pid, trial_type) with 4 change and 8 final counts,
    only where something changed.

    ``counts`` and ``changes`` are (pid, trial_type, side, mode, ...): selected
    and unselected, and changed.
    """
    key = ["pid", "trial_type"]
    cell = lambda s, m: (F.col("side") == s) & (F.col("mode") == m)
    pairs = [(s, m) for s in ("left", "right") for m in ("kinetic", "kinematic")]
    tot = lambda c, s, m: F.coalesce(F.sum(F.when(cell(s, m), F.col(c))), F.lit(0)).cast("bigint")
    ch = changes.groupBy(*key).agg(*[tot("changed", s, m).alias(f"{s}_{m}_changed") for s, m in pairs])
    fin = counts.groupBy(*key).agg(
        *[tot(c, s, m).alias(f"{s}_{m}_{n}") for s, m in pairs for c, n in (("selected", "sel"), ("unselected", "unsel"))]
    )
    any_change = sum((F.col(f"{s}_{m}_changed") for s, m in pairs), F.lit(0)) > 0
    out = fin.join(ch, key).where(any_change)
    return out.withColumns({"iso_datetime": F.lit(stamp), "username": F.lit(username)}).select(*AUDIT_COLUMNS)


def append_audit(rows: DataFrame, root: str) -> None:
    """Rows appended under their participant and trial type."""
    rows.write.mode("append").partitionBy("pid", "trial_type").parquet(root)


def profile_samples(samples: DataFrame, keys: Sequence[str], t: str, v: str) -> DataFrame:
    """Size, time range, value range and missing values per key."""
    x = F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(x).alias("n_valid"),
        F.min(t).alias("t_min"),
        F.max(t).alias("t_max"),
        F.min(x).alias("v_min"),
        F.max(x).alias("v_max"),
    )


def schema_tree(df: DataFrame) -> list[tuple[str, str]]:
    """(dotted path, type) of every leaf of a nested schema."""
    out: list[tuple[str, str]] = []

    def walk(name: str, t: T.DataType) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(f"{name}.{f.name}" if name else f.name, f.dataType)
        elif isinstance(t, T.ArrayType):
            walk(f"{name}[]", t.elementType)
        elif isinstance(t, T.MapType):
            walk(f"{name}{{}}", t.valueType)
        else:
            out.append((name, t.simpleString()))

    walk("", df.schema)
    return out
