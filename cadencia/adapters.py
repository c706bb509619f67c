"""Driver tables seen as the canonical tables of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(c: str):
    """Seconds since 1970 of a zone-free timestamp, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})") / F.lit(1e6)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events(trial_id, event_id, t, label, value, kinetic)."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trial_id"),
        "event_id",
        epoch_seconds("ts").alias("t"),
        F.col("event_type").alias("label"),
        "value",
        (F.col("value") > 50).alias("kinetic"),
    )


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """waves(sample_id, subject, side, label, cluster, wave)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        (F.col("vec_id") % 20).cast("bigint").alias("subject"),
        F.when(F.col("vec_id") % 2 == 0, "L").otherwise("R").alias("side"),
        F.concat(F.lit("m"), F.col("label").cast("string")).alias("label"),
        F.col("label").alias("cluster"),
        F.col("embedding").cast("array<double>").alias("wave"),
    )


def points(waves_df: DataFrame, *carry: str) -> DataFrame:
    """waves as long rows (carry..., idx, v)."""
    return waves_df.select(*carry, F.posexplode("wave").alias("idx", "v"))
