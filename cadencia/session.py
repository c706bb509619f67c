"""SparkSession defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "cadencia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, Arrow and adaptive execution switched on.

    ``master`` is left to spark-submit unless given, so the same code runs on a
    cluster; extra settings go in ``conf`` with ``__`` standing for a dot.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def cut_lineage(df):
    """Checkpoint ``df`` in the folder the session names.

    The cluster sets ``spark.checkpoint.dir`` to shared storage, so the rows
    outlive a lost executor. Only a local master without that setting falls
    back to a temporary folder.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="cadencia-ckpt-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
