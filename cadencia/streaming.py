"""Streams: online cycles, sessions and sliding summaries, incremental ingest.

Each function turns a streaming DataFrame into one; ``drain`` runs a stream over
what has arrived and ends, so that a later run with the same folders goes on
where it stopped.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .session import cut_lineage

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut_lineage(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, int]:
    """Append what ``stream`` gives for all files that have arrived to ``out``.

    Returns all rows of ``out`` and how many rows came too late in this run.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    q.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    return spark.read.schema(stream.schema).parquet(out), late


# --- online cycles

CYCLES = "cycle_type string, cycle_no long, t_start double, t_central double, t_end double, central_pct double"
LATE = "late"


class _Cycles(StatefulProcessor):
    """The open starts of one series, and events not yet old enough to be in order."""

    def __init__(self, definitions: Mapping[str, Sequence[str]], keys: Sequence[str], delay: float, patience: float | None):
        self.definitions = {k: list(v) for k, v in definitions.items()}
        self.keys, self.delay, self.patience = list(keys), delay, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", T.StructType([T.StructField("json", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.state.get()[0]) if self.state.exists() else {"held": [], "last": None, "top": None, "of": {}}
        out: list[tuple] = []
        for pdf in rows:
            for e in zip(pdf["t"].tolist(), pdf["label"].tolist(), pdf["event_id"].tolist()):
                if s["last"] is not None and list(e) <= s["last"]:
                    out.append((LATE, e[2], e[0], None, None, None))
                else:
                    s["held"].append(list(e))
                    s["top"] = e[0] if s["top"] is None else max(s["top"], e[0])
        s["held"].sort()
        ready = [e for e in s["held"] if e[0] <= s["top"] - self.delay] if s["held"] else []
        s["held"] = s["held"][len(ready) :]
        for t, label, event_id in ready:
            s["last"] = [t, label, event_id]
            for name, labels in self.definitions.items():
                out += self._step(s["of"].setdefault(name, {"n": 0, "starts": [], "open": []}), name, labels, t, label)
        self.state.update((json.dumps(s),))
        if out:
            named = pd.DataFrame(out, columns=["cycle_type", "cycle_no", "t_start", "t_central", "t_end", "central_pct"])
            for c in ("t_central", "t_end", "central_pct"):
                named[c] = named[c].astype("float64")
            for i, k in enumerate(self.keys):
                named.insert(i, k, key[i])
            yield named

    def _step(self, of: dict, name: str, labels: list[str], t: float, label: str) -> list[tuple]:
        """Cycles that end here; then starts that get their central event, then a new start."""
        done = []
        if label == labels[-1] and of["open"]:
            for no, start, central in of["open"]:
                pct = None if central is None else 0.0 if t == start else (central - start) / (t - start) * 100
                done.append((name, no, start, central, t, pct))
            of["open"] = []
        if len(labels) == 3 and label == labels[1] and of["starts"]:
            of["open"] += [[no, start, t] for no, start in of["starts"]]
            of["starts"] = []
        if label == labels[0]:
            of["n"] += 1
            if len(labels) == 3:
                of["starts"].append([of["n"], t])
            else:
                of["open"].append([of["n"], t, None])
        if self.patience is not None:
            of["starts"] = [x for x in of["starts"] if x[1] >= t - self.patience]
            of["open"] = [x for x in of["open"] if x[1] >= t - self.patience]
        return done

    def close(self) -> None:
        pass


def online_cycles(events: DataFrame, definitions: Mapping[str, Sequence[str]], keys: Sequence[str], *, delay: float = 0.0, patience: float | None = None) -> DataFrame:
    """Cycles of a stream (keys, t, label, event_id) as soon as they end.

    All definitions are followed in one pass; a cycle is what
    ``cycles.extract_cycles`` gives for the events of its series in order of t,
    label and event_id, whatever micro-batches they come in. An event is held back
    until its series has reached ``delay`` seconds after it; one that comes after
    a later event was used is late and returned as a row of type ``late`` with its
    event_id and time. The state of a series is its held events and its open
    starts; ``patience`` seconds after a start without an end it is given up, which
    bounds the state of a series whose ends never come.
    """
    schema = T.StructType([*[events.schema[k] for k in keys], *T._parse_datatype_string(CYCLES)])
    return events.select(*keys, "t", "label", "event_id").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Cycles(definitions, keys, delay, patience), outputStructType=schema, outputMode="Append", timeMode="None"
    )


# --- sessions and sliding summaries


def _summary(value: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value).alias("mean")]


def sessions(events: DataFrame, keys: Sequence[str], time: str, gap: str, value: str, *, delay: str | None = None) -> DataFrame:
    """Runs of events of a series with pauses shorter than ``gap``, and their values.

    Works on tables and, with a ``delay`` after which rows are too late, on streams.
    """
    rows = events.withWatermark(time, delay) if delay else events
    found = rows.groupBy(*keys, F.session_window(time, gap).alias("_w")).agg(*_summary(value))
    return found.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "lowest", "highest", "mean")


def sliding(events: DataFrame, keys: Sequence[str], time: str, width: str, step: str, value: str, *, delay: str | None = None) -> DataFrame:
    """Summaries of windows of ``width`` that begin every ``step``; as ``sessions`` otherwise."""
    rows = events.withWatermark(time, delay) if delay else events
    found = rows.groupBy(*keys, F.window(time, width, step).alias("_w")).agg(*_summary(value))
    return found.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "lowest", "highest", "mean")


# --- ingest


def files(spark: SparkSession, folder: str, schema: T.StructType, *, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in ``folder``, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(folder)


def once(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first row of each key; a repetition counts if it comes within ``delay`` of event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def arrive(table: DataFrame, folder: str, order: str, slices: int) -> None:
    """Write ``table`` into ``folder`` as files of ``slices`` runs by ``order``, one after the other.

    For replaying a table as a stream. Where runs begin is taken from
    approximate quantiles, so that rows never pass through the driver.
    """
    cuts = table.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)], 1000).alias("c")).first()["c"] or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:]):
        part = table.where((F.lit(True) if low is None else F.col(order) >= F.lit(low)) & (F.lit(True) if high is None else F.col(order) < F.lit(high)))
        part.coalesce(1).write.mode("append").parquet(folder)
