"""Rule documents: defaults overlaid by a file, list keys, range checks."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import QcRules

# fixed values: keys that must be lists in a channel whitelist
LIST_KEYS = ("meta", "events", "point", "analog")

# fixed values: the three ways to state a force limit
FORCE_KINDS = {"": "abs", "_pcGRF": "pcGRF", "_pcBW": "pcBW"}


def load_rules(spark: SparkSession, path: str, defaults: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """One small JSON object through Spark's file layer, over the defaults."""
    text = spark.read.text(path, wholetext=True).first()[0]
    data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError("a rule document must be an object")
    return {**(defaults or {}), **data}


def whitelist_rules(data: Mapping[str, Any]) -> dict[str, Any]:
    """All keys kept; the four list keys become lists."""
    out = dict(data)
    for k in LIST_KEYS:
        if not isinstance(out.get(k), list):
            out[k] = []
    return out


def _force(so: Mapping[str, Any], stem: str) -> tuple[str, float]:
    have = [(kind, so[stem + tail]) for tail, kind in FORCE_KINDS.items() if stem + tail in so]
    if len(have) != 1:
        raise ValueError(f"exactly one form of so.{stem} is needed, found {len(have)}")
    return have[0][0], float(have[0][1])


def qc_rules(data: Mapping[str, Any]) -> QcRules:
    """Checked thresholds: positive numbers, no maximum below its RMS limit."""
    for section in ("ik", "so"):
        if section not in data:
            raise ValueError(f"missing section {section}")
    ik, so = data["ik"], data["so"]
    for section, key in (("ik", "marker_error_RMS_max"), ("ik", "marker_error_max_max"), ("so", "moment_rms_max"), ("so", "moment_max_max"), ("so", "so_ms_tol")):
        v = data[section].get(key)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0:
            raise ValueError(f"{section}.{key} must be a number of at least 0")
    r = QcRules(
        ik_rms_max=float(ik["marker_error_RMS_max"]),
        ik_max_max=float(ik["marker_error_max_max"]),
        so_ms_tol=float(so["so_ms_tol"]),
        force_rms=_force(so, "force_rms_max"),
        force_max=_force(so, "force_max_max"),
        moment_rms_max=float(so["moment_rms_max"]),
        moment_max_max=float(so["moment_max_max"]),
    )
    if r.ik_max_max < r.ik_rms_max or r.moment_max_max < r.moment_rms_max:
        raise ValueError("a maximum limit lies below its RMS limit")
    if r.force_rms[0] == r.force_max[0] and r.force_max[1] < r.force_rms[1]:
        raise ValueError("so.force_max_max lies below so.force_rms_max")
    return r


def label_lists(spark: SparkSession, data: Mapping[str, Any], keys=LIST_KEYS) -> DataFrame:
    """The list keys of a rule document as rows (section, label)."""
    doc = spark.createDataFrame([(json.dumps({k: data.get(k, []) for k in keys}),)], "doc string")
    m = F.from_json("doc", "map<string, array<string>>")
    return doc.select(F.explode(m).alias("section", "_l")).select("section", F.explode("_l").alias("label"))
