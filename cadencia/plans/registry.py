"""Named queries over the driver tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the same result in plain SQL."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Six decimals; the tiny shift keeps summation order from flipping ties."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1e-9), 6) + F.lit(0.0)


def n64(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


EV = """ev AS (
  SELECT user_id AS trial_id, event_id, epoch_us(ts) / 1e6 AS t, event_type AS label,
         value, value > 50 AS kinetic FROM events),
sq AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY t, label, event_id) AS seq FROM ev)"""

WAVES = """w AS (
  SELECT vec_id AS sample_id, CAST(vec_id % 20 AS BIGINT) AS subject,
         CASE WHEN vec_id % 2 = 0 THEN 'L' ELSE 'R' END AS side,
         'm' || CAST(label AS VARCHAR) AS label, label AS cluster,
         CAST(embedding AS DOUBLE[]) AS wave FROM embeddings),
pt AS (SELECT sample_id, subject, side, label, cluster,
         unnest(range(0, len(wave))) AS idx, unnest(wave) AS v FROM w)"""


def r6s(e: str) -> str:
    return f"(round(({e}) + 1e-9, 6) + 0.0)"
