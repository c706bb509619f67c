"""Compare a registered query with its SQL on DuckDB.

``python tests/oracle.py [sf_dir] [name ...]`` checks from the command line.
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cadencia.plans import ORACLE, QUERIES  # noqa: E402
from cadencia.session import build_session  # noqa: E402


def spark_session():
    return build_session(
        "cadencia-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="10g",
    )


def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object and len(df) and isinstance(df[c].iloc[0], (list, np.ndarray)):
            df[c] = df[c].map(lambda v: None if v is None else tuple(np.asarray(v).tolist()))
    rows = [tuple("~" if pd.isna(v) is True else v for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr), [(c, kind(df[c])) for c in df.columns]


def kind(s):
    if s.dtype == object:
        v = s.dropna()
        return type(v.iloc[0]).__name__ if len(v) else "none"
    return {"i": "num", "u": "num", "f": "num", "b": "bool"}.get(s.dtype.kind, s.dtype.kind)


def compare(spark, con, name, sf_dir):
    """None when equal, else a short description of the first difference."""
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLE:
        return None if len(got) else "no rows"
    want = con.execute(ORACLE[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    (g, gk), (w, wk) = canon(got), canon(want)
    if len(g) != len(w):
        return f"rows {len(g)} vs {len(w)}; spark {g[:2]}; sql {w[:2]}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return f"{len(bad)} of {len(g)} rows differ: {bad[:3]}"
    if not len(g):
        return "both empty"
    mism = [(a, b) for a, b in zip(gk, wk) if a != b and "none" not in (a[1], b[1])]
    return f"types {mism}" if mism else None


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = spark_session(), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for n in names:
        t = time.time()
        try:
            msg = compare(spark, con, n, sf)
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        failed += msg is not None
        tag = "exact" if n in ORACLE else "rows"
        print(f"{'FAIL' if msg else 'ok':4} {tag:5} {n:28} {time.time() - t:6.2f}s {msg or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
