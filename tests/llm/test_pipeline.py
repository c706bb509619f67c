"""The queries of the subpackage on the smallest tables, and the pipeline's stages."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from cadencia.llm import ORACLE, QUERIES
from tests.llm.test_minhash import brute
from tests.llm.test_scans import private

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = [sorted(map(tuple, x[cols].astype(str).to_numpy().tolist())) for x in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_without_sql(spark, name):
    got = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op11') else 'documents'}.parquet").count()
    assert got.count() == (25 * 20 if name.startswith("op5") else n) or name.startswith("op6")


def test_registered():
    import __spark_entry__ as e

    assert {f"op{i}" for i in range(1, 11)} <= {q.split("_")[0] for q in e.queries()}
    assert "pipeline" in e.queries() and corpus_pipeline.ORACLE_SQL is None


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert out.columns == columns
        if name == "MinHash near-dedup":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            kept = {i for i, (n, root) in brute(rows, 5).items() if i == root}
            assert {r["doc_id"] for r in out.collect()} == kept
        if name == "PII":
            before = {r["doc_id"]: r["text"] for r in docs.collect()}
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(before) == set(after)
            assert not any(private(t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not private(t))
        docs = out
    assert docs.agg({"length": "max"}).first()[0] <= 2048
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(before)
