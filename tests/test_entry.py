"""Every query has a callable, every oracle a query, and a few are compared with DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([round(v, 6) if isinstance(v, float) else str(v) for v in r]) for r in frame.itertuples(index=False))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["dense_topk", "sparse_recall", "hybrid_topk", "chunk_fixed", "ledger_diff", "concept_graph", "ferment_report", "clean_markdown"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).fetchdf())
