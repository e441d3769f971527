"""The training-data queries that SQL can express, against it."""

import duckdb
import pytest

from textloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "labels"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{SF}/{view}.parquet')")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pages_query_gives_whole_digest(spark):
    df = QUERIES["op4_html_extraction"](spark, SF)
    assert df.columns == ["page_id", "url", "text", "n_chars"] and df.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
