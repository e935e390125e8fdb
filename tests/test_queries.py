"""Every query with SQL gives the rows that DuckDB gives; plans keep the shape they should have."""

import hashlib
import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from corpuloom.plans.stored import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(frame):
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return repr(float(x)) if not isinstance(x, str | bytes) and hasattr(x, "__float__") else str(x)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, db, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(db.sql(SQL[name]).df())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fts_bm25_and_topk", "flt_find_name_topk", "top_claim"])
def test_top_k_plans_without_full_sort(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "TakeOrderedAndProject" in text
    assert "CartesianProduct" not in text


def test_filters_reach_the_scan(spark, sf):
    text = plan(QUERIES["rel_pricing_summary"](spark, sf))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in text
    assert "l_orderkey" not in text


def test_no_python_in_native_queries(spark, sf):
    for name in ("fts_bm25_and_topk", "str_prose_score", "flt_grep_lines", "agg_dup_bytes"):
        assert "Python" not in plan(QUERIES[name](spark, sf))


def test_the_driver_may_import_before_there_is_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, check=False)
    assert said.returncode == 0, said.stderr


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_head_hash_of_long_texts(spark, tmp_path):
    texts = {1: "short", 2: "x" * 65_536, 3: "y" * 65_537, 4: "é" * 50_000, 5: "a" + "é" * 50_000}  # the last is cut within a character
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(QUERIES["hsh_head_hash"](spark, str(tmp_path)).collect())
    raw = {i: t.encode() for i, t in texts.items()}
    assert got == {i: hashlib.sha256(b[:65_536] + b"\0" + str(len(b)).encode()).hexdigest() for i, b in raw.items()}
