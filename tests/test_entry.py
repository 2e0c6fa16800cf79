import importlib
import os
import sys

import pytest

DATA = "/root/testdata/sf0.001"


def test_contract():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "graphloom")):
        if "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "graphloom.llm" not in open(os.path.join(folder, f)).read()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    df = sys.modules["__spark_entry__"].entry(spark)
    assert df.count() > 0 and "messageId" in df.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["ic5", "bi3", "bi12", "reply_roots", "degree_stats", "edge_kind_counts", "text_locate"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    e = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = e.queries()[name](spark, DATA).toPandas(), con.execute(e.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda d: sorted(tuple(map(str, r)) for r in d[cols].itertuples(index=False))
    assert plain(got) == plain(want)
