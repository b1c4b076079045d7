"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

import __spark_entry__
from loomspace.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [q for q in QUERIES if q in ORACLES])
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    wanted = duck.sql(ORACLES[name])
    assert sorted(wanted.columns) == columns
    assert plain(tuple(r[c] for c in columns) for r in found.collect()) == plain(wanted.select(*columns).fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_core_queries_stay_without_the_training_data_operators(monkeypatch):
    for missing in ("loomspace.llm.queries", "corpus_pipeline", "xxhash"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, missing, None)
            for name in [n for n in sys.modules if missing == "xxhash" and (n.startswith("loomspace.llm") or n == "corpus_pipeline")]:
                m.delitem(sys.modules, name)
            assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) >= set(QUERIES) & set(ORACLES)
