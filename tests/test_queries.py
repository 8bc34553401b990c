"""Every named query with SQL against DuckDB, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_module
from docketry.plans.oracles import ORACLES
from docketry.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) and not math.isnan(value) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = entry_module.queries()[name](spark, SF)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(plain(row[names.index(c)]) for c in got.columns) for row in result.fetchall())
    assert Counter(tuple(map(plain, r)) for r in got.collect()) == want


def test_entry_has_a_stable_schema(spark):
    assert entry_module.entry(spark).columns == ["lookup", "overall", "n", "n_candidates"]


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_extraction_reads_texts_once_and_joins_on_keys(spark):
    plan = QUERIES["extracted_citations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    plan = QUERIES["citation_verdicts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
