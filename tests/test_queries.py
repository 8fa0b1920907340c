import pytest

import __spark_entry__ as entry_points
from gridwright.plans import catalog
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, data, con, name):
    same(catalog.QUERIES[name](spark, data), con, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_properties(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    from gridwright.plans.registry import run
    from gridwright.sources.grid import Grid

    grid = Grid.of(docs, "doc_id")
    once = run(grid, "remove-duplicates", {"mode": "one", "column": "text"})
    twice = run(once.grid, "remove-duplicates", {"mode": "one", "column": "text"})
    assert sorted(map(tuple, once.df.collect())) == sorted(map(tuple, twice.df.collect()))
    stats = once.stats()
    assert stats["duplicates_removed"] + stats["remaining"] == stats["rows"]


def test_plans(spark, data):
    """Filters and columns reach the scan; a hot key is cut before the shuffle."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    outliers = plan(catalog.QUERIES["outliers_zscore"](spark, data))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in outliers
    # NaN has to stay and cannot be pushed; columns of whole numbers have none.
    whole = catalog.Case("orders", "o_orderkey, o_custkey", "remove-outliers", {"column": "o_custkey", "threshold": 0.1}, None)
    assert "PushedFilters: [Or(" in plan(whole(spark, data))
    assert plan(catalog.QUERIES["dedupe_first"](spark, data)).count("WindowGroupLimit") >= 2
    assert "Exchange" not in plan(catalog.QUERIES["chain_clean"](spark, data))
    assert "SinglePartition" not in plan(catalog.QUERIES["fill_mean"](spark, data))
