import pytest

from gridwright.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, data, name):
    same(QUERIES[name](spark, data), connect(data), ORACLE_SQL[name])


def test_names():
    import __spark_entry__
    import corpus_pipeline

    names = [n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op")]
    assert sorted(names) == sorted(["pipeline", *QUERIES]) and __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))


@pytest.mark.parametrize("name", ["op6_url_filter", "op9_pii", "op10_source_mixing"])
def test_native(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
