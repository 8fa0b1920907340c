import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridwright.operators import statistics as st


@pytest.mark.parametrize("small", [10, 50_000])
def test_order_statistics(spark, monkeypatch, small):
    monkeypatch.setattr(st, "SMALL", small)
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), 5.0, -2.5, rng.randrange(10)]) for _ in range(2000)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    ranks = [0, 1, 500, 999, 1500, 1998, 1999]
    assert st.order_statistics(df, F.col("x"), ranks) == {r: sorted(map(float, values))[r] for r in ranks}


def test_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    assert st.percentiles(df, F.col("x"), [0.25, 0.5, 0.75]) == [1.75, 3.0, 5.5]
    assert st.percentiles(df.filter("false"), F.col("x"), [0.5]) == [None]
    assert statistics.median([1, 2, 4, 10]) == 3.0


@pytest.mark.parametrize("small", [10, 50_000])
def test_many_columns_at_once(spark, monkeypatch, small):
    monkeypatch.setattr(st, "SMALL", small)
    monkeypatch.setattr(st, "LISTS", 3)
    rng = random.Random(4)
    rows = [tuple(None if rng.random() < 0.1 * i else float(rng.choice([rng.gauss(0, 1), 3.0, rng.randrange(5)])) for i in range(4)) + (None,) for _ in range(700)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = st.percentiles_of(df, [F.col(c) for c in "abcde"], [0.5, 0.9])
    for i, of in enumerate(got[:4]):
        values = sorted(r[i] for r in rows if r[i] is not None)
        assert of[0] == pytest.approx(statistics.median(values))
        at = 0.9 * (len(values) - 1)
        assert of[1] == pytest.approx(values[int(at)] + (values[min(int(at) + 1, len(values) - 1)] - values[int(at)]) * (at - int(at)))
    assert got[4] == [None, None]


def test_modes_of_many_columns(spark):
    df = spark.createDataFrame([(0, "b", "2", None), (1, "a", "2", None), (2, "a", "10", None), (3, "b", "10", None)], "p int, x string, y string, z string")
    assert st.most_frequent_of(df, [F.col(c) for c in "xyz"], F.col("p")) == ["b", "2", None]
    assert st.most_frequent_of(df, [], F.col("p")) == []
