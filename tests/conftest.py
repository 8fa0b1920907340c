import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip(f"{DATA} is not there")
    return DATA


@pytest.fixture
def text_grid(spark):
    """A grid of text columns from lists of cells, in row order."""
    from gridwright.sources.grid import POS, Grid

    def make(**columns):
        names, n = list(columns), len(next(iter(columns.values())))
        rows = [(i, *[columns[c][i] for c in names]) for i in range(n)]
        df = spark.createDataFrame(rows, f"{POS} long, " + ", ".join(f"`{c}` string" for c in names))
        return Grid(df, tuple(names), tuple(names), True)

    return make


@pytest.fixture
def cells():
    """A grid's rows in order, each a tuple; single columns as plain values."""

    def read(grid, *columns):
        from gridwright.sources.grid import POS

        df = grid.df.orderBy(POS) if grid.ordered else grid.df
        picked = [grid.columns[grid.index(c)] for c in columns] or list(grid.columns)
        rows = [tuple(r[c] for c in picked) for r in df.collect()]
        return [r[0] for r in rows] if len(picked) == 1 else rows

    return read
