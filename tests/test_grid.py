import json

import pytest
from pyspark.sql import functions as F

from gridwright.sources import grid as g
from gridwright.sources import wire
from gridwright.sources.positions import bucketed, carried


def test_headers_are_found_trimmed(text_grid):
    grid = text_grid(**{" a ": ["1"], "b": ["2"]})
    assert grid.index("a ") == 0
    with pytest.raises(KeyError):
        grid.index("A")


def test_repeated_headers_get_names():
    assert g.unique_names(["a", "A", "", "", "a_2"]) == ["a", "A_2", "column", "column_2", "a_2_2"]


def test_added_column_never_hides_another(text_grid, cells):
    grid = text_grid(a=["1", "2"]).add([("a", F.lit("x")), ("a", F.lit("y"))])
    assert grid.headers == ("a", "a_2", "a_3")
    assert cells(grid) == [("1", "x", "y"), ("2", "x", "y")]


def test_columns_and_rows(text_grid, cells):
    grid = text_grid(a=["0", "1", "2", "3"])
    assert cells(g.add_column(grid, "n", [1, 2.5, None]), "n") == [1.0, 2.5, None, None]
    assert cells(g.update_column(grid, "a", ["x"])) == ["x", None, None, None]
    with pytest.raises(KeyError):
        g.update_column(grid, " a", ["x"])
    assert cells(g.delete_rows(grid, [1, 1, 3, 9])) == ["0", "2"]
    assert cells(g.delete_rows(grid, [])) == ["0", "1", "2", "3"]
    assert g.delete_columns(g.add_column(grid, "n", [1]), [0]).headers == ("n",)
    assert g.column_names(grid) == ["a"]
    assert [r[0] for r in g.column_values(grid, 0).collect()] == ["0", "1", "2", "3"]


def test_range_promotes_its_first_row(text_grid, cells):
    grid = text_grid(a=["0", "h", "2", "3"], b=["x", None, "y", "z"])
    part = g.read_range(grid, [0, 1], 1, 2)
    assert part.headers == ("h", "")
    assert cells(part) == [("2", "y")]
    assert cells(g.read_range(grid, [0], 7, 9)) == []


def test_records(spark, cells):
    grid = g.from_records(spark, [{"a": 1, "b": "x"}, {"a": None, "c": 5}])
    assert grid.headers == ("a", "b")
    assert cells(grid) == [("1", "x"), ("", "")]
    assert [json.loads(r[0]) for r in g.to_records(grid).collect()] == [{"a": "1", "b": "x"}, {"a": "", "b": ""}]
    assert g.from_records(spark, []).headers == ()


def test_files_and_sheets(spark, tmp_path, text_grid, cells):
    grid = text_grid(a=["1", " 2"], b=["x", ""])
    g.write_files(grid, str(tmp_path / "c"), "csv", header=True)
    back = g.read_files(spark, str(tmp_path / "c"), "csv")
    assert sorted(r[0] for r in back.df.select("a").collect()) == [" 2", "1"] or sorted(r[0].strip() for r in back.df.select("a").collect()) == ["1", "2"]
    assert g.write_files(grid, str(tmp_path / "p")) == 2
    assert g.read_files(spark, str(tmp_path / "p")).df.count() == 2
    g.write_files(grid, str(tmp_path / "j"), "json")
    assert g.read_files(spark, str(tmp_path / "j"), "json").df.schema["a"].dataType.simpleString() == "string"
    assert g.add_sheet(grid, "some_sheet") == {"sheet": "some_sheet", "rows_written": 2}
    g.add_sheet(grid.keep([0]), "some_sheet")
    assert "some_sheet" in g.sheet_names(spark)
    assert g.read_sheet(spark, "some_sheet").headers == ("a",)
    with pytest.raises(KeyError):
        g.read_sheet(spark, "no_such_sheet")
    assert g.mark_cells(grid, "A1:B2", "#ff0") == {"range": "A1:B2", "color": "#ff0"}


def test_positions_of_any_order(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") * 7919 % 1000).cast("string").alias("s"))
    grid = g.Grid.of(df, ["s", "id"])
    rows = grid.df.select("s", "id", grid.position.alias("p")).collect()
    assert [(r.s, r.id) for r in sorted(rows, key=lambda r: r.p)] == sorted((r.s, r.id) for r in rows)
    assert sorted(r.p for r in rows) == list(range(1000))
    assert g.Grid.of(df.filter("false"), ["s", "id"]).df.count() == 0


def test_order_is_needed(spark):
    with pytest.raises(ValueError):
        g.Grid.of(spark.range(3)).position  # noqa: B018


def test_buckets_follow_the_position(spark):
    df = bucketed(spark.range(0, 10_000).withColumnRenamed("id", "p"), "p", 10)
    sizes = [r["count"] for r in df.groupBy("__bucket").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1200
    assert df.groupBy("__bucket").agg(F.min("p").alias("a"), F.max("p").alias("b")).orderBy("__bucket").select(F.lag("b").over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("__bucket")).alias("before"), "a").filter("before >= a").count() == 0


@pytest.mark.parametrize("forward", [True, False])
def test_carry_crosses_buckets(spark, forward):
    values = {3: "a", 400: "b", 7000: "c"}
    df = spark.range(0, 8000).withColumnRenamed("id", "p")
    v = F.when(F.col("p") == 3, "a").when(F.col("p") == 400, "b").when(F.col("p") == 7000, "c")
    got = {r.p: r.n for r in carried(df, "p", {"n": (v, v.isNotNull())}, forward).collect()}
    for p in range(0, 8000, 97):
        near = [k for k in values if (k <= p if forward else k >= p)]
        assert got[p] == (values[max(near) if forward else min(near)] if near else None)


def test_wire(spark, text_grid, cells):
    grid = text_grid(a=["1", None], b=["x", "y"])
    body = json.loads(wire.request(grid, "text-ops", {"column": "a"}))
    assert body["headers"] == ["a", "b"] and body["rows"] == [["1", "x"], [None, "y"]]
    with pytest.raises(ValueError):
        wire.request(grid, "text-ops", {}, most_rows=1)
    back, sheet, summary = wire.response(spark, json.dumps({"headers": ["h", "h"], "rows": [[1, "x"], [2, "y"]], "summary": "done"}))
    assert back.headers == ("h", "h") and cells(back, "h") == [1, 2] and sheet is None and summary == "done"
    back, sheet, _ = wire.response(spark, json.dumps({"new_sheet": {"name": "s", "headers": ["q"], "rows": []}}))
    assert sheet == "s" and back.headers == ("q",) and back.df.count() == 0
    assert wire.response(spark, json.dumps({"x": 1}))[0] is None
    with pytest.raises(RuntimeError):
        wire.response(spark, json.dumps({"error": "no"}))


def test_repeated_and_missing_order_keys(spark, cells):
    """Rows are numbered unless the caller vouches for the key."""
    from gridwright.plans.registry import run

    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "b"), (None, None), (2, "c")], "k int, v string")
    grid = g.Grid.of(df, "k")
    assert sorted(r[0] for r in grid.df.select(g.POS).collect()) == list(range(6))
    flags = run(grid, "detect-dup-key", {"key_columns": "v", "action": "flag"}).df.collect()
    assert len(flags) == 6 and sorted((r.v or "", r.is_duplicate_key) for r in flags) == [("", 0), ("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)]
    assert sorted(r.v or "" for r in run(grid, "detect-dup-key", {"key_columns": "v", "action": "remove_all"}).df.collect()) == ["", "c"]
    assert run(grid, "fill-missing", {"column": "v", "method": "ffill"}).df.filter("v is null").count() <= 1
    filled = run(grid, "fill-missing", {"column": "v", "method": "bfill"})
    assert filled.df.count() == 6 and filled.df.filter("v is null").count() == 0
    vouched = g.Grid.of(df.filter("v = 'c'"), "k", unique=True)
    assert vouched.df.first()[g.POS] == 2


def test_a_hot_order_key_fills_several_partitions(spark):
    df = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.col("id") * 0).otherwise(F.col("id")).cast("string").alias("k"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = g.Grid.of(df, "k").df
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_shared_folder(spark):
    from gridwright.sources.shared import discard, shared_dir, written

    back, path = written(spark.range(3), "some")
    assert path.startswith(shared_dir(spark)) and back.count() == 3
    discard(spark, path)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    from types import SimpleNamespace

    from gridwright.sources.shared import shared_dir

    def session(conf, checkpoint):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: conf), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint))

    with pytest.raises(RuntimeError):
        shared_dir(session(None, None))
    assert shared_dir(session(None, "hdfs://n/c")) == "hdfs://n/c" and shared_dir(session("hdfs://n/d", "hdfs://n/c")) == "hdfs://n/d"
