import pytest

from gridwright.plans.registry import STATELESS
from gridwright.streaming.stateless import clean_stream

STEPS = [("text-ops", {"column": "event_type", "operation": "uppercase"}), ("invalid-values", {"column": "value", "min_val": "10", "max_val": "100"}), ("date-standardize", {"column": "ts", "output_format": "unix"})]


def test_stream_equals_batch(spark, data, tmp_path):
    batch = spark.read.parquet(f"{data}/events.parquet").select("event_id", "ts", "event_type", "value")
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = clean_stream(stream, STEPS).writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("cleaned").collect())) == sorted(map(tuple, clean_stream(batch, STEPS).collect()))


def test_tools_over_the_whole_table_are_refused(spark):
    with pytest.raises(ValueError):
        clean_stream(spark.range(3), [("remove-duplicates", {})])
    assert "fill-missing" not in STATELESS
