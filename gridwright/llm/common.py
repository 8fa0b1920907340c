"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.sources.shared import discard, shared_dir, written  # noqa: F401

#: Words are runs of anything but these code points.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Each wanted name, with underscores put before it until df has no such column."""
    have, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name in have:
            name = f"_{name}"
        have.add(name)
        out.append(name)
    return out


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of about 8 MB, where the session leaves their size open: each
    task that hands texts to Python holds a batch or two outside the heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, size)


def in_turn(parts: Sequence[Broadcast]) -> Iterator[Any]:
    """The values of broadcast variables one after another. Of several only one is
    in a worker's memory at a time: it is read again from Spark's local copy."""
    for part in parts:
        yield part.value
        if len(parts) > 1:
            part.__dict__.pop("_value", None)
