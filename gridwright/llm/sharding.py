"""Sharding by global byte-size prefix sums.

Rows are range-partitioned by an order key, each partition's bytes are summed,
the sums of the partitions before it give every partition its offset in the
whole corpus, and the byte line is cut at equal targets. Shards are contiguous
in the order key and differ by about one row's size.

Only one number per partition (and one per partition and shard it touches)
reaches the driver; rows never do.

Defined results: a null text has size ``overhead``; a very long text is one row in
one shard; null order keys come first; rows that tie in the order key are ordered by the remaining tie columns,
and rows equal in all of those are interchangeable; an empty table gives an
empty result. Extra columns are carried along, whatever their names, but for
those named like the two results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.llm.common import free_names, shared_dir, small_batches, table


def shard_by_bytes(df: DataFrame, size: Column, order_by: list[str], n_shards: int = 24, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """df with an int shard (0 to n_shards - 1) and a long slot, gapless from 0 in each shard.

    size: bytes of a row, at least 1. A row goes to the shard in whose share of
    the byte line its middle lies.
    """
    shared_dir(df.sparkSession)
    small_batches(df.sparkSession)
    b, tie, pid = free_names(df, "__bytes", "__tie", "__pid")
    # The tie column only spreads rows which are equal in order_by, so that one
    # repeated key can fill several partitions.
    keyed = df.withColumns({b: size.cast("long"), tie: F.monotonically_increasing_id()})
    keys = [F.col(c).asc_nulls_first() for c in order_by] + [F.col(b), F.col(tie)]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie).checkpoint()
    placed = placed.withColumn(pid, F.spark_partition_id())

    totals = {r[0]: r[1] for r in placed.groupBy(pid).agg(F.sum(b)).collect()}
    whole, at, offsets = sum(totals.values()), 0, {}
    for p in sorted(totals):
        offsets[p] = at
        at += totals[p]

    def cut(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        # 2 * start + size is twice the row's middle: whole numbers throughout.
        return np.minimum((2 * start + sizes) * n_shards // (2 * whole), n_shards - 1)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
        """Each batch with its partition's number and its rows' shards."""
        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            p, sizes = batch.column(pid)[0].as_py(), batch.column(b).to_numpy()
            ends = np.cumsum(sizes) + offsets[p] + done
            done += int(sizes.sum())
            yield batch, p, cut(ends - sizes, sizes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: dict[tuple[int, int], int] = {}
        for _, p, shard in shards(batches):
            for s, n in zip(*np.unique(shard, return_counts=True)):
                here[p, int(s)] = here.get((p, int(s)), 0) + int(n)
        rows = [(p, s, n) for (p, s), n in here.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["p", "s", "n"])

    first_slot: dict[tuple[int, int], int] = {}
    seen: dict[int, int] = {}
    for p, s, n in sorted(tuple(r) for r in placed.select(pid, b).mapInArrow(counted, "p long, s long, n long").collect()):
        first_slot[p, s] = seen.get(s, 0)
        seen[s] = seen.get(s, 0) + n

    kept = [f for f in df.schema.fields if f.name.lower() not in (shard_col.lower(), slot_col.lower())]
    names = [f.name for f in kept]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[int, int] = {}
        for batch, p, shard in shards(batches):
            slot = np.empty(len(shard), dtype=np.int64)
            for s in np.unique(shard).tolist():
                mine = np.flatnonzero(shard == s)
                at = first_slot[p, s] + used.get(s, 0)
                slot[mine] = np.arange(at, at + len(mine))
                used[s] = used.get(s, 0) + len(mine)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(shard, pa.int32()), pa.array(slot)], [*names, shard_col, slot_col])

    schema = T.StructType([*kept, T.StructField(shard_col, T.IntegerType()), T.StructField(slot_col, T.LongType())])
    return placed.select(*names, pid, b).mapInArrow(dealt, schema)


def document_bytes(text: Column, overhead: int = 8) -> Column:
    """UTF-8 bytes of the text (null: none) plus what the shard format adds to each record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lean = docs.select(
        "doc_id",
        document_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
    )
    out = shard_by_bytes(lean, F.col("size"), ["doc_id", "text_crc32"], n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
