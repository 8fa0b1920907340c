"""Row positions and ordered buckets without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.sources.shared import shared_dir


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a long column: 0, 1, 2 ... in the given order.

    Rows are range-partitioned and sorted once and checkpointed; the partitions'
    row counts (one number each) give their offsets, and rows are counted within
    their partition. Rows of one order are told apart by where they were read, so
    that a repeated or missing key can fill several partitions.
    """
    shared_dir(df.sparkSession)
    keyed, keys = df.withColumn("__tie", F.monotonically_increasing_id()), [*order, F.col("__tie")]
    placed = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie").checkpoint()
    placed = placed.withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    offsets, total = [], 0
    for pid, n in sorted(tuple(r) for r in placed.groupBy("__pid").count().collect()):
        offsets.append((pid, total))
        total += n
    # As many rows as partitions.
    start = F.broadcast(df.sparkSession.createDataFrame(offsets, "__p int, __start long"))
    joined = placed.join(start, F.col("__pid") == F.col("__p"))
    # The id counts rows from 0 within a partition, in its lower 33 bits.
    return joined.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__pid", "__at", "__p", "__start")


def _place(x: Column, cuts: list, low: int = 0) -> Column:
    """How many cuts lie below x, by halving: log2(len(cuts)) comparisons."""
    if not cuts:
        return F.lit(low)
    middle = len(cuts) // 2
    return F.when(x > cuts[middle], _place(x, cuts[middle + 1 :], low + middle + 1)).otherwise(_place(x, cuts[:middle], low))


def bucketed(df: DataFrame, position: str, buckets: int | None = None) -> DataFrame:
    """df with ``__bucket``: a number that grows with the position, such that
    buckets hold about equally many rows.

    The bounds are approximate quantiles of the position: one aggregate, and as
    many numbers on the driver as there are buckets.
    """
    spark = df.sparkSession
    n = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    bounds = df.agg(F.percentile_approx(F.col(position), shares, 10_000)).first()[0] or []
    place = _place(F.col(position), sorted(set(bounds)))
    return df.withColumn("__bucket", F.when(F.col(position).isNotNull(), place).otherwise(-1))


def carried(df: DataFrame, position: str, values: dict[str, tuple[Column, Column]], forward: bool = True) -> DataFrame:
    """df with a column for each name: the nearest value at or before the row (or
    at or after it) for which the condition held.

    values: name to (value, condition). Each bucket of the position finds its own
    last value; the buckets' values (a row for each) are carried over in order
    and joined back, so that no task sees more than one bucket's rows.
    """
    placed = bucketed(df, position)
    pick = F.max_by if forward else F.min_by
    ends = placed.groupBy("__bucket").agg(*[pick(F.struct(v.alias("v")), F.when(c, F.col(position))).alias(n) for n, (v, c) in values.items()])
    order = F.col("__bucket") if forward else -F.col("__bucket")
    over = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("__bucket").alias("__b"), *[F.last(n, True).over(over).alias(f"__c_{n}") for n in values])
    inside = Window.partitionBy("__bucket").orderBy(F.col(position) if forward else F.col(position).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # As many rows as buckets: bounded by the number of shuffle partitions.
    joined = placed.join(F.broadcast(carry), F.col("__bucket") == F.col("__b"), "left")
    out = [F.coalesce(F.last(F.when(c, F.struct(v.alias("v"))), True).over(inside), F.col(f"__c_{n}"))["v"].alias(n) for n, (v, c) in values.items()]
    return joined.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], *out)
