"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import discard, written


def connected_components(edges: DataFrame, most_rounds: int = 60, paths: list[str] | None = None) -> DataFrame:
    """node and component (its smallest node) for every node of edges (a long, b long).

    Each round links every node's larger neighbours to its smallest one, then
    does the same with the smaller ones, until only stars are left; that takes a
    number of rounds logarithmic in practice, none for stars. A node's smallest neighbour is an
    aggregate (combined before the shuffle) that is joined back, so the
    neighbours of one node never have to meet in a task. Each round is written
    to the shared folder. Self-links and repeated edges are harmless. paths: gets
    the table that the result reads, for the caller to discard.
    """
    spark = edges.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now, path = written(edges.filter("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "cc")
    for _ in range(most_rounds):
        # Done when every node has one link and no node that is linked to has any.
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("at")).union(now.select("v", F.lit(0), F.lit(1)))
        open_ = F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("at") > 0)))
        if not ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("at").alias("at")).agg(open_).first()[0]:
            break
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after, new_path = written(small, "cc")
        discard(spark, path)
        now, path = after, new_path
    else:
        raise RuntimeError("components did not settle")
    if paths is not None:
        paths.append(path)
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
