"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Every source gets a target in words: its weight's share of all words, but at
   most ``max_repeats`` times what it has; the excess goes to the others by
   weight (solved in one pass over the sources, ordered by where they saturate).
2. The mix is cut into equal blocks of ``block_words`` words and the blocks are
   apportioned to the sources by highest quotients target / (2k - 1). Rounding
   target / (words per block) is that method with the divisor fixed; the few
   seats that are then missing or too many are settled by the quotients at the
   margin, so no list of all quotients is ever made.
3. Within a source the blocks are apportioned again, to its shards of about
   ``shard_rows`` documents, by the shards' words. A large source has many
   shards, so no task handles more than a shard's rows.
4. Within a shard, documents stand in an order seeded by ``seed``; whole passes
   take everything, and the rest of the quota takes the first blocks.

A document's shard and place come from a hash of id, size and, among rows equal in
id, source and size, its number: such rows are counted first and told apart again
from the count, ``copies_per_row`` at a time, so rows without an id, or all under one,
are dealt out like others.

DataFrame functions only. Text is read once, to count words (very long ones too);
shuffles carry (doc_id, source, size). The one window without partitions runs over
one row per source, never over documents.

Defined results: null or empty texts have size 0 and are never taken; null
sources form one source that comes last; repeated rows are documents of their own,
and interchangeable; ties of quotients go to the smaller rank or shard; an empty
table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import table, word_count, written


def _apportion(cells: DataFrame, key: list[str], seats: Column, votes: Column, per: list[str], tie: str) -> DataFrame:
    """cells with a long ``quota``: the seats of each group ``per``, by votes.

    Rounded shares first, then the highest (or lowest) quotients at the margin;
    of equal quotients the smaller ``tie`` has precedence.
    A cell's quota moves by at most its share of half the number of cells plus
    one, so that many quotients per cell suffice: about 2.5 per cell in all.
    """
    group = Window.partitionBy(*per) if per else Window.partitionBy(F.lit(0))
    base = cells.withColumns({"__votes": votes.cast("double"), "__seats": seats}).withColumns({"__all": F.sum("__votes").over(group), "__cells": F.count(F.lit(1)).over(group)})
    base = base.withColumn("__q", F.when(F.col("__all") > 0, F.floor(F.col("__votes") * F.col("__seats") / F.col("__all") + 0.5)).otherwise(0).cast("long"))
    base = base.withColumn("__delta", F.when(F.col("__all") > 0, F.col("__seats") - F.sum("__q").over(group)).otherwise(0))
    reach = (F.ceil(F.col("__votes") / F.col("__all") * F.col("__cells") / 2) + 1).cast("int")
    tried = base.filter((F.col("__delta") != 0) & (F.col("__votes") > 0)).select(*dict.fromkeys(per + key), tie, "__votes", "__q", "__delta", F.explode(F.sequence(F.lit(1), reach)).alias("__k"))
    up = F.col("__delta") > 0
    seat = F.when(up, F.col("__q") + F.col("__k")).otherwise(F.col("__q") - F.col("__k") + 1)
    tried = tried.withColumn("__seat", seat).filter("__seat > 0").withColumn("__quotient", F.col("__votes") / (2 * F.col("__seat") - 1))
    first = (Window.partitionBy(*per) if per else Window.partitionBy(F.lit(0))).orderBy(F.when(up, -F.col("__quotient")).otherwise(F.col("__quotient")), F.when(up, F.col(tie)).otherwise(-F.col(tie)), F.col("__k"))
    moved = tried.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= F.abs("__delta")).groupBy(*key).agg(F.sum(F.when(up, 1).otherwise(-1)).alias("__moved"))
    joined = base.join(moved.select(*[F.col(k).alias(f"__m_{k}") for k in key], "__moved"), [F.col(k) == F.col(f"__m_{k}") for k in key], "left")
    return joined.withColumn("quota", F.col("__q") + F.coalesce("__moved", F.lit(0))).select(*cells.columns, "quota")


def source_targets(sized: DataFrame, weights: Column, max_repeats: int = 3) -> DataFrame:
    """One row per source: rank (from 1), source_size, source_rows, weight, target.

    weights: an expression over ``rank``. Sources come in code point order, null last.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    one = Window.partitionBy(F.lit(0))
    ranked = totals.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").isNull(), F.col("source"))).cast("long")).withColumn("weight", weights.cast("double"))
    cap = F.lit(max_repeats) * F.col("source_size")
    ranked = ranked.withColumn("__full", cap / F.col("weight"))
    by_full = one.orderBy("__full", "rank")
    ranked = ranked.withColumns({
        "__whole": F.sum("source_size").over(one),
        "__before": F.coalesce(F.sum(cap).over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__left": F.sum("weight").over(by_full.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    ranked = ranked.withColumn("__level", (F.col("__whole") - F.col("__before")) / F.col("__left"))
    # The first source, by where it saturates, that the level leaves below its cap fixes the level.
    level = F.coalesce(F.min_by(F.when(F.col("__level") <= F.col("__full"), F.col("__level")), F.when(F.col("__level") <= F.col("__full"), F.col("__full"))).over(one), F.lit(0.0))
    return ranked.withColumn("target", F.least(F.col("weight") * level, cap.cast("double"))).select("source", "rank", "source_size", "source_rows", "weight", "target")


def mix_sources(sized: DataFrame, weights: Column | None = None, block_words: int = 8, shard_rows: int = 4096, max_repeats: int = 3, seed: int = 7, copies_per_row: int = 4096) -> DataFrame:
    """sized (doc_id, source, size) with source_size, target and taken."""
    weights = ((F.col("rank") - 1) % 3 + 1) if weights is None else weights
    counted = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    last = F.floor((F.col("n") - 1) / F.lit(copies_per_row))
    runs = counted.select("doc_id", "source", "size", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("run"))
    # Runs of one key go to many tasks before they become rows.
    runs = runs.repartition("doc_id", "size", "run")
    copies = F.sequence(F.col("run") * copies_per_row, F.least(F.col("n"), (F.col("run") + 1) * copies_per_row) - 1)
    # Read three times below: a small table without text.
    sized, _ = written(runs.select("doc_id", "source", "size", F.explode(copies).alias("copy")), "mix-sizes")
    sources = source_targets(sized, weights, max_repeats)
    whole = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    seats = F.ceil(whole / F.lit(block_words))
    quotas = _apportion(sources.withColumn("__n", seats), ["rank"], F.col("__n"), F.col("target"), [], "rank").drop("__n").withColumnRenamed("quota", "source_quota")
    quotas = quotas.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_rows") / F.lit(shard_rows)))).withColumn("sk", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    quotas, _ = written(quotas, "mix-quotas")

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("copy").cast("string")))
    docs = sized.select("doc_id", "source", "size", "copy", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("sk"), order.alias("__order"))
    docs = docs.join(quotas.select("sk", "rank", "source_size", "target", "source_quota", "shards"), "sk")
    docs = docs.withColumn("__shard", F.conv(F.substring("__order", 1, 8), 16, 10).cast("long") % F.col("shards"))
    cells = docs.groupBy("rank", "__shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("__want"))
    cells = _apportion(cells, ["rank", "__shard"], F.col("__want"), F.col("shard_size"), ["rank"], "__shard")
    cells = cells.select(F.col("rank").alias("__r"), F.col("__shard").alias("__s"), "shard_size", F.least(F.col("quota") * block_words, F.col("shard_size") * max_repeats).alias("__words"))
    docs = docs.join(cells, (F.col("rank") == F.col("__r")) & (F.col("__shard") == F.col("__s")))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("rank", "__shard").orderBy(F.substring("__order", 9, 24), "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passes = F.when(F.col("shard_size") > 0, F.expr("__words div shard_size")).otherwise(0)
    rest = F.when(F.col("shard_size") > 0, F.col("__words") % F.col("shard_size")).otherwise(0)
    docs = docs.withColumn("taken", (passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))).cast("long"))
    return docs.select("doc_id", "source", "size", "source_size", "target", "taken")


def op10_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
