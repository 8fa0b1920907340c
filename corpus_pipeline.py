"""Corpus pipeline: language ID, near-deduplication, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's docs. All but
the last return the columns of docs; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.llm import decontam, langid, mixing, near_dedup, sharding
from gridwright.llm.common import discard, free_names, table, word_count, written


def _all(docs: DataFrame) -> list[Column]:
    """The columns of docs, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what has no language: null texts, texts without a letter, and texts
    whose shortest code is more than 256 bits longer than their plain bytes (8 bits
    each), so that no learned language describes them. A short text that several
    languages describe alike stays."""
    learn = docs.filter(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang")
    names = free_names(docs, "lang_pred", "score", "bits_per_byte")
    judged = langid.predict(docs, langid.fit(learn), names=tuple(names))
    described = (F.col(names[2]) - 8) * F.octet_length("text") <= 256
    return judged.filter((F.col(names[0]) != "und") & described).select(*_all(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of texts alike in 0.8 or more of their
    five-word shingles: the one with the smallest id, and one without an id only
    where no other is there (by a hash of the text). Of rows repeated under one id
    with one text, or with one text under none, one stays, the least by its other
    columns; texts without a word are alike to no others."""
    key, hashed, rank, gone, text = free_names(docs, "key", "hashed", "rank", "gone", "gone_text")
    large = 1 << 62
    keyed = docs.withColumn(hashed, F.xxhash64("text"))
    keyed = keyed.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.pmod(F.col(hashed), F.lit(large)) + large))
    # A row number of 1 is asked for, so every task keeps one row of a key before the shuffle.
    plain = [c for c, f in zip(_all(docs), docs.schema.fields) if isinstance(f.dataType, T.AtomicType) and f.name != "text"]
    once = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(key, hashed).orderBy(*plain))).filter(F.col(rank) == 1)
    found = near_dedup.near_duplicates(keyed, id_col=key).filter("not kept")
    left = found.select(F.col(key).alias(gone), F.col("text_hash").alias(text)).distinct()
    return once.join(left, (F.col(key) == F.col(gone)) & (F.col(hashed) == F.col(text)), "left_anti").select(*_all(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    name = free_names(docs, "hits")[0]
    found = decontam.overlap_column(docs, table(spark, sf_dir, "benchmark"), name=name)
    return found.filter(F.size(name) == 0).select(*_all(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its words taken over its words,
    rounded, so only a document at the edge of a quota gains or loses a part."""
    size, times, of, source, words = free_names(docs, "words", "times", "of", "from", "sized")
    sized = docs.withColumn(size, word_count(F.col("text")))
    mixed = mixing.mix_sources(sized.select("doc_id", "source", F.col(size).alias("size")))
    per = mixed.groupBy("doc_id", "source", "size").agg(F.floor(F.try_divide(F.sum("taken"), F.count(F.lit(1)) * F.first("size")) + 0.5).cast("int").alias(times))
    per = per.filter(F.col(times) > 0).select(F.col("doc_id").alias(of), F.col("source").alias(source), F.col("size").alias(words), times)
    joined = sized.join(per, F.col("doc_id").eqNullSafe(F.col(of)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(size) == F.col(words)))
    return joined.select(*_all(docs), F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(times)).select(*_all(docs))


def byte_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with shard (24 contiguous ones of equal bytes) and slot."""
    return sharding.shard_by_bytes(docs, sharding.document_bytes(F.col("text")), ["doc_id"], n_shards=24)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("byte_sharding", byte_sharding),
]

#: SQL cannot express the first stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, *before)  # nothing reads the stage before last any more
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
