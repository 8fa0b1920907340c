import zlib

from pyspark.sql import functions as F

from gridwright.llm.sharding import document_bytes, op2_sharding, shard_by_bytes
from tests.llm.odd import collected


def brute(rows, n):
    """rows: (key, size) in order; shard and slot of each."""
    total, at, used, out = sum(s for _, s in rows), 0, {}, []
    for k, s in rows:
        shard = min(n - 1, (2 * at + s) * n // (2 * total))
        out.append((k, s, shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + 1
        at += s
    return out


def test_against_brute_force(spark, data, documents):
    rows = sorted((r.doc_id, len((r.text or "").encode()) + 8) for r in documents.collect())
    got = op2_sharding(spark, data)
    assert sorted(collected(got, "doc_id", "size", "shard", "slot")) == brute(rows, 24)
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in documents.collect()}
    assert all(crc[i] == c for i, c in collected(got, "doc_id", "text_crc32"))
    assert set(collected(got, "law", "grown_shard")) == {("bytes", None)}


def test_hot_key_is_spread(spark):
    df = spark.range(0, 3000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("k"), F.lit(10).alias("b"))
    got = shard_by_bytes(df, F.col("b"), ["k"], 6)
    assert sorted(r[1] for r in collected(got.groupBy("shard").count())) == [500] * 6
    for s in range(6):
        assert sorted(r.slot for r in got.filter(F.col("shard") == s).collect()) == list(range(500))


def test_odd_rows(odd):
    got = shard_by_bytes(odd, document_bytes(F.col("text")), ["doc_id"], 4)
    assert got.count() == odd.count()
    assert set(got.columns) == set(odd.columns)
    assert sorted(map(repr, collected(got, "doc_id", "text", "size"))) == sorted(map(repr, collected(odd, "doc_id", "text", "size")))
    assert got.filter(F.col("doc_id") == 2**60 + 1).count() == 1
    for s in range(4):
        slots = sorted(r.slot for r in got.filter(F.col("shard") == s).collect())
        assert slots == list(range(len(slots)))


def test_nothing(none):
    assert collected(shard_by_bytes(none, document_bytes(F.col("text")), ["doc_id"])) == []
