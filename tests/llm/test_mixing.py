import pytest
from pyspark.sql import functions as F

from gridwright.llm.common import word_count
from gridwright.llm.mixing import mix_sources, source_targets
from tests.llm.odd import collected


def fair_targets(sizes, weights, most=3):
    """By the definition: excess over the cap is shared out until none is left."""
    total, target, capped = sum(sizes), [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        weight = sum(weights[i] for i in free)
        target = [most * sizes[i] if i in capped else left * weights[i] / weight for i in range(len(sizes))]
        over = [i for i in free if target[i] > most * sizes[i]]
        if not over:
            return target
        capped.update(over)


def highest_quotients(votes, seats):
    quota = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * quota[i] + 1), -i))
        quota[best] += 1
    return quota


@pytest.mark.parametrize("sizes", [[100, 5, 900, 40], [1, 1, 1], [1000, 0, 3, 7, 2, 900]])
def test_targets(spark, sizes):
    names = [chr(97 + i) for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(range(len(sizes)), names, sizes)), "doc_id long, source string, size long")
    got = {r.source: r.target for r in source_targets(df, (F.col("rank") - 1) % 3 + 1).collect()}
    want = fair_targets(sizes, [i % 3 + 1 for i in range(len(sizes))])
    assert [got[n] for n in names] == pytest.approx(want)


def test_quotas_are_those_of_the_highest_quotients(spark):
    from gridwright.llm.mixing import _apportion

    for votes, seats in [([100.0, 60.0, 31.0, 3.0, 1.0], 37), ([5.0, 5.0, 5.0], 4), ([1.0] * 9, 5), ([97.0, 1.0, 1.0, 1.0], 10), ([3.0, 0.0], 2)]:
        cells = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "k int, v double")
        got = {r.k: r.quota for r in _apportion(cells, ["k"], F.lit(seats).cast("long"), F.col("v"), [], "k").collect()}
        assert [got[i] for i in range(len(votes))] == highest_quotients(votes, seats), votes


def sized(df):
    return df.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def test_mix(documents):
    rows = mix_sources(sized(documents), shard_rows=16).collect()
    assert len(rows) == documents.count()
    words = {r.doc_id: len((r.text or "").split()) for r in documents.collect()}
    by = {}
    for r in rows:
        assert r.size == words[r.doc_id] and 0 <= r.taken <= 3 * r.size
        a, t, _ = by.get(r.source, (0, 0, 0))
        by[r.source] = (a + r.taken, r.target, r.source_size)
    for taken, target, _ in by.values():
        assert abs(taken - target) <= 8
    again = mix_sources(sized(documents.repartition(7)), shard_rows=16).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    other = mix_sources(sized(documents), shard_rows=16, seed=8).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) != sorted((r.doc_id, r.taken) for r in other)


def test_odd_rows(odd, none):
    rows = mix_sources(sized(odd)).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 8
    assert collected(mix_sources(sized(none))) == []


def test_one_empty_source(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 10)], "doc_id long, source string, size long")
    assert sorted((r.doc_id, r.taken) for r in mix_sources(df, block_words=5).collect()) == [(1, 0), (2, 10)]


def test_rows_without_an_id_are_dealt_out(spark):
    """20,000 rows under no id or one id, of one size: spread over shards, and over tasks."""
    rows = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") % 2 == 0, F.lit(5)).cast("long").alias("doc_id"), F.when(F.col("id") % 5 > 0, "s").alias("source"), F.lit(3).cast("long").alias("size"))
    got = mix_sources(rows, block_words=8, shard_rows=500, copies_per_row=100).cache()
    assert got.count() == 20_000 and got.groupBy("doc_id", "source").count().count() == 4
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 8 + 0.001 * r.target  # a shard at its cap can lose a part of a block
    again = mix_sources(rows.repartition(3), block_words=8, shard_rows=500, copies_per_row=100)
    per = lambda df: sorted(map(repr, collected(df.groupBy("doc_id", "source", "taken").count())))
    assert per(got) == per(again)
    spread = got.groupBy("doc_id", "source", "taken").count().count()
    assert spread >= 4
