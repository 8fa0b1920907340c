import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gridwright.llm import langid
from tests.llm.odd import EN, collected
from tests.llm.test_near_dedup import brute


@pytest.fixture(scope="module")
def stages(spark, data, documents):
    """Each stage's input and output."""
    out, docs = {}, documents
    for name, stage in cp.STAGES:
        result = stage(spark, docs, data).cache()
        out[name] = (docs, result)
        docs = result
    return out


def ids(df):
    return {r[0] for r in collected(df, "doc_id")}


def test_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "byte_sharding"]


def test_columns(stages):
    for name in [n for n, _ in cp.STAGES][:-1]:
        assert stages[name][1].columns == stages[name][0].columns


def test_language_id(stages):
    before, after = stages["language_id"]
    model = langid.fit(before.filter(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))
    want = {r.doc_id for r in langid.predict(before, model, names=("p", "s", "b")).collect() if r.p != "und" and (r.b - 8) * len(r.text.encode()) <= 256}
    assert ids(after) == want and len(want) >= 0.99 * before.count()


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    want = {i for i, (_, c) in brute(collected(before, "doc_id", "text"), 5).items() if i == c}
    assert ids(after) == want < ids(before)


def test_decontamination(spark, data, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    dirty = {i for i, t in collected(before, "doc_id", "text") if any(x in t for x in items)}
    assert ids(after) == ids(before) - dirty


def test_mixing(stages):
    before, after = stages["source_mixing"]
    words = {i: len(t.split()) for i, t in collected(before, "doc_id", "text")}
    copies = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert max(copies.values()) <= 3 and set(copies) <= set(words)
    total = sum(words.values())
    assert abs(sum(words[i] * n for i, n in copies.items()) - total) < 0.25 * total


def test_sharding(stages):
    before, after = stages["byte_sharding"]
    assert after.count() == before.count() and set(after.columns) == {*before.columns, "shard", "slot"}


def test_run(spark, data, stages):
    got = cp.run(spark, data)
    assert sorted(collected(got, "doc_id", "shard", "slot")) == sorted(collected(stages["byte_sharding"][1], "doc_id", "shard", "slot"))


def test_odd_rows(spark, data, odd, none):
    for name, stage in cp.STAGES:
        out = stage(spark, odd, data)
        assert set(odd.columns) <= set(out.columns)
        # Columns that are named like the stages' own come out as they went in.
        own = [c for c in odd.columns if c.startswith("__") or c in ("gone", "hashed", "times", "of", "words", "text_hash", "node", "from", "copy", "kept")]
        assert len(own) == 18 and {tuple(r) for r in out.select(*own).collect()} == {tuple(range(18))}
        assert out.count() <= 3 * odd.count()
        assert stage(spark, none, data).count() == 0, name
    kept = cp.near_dedup_stage(spark, odd, data)
    assert kept.filter("doc_id is null").collect()[0].text is None and kept.filter("doc_id is null").count() == 1
    assert kept.filter((F.col("doc_id") == 7) & (F.col("text") == EN)).count() == 0


def test_one_document_of_each_group_stays(spark, data, documents):
    """Also of repeated rows and of documents without an id, which are groups of their own kind."""
    from tests.llm.test_near_dedup import shingles

    rows = [r.asDict() for r in documents.limit(60).collect()]
    more = [dict(r, doc_id=None) for r in rows[::3]] + [dict(r, doc_id=None, text=r["text"] + " end") for r in rows[1::6]] + [dict(r, n_chars=7) for r in rows[::4]] + rows[::5]
    more += [dict(rows[0], doc_id=None, text=f"a text {i % 2} of words that nobody else here has in it") for i in range(6)]
    df = spark.createDataFrame([tuple(r[c] for c in documents.columns) for r in rows + more], documents.schema)
    got = cp.near_dedup_stage(spark, df, data).collect()
    texts = {r["text"] for r in rows + more}
    numbered = list(enumerate(sorted(texts)))
    of = {t: brute(numbered, 5)[i][1] for i, t in numbered if shingles(t, 5)}
    groups = [of[r.text] for r in got if r.text in of]
    assert sorted(groups) == sorted(set(of.values()))
    least = {}
    for r in rows + more:
        if r["doc_id"] is not None and r["text"] in of:
            least[of[r["text"]]] = min(least.get(of[r["text"]], r["doc_id"]), r["doc_id"])
    assert all(r.doc_id == least.get(of[r.text]) for r in got if r.text in of)


def test_texts_of_no_learned_language_go(spark, data, documents):
    import base64
    import random

    rng = random.Random(3)
    other = [base64.b64encode(rng.randbytes(300)).decode(), "\u042d\u0442\u043e \u043e\u0431\u044b\u0447\u043d\u044b\u0439 \u0442\u0435\u043a\u0441\u0442 " * 9]
    more = spark.createDataFrame([(10**7 + i, t, None, "x", len(t)) for i, t in enumerate(other)], documents.schema)
    kept = ids(cp.language_id(spark, documents.union(more), data))
    assert kept == ids(cp.language_id(spark, documents, data)) and len(kept) >= 0.99 * documents.count()
