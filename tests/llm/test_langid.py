import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridwright.llm import langid
from tests.llm.odd import EN, FR, collected


def learn(df):
    return df.select(F.col("doc_id").alias("id"), "text", "lang")


def test_held_out_accuracy(spark, data, documents):
    rows = langid.op8_language_id(spark, data).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 20 and right >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def only(models):
    """The one group's model."""
    (model,) = models
    return model.value


def same_model(a, b):
    tables = lambda m: (m.pairs, m.escapes, m.threes.values, m.threes.keys, m.fours.values, m.fours.keys)
    return a.languages == b.languages and all((x == y).all() for x, y in zip(tables(a), tables(b)))


def bits_of(models, texts):
    """Bits of each text under each language, by name."""
    out = [{} for _ in texts]
    for model in models:
        m = model.value
        for row, got in zip(out, m.code_lengths([langid._bytes(t) for t in texts], at_once=7)):
            row.update(zip(m.languages, got.tolist()))
    return out


def test_nothing_is_learned_from_held_out_documents(spark, documents):
    kept = documents.filter(~langid.held_out(F.col("doc_id")))
    a = only(langid.fit(learn(kept)))
    assert same_model(a, only(langid.fit(learn(kept.repartition(5)))))  # whatever the partitions
    spoiled = documents.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert same_model(a, only(langid.fit(learn(spoiled.filter(~langid.held_out(F.col("doc_id")))))))


def counts_of(texts):
    """By context of up to three bytes: how often each byte follows."""
    counts = {}
    for text in texts:
        s = langid._bytes(text)
        for i in range(3, len(s)):
            for depth in range(4):
                c = counts.setdefault(s[i - depth : i], {})
                c[s[i]] = c.get(s[i], 0) + 1
    return counts


def chances(counts, context):
    """Of each byte by definition: longest context first, escape to shorter ones.
    A context that the language never saw passes on to the shorter one."""
    p = np.full(256, 1 / 256)
    for depth in range(4):
        seen = counts.get(context[len(context) - depth :] if depth else b"")
        if not seen:
            continue
        total, distinct = sum(seen.values()), len(seen)
        rest = sum(p[s] for s in range(256) if s not in seen)
        escape = distinct if distinct < 256 else 0
        p = np.array([seen[s] / (total + escape) if s in seen else p[s] / rest * escape / (total + escape) for s in range(256)])
    return p


def code_length(counts, text):
    s = langid._bytes(text)
    return sum(-math.log2(chances(counts, s[i - 3 : i])[s[i]]) for i in range(3, len(s)))


def trained(spark, words, n=6, **options):
    rng = random.Random(4)
    train = [(i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang) for i, lang in enumerate(list(words) * n)]
    return langid.fit(spark.createDataFrame(train, "id long, text string, lang string"), **options), {lang: counts_of([t for _, t, x in train if x == lang]) for lang in words}


def test_code_lengths_by_definition(spark):
    words = {"aa": ["ab", "abc", "bca", "c"], "bb": ["ba", "cab", "ccc", "a"], "cc": ["\u0434\u0430", "\u043d\u0435\u0442", "\u4e2d\u6587", "q"]}
    test = ["abc bca", "ccc cab q", "a", "", "\u0434\u0430 \u00e9 \U0001d11e z", "cab " * 40]
    models, counts = trained(spark, words)
    apart, _ = trained(spark, words, languages_at_once=2, entries_at_once=1)
    assert [m.value.languages for m in apart] == [["aa"], ["bb"], ["cc"]]
    for text, got, other in zip(test, bits_of(models, test), bits_of(apart, test)):
        assert got.keys() == other.keys() == words.keys()
        for lang in words:
            want = code_length(counts[lang], text)
            assert abs(want - got[lang]) < 1e-3 * max(1, want) and abs(want - other[lang]) < 1e-3 * max(1, want), (lang, text)


def test_probabilities_sum_to_one(spark, documents):
    model = only(langid.fit(learn(documents)))
    rng = random.Random(6)
    texts = [langid._bytes(r.text) for r in documents.limit(5).collect()]
    contexts = [t[i : i + 3] for t in texts for i in (0, 3, rng.randrange(3, max(4, len(t) - 3)))] + [bytes(rng.randrange(256) for _ in range(3)) for _ in range(5)]
    for context in contexts:
        bits = model.code_lengths([context + bytes([s]) for s in range(256)])
        assert np.allclose(np.exp2(-bits).sum(axis=0), 1, atol=1e-3)


def test_every_byte_has_its_own_place(spark):
    """More than 120 different bytes, and rare ones."""
    letters = "".join(chr(c) for c in [*range(97, 123), *range(0xC0, 0x180), *range(0x3B1, 0x3C9), *range(0x430, 0x450), *range(0x5D0, 0x5EA), 0x4E2D, 0xAC00, 0x1D11E])
    models, counts = trained(spark, {"aa": [letters[i : i + 5] for i in range(0, len(letters), 5)], "bb": ["other", "words"]}, n=3)
    texts = [letters[i : i + 20] for i in range(0, len(letters), 20)]
    for text, got in zip(texts, bits_of(models, texts)):
        for lang in ("aa", "bb"):
            assert abs(code_length(counts[lang], text) - got[lang]) < 1e-3 * max(1, got[lang])


def test_many_languages(spark):
    """200 languages: groups of bounded size, the same choice as by definition."""
    rng = random.Random(8)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 8))) for _ in range(12)] for i in range(200)}
    models, counts = trained(spark, words, n=2, entries_at_once=3000)
    sizes = [len(m.value.fours.keys) for m in models]
    assert len(models) >= 13 and max(sizes) <= 3001 and sum(len(m.value.languages) for m in models) == 200
    texts = [(i, " ".join(rng.choice(words[f"l{i * 9:03}"]) for _ in range(12))) for i in range(20)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), models).collect()}
    for i, text in texts:
        lengths = {lang: code_length(counts[lang], text) for lang in sorted(words)}
        best = min(lengths, key=lengths.get)
        assert got[i].lang_pred == best == f"l{i * 9:03}"
        share = 1 / sum(2 ** (lengths[best] - x) for x in lengths.values())
        assert abs(got[i].score - share) < 1e-2 and abs(got[i].bits_per_byte - lengths[best] / len(text)) < 1e-2


def test_odd_rows(spark, odd, none):
    train = spark.createDataFrame([(i, t, g) for i in range(8) for t, g in ((EN, "en"), (FR, "fr"))], "id long, text string, lang string")
    models = langid.fit(train)
    got = langid.predict(odd, models, names=("p", "s", "b"))
    assert got.count() == odd.count() and got.columns[: len(odd.columns)] == odd.columns
    by = {r.doc_id: (r.p, r.s) for r in got.collect() if r.doc_id not in (7, None)}
    assert [by[i] for i in (0, 1, 2, 5, 15)] == [("und", 0.0)] * 5
    assert by[6][0] == "en" and by[10][0] == "fr" and by[19][0] != "und"
    # Columns named like results are replaced.
    own = langid.predict(odd, models)
    assert sorted(own.columns) == sorted([*odd.columns, "bits_per_byte"]) and own.filter("lang_pred = 'en'").count() > 0
    assert {r.p for r in langid.predict(odd, langid.fit(train.filter("false")), names=("p", "s", "b")).collect()} == {"und"}
    assert langid.fit(learn(none)) == []
    assert collected(langid.predict(none, models, names=("p", "s", "b"))) == []
