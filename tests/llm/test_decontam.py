import math
import random
from collections import Counter

import pytest

from gridwright.llm.decontam import Index, find_contamination, overlap_column, overlaps, pairs_of, passages, question_answer, words_of
from tests.llm.odd import EN, collected


def scores(items, words, k1=1.2, b=0.75):
    """Normalised BM25 of every item against a passage, straight from the definition."""
    grams = [Counter(pairs_of(words_of(q) + words_of(a))) for _, q, a in items]
    grams = [g if len(g) >= 5 else Counter() for g in grams]
    live = [g for g in grams if g]
    mean = sum(sum(g.values()) for g in live) / len(live)
    df = Counter(t for g in live for t in g)
    here = set(pairs_of(words))
    out = []
    for g in grams:
        w = {t: math.log(1 + (len(live) - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * sum(g.values()) / mean)) for t, f in g.items()}
        out.append(sum(x for t, x in w.items() if t in here) / sum(w.values()) if w else 0.0)
    return out


def test_block_max_wand_retrieves_all(spark, data):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 60))), "") for i in range(150)]
    for block in (2, 64):
        index = Index(items, block=block)
        for _ in range(60):
            terms = sorted(rng.sample(range(len(index.terms)), rng.choice([3, 40, 400])))
            threshold = rng.choice([0.01, 0.05, 0.1, 0.3])
            want = Counter()
            for t in terms:
                for item, x in zip(*index.postings[t]):
                    want[item] += x
            got = dict(index.retrieve(terms, threshold))
            assert sorted(got) == sorted(i for i, x in want.items() if x >= threshold - 1e-12)
            assert all(got[i] == pytest.approx(want[i]) for i in got)


def test_against_brute_force(spark, data, documents):
    """Every item and passage compared."""
    items = [(r.item_id, *question_answer(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    index = Index(items)
    want = set()
    for d in documents.collect():
        words = words_of(d.text)
        for a, b in passages(len(words) - 1, index.longest):
            part = words[a : b + 1]
            for (item, q, r), s in zip(items, scores(items, part)):
                in_q, in_r = ((len(set(pairs_of(words_of(x))) & set(pairs_of(part))) / max(1, len(set(pairs_of(words_of(x)))))) for x in (q, r))
                if s >= 0.5 and in_q >= 0.6 and (in_r >= 0.6 or not pairs_of(words_of(r))):
                    want.add((d.doc_id, item))
    got = find_contamination(documents, spark.read.parquet(f"{data}/benchmark.parquet"))
    assert set(collected(got, "doc_id", "item_id")) == want and want
    blocks = find_contamination(documents, spark.read.parquet(f"{data}/benchmark.parquet"), block_bytes=2000)
    assert set(collected(blocks, "doc_id", "item_id")) == want


def test_planted(spark):
    item = "Which of the seven rivers that cross the northern plain freezes first in a hard winter? The smallest one, which has no name on any map."
    filler = " ".join(f"filler{i} word{i * 7 % 31} and" for i in range(400))
    texts = {
        1: filler + " " + item + " " + filler,
        2: filler + " " + item.upper().replace(" ", "\n").replace(",", " -") + " " + filler,
        3: filler,
        4: filler + " Which of the seven rivers that cross the northern plain freezes first in a hard winter? " + filler,
        5: item.replace("winter", "summer").replace("hard", "long"),
        6: "The smallest one, which has no name on any map. " + filler,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    others = [(i, f"Item{i} has another question altogether number{i} about thing{i} and place{i}? Answer{i} is quite a different reply{i} here.") for i in range(20)]
    got = find_contamination(docs, spark.createDataFrame([(99, item), *others], "item_id long, text string"))
    assert set(collected(got, "doc_id", "item_id")) == {(1, 99), (2, 99), (5, 99)}
    fields = spark.createDataFrame([(99, *question_answer(item))], "item_id long, question string, answer string")
    assert set(collected(find_contamination(docs, fields), "doc_id")) == {(1,), (2,), (5,)}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, EN), (2, None), (3, ""), (4, "too short"), (None, EN), (5, EN)], "item_id long, text string")
    found = overlap_column(odd, items)
    assert found.count() == odd.count() and set(found.columns) == set(odd.columns)
    hit = {r.doc_id for r in found.collect() if len(r.hits) == 3}
    assert {6, 7, 8, 9, 2**60 + 1} <= hit and 0 not in hit and 10 not in hit
    assert find_contamination(odd, items.filter("false")).count() == 0
    assert find_contamination(none, items).count() == 0
    assert overlaps("", Index([]), 0.5, 0.6, 0.6) == []


def test_question_answer():
    assert question_answer("One? Two. Three four.") == ("One? Two.", "Three four.")
    assert question_answer("no end") == ("no end", "")


def test_short_items_are_found_as_exact_sequences(spark):
    items = [(1, "2 + 2 = ? 4"), (2, "Who wrote Hamlet? Shakespeare."), (3, "ho ho ho ho ho ho ho"), (4, "Zyzzyva"), (5, "..."), (6, "Who wrote Hamlet? Shakespeare."), (7, "2 + 2 = ? 5")]
    texts = {
        1: "The test asks: 2+2 =?\n4, and others.",
        2: "who wrote hamlet -- shakespeare",
        3: "who wrote the hamlet of shakespeare, who wrote hamlet",
        4: "ho " * 6,
        5: "ho " * 9,
        6: "a zyzzyva is a weevil",
        7: "2 4 2 and 2 2 3 4",
        8: "",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for options in ({}, {"block_bytes": 30}):
        got = find_contamination(docs, spark.createDataFrame(items, "item_id long, text string"), **options)
        assert collected(got, "doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word") == [
            (1, 1, 1.0, 1.0, 1.0, 3), (2, 2, 1.0, 1.0, 1.0, 0), (2, 6, 1.0, 1.0, 1.0, 0), (5, 3, 1.0, 1.0, 1.0, 0), (6, 4, 1.0, 1.0, 1.0, 1)
        ]


def test_scripts_without_spaces():
    assert words_of("\u6c34\u306fH2O\u3067\u3059\u3002 caf\u00e9") == ["\u6c34", "\u306f", "h2o", "\u3067", "\u3059", "caf\u00e9"]
    items = [(1, *question_answer("\u4e2d\u56fd\u6700\u957f\u7684\u6cb3\u6d41\u662f\u54ea\u4e00\u6761\uff1f\u957f\u6c5f\u3002")), (2, *question_answer("\u0e40\u0e21\u0e37\u0e2d\u0e07\u0e2b\u0e25\u0e27\u0e07\u0e02\u0e2d\u0e07\u0e44\u0e17\u0e22\u0e04\u0e37\u0e2d\u0e2d\u0e30\u0e44\u0e23"))]
    index = Index(items)
    for number, (_, q, a) in enumerate(items):
        hits = overlaps(f"\u5929\u6c14\u5f88\u597d {q}{a} \u6211\u4eec\u53bb\u516c\u56ed", index, 0.5, 0.6, 0.6)
        assert [h[0] for h in hits] == [number]
    assert overlaps("\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed", index, 0.5, 0.6, 0.6) == []


def item_of(i, n):
    return " ".join(f"i{i}w{j}" for j in range(n))


def test_a_long_item_does_not_widen_the_passages_of_others():
    """Halves of an item, far apart, aren't a copy of it."""
    words = item_of(1, 20).split()
    items = [(1, " ".join(words), ""), *((i, item_of(i, 20), "") for i in range(2, 9))]
    far = " ".join(words[:10] + [f"x{i}" for i in range(200)] + words[10:])
    copy = " ".join([f"x{i}" for i in range(33)] + words)
    for more in ([], [(9, item_of(9, 3000), "")]):
        index = Index(items + more)
        assert overlaps(far, index, 0.5, 0.6, 0.6) == []
        assert [(h[0], h[1]) for h in overlaps(copy, index, 0.5, 0.6, 0.6)] == [(0, pytest.approx(1.0))]


def test_every_item_is_found_at_every_place():
    items = [(i, item_of(i, n), "") for i, n in enumerate((7, 18, 33, 50, 61))]
    index = Index(items)
    for number, (_, text, _) in enumerate(items):
        for before in range(0, 260, 3):
            hits = overlaps(" ".join(["x"] * before + [text] + ["x"] * 150), index, 0.99, 1.0, 1.0)
            assert [h[0] for h in hits] == [number], before


def test_scores_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(8, 40)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t[: len(t) * 3 // 4]) for i, t in items], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = lambda **k: {(r[0], r[1]): r.score for r in find_contamination(docs, table, **k).collect()}
    whole, blocks = found(), found(block_bytes=500)
    assert whole == pytest.approx(blocks) and len(whole) > 50


def test_ten_blocks_give_what_one_gives(spark, data, documents):
    """Items under one id or none are dealt out as well; one block is in memory at a time."""
    from pyspark.sql import functions as F

    from gridwright.llm.common import in_turn
    from gridwright.llm.decontam import block_of

    items = spark.read.parquet(f"{data}/benchmark.parquet").select(F.when(F.col("item_id") % 3 == 0, 7).when(F.col("item_id") % 3 == 1, F.col("item_id")).alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    rows = lambda n: sorted(map(repr, collected(find_contamination(documents, items, block_bytes=size // n + 1), "doc_id", "item_id", "question_overlap", "answer_overlap", "first_word")))
    assert rows(1) == rows(10) and rows(1)
    assert items.filter("item_id is null").select(block_of(items, 10)).distinct().count() > 3
    parts = [spark.sparkContext.broadcast(i) for i in range(3)]

    def held(batches):
        for batch in batches:
            seen = [(v, sum("_value" in p.__dict__ for p in parts)) for v in in_turn(parts)]
            assert seen == [(0, 1), (1, 1), (2, 1)]
            yield batch

    assert spark.range(3).mapInArrow(held, "id long").count() == 3


def test_one_sentence_items(spark):
    item = "the seven rivers of the northern plain freeze over in every hard winter"
    words = item.split()
    docs = spark.createDataFrame([(1, item), (2, " ".join(words[:10])), (3, " ".join(words[:4]))], "doc_id long, text string")
    others = [(i, " ".join(f"o{i}w{j}" for j in range(13))) for i in range(9)]
    got = find_contamination(docs, spark.createDataFrame([(99, item), *others], "item_id long, text string"))
    assert collected(got, "doc_id", "answer_overlap") == [(1, 1.0), (2, 1.0)]
