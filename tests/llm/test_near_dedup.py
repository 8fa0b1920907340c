import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.llm.components import connected_components
from gridwright.llm.near_dedup import _dealt, near_duplicates, spanning_links
from gridwright.llm.shingles import WordHashes, shingle_sets, sketches
from tests.llm.odd import collected


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, k, percent=80):
    """rows: (id, text) with distinct ids; id to (set size, component)."""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(documents, k):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents, k=k).collect()}
    assert got == brute([(r.doc_id, r.text) for r in documents.collect()], k)


def edited(rng, words, share):
    return [f"new{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def test_one_large_group_of_near_copies(spark):
    """Copies edited more and less: some linked, some not, all in the same buckets."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.0, 0.005, 0.01, 0.02, 0.04, 0.08])))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(50))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    for weight, chunk, blocks in ((1_000_000, 64, None), (20_000, 3, None), (20_000, 3, 0)):  # one block, many, and by bucket
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, k=4, block_weight=weight, chunk=chunk, most_blocks=blocks).collect()}
        assert got == want


def pair_of(rng, name, n, both):
    """Two texts of n words whose sets of single words have ``both`` in common."""
    words = [f"{name}x{i}" for i in range(2 * n - both)]
    a, b = words[:n], words[n - both :]
    rng.shuffle(a)
    rng.shuffle(b)
    return " ".join(a), " ".join(b)


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.800 to 0.85: next to all are found; just below, none."""
    rng = random.Random(7)
    rows, want = [], set()
    for i in range(400):
        both = rng.randrange(160, 166) if i % 4 else rng.randrange(150, 160)  # of 200 and 200 less these
        a, b = pair_of(rng, f"p{i}", 180, both)
        rows += [(2 * i, a), (2 * i + 1, b)]
        if 100 * both >= 80 * (360 - both):
            want.add(2 * i + 1)
    got = {r.doc_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1).filter("not kept").collect()}
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 250


def test_boilerplate_does_not_multiply_sets(spark):
    """Texts that share two thirds of their words hang together in one cluster without a link."""
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"u{i}x{j}" for j in range(30)])) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 200, 10)]
    for blocks in (None, 2):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2, block_weight=20_000, most_blocks=blocks).collect()}
        assert got == brute(rows, 2)
    # A heavy group of one large component and few others: its sets go out once for each block of the others.
    groups = spark.range(0, 5000).select(F.lit(True).alias("bucket"), F.lit(7).cast("long").alias("g"), F.col("id").alias("node"), F.when(F.col("id") < 4990, 0).otherwise(F.col("id")).cast("long").alias("comp"), F.lit(900).cast("long").alias("weight"))
    dealt = _dealt(groups, 400_000).cache()
    assert dealt.filter("comp = 0").count() == 4990 and dealt.filter("comp <> 0").count() == 10 * 13
    pairs = dealt.select("x", "y").distinct().collect()
    assert (0, 0) in [tuple(p) for p in pairs] and all(p.x == 0 for p in pairs)


def test_odd_rows(odd, none):
    got = near_duplicates(odd, k=4)
    assert got.count() == odd.count()
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()]
    by = {i: (n, c, k) for i, n, c, k in rows if i not in (7, None)}
    assert [by[i][:2] for i in (0, 1, 2)] == [(0, 0), (0, 1), (0, 2)]
    assert by[3] == (1, 3, True) and by[4] == (1, 4, True)
    assert by[6][1] == by[8][1] == by[2**60 + 1][1] == 6 and not by[8][2]
    assert by[12][1] == by[13][1] == 12
    assert all(c is None and k for i, n, c, k in rows if i is None)
    # One id with two texts: each text is in its own component.
    assert {c for i, _, c, _ in rows if i == 7} == {6, 7} or {c for i, _, c, _ in rows if i == 7} == {6, by[10][1]}
    assert collected(near_duplicates(none)) == []


def test_short_sequences_are_one_shingle():
    sets = shingle_sets(["a b", "A  B", "b a", "a b c d", "", None], 4, WordHashes())
    assert [len(s) for s in sets] == [1, 1, 1, 1, 0, 0]
    assert sets[0] == sets[1] and sets[0] != sets[2] and sets[0] != sets[3]


def test_sketches_estimate_similarity_and_fill_every_coordinate():
    rng = np.random.default_rng(2)
    t, errors = 336, []
    for n in (1, 3, 50, 400, 3000):
        for share in (0.3, 0.8, 1.0):
            common = rng.integers(0, 2**63, max(1, round(n * share)), dtype=np.uint64)
            rest = [rng.integers(0, 2**63, n - len(common), dtype=np.uint64) for _ in range(2)]
            a, b = (np.unique(np.r_[common, r]) for r in rest)
            s = sketches([a, b], t)
            assert (s != np.uint64(2**64 - 1)).all()
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(abs((s[0] == s[1]).mean() - j))
    assert max(errors) < 0.1
    assert sketches([], t).shape == (0, t)


def test_a_sketch_does_not_depend_on_its_batch():
    sets = shingle_sets(["a b c d e f", "x y", "one two three four five six seven"], 3, WordHashes())
    assert (sketches(sets, 48)[1] == sketches(sets[1:2], 48)[0]).all()


def test_spanning_links_are_a_forest():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**60, 300, dtype=np.uint64))
    sets = [np.unique(np.r_[base[: 300 - d], rng.integers(0, 2**60, d, dtype=np.uint64)]) for d in [0, 5, 10, 20, 40, 80, 10, 5]]
    links = spanning_links(sets, None, 80)
    assert len(links) < len(sets)
    side = np.array([0, 1] * 4)
    assert all(side[i] != side[j] for i, j in spanning_links(sets, side, 80))


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert got.count() == got.select("node").distinct().count()
    assert {r.node: r.component for r in got.collect()} == {x: root(x) for x in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_bucket_rows_stay_linear(spark):
    """Thousands of copies of one text are one node: no pair of them is made."""
    df = spark.range(0, 20_000).select(F.col("id").alias("doc_id"), F.lit("one and the same text for all of them here").alias("text"))
    got = near_duplicates(df)
    assert got.filter("component_id = 0").count() == 20_000 and got.filter("kept").count() == 1
