"""MinHash near-deduplication with fast similarity sketching.

1. Each whole text becomes its set of word shingles; sets get a 128-bit
   fingerprint and a sketch, cut into bands. Documents with equal sets are one
   node from here on, however many copies there are.
2. Nodes that share a band key (a bucket) are candidates; a bucket is never made a
   list. Each node is first compared, on full sets, with one other: of its buckets'
   smallest nodes the one that it shares most buckets with. So a group of near
   copies becomes one component at the cost of one comparison each.
3. Buckets whose nodes are in one component by now are done. In the others every
   pair across components is decided on full sets: components that hang together by
   such buckets are verified as one group while that makes no more blocks than there
   are bands (so a set goes out at most that often), else each bucket on its own.
   A group heavier than a block is dealt into blocks, and each pair of blocks is one
   task's group, but for the blocks of its heaviest component among themselves: its
   nodes are linked already. An inverted index over the shingles counts the exact
   intersections, and only a spanning forest of the links leaves a task, so rows
   out never exceed rows in.
4. Components of all links are the result.

A pair at the threshold shares a band with probability 1 - (1 - s^r)^bands; for
s = 0.8, 48 bands of 7 rows miss it once in 80,000 times, and for s = 0.9 less
than once in 10^13. What a band finds is decided exactly.

Defined results: null, empty and blank texts have an empty set and link with
nothing; very long texts are read whole; a null id takes no part in links and is
kept under component null; equal texts always share a component, under the
smallest id; rows repeated under one id are one document; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import discard, small_batches, table, written
from gridwright.llm.components import connected_components
from gridwright.llm.shingles import WordHashes, band_keys, parts_of, shingle_sets, sketches


def _fingerprint(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def sketch_table(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id, hash (of the text), n (set size), fp (of the set) and the band keys of each document (id, text)."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for part, texts in parts_of(batch.column("text")):
                sets = shingle_sets(texts, k, hashes)
                full = [s for s in sets if len(s)]
                keys = band_keys(sketches(full, bands * rows), bands).view(np.int64)
                ends = np.cumsum([0] + [bands * bool(len(s)) for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(part.start, part.stop - part.start),
                        batch.column("hash").slice(part.start, part.stop - part.start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_fingerprint(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1), pa.int64())),
                    ],
                    ["id", "hash", "n", "fp", "bands"],
                )

    return docs.select("id", F.xxhash64("text").alias("hash"), "text").mapInArrow(sketched, "id long, hash long, n long, fp binary, bands array<long>")


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def spanning_links(sets: list[np.ndarray], side: np.ndarray | None, percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union.

    side: 0 or 1 for each set where only pairs across the sides count. known: the
    component of each set so far; the forest only adds to these.

    Every pair with an end outside the component which the first few sets
    opened is counted exactly; pairs inside it are connected already.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, posts = values[order], owner[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    count = np.diff(np.r_[first, len(values)])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.repeat(np.arange(len(first)), count)
    at = np.r_[0, np.cumsum(sizes)]
    forest, links = _Forest(n), []
    heads: dict[int, int] = {}
    for i, c in enumerate(known or ()):
        forest.join(i, heads.setdefault(c, i))

    def count_for(i: int) -> None:
        v = place[at[i] : at[i + 1]]
        v = v[count[v] > 1]
        if not len(v):
            return
        c, f = count[v], first[v]
        ends = np.cumsum(c)
        hits = posts[np.arange(ends[-1]) + np.repeat(f - ends + c, c)]
        inter = np.bincount(hits, minlength=n)
        good = 100 * inter >= percent * (sizes + sizes[i] - inter)
        good[i] = False
        if side is not None:
            good &= side != side[i]
        for j in np.flatnonzero(good).tolist():
            if forest.join(i, j):
                links.append((i, j))

    done = set()
    for i in sorted({0, n // 3, 2 * n // 3, n - 1}) if known is None else ():
        count_for(i)
        done.add(i)
    roots = np.array([forest.root(i) for i in range(n)])
    large = np.bincount(roots).argmax()
    for i in np.flatnonzero(roots != large).tolist():
        if i not in done:
            count_for(i)
    return links


def _with_centers(percent: int):
    """Of rows by (center, chunk, node), each chunk with its center first: the nodes
    that are linked with their center."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, center = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for c, node, data in zip(*(batch.column(name).to_pylist() for name in ("center", "node", "shingles")), strict=True):
                s = np.frombuffer(data, dtype=np.uint64)
                if node == c:
                    of, center = c, s
                elif of == c:
                    both = int((center[np.minimum(np.searchsorted(center, s), len(center) - 1)] == s).sum())
                    if 100 * both >= percent * (len(s) + len(center) - both):
                        a.append(node)
                        b.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return task


def _verified(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def close(group: dict[int, tuple[int, int, bytes]], key: tuple[bool, int, int, int]) -> None:
            if len(group) < 2:
                return
            nodes = list(group)
            sets = [np.frombuffer(group[x][2], dtype=np.uint64) for x in nodes]
            side = np.array([group[x][0] != key[2] for x in nodes]) if key[2] != key[3] else None
            for i, j in spanning_links(sets, side, percent, [group[x][1] for x in nodes]):
                a.append(nodes[i])
                b.append(nodes[j])

        group: dict[int, tuple[int, int, bytes]] = {}
        current = None
        for batch in batches:
            for bucket, g, x, y, block, comp, node, s in zip(*(batch.column(name).to_pylist() for name in ("bucket", "g", "x", "y", "block", "comp", "node", "shingles")), strict=True):
                if (bucket, g, x, y) != current:
                    if current:
                        close(group, current)
                    group, current = {}, (bucket, g, x, y)
                group[node] = (block, comp, s)
        if current:
            close(group, current)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return task


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, n and shingles of wanted (node, rep, rep_hash, fp), from the texts of docs (id, text)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = WordHashes(), set()
        for batch in batches:
            columns = batch.select(["node", "fp"]).to_pydict()
            for part, texts in parts_of(batch.column("text")):
                rows: list[tuple[int, int, bytes]] = []
                for i, s in enumerate(shingle_sets(texts, k, hashes), part.start):
                    # Rows repeated under one id give one set; another text of the same hash gives none.
                    if columns["node"][i] not in done and _fingerprint(s) == columns["fp"][i]:
                        done.add(columns["node"][i])
                        rows.append((columns["node"][i], len(s), s.tobytes()))
                node, n, data = zip(*rows) if rows else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], ["node", "n", "shingles"])

    texts = docs.filter("id is not null and text is not null").withColumn("hash", F.xxhash64("text"))
    found = texts.join(wanted, (F.col("id") == F.col("rep")) & (F.col("hash") == F.col("rep_hash")))
    return found.select("node", "fp", "text").mapInArrow(made, "node long, n long, shingles binary")


def _dealt(groups: DataFrame, block_weight: int) -> DataFrame:
    """groups (bucket, g, node, comp, weight) with x, y and block: a row for each
    pair of blocks that a node is compared in."""
    key = ["bucket", "g"]
    per = groups.groupBy(*key, "comp").agg(F.sum("weight").alias("w"))
    per = per.groupBy(*key).agg(F.sum("w").alias("whole"), F.max(F.struct("w", -F.col("comp"))).alias("top"))
    parts = lambda w: F.when(F.col("whole") > block_weight, F.ceil(w / F.lit(block_weight))).otherwise(1).cast("int")
    per = per.select(*[F.col(c).alias(f"of_{c}") for c in key], (-F.col("top")["col2"]).alias("core"), parts(F.col("whole") - F.col("top")["w"]).alias("rest"), parts(F.col("top")["w"]).alias("cores"), (F.col("whole") > block_weight).alias("split"))
    rows = groups.join(per, (F.col("bucket") == F.col("of_bucket")) & (F.col("g") == F.col("of_g")))
    inner = F.col("comp") == F.col("core")
    place = F.xxhash64("node")
    block = F.when(~F.col("split"), 0).when(inner, F.col("rest") + F.pmod(place, F.col("cores"))).otherwise(F.pmod(place, F.col("rest"))).cast("int")
    # Those outside the heaviest component meet all blocks, those inside only the blocks outside.
    others = F.when(~F.col("split"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.when(inner, F.col("rest")).otherwise(F.col("rest") + F.col("cores")) - 1))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(others))
    return rows.select(*key, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "comp", "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 48, rows: int = 7, block_weight: int = 400_000, chunk: int = 64, most_blocks: int | None = None) -> DataFrame:
    """id_col, n_shingles, component_id, kept and text_hash (xxhash64) for each row of docs.

    Documents are linked at ``percent`` hundredths of Jaccard similarity over
    distinct k-word shingles. block_weight: a block's shingles plus 500 for each
    of its sets, about; two blocks are in a task's memory at a time. chunk: nodes
    that are compared with one copy of their center. most_blocks: blocks of a group
    of several buckets (as many as bands); a heavier one is verified by bucket.
    """
    spark = docs.sparkSession
    small_batches(spark)
    most_blocks = bands if most_blocks is None else most_blocks
    done: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        done.append(path)
        return df

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched, _ = written(sketch_table(docs, k, bands, rows), "near-sketch")

    linked = sketched.filter("id is not null and fp is not null")
    nodes = linked.groupBy("fp").agg(F.min(F.struct("id", "hash")).alias("rep"), F.first("bands").alias("bands"))
    nodes = kept(nodes.select("fp", F.col("rep")["id"].alias("rep"), F.col("rep")["hash"].alias("rep_hash"), "bands", F.monotonically_increasing_id().alias("node")), "near-nodes")

    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least <> most").select("key", "least")
    members = kept(keys.join(shared, "key").select("key", "node", "least"), "near-members")
    wanted = nodes.drop("bands").join(members.select("node").distinct(), "node")
    sets = kept(_sets(docs, wanted, k), "near-sets")

    # Each node with the center that it shares most buckets with.
    ties = members.filter("node <> least").groupBy("node", "least").agg(F.count(F.lit(1)).alias("times"))
    centers = kept(ties.groupBy("node").agg(F.max_by("least", F.struct("times", -F.col("least"))).alias("center")), "near-centers")
    chunks = centers.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("int").alias("chunks"))
    outer = centers.join(chunks, "center").select("center", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "node")
    inner = chunks.select("center", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("center").alias("node"))
    compared = outer.union(inner).join(sets, "node").select("center", "chunk", "node", "shingles").repartition("center", "chunk").sortWithinPartitions("center", "chunk", "node")
    first = kept(compared.mapInArrow(_with_centers(percent), "a long, b long"), "near-links")

    # Buckets that still hold several components, and the components that hang together by them.
    comps = connected_components(first, paths=done).withColumnRenamed("node", "of_node")
    named = kept(members.join(comps, F.col("node") == F.col("of_node"), "left").select("key", "node", F.coalesce("component", "node").alias("comp")), "near-named")
    pairs = named.select("key", "comp").distinct()
    open_ = pairs.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select(F.col("key").alias("of_key"), "low")
    open_ = kept(open_, "near-open")
    edges = pairs.join(open_, F.col("key") == F.col("of_key")).filter("comp <> low").select(F.col("comp").alias("a"), F.col("low").alias("b")).distinct()
    joined = connected_components(edges, paths=done).select(F.col("node").alias("of_comp"), F.col("component").alias("cluster"))
    weights = sets.select(F.col("node").alias("of_node"), (F.col("n") + 500).alias("weight"))
    left = named.select("node", "comp").distinct().join(joined, F.col("comp") == F.col("of_comp")).join(weights, F.col("node") == F.col("of_node"))
    left = kept(left.select("cluster", "node", "comp", "weight"), "near-clusters")
    heavy = left.groupBy("cluster").agg(F.sum("weight").alias("whole")).filter(F.col("whole") > block_weight * most_blocks).select(F.col("cluster").alias("of"))
    light = left.join(heavy, F.col("cluster") == F.col("of"), "left_anti").select(F.lit(False).alias("bucket"), F.col("cluster").alias("g"), "node", "comp", "weight")
    apart = left.join(heavy, F.col("cluster") == F.col("of"), "left_semi").select(F.col("node").alias("of_node"), "weight")
    buckets = named.join(open_, F.col("key") == F.col("of_key"), "left_semi").join(apart, F.col("node") == F.col("of_node")).select("key", "node", "comp", "weight")
    # Of buckets with the same nodes one is enough.
    alike = buckets.groupBy("key").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"), F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    alike = alike.groupBy("all", "n", "a", "b").agg(F.min("key").alias("of_key")).select("of_key")
    buckets = buckets.join(alike, F.col("key") == F.col("of_key"), "left_semi").select(F.lit(True).alias("bucket"), F.col("key").alias("g"), "node", "comp", "weight")
    tasks = _dealt(light.union(buckets), block_weight).join(sets.select("node", "shingles"), "node")
    tasks = tasks.repartition("bucket", "g", "x", "y").sortWithinPartitions("bucket", "g", "x", "y")
    second = kept(tasks.mapInArrow(_verified(percent), "a long, b long"), "near-links")

    found = connected_components(first.union(second), paths=done)
    named = nodes.select("node", "fp", "rep").join(found, "node", "left")
    heads = named.filter("component is not null").groupBy("component").agg(F.min("rep").alias("head")).withColumnRenamed("component", "c")
    named = named.join(heads, F.col("component") == F.col("c"), "left").select(F.col("fp").alias("f"), F.coalesce("head", "rep").alias("head"))
    named, _ = written(named, "near-heads")
    discard(spark, *done)
    out = sketched.select("id", "hash", "n", "fp").join(named, F.col("fp") == F.col("f"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("head", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), F.col("hash").alias("text_hash"))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4).drop("text_hash")
