"""Benchmark decontamination: BM25 over an inverted index of test items.

Index terms are pairs of neighbouring words (lower case, letters and digits): in
running text a test item's own pairs are rare, so almost every clean passage can
be dismissed by the bound below. A posting's impact is its BM25 weight divided by
the item's score for itself, so 1 means the whole item and one threshold fits
items of any length. Postings stand in blocks that know their largest impact.

For each item, every document is cut into overlapping passages twice as long as
the item; an item in a text lies whole in at least one. Retrieval goes over ranges
that hold the passages of the longest item, and so of every item, whole: a range's
terms are looked up at once for the whole document; where the sum of the terms'
largest impacts stays under the threshold nothing can be retrieved. All others
query the index with block-max WAND, which retrieves every item at or above the
threshold: no top-k, no cap. A retrieved item counts only if one of its own
passages reaches the threshold and overlaps its question and its answer (the last
sentence, where items have no fields of their own).

One narrow pass over whole texts with a broadcast index. Items are dealt by a hash
of id and text into as many blocks as give about ``block_bytes`` of text each; every
block is a broadcast variable, made one after another, and a worker goes through
them one at a time for each batch of documents: neither holds more than one block,
whatever the size of the benchmark. The weights come from the number, mean length
and term counts of all items, not of a block.

Items with fewer than ``least_terms`` distinct word pairs can't be told by overlap:
they are found as exact sequences of words, with a score and overlaps of 1, first
place first; an item of one word is found wherever that word is. In scripts
written without spaces between words every character is a word.

An item of one sentence has no answer: all of it is the question, of which
``question`` has to be there, beside the score; the answer's overlap is then 1.

Defined results: null or empty texts, and items without a word, match nothing;
very long texts are read whole; equal items, and items under one id or none, are all
reported, by id (null last) and text; of passages that tie the first one counts;
equal texts and repeated rows get equal rows; rows with a null id are reported under
null; an empty table on either side gives an empty result; extra columns are carried
along, but for one named like the result, which is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.llm.common import discard, in_turn, small_batches, table, written
from gridwright.llm.shingles import by_words

_WORD = re.compile(r"[^\W_]+")
# Han, kana, bopomofo and Yi; Thai, Lao, Burmese, Khmer, the Tai scripts, Balinese and Javanese.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3021-\u3029\u3031-\u3035\u3038-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\ua980-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001aff0-\U0001b16f\U00020000-\U000323af"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD_OR_CHARACTER = re.compile(f"[^\\W_{_UNSPACED}]+|(?=[^\\W_])[{_UNSPACED}]")
_SENTENCE = re.compile(r"(?<=[.?!])\s+")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    word = _WORD if text.isascii() or not _ANY_UNSPACED.search(text) else _WORD_OR_CHARACTER
    return word.findall(text)


def pairs_of(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def question_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last one (empty if there is only one)."""
    head, tail = text.strip(), ""
    cuts = list(_SENTENCE.finditer(head))
    if cuts:
        head, tail = head[: cuts[-1].start()], head[cuts[-1].end() :]
    return head, tail


class Index:
    """Block-max inverted index. Items are (id, question, answer). of_all: number
    and mean size of all items, and in how many of them each term is, if these
    items are only a part."""

    def __init__(self, items: list[tuple[int, str, str]], least_terms: int = 5, k1: float = 1.2, b: float = 0.75, block: int = 64, of_all: tuple[int, float, dict] | None = None) -> None:
        self.ids: list[int] = []
        self.parts: list[tuple[frozenset, frozenset]] = []
        grams: list[Counter] = []
        short: list[tuple[int, tuple[str, ...]]] = []
        for ident, question, answer in sorted(items, key=lambda x: (x[0] is None, x[0], x[1:])):
            q, a = words_of(question), words_of(answer)
            count = Counter(pairs_of(q + a))
            if len(count) >= least_terms:
                self.ids.append(ident)
                self.parts.append((frozenset(pairs_of(q)), frozenset(pairs_of(a))))
                grams.append(count)
            elif q + a:
                short.append((ident, tuple(q + a)))
        # Short items by their words, and the lengths of those that begin with a word.
        self.exact: dict[tuple[str, ...], list[int]] = {}
        self.lengths: dict[str, list[int]] = {}
        for ident, w in short:
            self.exact.setdefault(w, []).append(len(self.ids))
            self.ids.append(ident)
        for w in self.exact:
            self.lengths.setdefault(w[0], []).append(len(w))
        self.lengths = {w: sorted(set(x)) for w, x in self.lengths.items()}
        sizes = self.sizes = [sum(g.values()) for g in grams]
        self.longest = max(sizes, default=0)
        if of_all is None:
            of_all = len(grams), sum(sizes) / len(grams) if grams else 1.0, Counter(t for g in grams for t in g)
        n, mean, df = of_all
        weights: list[dict] = []
        for g, size in zip(grams, sizes):
            w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * size / mean)) for t, f in sorted(g.items())}
            whole = sum(w.values())
            weights.append({t: x / whole for t, x in w.items()})
        self.terms = sorted({t for g in grams for t in g})
        number = {t: i for i, t in enumerate(self.terms)}
        self.words: dict[str, int] = {}
        for t in self.terms:
            for w in t:
                self.words.setdefault(w, len(self.words) + 1)
        self.width = len(self.words) + 1
        codes = np.array([self.words[a] * self.width + self.words[c] for a, c in self.terms], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.term_of = codes[order], order
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.terms]
        self.impacts = [{number[t]: x for t, x in w.items()} for w in weights]
        for item, w in enumerate(weights):
            for t, x in w.items():
                self.postings[number[t]][0].append(item)
                self.postings[number[t]][1].append(x)
        self.bounds = np.array([max(x) for _, x in self.postings])
        self.blocks = [([p[min(i + block, len(p)) - 1] for i in range(0, len(p), block)], [max(x[i : i + block]) for i in range(0, len(p), block)]) for p, x in self.postings]

    def look_up(self, words: list[str]) -> np.ndarray:
        """Term number of each pair of neighbouring words; -1 if no item has it."""
        if len(words) < 2 or not len(self.codes):
            return np.full(max(0, len(words) - 1), -1)
        w = np.fromiter((self.words.get(x, 0) for x in words), dtype=np.int64, count=len(words))
        out = np.full(len(w) - 1, -1)
        can = np.flatnonzero((w[:-1] > 0) & (w[1:] > 0))
        code = w[can] * self.width + w[can + 1]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        out[can] = np.where(self.codes[at] == code, self.term_of[at], -1)
        return out

    def sequences(self, words: list[str]) -> dict[int, int]:
        """Each short item in the words, and its first place."""
        found: dict[int, int] = {}
        if not self.exact or self.lengths.keys().isdisjoint(words):
            return found
        for i, w in enumerate(words):
            for n in self.lengths.get(w, ()):
                for item in self.exact.get(tuple(words[i : i + n]), ()):
                    found.setdefault(item, i)
        return found

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every item whose impacts over these distinct terms reach threshold."""
        found = []
        eps = 1e-12
        cursors = [[self.postings[t][0][0], 0, t] for t in sorted(terms)]  # item, position, term
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                total += self.bounds[t]
                if total >= threshold - eps:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            near, ends = 0.0, []
            for c in cursors[: pivot + 1]:
                lasts, tops = self.blocks[c[2]]
                k = bisect_left(lasts, item)
                if k < len(lasts):
                    near += tops[k]
                    ends.append(lasts[k])
            if near >= threshold - eps:
                if cursors[0][0] == item:
                    score = sum(self.postings[c[2]][1][c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold - eps:
                        found.append((item, score))
                    goal = item + 1
                else:
                    goal = item
            else:
                # No item up to the end of the nearest block, or up to the next list's item, can reach it.
                goal = min(ends, default=item) + 1
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, item + 1)
            for c in cursors[: pivot + 1]:
                if c[0] < goal:
                    items = self.postings[c[2]][0]
                    c[1] = bisect_left(items, goal, c[1])
                    c[0] = items[c[1]] if c[1] < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


def passages(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """Overlapping ranges of n terms, twice as long as the longest item."""
    step = max(longest, 16)
    for start in range(0, max(n, 1), step):
        yield start, min(n, start + 2 * step)
        if start + 2 * step >= n:
            break


def ranges(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """Ranges of n terms that hold each passage of an item up to the longest whole."""
    step = max(longest, 16)
    for a, b in passages(n, longest):
        yield a, min(n, a + 3 * step)
        if b == n:
            break


def overlaps(text: str, index: Index, threshold: float, question: float, answer: float) -> list[tuple[int, float, float, float, int]]:
    """item, best score, question and answer overlap, first word of that passage (or sequence)."""
    words = words_of(text)
    best: dict[int, tuple[int, float, float, float, int]] = {i: (i, 1.0, 1.0, 1.0, a) for i, a in index.sequences(words).items()}
    terms = index.look_up(words)
    if not (terms >= 0).any():
        return [best[i] for i in sorted(best)]
    bound = np.r_[0.0, np.cumsum(np.where(terms >= 0, index.bounds[terms], 0.0))]
    near: set[int] = set()
    for a, b in ranges(len(terms), index.longest):
        if bound[b] - bound[a] < threshold - 1e-9:
            continue
        here = np.unique(terms[a:b])
        near.update(item for item, _ in index.retrieve(here[here >= 0].tolist(), threshold))
    places: dict[int, list[int]] = {}
    if near:
        for i in np.flatnonzero(terms >= 0).tolist():
            places.setdefault(int(terms[i]), []).append(i)
    for item in near:
        step = max(index.sizes[item], 16)
        cells: dict[int, set[int]] = {}  # the item's terms in each passage
        for t in index.impacts[item]:
            for i in places.get(t, ()):
                cells.setdefault(i // step, set()).add(t)
                if i >= step:
                    cells.setdefault(i // step - 1, set()).add(t)
        q, r = index.parts[item]
        for cell in sorted(cells):
            score = sum(index.impacts[item][t] for t in sorted(cells[cell]))
            if score < threshold - 1e-12 or (item in best and score <= best[item][1]):
                continue
            grams = {index.terms[t] for t in cells[cell]}
            in_q = len(q & grams) / len(q) if q else 1.0
            in_a = len(r & grams) / len(r) if r else 1.0
            if in_q >= question and in_a >= answer:
                best[item] = (item, score, in_q, in_a, cell * step)
    return [best[i] for i in sorted(best)]


def terms_of_items(items: DataFrame, split: bool, n_blocks: int, least_terms: int) -> tuple[int, float, DataFrame]:
    """Number and mean size of the items that are indexed by terms; and a row for
    each of their terms: in how many items it is, and the blocks of these."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term: list[str | None] = []
            block: list[int] = []
            size: list[int | None] = []
            for row in batch.to_pylist():
                q, a = (row["question"] or "", row["answer"] or "") if split else question_answer(row["text"] or "")
                count = Counter(pairs_of(words_of(q) + words_of(a)))
                if len(count) >= least_terms:
                    term += [None, *(" ".join(t) for t in count)]
                    block += [row["block"]] * (len(count) + 1)
                    size += [sum(count.values()), *[None] * len(count)]
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(block, pa.int64()), pa.array(size, pa.int64())], ["term", "block", "size"])

    rows = items.withColumn("block", block_of(items, n_blocks).cast("long")).mapInArrow(counted, "term string, block long, size long")
    n, size = rows.filter("term IS NULL").agg(F.count("size"), F.sum("size")).first()
    terms = rows.filter("term IS NOT NULL").groupBy("term").agg(F.count("block").alias("n"), F.collect_set("block").alias("blocks"))
    return n, size / n if n else 1.0, terms


def block_of(items: DataFrame, n_blocks: int) -> Column:
    """By id and text, so that items under one id or none are dealt out too."""
    return F.pmod(F.xxhash64(*items.columns), F.lit(n_blocks))


def overlap_column(docs: DataFrame, items: DataFrame, text_col: str = "text", name: str = "hits", threshold: float = 0.5, question: float = 0.6, answer: float = 0.6, least_terms: int = 5, block_bytes: int = 16_000_000) -> DataFrame:
    """docs with an array of (item_id, score, question_overlap, answer_overlap,
    first_word): what each document contains of the items. A column of that name
    is replaced.

    items: item_id and text, or item_id, question and answer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    split = {"question", "answer"} <= set(items.columns)
    items = items.select(F.col("item_id").cast("long"), *(["question", "answer"] if split else ["text"]))
    text = [c for c in items.columns if c != "item_id"]
    size = items.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(0)))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    hit = pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in ("score", "question_overlap", "answer_overlap")), ("first_word", pa.int64())])
    names = [f.name for f in hit]
    found = T.ArrayType(T.StructType([T.StructField(n, T.DoubleType() if n in names[1:4] else T.LongType()) for n in names]))

    shown = [f for f in docs.schema.fields if f.name.lower() != name.lower()]

    paths, of_all = [], None
    if n_blocks > 1:
        n, mean, terms = terms_of_items(items, split, n_blocks, least_terms)
        terms, path = written(terms, "decontamination-terms")
        paths.append(path)
    blocks = []
    for block in range(n_blocks):
        rows = items.filter(block_of(items, n_blocks) == block).collect()  # block_bytes of text, about
        listed = [(r["item_id"], r["question"] or "", r["answer"] or "") if split else (r["item_id"], *question_answer(r["text"] or "")) for r in rows]
        if n_blocks > 1:
            of_all = n, mean, {tuple(r["term"].split(" ")): r["n"] for r in terms.filter(F.array_contains("blocks", F.lit(block).cast("long"))).select("term", "n").collect()}
        blocks.append(spark.sparkContext.broadcast(Index(listed, least_terms, of_all=of_all)))
    discard(spark, *paths)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            hits: list[list[dict]] = [[] for _ in texts]
            for known in in_turn(blocks):
                for i, t in enumerate(texts):
                    if t:
                        hits[i] += [dict(zip(names, (known.ids[h[0]], *h[1:]))) for h in overlaps(t, known, threshold, question, answer)]
            if len(blocks) > 1:
                hits = [sorted(h, key=lambda x: (x["item_id"] is None, x["item_id"])) for h in hits]
            for part in by_words(texts):
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(part.start, part.stop - part.start) for f in shown), pa.array(hits[part], pa.list_(hit))], [*(f.name for f in shown), name])

    return docs.mapInArrow(searched, T.StructType([*shown, T.StructField(name, found)]))


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id and the fields of overlap_column for each document and item in it."""
    found = overlap_column(docs.select(id_col, text_col), items, text_col, "__hits", **options)
    return found.select(id_col, F.explode("__hits").alias("h")).select(id_col, "h.*")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
