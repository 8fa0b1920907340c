"""Language identification by prediction by partial matching.

For every language a tree of byte contexts up to three bytes long is learned
from a sample. A context gives a symbol it has seen the probability
count / (total + distinct), and the escape probability distinct / (total +
distinct) to all others, which is shared out in proportion to what the next
shorter context gives them; below the empty context all 256 bytes are equally
likely. A context that a language never saw passes on to the shorter one for free.
The statistics are then frozen: the code length of a text under a language is a
sum of table entries, exact, and the shortest code wins.

Nothing is left out of the tables: every byte is a symbol, every context that the
sample has is there. Contexts of one byte make a full table; for longer ones only
what was seen is stored, as the difference that it makes to the code length that
the shorter context gives.

Learning: the documents per language are counted, then each is taken with the
probability that gives about ``sample_docs`` for its language, by a hash of its
id. Whole texts are counted on the executors, into a table. Languages go through
the driver in groups of at most ``languages_at_once``, and with at most
``entries_at_once`` table entries where a group has more than one; each group is a
broadcast variable of its own, and a worker holds one of several at a time. So the
number of languages grows neither the driver's memory nor a worker's.

Prediction reads whole texts, in slices of bounded size, in one narrow pass without
a shuffle.

Defined results: texts that are null or without a letter are ``und`` with score
0; so is everything if nothing could be learned; very long texts are read to their
end; ties go to the first language by code point; equal texts and repeated rows get
equal results; an empty table gives an empty result; a null id counts as the empty
text when documents are held out; extra columns are carried along, but for those
named like results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.llm.common import discard, in_turn, small_batches, table, written
from gridwright.llm.shingles import by_words

ORDER = 3
_LETTER = regex.compile(r"\p{L}")
#: Digits count as 0 and blanks as the space.
_FOLD = bytes.maketrans(b"123456789\t\n\r\x0b\x0c", b"000000000     ")


def _bytes(text: str) -> bytes:
    """What the model reads: a context of spaces, then the lower-cased text."""
    return b"   " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD)


class Rows:
    """Rows of values by key: a hash table with linear probing; 0 without a row."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.values = np.concatenate([np.zeros((1, values.shape[1]), np.float32), values.astype(np.float32)])
        self.keys = np.concatenate([[-1], keys.astype(np.int64)])
        self.slots = np.zeros(1 << bits, dtype=np.int32)
        at, left = self._home(keys.astype(np.int64)), np.arange(1, len(keys) + 1)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]  # of several the last one stays
            lost = self.slots[at] != left
            at, left = (at[lost] + 1) & self.mask, left[lost]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, 0 if there is none."""
        at = self._home(keys)
        row = self.slots[at]
        open_ = np.flatnonzero((row > 0) & (self.keys[row] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            row[open_] = self.slots[at[open_]]
            open_ = open_[(row[open_] > 0) & (self.keys[row[open_]] != keys[open_])]
        return row


@dataclass
class LanguageModel:
    """Code lengths in bits are sums, over a text's bytes, of ``pairs`` at (byte
    before, byte), ``escapes`` at the two bytes before, and what ``threes`` and
    ``fours`` have for the last three and four bytes."""

    languages: list[str]
    pairs: np.ndarray  #: 65536 x languages
    escapes: np.ndarray  #: 65536 x languages: what leaving a context of two costs
    threes: Rows  #: for each language what three bytes save at the last of them, then what leaving them as a context costs
    fours: Rows  #: for each language what four bytes save at the last of them

    def code_lengths(self, data: list[bytes], at_once: int = 1 << 17) -> np.ndarray:
        """Bits of each text, as _bytes gives them (rows), under each language
        (columns); at_once: bytes looked up together, whatever texts they are of."""
        out = np.zeros((len(data), len(self.languages)))
        here: list[tuple[int, bytes]] = []
        size = 0
        for i, d in enumerate(data):
            for start in range(0, max(1, len(d) - ORDER), at_once):
                piece = d[start : start + at_once + ORDER]
                if here and size + len(piece) > at_once:
                    self._add(here, out)
                    here, size = [], 0
                here.append((i, piece))
                size += len(piece)
        if here:
            self._add(here, out)
        return out

    def _add(self, pieces: list[tuple[int, bytes]], out: np.ndarray) -> None:
        """Every byte of a piece but its first three, which are context."""
        b = np.frombuffer(b"".join(d for _, d in pieces), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(d) for _, d in pieces])
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        n = len(self.languages)
        row = self.threes.find(three)
        bits = self.pairs[two[2:]] + self.escapes[two[1:-1]]
        bits += self.threes.values[row[1:], :n] + self.threes.values[row[:-1], n:]
        bits += self.fours.values[self.fours.find(three[:-1] << 8 | b[3:])]
        # Entry j is for byte j + 3 of all pieces together; between pieces three entries belong to none.
        starts = np.r_[0, ends[:-1]]
        full = [(i, s, e - ORDER) for (i, _), s, e in zip(pieces, starts.tolist(), ends.tolist()) if e - ORDER > s]
        if full:
            edges = np.array([x for _, s, e in full for x in (s, e)])
            # The last end can lie behind the last entry, where reduceat takes no index.
            sums = np.add.reduceat(np.concatenate([bits, np.zeros((1, n), np.float32)]), edges, axis=0, dtype=np.float64)[::2]
            np.add.at(out, [i for i, _, _ in full], sums)


def held_out(doc_id: Column) -> Column:
    """The quarter of the documents which learning never sees."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = np.array(batch.column("lang").to_pylist()), batch.column("text").to_pylist()
        for part in by_words(texts):
            for lang in np.unique(langs[part]).tolist():
                grams = []
                for t, here in zip(texts[part], langs[part].tolist()):
                    if here == lang:
                        b = np.frombuffer(_bytes(t), dtype=np.uint8).astype(np.int64)
                        grams.append(((b[:-3] << 8 | b[1:-2]) << 8 | b[2:-1]) << 8 | b[3:])
                code, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n.astype(np.int64))], ["lang", "code", "n"])


def _groups(sizes: dict[str, int], most: int, entries: int) -> list[list[str]]:
    """Languages in order, in groups of at most ``most`` with ``entries`` in all (or of one)."""
    out: list[list[str]] = []
    room = 0
    for lang in sorted(sizes):
        if not out or len(out[-1]) == most or room < sizes[lang]:
            out.append([])
            room = entries
        out[-1].append(lang)
        room -= sizes[lang]
    return out


def fit(docs: DataFrame, sample_docs: int = 1500, languages_at_once: int = 16, entries_at_once: int = 1_500_000) -> list[Broadcast]:
    """Learn from docs (id, text, lang): models of groups of languages, broadcast;
    none if they hold nothing to learn from."""
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # a number for each language
    if not rows:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, min(1.0, sample_docs / n))])
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.filter(draw < share[F.col("lang")])
    counts = sample.select("lang", "text").mapInArrow(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts, path = written(counts, "language-counts")
    sizes = {r[0]: r[1] for r in counts.groupBy("lang").count().collect()}
    models = []
    for group in _groups(sizes, languages_at_once, entries_at_once):
        found: pd.DataFrame = counts.filter(F.col("lang").isin(group)).toPandas()
        models.append(sc.broadcast(_tables(found, group)))
    discard(docs.sparkSession, path)
    return models


def _tables(found: pd.DataFrame, languages: list[str]) -> LanguageModel:
    many = len(languages)
    lang = found["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy(np.int64)
    code, n = found["code"].to_numpy(np.int64), found["n"].to_numpy(np.float64)

    def seen(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, last ``length`` bytes and count of everything seen, in order."""
        key, at = np.unique(lang << 32 | code & ((1 << 8 * length) - 1), return_inverse=True)
        return key >> 32, key & 0xFFFFFFFF, np.bincount(at, n, len(key))

    def blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Probabilities of full tables, symbols along the last axis."""
        total, distinct = counts.sum(axis=-1, keepdims=True), (counts > 0).sum(axis=-1, keepdims=True)
        unseen = np.where(counts > 0, 0, shorter)
        left = unseen.sum(axis=-1, keepdims=True)
        escape = np.where(distinct < 256, distinct, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(counts > 0, counts / (total + escape), unseen / left * (escape / (total + escape)))
        return np.where(total > 0, p, shorter)

    one, two = np.zeros((many, 256)), np.zeros((many, 256, 256))
    of, gram, count = seen(1)
    one[of, gram] = count
    of, gram, count = seen(2)
    two[of, gram >> 8, gram & 255] = count
    pairs = -np.log2(blend(two, blend(one, np.full((many, 256), 1 / 256))[:, None, :])).reshape(many, 65536)

    def longer(length: int, shorter: np.ndarray, shorter_keys: np.ndarray | None) -> tuple:
        """For what was seen of this length: language, bytes, bits, what they save
        against the shorter context; and language, context and cost of leaving it.

        shorter: bits of the same last byte after the shorter context, of everything
        seen there (what was seen after a longer context was after the shorter)."""
        of, gram, count = seen(length)
        low = gram & ((1 << 8 * (length - 1)) - 1)
        without = shorter[of, low] if shorter_keys is None else shorter[np.searchsorted(shorter_keys, of << 32 | low)]
        context, at = np.unique(of << 32 | gram >> 8, return_inverse=True)
        total, distinct = np.bincount(at, count), np.bincount(at)
        left = np.maximum(1 - np.bincount(at, np.exp2(-without)), 1e-12)
        escape = np.where(distinct < 256, distinct, 0)
        with np.errstate(divide="ignore"):
            leave = np.where(escape > 0, np.log2(left) - np.log2(escape / (total + escape)), 0.0)
        bits = np.log2((total + escape)[at]) - np.log2(count)
        return of, gram, bits, bits - without - leave[at], context >> 32, context & 0xFFFFFFFF, leave

    of3, gram3, bits3, saves3, of2, context2, leave2 = longer(3, pairs, None)
    of4, gram4, _, saves4, of3c, context3, leave3 = longer(4, bits3, of3 << 32 | gram3)
    escapes = np.zeros((65536, many), dtype=np.float32)
    escapes[context2, of2] = leave2

    def rows(width: int, *parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Rows:
        keys = np.unique(np.concatenate([k for _, k, _ in parts]))
        values = np.zeros((len(keys), width), dtype=np.float32)
        for column, k, v in parts:
            values[np.searchsorted(keys, k), column] = v
        return Rows(keys, values)

    return LanguageModel(languages, np.ascontiguousarray(pairs.T).astype(np.float32), escapes, rows(2 * many, (of3, gram3, saves3), (of3c + many, context3, leave3)), rows(many, (of4, gram4, saves4)))


def predict(docs: DataFrame, models: list[Broadcast], text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """docs with the language of the shortest code, its share of the likelihood
    (0 to 1) and its bits per byte (null for ``und``). Columns of these names are
    replaced."""
    small_batches(docs.sparkSession)
    taken = {n.lower() for n in names}
    kept = [f for f in docs.schema.fields if f.name.lower() not in taken or f.name == text_col]
    shown = [f for f in kept if f.name.lower() not in taken]
    schema = T.StructType([*shown, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            able = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if models else []
            best, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            # The shortest code so far and its language; and how much likelier all languages are together.
            least, pick, whole = np.full(len(able), np.inf), np.empty(len(able), dtype=object), np.zeros(len(able))
            sizes = np.ones(len(able))
            for model in in_turn(models) if able else ():
                for part in by_words([texts[i] for i in able]):
                    data = [_bytes(texts[i]) for i in able[part]]
                    sizes[part] = [len(d) - ORDER for d in data]
                    lengths = model.code_lengths(data)
                    shortest = lengths.min(axis=1)
                    low = np.minimum(least[part], shortest)
                    whole[part] = np.where(np.isinf(least[part]), 0, whole[part] * np.exp2(low - least[part])) + np.exp2(low[:, None] - lengths).sum(axis=1)
                    better = shortest < least[part]
                    pick[part] = np.where(better, np.array(model.languages, dtype=object)[lengths.argmin(axis=1)], pick[part])
                    least[part] = low
            for i, *found in zip(able, pick.tolist(), (1 / whole).tolist(), (least / sizes).tolist()):
                best[i], score[i], rate[i] = found
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in shown), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], [*(f.name for f in shown), *names])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(scored, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = fit(docs.filter(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))
    lean = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(lean, models).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")
