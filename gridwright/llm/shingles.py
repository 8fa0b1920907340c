"""Word shingle sets and their sketches, computed over batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered for up to ``most`` words."""

    def __init__(self, most: int = 60_000) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and 0x09-0x0D, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_sets(texts: Iterable[str | None], k: int, hashes: WordHashes) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes; with
    fewer words the whole sequence is one shingle; without words the set is empty."""
    out = []
    for text in texts:
        words = words_of(text)
        n = len(words)
        if not n:
            out.append(np.empty(0, dtype=np.uint64))
            continue
        w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
        size = min(k, n)
        acc = np.full(n - size + 1, size, dtype=np.uint64)
        for j in range(size):
            acc = mixed(acc * _ODD + w[j : n - size + 1 + j])
        out.append(np.unique(acc))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches: a row of t coordinates for each non-empty set.

    In round i < t every element is thrown into one of the t bins with a value
    that carries i in its high bits, so an earlier round always wins; in round
    t + j every element goes into bin j, so after 2t rounds each coordinate is
    filled. A set leaves as soon as its bins are full: a set of n elements needs
    about t ln t / n rounds. Two sets agree in a coordinate with the probability
    of their Jaccard similarity, and the number of agreements concentrates as
    if coordinates were independent.
    """
    n = len(sets)
    out = np.full(n * t, _FULL, dtype=np.uint64)
    values = np.concatenate(sets) if n else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    for i in range(2 * t):
        if not len(values):
            break
        x = mixed(values + np.uint64((i + 1) * int(_ODD) % 2**64))
        bins = ((x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, (np.uint64(i) << np.uint64(52)) | (mixed(x) >> np.uint64(12)))
        hollow = (out.reshape(n, t) == _FULL).any(axis=1)
        left = hollow[owner]
        if not left.all():
            values, owner = values[left], owner[left]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for each row and band; the band's number is part of it."""
    n, t = sketch.shape
    rows = sketch.reshape(n, bands, t // bands)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for j in range(rows.shape[2]):
        acc = mixed(acc * _ODD + rows[:, :, j])
    return acc


def by_words(texts: list[str | None], most: int = 1_500_000) -> Iterator[slice]:
    """Slices of consecutive texts with about ``most`` characters each."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def parts_of(texts: pa.Array, most: int = 400_000) -> Iterator[tuple[slice, list[str | None]]]:
    """The same of an Arrow column, each slice with its texts: no more of them are
    Python strings at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield slice(start, stop), texts.slice(start, stop - start).to_pylist()
        start = stop
