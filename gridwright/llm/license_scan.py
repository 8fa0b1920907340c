"""Licence scan: Dice coefficient over word bigrams against licence templates.

Texts are normalised (lower case, words of letters and digits; on a line that
begins with a copyright statement (the word, or a sign and a year), the statement is
left out: years and holder up to the end of the sentence, to a template's first words, or to twelve words of
holder). A unit is any run of words at least as long as the template it is
compared with, wherever it begins and ends, or a shorter one that begins and ends
with a line or a sentence: a short run cut out of a sentence could leave out just
the words that tell licences apart. A unit of n bigrams has a Dice coefficient of
t against a template of m only if n is between t/(2-t) and (2-t)/t times m, so
t/(2-t) times m of the template's bigrams have to stand that close together; the
few places left are compared exactly, as multisets, from every bigram of the
template on. Of units that overlap the one stays that exceeds the threshold by
most bigrams, so an altered licence isn't given up for a short notice inside it.

One narrow pass over whole texts. The templates are a fixed list; a caller's own
list is broadcast after a check of its size.

Defined results: null, empty and blank texts, and texts without a match, give no
row; very long texts are read whole; equal texts and repeated rows give equal rows;
several matches can stand on one line; ties go
to the longer unit, then to the first one, then to the first template by name; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridwright.llm.common import small_batches, table
from gridwright.llm.shingles import by_words

# Public licence notices and texts.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_UNLICENSE_REST = """

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_CC0 = """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.

You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."""
_CC = """This work is licensed under the Creative Commons {kind} License."""
_CC_VISIT = """ To view a copy of this license, visit http://creativecommons.org/licenses/{code}/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""

TEMPLATES: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
    ("Apache-2.0", _APACHE),
    ("GPL-2.0", _GPL.format(name="General Public License", v="2")),
    ("GPL-3.0", _GPL.format(name="General Public License", v="3")),
    ("LGPL-2.1", _GPL.format(name="Lesser General Public License", v="2.1")),
    ("LGPL-3.0", _GPL.format(name="Lesser General Public License", v="3")),
    ("AGPL-3.0", _GPL.format(name="Affero General Public License", v="3")),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + _UNLICENSE_REST),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("CC0-1.0", _CC0),
]
# Notices of Creative Commons licences, as their legal pages word them.
for _code, _kind in [("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")]:
    for _v, _where in [("3.0", "Unported"), ("4.0", "International")]:
        _short = _CC.format(kind=f"{_kind} {_v} {_where}")
        TEMPLATES.append((f"CC-{_code.upper()}-{_v}", _short))
        TEMPLATES.append((f"CC-{_code.upper()}-{_v}", _short + _CC_VISIT.format(code=f"{_code}/{_v}")))
# Notices of one line, in the forms that pages and files carry them.
for _name, _said in [
    ("MIT", "the MIT License"),
    ("ISC", "the ISC License"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "the Mozilla Public License, version 2.0"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-3.0", "CC BY 3.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-3.0", "CC BY-SA 3.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
]:
    for _way in ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.", "This software is licensed under {}."):
        TEMPLATES.append((_name, _way.format(_said)))

_WORD = re.compile(r"[^\W_]+")
_WORD_OR_END = re.compile(r"[^\W_]+|[.!?;:](?=\s)")
# The word is part of the licence before some others: lines can be wrapped there.
_COPYRIGHT = re.compile(r"[\W_]*(?:copyright(?![^\W_])(?!\W*$)(?!\W+(?:notices?|holders?|owners?|laws?|licen[sc]es?|statements?)(?![^\W_]))|(?:\(c\)|\xa9)(?=\W*\d{4}(?![^\W_])))(?:[\W_]*(?:\(c\)|©|c(?![^\W_])|\d{4}(?![^\W_])|present(?![^\W_])|by(?![^\W_])))*")
_RIGHTS = re.compile(r"[\W_]*all rights reserved(?![^\W_])")


def unstated(line: str, first: frozenset[tuple[str, str]] = frozenset(), most: int = 12) -> str:
    """A line in lower case from behind its copyright statements on. first: pairs
    of words that begin a template, where a holder ends at the latest."""
    while stated := _COPYRIGHT.match(line):
        at, held, last = stated.end(), 0, None
        for x in _WORD_OR_END.finditer(line, at):
            if x[0] in ".!?;:":
                at = x.end()
                break
            if last and (last[0], x[0]) in first:
                at = last.start()
                break
            if held == most:
                at = x.start()
                break
            held, last = held + 1, x
        else:
            return ""
        line = line[at:]
        if rights := _RIGHTS.match(line):
            line = line[rights.end() :]
    return line


def words_of(text: str) -> list[str]:
    """Normalised words; copyright statements at the start of lines don't count."""
    return [x for line in text.lower().split("\n") for x in _WORD.findall(unstated(line))]


def dice(a: Counter, b: Counter) -> float:
    """Of two bigram multisets."""
    both = sum(min(n, b[x]) for x, n in a.items())
    whole = sum(a.values()) + sum(b.values())
    return 2 * both / whole if whole else 0.0


class Templates:
    """Templates by size, with the vocabulary and bigrams that occur in any."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        self.threshold = threshold
        rows, first = [], set()
        for name, text in templates:
            w = words_of(text)
            if len(w) > 1:
                first.add((w[0], w[1]))
                rows.append((len(w) - 1, name, Counter(zip(w, w[1:]))))
        self.opening = frozenset(first)
        self.rows = sorted(rows, key=lambda r: r[:2])
        self.sizes = np.array([r[0] for r in self.rows])
        self.ids: dict[str, int] = {}
        for _, _, grams in self.rows:
            for pair in grams:
                for w in pair:
                    self.ids.setdefault(w, len(self.ids) + 1)
        n = self.width = len(self.ids) + 1
        self.known = np.unique([self.ids[a] * n + self.ids[b] for _, _, g in self.rows for a, b in g]) if self.rows else np.empty(0, dtype=np.int64)
        # Of each template its bigrams, by number, and how often it has them; and the same by bigram.
        self.grams: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        for _, _, g in self.rows:
            code = np.array([self.ids[a] * n + self.ids[b] for a, b in g], dtype=np.int64)
            order = np.argsort(code)
            self.grams.append(np.searchsorted(self.known, code[order]))
            self.times.append(np.fromiter(g.values(), dtype=np.int64, count=len(g))[order])
        of = np.concatenate(self.grams) if self.rows else np.empty(0, dtype=np.int64)
        order = np.argsort(of, kind="stable")
        self.first = np.searchsorted(of[order], np.arange(len(self.known) + 1))
        self.holders = np.repeat(np.arange(len(self.rows)), [len(g) for g in self.grams])[order]
        self.held = np.concatenate(self.times)[order] if self.rows else of
        # Bigrams of the template that a unit needs, and bigrams that it has at most.
        self.least = np.ceil(self.sizes * threshold / (2 - threshold) - 1e-9).astype(np.int64)
        self.most = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9).astype(np.int64)
        self.bounds = sorted({(int(k), int(m)) for k, m in zip(self.least, self.most)})

    def look_up(self, words: list[str]) -> np.ndarray:
        """The number of each bigram; -1 if no template has it."""
        w = np.fromiter((self.ids.get(x, 0) for x in words), dtype=np.int64, count=len(words))
        code = w[:-1] * self.width + w[1:]
        if not len(self.known):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
        return np.where((self.known[at] == code) & (w[:-1] > 0) & (w[1:] > 0), at, -1)

    def hits(self, words: list[str]) -> np.ndarray:
        """Of each bigram, whether any template has it."""
        return self.look_up(words) >= 0

    def near(self, at: np.ndarray, gram: np.ndarray) -> list[int]:
        """Templates that can be in a text with these bigrams, at these places."""
        if not any(len(at) >= k and (at[k - 1 :] - at[: len(at) - k + 1] < most).any() for k, most in self.bounds):
            return []
        distinct, times = np.unique(gram, return_counts=True)
        n = self.first[distinct + 1] - self.first[distinct]
        flat = np.repeat(self.first[distinct] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        have = np.bincount(self.holders[flat], np.minimum(self.held[flat], np.repeat(times, n)), len(self.rows))
        return np.flatnonzero(have >= self.least).tolist()

    def best(self, words: list[str], hits: int) -> tuple[float, str] | None:
        n, t = len(words) - 1, self.threshold
        if n < 1:
            return None
        low, high = np.searchsorted(self.sizes, [np.ceil(n * t / (2 - t) - 1e-9), np.floor(n * (2 - t) / t + 1e-9) + 0.5])
        grams = None
        found: tuple[float, str] | None = None
        for size, name, other in self.rows[low:high]:
            if 2 * min(hits, size) < t * (n + size):
                continue
            grams = grams or Counter(zip(words, words[1:]))
            d = dice(grams, other)
            if d >= t and (found is None or (-d, name) < (-found[0], found[1])):
                found = (d, name)
        return found


class Places:
    """The places of one template's bigrams in a text, and the best unit from each."""

    def __init__(self, templates: Templates, number: int, at: np.ndarray, gram: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> None:
        self.size, self.name, _ = templates.rows[number]
        self.threshold, self.opens = templates.threshold, opens
        own, times = templates.grams[number], templates.times[number]
        i = np.minimum(np.searchsorted(own, gram), len(own) - 1)
        here = own[i] == gram
        self.at, i = at[here], i[here]
        self.closes = closes[self.at + 1]
        # A bigram counts unless the template's number of them stands before it in the unit: the last that is one too many.
        order, n = np.argsort(i, kind="stable"), np.arange(len(i))
        before = n - times[i[order]]
        same = (before >= 0) & (i[order][before] == i[order])
        self.before = np.full(len(i), -1)
        self.before[order[same]] = order[before[same]]
        self.stop = np.searchsorted(self.at, self.at + templates.most[number])
        # Neither repeated bigrams nor words around them count in this bound.
        reach = 2 * (n + 1) - self.threshold * self.at
        top = np.maximum.accumulate(reach[::-1])[::-1] - 2 * n + self.threshold * self.at
        self.starts = np.flatnonzero((self.stop - n >= templates.least[number]) & (top >= self.threshold * (self.size + 1) - 1e-9)).tolist()

    def best(self, i: int, limit: int | None = None) -> tuple | None:
        """Excess, Dice, and first and last word of the best unit from place i on and before word limit."""
        stop = self.stop[i] if limit is None else min(self.stop[i], np.searchsorted(self.at, limit - 1))
        if stop <= i:
            return None
        first = self.at[i]
        both = np.cumsum(self.before[i:stop] < i)
        n = np.minimum(self.closes[i:stop] - self.opens[first], np.maximum(self.at[i:stop] - first + 1, self.size))
        over = 2 * both - self.threshold * (n + self.size)
        j = len(over) - 1 - int(over[::-1].argmax())
        if over[j] < -1e-9:
            return None
        return float(over[j]), 2 * int(both[j]) / int(n[j] + self.size), int(first), int(self.at[i + j]) + 1


def edges(lines: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n words, the word that its line's or sentence's part begins and ends with."""
    opens, closes = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    first = i = 0

    def close() -> None:
        nonlocal first
        opens[first:i], closes[first:i] = first, i - 1
        first = i

    for line in lines:
        for x in _WORD_OR_END.findall(line):
            if x in ".!?;:":
                close()
            else:
                i += 1
        close()
    return opens, closes


def scan_text(text: str, templates: Templates) -> list[tuple[str, float, int, int]]:
    """licence, Dice coefficient, first and last line (from 0) of each match."""
    lines = [unstated(x, templates.opening) for x in text.lower().split("\n")]
    words = [_WORD.findall(x) for x in lines]
    everything = [x for w in words for x in w]
    if len(everything) < 2:
        return []
    gram = templates.look_up(everything)
    at = np.flatnonzero(gram >= 0)
    gram = gram[at]
    near = templates.near(at, gram)
    if not near:
        return []
    opens, closes = edges(lines, len(everything))
    places = [Places(templates, number, at, gram, opens, closes) for number in near]
    heap: list[tuple] = []

    def offer(k: int, i: int, limit: int | None = None) -> None:
        if found := places[k].best(i, limit):
            over, score, a, b = found
            heapq.heappush(heap, (-round(over, 9), a - b, a, places[k].name, k, i, b, score))

    for k, p in enumerate(places):
        for i in p.starts:
            offer(k, i)
    ends = np.cumsum([len(w) for w in words])
    kept: list[tuple[int, int]] = []  # words, in order
    out = []
    while heap:
        _, _, a, name, k, i, b, score = heapq.heappop(heap)
        n = bisect_right(kept, (a, len(everything)))
        if n and kept[n - 1][1] >= a:
            continue
        if n < len(kept) and kept[n][0] <= b:
            offer(k, i, kept[n][0])  # what ends before that one
            continue
        insort(kept, (a, b))
        out.append((a, (name, score, int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "right")))))
    return [f for _, f in sorted(out)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, most_template_bytes: int = 32_000_000) -> DataFrame:
    """id, license, dice, first_line and last_line for each match in docs.

    templates: name and text; up to most_template_bytes of text in all.
    """
    small_batches(docs.sparkSession)
    chosen = TEMPLATES if templates is None else templates
    if sum(len(t) for _, t in chosen) > most_template_bytes:
        raise ValueError(f"templates are larger than {most_template_bytes} characters: scan with parts of the list")
    shared = docs.sparkSession.sparkContext.broadcast(Templates(chosen, threshold))
    kind = docs.schema[id_col].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            for part in by_words(texts):
                rows = [(part.start + i, *m) for i, t in enumerate(texts[part]) if t for m in scan_text(t, known)]
                take, name, score, a, b = zip(*rows) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(take, pa.int64())), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                    [id_col, "license", "dice", "first_line", "last_line"],
                )

    return docs.select(id_col, text_col).mapInArrow(scanned, f"`{id_col}` {kind}, license string, dice double, first_line int, last_line int")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
