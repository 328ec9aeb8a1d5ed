"""License notices in documents, by patience alignment with templates.

A window of a text and a template are aligned on the words that each of them has exactly once: those in both that keep their
order (the longest increasing subsequence) become anchors, and the gaps between them are aligned in the same way, where further
words are unique. Coverage is the share of the template's words that found their place.

Windows are twice as long as the template and start every half template; only those with enough different words of the template
are aligned, which loses none of the coverage asked for.

Licenses differ by few words (a version, a clause), which no share of words tells apart. So a notice has phrases that must stand in
the text as they are, and of notices that overlap the one with most words found counts.
"""

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epsgroup.llm.words import _SPACE, LOWER, hashed, slices, words
from epsgroup.ship import ship

COVERAGE = 0.9  # of a notice with phrases one word may lack in any case, but none of its phrases
MARKERS = "1 2 3 4 5 a b c d e i ii iii iv v"  # of lists: they may stand inside a phrase
LATER = tuple(f"{a} {b}" for a in ("or", "and") for b in ("later", "newer", "higher", "greater", "above", "any", "at"))

_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes "
    "software developed by the organization. "
)
_BSD_NAME = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
    "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_PHRASES = (
    "permission is hereby granted free of charge", "subject to the following conditions",
    "copies or substantial portions of the software the software is provided as is",
)
_GPL = "This work is licensed under the GNU General Public License, version 3"
_CC = "This work is licensed under a Creative Commons Attribution"

# Notices as licensors ask to write them, by SPDX identifier, and phrases that tell them from their siblings.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2.0",)),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2.0",),
    ),
    ("MIT", "Released under the MIT License.", ("mit license",)),
    ("MIT", "This project is licensed under the terms of the MIT license.", ("mit license",)),
    ("MIT", _MIT, _MIT_PHRASES),
    (
        "X11",
        f"{_MIT} Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the "
        "sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
        (*_MIT_PHRASES, "except as contained in this notice the name"),
    ),
    ("GPL-3.0-only", f"{_GPL}.", ("gnu general public license version 3",)),
    ("GPL-3.0-or-later", f"{_GPL} or later.", ("gnu general public license version 3 or later",)),
    ("GPL-3.0-or-later", f"{_GPL}, or (at your option) any later version.", ("gnu general public license version 3 or at your option any later version",)),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license as published", "either version 3 of the license or at your option any later version"),
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc by 4.0",)),
    ("CC-BY-4.0", f"{_CC} 4.0 International License.", ("creative commons attribution 4.0 international",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc by-sa 4.0",)),
    ("CC-BY-SA-4.0", f"{_CC}-ShareAlike 4.0 International License.", ("creative commons attribution-sharealike 4.0 international",)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc by-nc 4.0",)),
    ("CC-BY-NC-4.0", f"{_CC}-NonCommercial 4.0 International License.", ("creative commons attribution-noncommercial 4.0 international",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2.0",)),
    ("BSD-2-Clause", _BSD_START + _BSD_TWO + _BSD_END, ("provided with the distribution this software is provided by",)),
    (
        "BSD-3-Clause",
        _BSD_START + _BSD_TWO + _BSD_NAME + _BSD_END,
        ("provided with the distribution neither the name of", "prior written permission this software is provided by"),
    ),
    (
        "BSD-4-Clause",
        _BSD_START + _BSD_TWO + _BSD_ADVERTISING + _BSD_NAME + _BSD_END,
        ("provided with the distribution all advertising materials mentioning features", "neither the name of", "prior written permission this software is provided by"),
    ),
    ("LicenseRef-all-rights-reserved", "All rights reserved.", ("all rights reserved",)),
)
TEMPLATES = tuple((name, text) for name, text, _ in NOTICES)
TELLING = {text: phrases for _, text, phrases in NOTICES}
ENDING = {"GPL-3.0-only": LATER}  # what must not follow a phrase of these licenses

_PLAIN = np.ones(256, bool)  # bytes that end no word: all but ASCII signs; a plus says something ("version 3+")
_PLAIN[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "+"]] = False
_PLAIN[_SPACE] = False


def bare_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words without signs at their ends, number of them in each text, place of each among all words of its text).

    Words of signs only are left out. Curly quotes are signs.
    """
    for curly in (b"\xe2\x80\x98", b"\xe2\x80\x99", b"\xe2\x80\x9c", b"\xe2\x80\x9d"):
        texts = [t.replace(curly, b"'") for t in texts]
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space, plain, at = _SPACE[buf], _PLAIN[buf], np.arange(len(buf), dtype=np.int32)
    before = [np.maximum.accumulate(np.where(x, at, -1)) for x in (plain, space)]
    after = [np.minimum.accumulate(np.where(x, at, len(buf))[::-1])[::-1] for x in (plain, space)]
    sign = ~plain & ~space & ((before[0] <= before[1]) | (after[0] >= after[1]))
    hashes, starts = hashed(np.where(sign, 32, buf).astype(np.uint8))
    firsts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    place = np.searchsorted(firsts, starts, "right") - 1
    return hashes, counts, place - np.repeat(np.searchsorted(firsts, np.concatenate([[0], ends[:-1]])), counts)


def one_by_one(text: str) -> list[int]:
    return bare_words([text.encode().translate(LOWER)])[0].tolist()


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops, piles, before = [], [], []
    for place, value in enumerate(values):
        pile = bisect_left(tops, value)
        before.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            piles.append(place)
        else:
            tops[pile], piles[pile] = value, place
    out, place = [], piles[-1] if piles else -1
    while place >= 0:
        out.append(place)
        place = before[place]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """(place in the text, place in the template) of the words matched, in order."""
    found, waiting = [], [(0, len(text), 0, len(template))]
    while waiting:
        low, high, first, last = waiting.pop()
        while low < high and first < last and text[low] == template[first]:
            found.append((low, first))
            low, first = low + 1, first + 1
        while low < high and first < last and text[high - 1] == template[last - 1]:
            high, last = high - 1, last - 1
            found.append((high, last))
        if low == high or first == last:
            continue
        once: list[dict] = []
        for words_, a, b in ((text, low, high), (template, first, last)):
            places: dict = {}
            for at in range(a, b):
                places[words_[at]] = -1 if words_[at] in places else at
            once.append(places)
        both = [(at, once[0].get(word, -1)) for word, at in once[1].items() if at >= 0]
        both = sorted((t, at) for t, at in ((t, at) for at, t in both) if t >= 0)
        by_template = sorted(both, key=lambda x: x[1])
        anchors = [by_template[i] for i in increasing([t for t, _ in by_template])]
        if not anchors:
            continue
        found += anchors
        ends = [(low - 1, first - 1), *anchors, (high, last)]
        for (t0, p0), (t1, p1) in zip(ends, ends[1:], strict=False):
            waiting.append((t0 + 1, t1, p0 + 1, p1))
    return sorted(found)


_MARKERS = frozenset(one_by_one(MARKERS))


class Group:
    """Templates that are compared in the same way: bare words and phrases, or words as written."""

    def __init__(self, numbers: list[int], templates, bare: bool):
        self.numbers, self.bare = numbers, bare
        own = [templates[t] for t in numbers]
        hashes, counts = self.split([text.encode().translate(LOWER) for _, text in own])[:2]
        self.words = [p.tolist() for p in np.split(hashes, np.cumsum(counts)[:-1])]
        self.lacking = [max(int(bare), int((1 - COVERAGE) * len(w) + 1e-9)) for w in self.words]
        self.need = [len(set(w)) - lacking for w, lacking in zip(self.words, self.lacking, strict=True)]
        self.phrases = [[self._spot(w, one_by_one(p)) for p in TELLING[text]] if bare else [] for w, (_, text) in zip(self.words, own, strict=True)]
        self.must = [np.array(sorted({w[i] for a, b in spots for i in range(a, b)}), np.uint64) for w, spots in zip(self.words, self.phrases, strict=True)]
        self.barred = [[one_by_one(e) for e in ENDING.get(name, ())] if bare else [] for name, _ in own]
        pairs = sorted((word, t) for t, w in enumerate(self.words) for word in set(w))
        self.known, self.owner = np.array([w for w, _ in pairs], np.uint64), np.array([t for _, t in pairs])

    @staticmethod
    def _spot(own: list, phrase: list) -> tuple[int, int]:
        return next((i, i + len(phrase)) for i in range(len(own)) if own[i : i + len(phrase)] == phrase)

    def split(self, texts: list[bytes]):
        if self.bare:
            return bare_words(texts)
        hashes, counts = words(texts)
        return hashes, counts, np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)

    def says(self, t: int, matched: list[tuple[int, int]], window: list) -> bool:
        """Whether all phrases stand in the window as they are, but for markers of lists, and nothing barred follows."""
        where = {place: at for at, place in matched}
        for a, b in self.phrases[t]:
            if any(i not in where for i in range(a, b)):
                return False
            if any(w not in _MARKERS for i in range(a, b - 1) for w in window[where[i] + 1 : where[i + 1]]):
                return False
            after = where[b - 1] + 1
            if any(window[after : after + len(x)] == x for x in self.barred[t]):
                return False
        return True

    def found(self, texts: list[bytes]):
        """(row, template, words matched, coverage, first word, end word) of every place that covers a template."""
        hashes, counts, place = self.split(texts)
        if not len(self.known):
            return
        low = np.searchsorted(self.known, hashes)
        there = np.flatnonzero(self.known[np.minimum(low, len(self.known) - 1)] == hashes)
        low = low[there]
        many = np.searchsorted(self.known, hashes[there], "right") - low
        at = np.repeat(there, many)
        template = self.owner[np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)]
        row = np.repeat(np.arange(len(texts)), counts)[at]
        order = np.lexsort((at, template, row))
        at, template, row = at[order], template[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (template[1:] != template[:-1]) | (row[1:] != row[:-1])])) if len(at) else []
        starts = np.cumsum(counts) - counts
        for a, b in zip(first, [*first[1:], len(at)], strict=True):
            t, r = int(template[a]), int(row[a])
            if b - a < self.need[t] or not self._enough(t, hashes[at[a:b]]):
                continue
            own, places = self.words[t], at[a:b] - starts[r]
            half, size = max(1, len(own) // 2), 2 * len(own)
            # Nothing is known of what follows the window, so it is longer by what must not follow a phrase.
            text, tail = hashes[starts[r] : starts[r] + counts[r]], max((len(x) for x in self.barred[t]), default=0)
            for start in np.unique(np.concatenate([places // half - k for k in range(4)]) * half):
                lo, hi = np.searchsorted(places, (start, start + size))
                if not self._enough(t, hashes[at[a + lo : a + hi]]):
                    continue
                begin, end = max(0, int(start)), min(len(text), int(start) + size)
                matched = align(text[begin:end].tolist(), own)
                if len(own) - len(matched) > self.lacking[t] or not self.says(t, matched, text[begin : end + tail].tolist()):
                    continue
                begin, matched = self._tight(t, text, begin, matched, tail)
                low_, high_ = starts[r] + begin + matched[0][0], starts[r] + begin + matched[-1][0]
                yield r, self.numbers[t], len(matched), len(matched) / len(own), int(place[low_]), int(place[high_]) + 1

    def _enough(self, t: int, some: np.ndarray) -> bool:
        different = np.unique(some)
        return len(different) >= self.need[t] and bool(np.isin(self.must[t], different).all())

    def _tight(self, t: int, text: np.ndarray, begin: int, matched: list, tail: int):
        """The same match without words at its ends that have a double further inside."""
        for left, right in ((1, 0), (0, 1)):
            while len(matched) > 1:
                low, high = begin + matched[0][0] + left, begin + matched[-1][0] + 1 - right
                again = align(text[low:high].tolist(), self.words[t])
                if len(again) < len(matched) or not self.says(t, again, text[low : high + tail].tolist()):
                    break
                begin, matched = low, again
        return begin, matched


class Templates:
    def __init__(self, templates):
        self.names = [name for name, _ in templates]
        told = [text in TELLING for _, text in templates]
        self.groups = [Group([t for t, x in enumerate(told) if x == bare], templates, bare) for bare in (True, False) if bare in told]

    def found(self, texts: list[bytes]):
        """(row, template, coverage, first word, end word): the best place of each text for each template it covers.

        Of places that overlap only the one with most words matched counts.
        """
        rows = defaultdict(set)
        for group in self.groups:
            for r, t, matched, coverage, first, end in group.found(texts):
                rows[r].add((-matched, -coverage, end - first, first, t, end))
        for r, places in sorted(rows.items()):
            taken, best = [], {}
            for _, coverage, _, first, t, end in sorted(places):
                i = bisect_left(taken, (first, end))
                if (i and taken[i - 1][1] > first) or (i < len(taken) and taken[i][0] < end):
                    continue
                taken.insert(i, (first, end))
                best[t] = min(best.get(t, (0.0,)), (coverage, first, end))
            for t, (coverage, first, end) in sorted(best.items()):
                yield r, t, -coverage, first, end


def scan(docs: DataFrame, id_col: str, text_col: str, templates=TEMPLATES) -> DataFrame:
    """(id_col, license, template, coverage, first_word, end_word): a row for each document and template covered by at least COVERAGE.

    Words are runs of bytes without white space, A-Z as a-z. Templates of NOTICES are compared without signs at the ends of words; they need
    their phrases, and one word may lack however short they are. Other templates are compared as written. Of templates whose places
    overlap the one with most words counts. If a text covers a template several times the best place counts, the first of
    equals. A null text has no rows; repeated rows and null ids are scanned one by one; other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def look(batches):
        known = Templates(templates)
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                columns = [*zip(*known.found(texts), strict=True)] or [()] * 5
                owner = batch.column(0).take(pa.array([first + r for r in columns[0]], pa.int64()))
                arrays = [owner, pa.array([known.names[t] for t in columns[1]], pa.string()), pa.array(columns[1], pa.int32()),
                          pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "license", "template", "coverage", "first_word", "end_word"])

    schema = f"doc {kind}, license string, template int, coverage double, first_word long, end_word long"
    return rows.mapInArrow(look, schema).withColumnRenamed("doc", id_col)
