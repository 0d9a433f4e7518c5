"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Texts are reduced to their lower-cased ASCII letters and digits. Hashes of every GRAM of these characters are winnowed: of each
WINDOW consecutive hashes the least is a fingerprint, so any common stretch of GRAM + WINDOW - 1 characters has one in
common. An inverted index from fingerprints to the templates, a fixed list, is searched with those of each whole text.
Around the hits of a template, where enough of its words stand at all, a banded local alignment of words (match 2, mismatch and gap -1) gives the matched words:
their share of the template is the coverage, the first and last give the span. Spans with `coverage` or more are candidates if all words
of the template that tell licences and versions apart (DECISIVE, and the numbers of a version in its name) are matched; of overlapping candidates the one with the
most matched words is reported, then the one that begins first, then the first in order of name.

The templates are whole texts of short licences, and of long ones the notices and headers by which works name them;
`scan` takes any others.

Defined cases: null and empty texts have no licence; characters beyond ASCII are separators; reported spans
never overlap; repeated rows are reported each; an empty table, or no template, gives an empty result; other columns are not
read; spans are in words and code points, ends exclusive. A long text is held whole with 16 bytes a word and some 40
bytes a character of one chunk; a text with a hit has its words as strings too.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textops as T
from .common import documents

GRAM = 12
WINDOW = 8
BAND = 8  # words that an alignment may drift, or a sixth of a longer template
#: Words that tell licences apart, beside version numbers.
DECISIVE = frozenset(b"affero lesser library nc nd sa noncommercial sharealike noderivatives".split())
# Texts, notices and headers as published by the licences' stewards.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES = {
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": f"{_BSD_TERMS} {_BSD_AS_IS}",
    "bsd-3-clause": f"{_BSD_TERMS} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-3.0-sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0-sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "mit": f'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)] = True


def fingerprints(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed hashes of lower-cased letters, and where their grams start."""
    hashes = T.gram_hashes(T._BYTE_HASH[letters], GRAM)
    if not len(hashes):
        return hashes, np.zeros(0, dtype=np.int64)
    n = max(len(hashes) - WINDOW + 1, 1)
    least = hashes[:n].copy()
    for j in range(1, min(WINDOW, len(hashes))):
        np.minimum(least, hashes[j : j + n], out=least)
    chosen = np.zeros(len(hashes), dtype=bool)
    for j in range(min(WINDOW, len(hashes))):
        chosen[j : j + n] |= hashes[j : j + n] == least
    at = np.flatnonzero(chosen)
    return hashes[at], at


def edges_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the runs of letters and digits."""
    inside = np.concatenate([[False], _ALNUM[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def words_of(text: bytes) -> list[bytes]:
    """Runs of letters and digits, lower-cased."""
    low = text.lower()
    return [low[a:b] for a, b in zip(*(x.tolist() for x in edges_of(np.frombuffer(text, np.uint8))), strict=True)]


NONE = (0, 0, -1, -1, 0)


def align(template: list[bytes], words: list[bytes], shift: int, band: int = BAND, told: dict[bytes, int] | None = None) -> tuple[int, int, int, int]:
    """Matched words, first and last + 1 word, and bits of the matched words of `told`, of the best local alignment with |j - i - shift| <= band."""
    width = 2 * band + 1
    before = [NONE] * (width + 1)
    best = NONE
    for i, want in enumerate(template):
        now = [NONE] * (width + 1)
        bit = told.get(want, 0) if told else 0
        for k in range(width):
            j = i + shift + k - band
            if not 0 <= j < len(words):
                continue
            score, matched, first, last, decided = before[k]
            same = words[j] == want
            cell = (score + 2, matched + 1, j if first < 0 else first, j + 1, decided | bit) if same else (score - 1, matched, first, last, decided)
            for other in (before[k + 1], now[k - 1] if k else NONE):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] <= 0:
                cell = NONE
            now[k] = cell
            if cell[0] > best[0]:
                best = cell
        before = now
    return best[1:]


def decisive(name: str, words: list[bytes]) -> dict[bytes, int]:
    """A bit for each word of a template that its spans must have."""
    version = set(b" ".join(x.encode() for x in re.findall(r"\d+\.\d+", name)).replace(b".", b" ").split())
    return {word: 1 << k for k, word in enumerate(sorted(set(words) & (DECISIVE | version)))}


class Index:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.words = [words_of(templates[name].encode()) for name in self.names]
        self.told = [decisive(name, words) for name, words in zip(self.names, self.words, strict=True)]
        self.bands = [max(BAND, len(words) // 6) for words in self.words]
        self.number = {word: n for n, word in enumerate(sorted({word for words in self.words for word in words}))}
        self.bags = [np.bincount([self.number[word] for word in words], minlength=len(self.number)) for words in self.words]
        self.found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            letters = np.frombuffer(b"".join(words), np.uint8)
            owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
            for h, at in zip(*(x.tolist() for x in fingerprints(letters)), strict=True):
                self.found[h].append((k, int(owner[at])))
        self.known = np.array(sorted(self.found), dtype=np.uint64)

    def scan(self, column: pa.Array, coverage: float) -> Iterator[tuple[int, str, float, int, int, int, int]]:
        """(row, template, coverage, first word, last word + 1, first code point, last code point + 1)."""
        for w in T.chunks(column):
            kept = np.flatnonzero(_ALNUM[w.data])
            hashes, at = fingerprints(T._LOWER[w.data[kept]])
            hit = np.flatnonzero(np.isin(hashes, self.known))
            place = kept[at[hit]]
            owner = np.searchsorted(w.offsets, place, side="right") - 1
            cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=w.n))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                d = int(owner[a])
                low, high = int(w.offsets[d]), int(w.offsets[d + 1])
                yield from ((w.first + d, *x) for x in self._spans(w.data[low:high], place[a:b] - low, hashes[hit[a:b]].tolist(), coverage))

    def _spans(self, data: np.ndarray, places: np.ndarray, hashes: list[int], coverage: float) -> list[tuple[str, float, int, int, int, int]]:
        starts, ends = edges_of(data)
        at = np.searchsorted(starts, places, side="right") - 1
        seeds: dict[int, set[int]] = defaultdict(set)
        for h, j in zip(hashes, at.tolist(), strict=True):
            for k, i in self.found[h]:
                seeds[k].add(j - i)
        found = []
        low = [data[s:e].tobytes().lower() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        numbers = np.array([self.number.get(word, -1) for word in low], dtype=np.int64)
        for k, shifts in seeds.items():
            template, band, words, left = self.words[k], self.bands[k], list(low), numbers.copy()
            spaced = []  # one shift for those within the band of an alignment
            for shift in sorted(shifts):
                if not spaced or shift - spaced[-1] > band // 2:
                    spaced.append(shift)
            for n, shift in enumerate(spaced):
                while True:
                    begin, end = max(0, shift - band), shift + len(template) + band
                    there = left[begin:end]
                    if np.minimum(np.bincount(there[there >= 0], minlength=len(self.number)), self.bags[k]).sum() < coverage * len(template):
                        break  # no alignment matches more than the words in common
                    tries = []
                    for other in spaced[n:]:  # neighbours may see more of the same stretch
                        if other - shift > 2 * band or (tries and tries[0][0] < coverage * len(template)):
                            break
                        begin = max(0, other - band)
                        matched, first, last, bits = align(template, words[begin : other + len(template) + band], other - begin, band, self.told[k])
                        tries.append((matched, -begin - first, begin + last, bits))
                    matched, first, last, bits = max(tries)
                    if tries[0][0] < coverage * len(template):
                        break
                    if bits == sum(self.told[k].values()):
                        found.append((-matched, -first, self.names[k], last, matched / len(template)))
                    words[-first:last] = [b""] * (last + first)  # the same words are no second span of this template
                    left[-first:last] = -1
        begins, out = [], []  # spans that overlap no better one, by place
        for _, first, name, last, share in sorted(found):
            n = bisect.bisect_right(begins, first)
            if (not n or out[n - 1][1] <= first) and (n == len(out) or last <= begins[n]):
                begins.insert(n, first)
                out.insert(n, (first, last, name, share))
        done, points, rows = 0, 0, []  # code points are counted on from span to span
        for first, last, name, share in out:
            ahead = points + int(np.count_nonzero((data[done : starts[first]] & 0xC0) != 0x80))
            done, points = int(ends[last - 1]), ahead + int(np.count_nonzero((data[starts[first] : ends[last - 1]] & 0xC0) != 0x80))
            rows.append((name, share, first, last, ahead, points))
        return rows


NAMES = ["doc_id", "template", "coverage", "first_word", "end_word", "start", "end"]
KINDS = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """One row for each licence span of docs (doc_id, text)."""
    index = Index(TEMPLATES if templates is None else templates)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(b["doc_id"][row].as_py(), *rest) for row, *rest in index.scan(b["text"], coverage)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True) if found else [[]] * 7, KINDS, strict=True)], NAMES)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, template string, coverage double, first_word bigint, end_word bigint, start bigint, end bigint")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
