"""Licence scans: windows of words compared with licence templates by the Dice coefficient over word bigrams.

A text is normalised word by word (lower case, letters, digits and inner dots), over lines and paragraphs. A
window is any stretch of its words. One with S bigrams can reach a Dice coefficient of d only with templates
of a size between S*d/(2-d) and S*(2-d)/d, since 2*min/(sum) bounds it, so a template with T bigrams needs
T*d/(2-d) of them within T*(2-d)/d neighbouring bigrams of the text; templates without such a stretch are
pruned before any comparison. Bigrams count as often as they occur.

The best windows begin and end with a bigram of the template, so for every such beginning the best end is
found by running sums. Matches are reported without overlap, better scores and longer spans first. In a
notice (a template of at most ``NOTICE`` words) a window must hold all words that name the licence (those of
``NAMING`` and version numbers) and no others of ``NAMING``, so that no part of another licence's notice matches.

Defined cases: null text is empty and has no match; ties between templates go to the first name; positions
are code points, ends exclusive, closing punctuation included; rows are independent.
"""

from __future__ import annotations

import heapq
import pkgutil
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict, deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches

#: Public licence texts and the notices that usually stand for them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "ISC": [
        "SPDX-License-Identifier: ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "MPL-2.0": ["SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": ["Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1-only", "Licensed under the GNU Lesser General Public License v2.1."],
    "LGPL-3.0": ["SPDX-License-Identifier: LGPL-3.0-only", "Licensed under the GNU Lesser General Public License v3.0."],
    "AGPL-3.0": [
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Licensed under the GNU Affero General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ],
    "EPL-2.0": ["SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved."],
}
#: Full public texts, one file each; read as package data, so that they can be in an archive.
FULL = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
for _name in FULL:
    TEMPLATES[_name].append(pkgutil.get_data("quarry.llm", f"licenses/{_name}.txt").decode())
#: A reservation of rights names no licence: it decides only where nothing else matches.
RESERVED = "Proprietary"
NAMING = frozenset("mit apache gnu lesser library affero gpl lgpl agpl bsd isc mozilla mpl eclipse epl cc cc0 nc nd sa attribution noncommercial noderivatives sharealike".split())
NOTICE = 120
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
CLOSING = re.compile(r"[.!?]*[\"')\]]*")
LEAST = 0.85


def lowered(text: str) -> str:
    """Lower case of the same length: the only letter that would become two is taken as its first."""
    return text.replace("\u0130", "i").lower()


def normalise(text: str) -> list[str]:
    return WORD.findall(lowered(text))


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False)) if len(words) != 1 else Counter([(words[0],)])


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * sum((a & b).values()) / total if total else 0.0


class Templates:
    def __init__(self, least: float):
        rows = sorted((bigrams(normalise(text)).total(), name, n) for name, texts in TEMPLATES.items() for n, text in enumerate(texts))
        words = [normalise(TEMPLATES[name][n]) for _, name, n in rows]
        self.least = least
        self.names = [name for _, name, _ in rows]
        self.sizes = [size for size, _, _ in rows]
        self.grams = [bigrams(w) for w in words]
        self.naming = [None if len(w) > NOTICE else (NAMING.intersection(w), frozenset(x for x in w if x[0].isdigit())) for w in words]
        self.codes: dict[tuple[str, ...], int] = {}
        for grams in self.grams:
            for g in grams:
                self.codes.setdefault(g, len(self.codes))
        self.times = np.zeros((len(rows), len(self.codes)), np.uint16)  # how often a template holds a bigram
        for row, grams in zip(self.times, self.grams, strict=True):
            for g, n in grams.items():
                row[self.codes[g]] = n
        self.holds = self.times.astype(bool)
        sizes, slack = np.array(self.sizes), 1e-9
        self.needed = np.maximum(1, np.ceil(sizes * least / (2 - least) - slack)).astype(int)
        self.reach = np.floor(sizes * (2 - least) / least + slack).astype(int)

    def fits(self, i: int, words: list[str]) -> bool:
        """Whether the words name the licence of template ``i``, if that is a notice."""
        if self.naming[i] is None:
            return True
        names, numbers = self.naming[i]
        return NAMING.intersection(words) == names and numbers.issubset(words)

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The best template of a window and its coefficient, if at least ``least``."""
        grams = bigrams(words)
        size, slack = grams.total(), 1e-9
        if not size:
            return None
        low = bisect_left(self.sizes, size * self.least / (2 - self.least) - slack)
        high = bisect_right(self.sizes, size * (2 - self.least) / self.least + slack)
        found = [(dice(grams, self.grams[i]), self.names[i]) for i in range(low, high) if self.fits(i, words)]
        found = [f for f in found if f[0] >= self.least]
        return min(found, key=lambda f: (-f[0], f[1])) if found else None


@lru_cache(maxsize=4)
def templates(least: float) -> Templates:
    return Templates(least)


class Hits:
    """Where a text holds bigrams of one template: the best window from each of them on."""

    def __init__(self, known: Templates, i: int, words: list[str], at: np.ndarray, codes: np.ndarray):
        self.known, self.i, self.words, self.at = known, i, words, at
        self.earlier = np.full(len(at), -1)  # a bigram counts in windows that begin after this one
        seen: dict[int, deque] = defaultdict(deque)
        for place, (p, c, n) in enumerate(zip(at.tolist(), codes.tolist(), known.times[i][codes].tolist(), strict=True)):
            if len(seen[c]) == n:
                self.earlier[place] = seen[c].popleft()
            seen[c].append(p)

    def starts(self) -> list[int]:
        """The hits with enough others in reach."""
        need = self.known.needed[self.i]
        return np.flatnonzero(self.at[need - 1 :] - self.at[: len(self.at) - need + 1] < self.known.reach[self.i]).tolist()

    def window(self, start: int, limit: int) -> tuple[float, int, int, str, int, int] | None:
        """The best window that begins with hit ``start`` and has its bigrams before ``limit``, as an entry of the heap."""
        known, i, begin = self.known, self.i, int(self.at[start])
        end = int(np.searchsorted(self.at, min(limit, begin + known.reach[i])))
        if end - start < known.needed[i]:
            return None
        sizes = self.at[start:end] - begin + 1
        common = np.cumsum(self.earlier[start:end] < begin)
        scores = 2 * common / (sizes + known.sizes[i])
        for n in np.lexsort((-sizes, -scores)) if known.naming[i] else [len(scores) - 1 - int(np.argmax(scores[::-1]))]:
            if scores[n] < known.least:
                return None
            size = int(sizes[n])
            if known.fits(i, self.words[begin : begin + size + 1]):
                return -float(scores[n]), -size, begin, known.names[i], i, start
        return None


def windows(words: list[str], known: Templates) -> list[tuple[int, int]]:
    """(first word, word after the last) of the windows that match, without overlaps, best first."""
    codes = known.codes
    pairs = [(p, c) for p, g in enumerate(zip(words, words[1:], strict=False)) if (c := codes.get(g)) is not None]
    if not pairs:
        return []
    at, held = np.array(pairs).T
    counts = known.holds @ np.bincount(held, minlength=len(codes))
    hits: dict[int, Hits] = {}
    heap = []
    for i in np.flatnonzero(counts >= known.needed).tolist():
        own = known.holds[i][held]
        where, need = at[own], known.needed[i]
        if (where[need - 1 :] - where[: len(where) - need + 1] < known.reach[i]).any():
            hits[i] = Hits(known, i, words, where, held[own])
            heap += [w for s in hits[i].starts() if (w := hits[i].window(s, len(words)))]
    heapq.heapify(heap)
    taken: list[tuple[int, int]] = []
    out = []
    while heap:
        _, size, begin, _, i, start = heapq.heappop(heap)
        end = begin - size + 1
        after = bisect_left(taken, (begin, begin))
        if after and taken[after - 1][1] > begin:
            continue
        if after < len(taken) and taken[after][0] < end:
            if w := hits[i].window(start, taken[after][0] - 1):
                heapq.heappush(heap, w)
            continue
        insort(taken, (begin, end))
        out.append((begin, end))
    return out


def passages(text: str, known: Templates) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the windows that match."""
    low = lowered(text)
    words = WORD.findall(low)
    found = windows(words, known)
    if not found:
        return []
    spans = [m.span() for m in WORD.finditer(low)]
    return [(spans[b][0], CLOSING.match(low, spans[e - 1][1]).end(), words[b:e]) for b, e in found]


def matches(text: str, least: float = LEAST) -> list[tuple[int, int, str, float]]:
    """(start, end, licence, coefficient) without overlaps, in order of position."""
    known = templates(least)
    return sorted((s, e, hit[1], hit[0]) for s, e, words in passages(text, known) if (hit := known.best(words)))


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_matches, license and score of the best match (null if none), and all spans as text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            found = matches(text or "", least)
            top = min(found, key=lambda m: (m[2] == RESERVED, -m[3], m[0]), default=None)
            rows.append((len(found), top and top[2], top and top[3], ",".join(f"{name}:{s}:{e}" for s, e, name, _ in found)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        types = (pa.int64(), pa.string(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_matches", "license", "score", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_matches long, license string, score double, spans string")
