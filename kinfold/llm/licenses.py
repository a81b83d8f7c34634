"""License scans by patience alignment of texts to license templates.

A text is aligned to a template in windows: words that occur once in the
window and once in the template are anchors, the longest increasing
subsequence of them is kept, and the gaps between anchors, of any length, are
aligned in the same way. Coverage is the share of the template's words that
are aligned. A statement may be interrupted at any length: windows come in sizes,
each twice the one before, of ``STRETCH`` times the stretches that they are for,
up to the whole text, so a statement that is repeated in a text is found each
time; of findings that overlap the one of more aligned words stays.

Covered words alone prove little in a long stretch, so three rules hold. A
license text must have ``RUN_SHARE`` of its words in runs of ``RUN`` words that
follow each other in both. A notice (a template of up to ``NOTICE`` words) stands in
one piece or is interrupted once. And a template may name words that must be
aligned, which tell it from its relatives, and words that must not stand inside:
"CC BY-ND 4.0" is no "CC BY 4.0", and an LGPL header no GPL header.

The number of words that a window shares with a template, counted with
repeats, is an upper bound of what an alignment can find, so windows are passed
over only where no alignment could reach ``COVERAGE``, or where a word that must be
there is not. Texts are read whole and one by one; nothing is shuffled.

Defined results: a null or empty text has no finding; a repeated row gives a
row each time; ties in aligned words go to the greater coverage, then to the
order of ``TEMPLATES``, then to the shorter stretch; an empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, text_bytes, words

COVERAGE = 0.8
STRETCH = 1.5
#: Words of the longest notice.
NOTICE = 16
#: Words of a run, and the share of a license text's words that lie in runs.
RUN, RUN_SHARE = 4, 0.6

_GNU = """you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version."""
_WARRANTY = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: {one} Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. {two} Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{three}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
_ENDORSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """

# License names and the texts, headers or notices that are looked for.
TEMPLATES: dict[str, str] = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "BSD-2-Clause": _BSD.format(one="1.", two="2.", three=""),
    "BSD-3-Clause": _BSD.format(one="1.", two="2.", three=_ENDORSE),
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered
source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice
may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    **{f"GPL-{v}": f"This program is free software: {_GNU.format(name='General Public License', version=n)} This program {_WARRANTY}"
       for v, n in (("2.0", "2"), ("3.0", "3"))},
    **{f"LGPL-{v}": f"library is free software; {_GNU.format(name='Lesser General Public License', version=n)} This library {_WARRANTY}"
       for v, n in (("2.1", "2.1"), ("3.0", "3"))},
    "AGPL-3.0": f"program is free software: {_GNU.format(name='Affero General Public License', version='3')} This program {_WARRANTY}",
    "MIT notice": "Released under the MIT License.",
    "MIT notice, licensed": "Licensed under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1 notice": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "Licensed under the GNU Affero General Public License, version 3.",
    **{f"CC-{k.replace(' ', '-')}-{v} notice": f"Licensed under CC {k} {v}."
       for k in ("BY", "BY SA", "BY NC", "BY ND", "BY NC SA", "BY NC ND") for v in ("4.0", "3.0")},
}

# Words that must be aligned, and words that must not stand inside a finding.
_KIN = {"lesser", "affero", "library"}
MUST: dict[str, set[str]] = {
    "BSD-3-Clause": {"endorse", "promote"}, "Apache-2.0": {"apache"}, "MPL-2.0": {"mozilla"},
    "GPL-2.0": {"version", "2"}, "GPL-3.0": {"version", "3"}, "LGPL-2.1": {"lesser", "2"}, "LGPL-3.0": {"lesser", "3"}, "AGPL-3.0": {"affero", "3"},
    "MIT notice": {"mit", "license"}, "MIT notice, licensed": {"mit", "license"}, "Apache-2.0 notice": {"apache", "license", "2"},
    "GPL-2.0 notice": {"gnu", "public", "2"}, "GPL-3.0 notice": {"gnu", "public", "3"}, "LGPL-2.1 notice": {"gnu", "lesser", "2"},
    "LGPL-3.0 notice": {"gnu", "lesser", "3"}, "AGPL-3.0 notice": {"gnu", "affero", "3"},
    **{n: set(t.lower().replace(".", " ").split()) - {"licensed", "under"} for n, t in TEMPLATES.items() if n.startswith("CC-")},
}
WITHOUT: dict[str, set[str]] = {
    "GPL-2.0": _KIN, "GPL-3.0": _KIN, "GPL-2.0 notice": _KIN, "GPL-3.0 notice": _KIN,
    "LGPL-2.1 notice": {"affero"}, "LGPL-3.0 notice": {"affero"}, "AGPL-3.0 notice": {"lesser"},
    **{n: {"nc", "nd", "sa"} - set(t.lower().replace(".", " ").split()) for n, t in TEMPLATES.items() if n.startswith("CC-")},
}


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _once(seq: list[int], lo: int, hi: int) -> dict[int, int]:
    """word -> its place, for the words that occur once in seq[lo:hi]."""
    seen: dict[int, int] = {}
    for i in range(lo, hi):
        seen[seq[i]] = -1 if seq[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both, by patience
    alignment. Word 0 is no word of a template and never aligned."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        # Equal words at both ends of a gap need no anchor.
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = _once(text, a, b), _once(template, c, d)
        both = [(i, there[w]) for w, i in here.items() if w in there]
        both.sort()
        anchors = [both[i] for i in increasing([j for _, j in both])]
        if anchors:
            out.extend(anchors)
            for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
                todo.append((i + 1, k, j + 1, m))
    return sorted(out)


class Scanner:
    """The templates as numbered words, with the words that they must and must not hold."""

    def __init__(self, templates: dict[str, str], must: dict[str, set[str]] | None = None, without: dict[str, set[str]] | None = None):
        must, without = MUST if must is None else must, WITHOUT if without is None else without
        self.number: dict[bytes, int] = {}
        self.templates = {name: [self.number.setdefault(w, len(self.number) + 1) for w in words(t.encode())] for name, t in templates.items()}
        # Words that must not stand inside are told apart too.
        self.without = [{self.number.setdefault(w.encode(), len(self.number) + 1) for w in without.get(name, ())} for name in templates]
        self.must = [sorted(self.number[w.encode()] for w in must.get(name, ())) for name in templates]
        n = len(self.number) + 1
        self.counts = np.array([np.bincount(t, minlength=n) for t in self.templates.values()])  # none of word 0
        self.least = np.array([COVERAGE * len(t) for t in self.templates.values()])

    def scan(self, text: bytes | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last) of the findings."""
        ws = words(text)
        ids = np.fromiter((self.number.get(w, 0) for w in ws), np.int64, len(ws))
        found = set()
        names = list(self.templates)
        for k in self._possible(ids):
            template = self.templates[names[k]]
            shared = np.concatenate(([0], np.cumsum(self.counts[k][ids] > 0)))
            for start, end in self._windows(shared, len(template), self.least[k]):
                window = ids[start:end]
                held = np.bincount(window, minlength=self.counts.shape[1])
                if np.minimum(held, self.counts[k]).sum() < self.least[k] or not held[self.must[k]].all():
                    continue
                pairs = align(window.tolist(), template)
                if self._holds(k, pairs, window, template):
                    a, b = start + pairs[0][0], start + pairs[-1][0] + 1
                    found.add((-len(pairs), -len(pairs) / len(template), k, b - a, a, b))
        out: list[tuple[str, float, int, int]] = []
        for _, coverage, k, _, a, b in sorted(found):
            if all(b <= x[2] or a >= x[3] for x in out):
                out.append((names[k], -coverage, a, b))
        return sorted(out, key=lambda x: x[2])

    def _holds(self, k: int, pairs: list[tuple[int, int]], window: np.ndarray, template: list[int]) -> bool:
        """Whether an alignment is a finding."""
        if len(pairs) < self.least[k]:
            return False
        at = np.array(pairs)
        if not set(self.must[k]) <= set(window[at[:, 0]].tolist()):
            return False
        if self.without[k] and self.without[k] & set(window[at[0, 0]:at[-1, 0] + 1].tolist()):
            return False
        step = np.diff(at, axis=0)
        if len(template) <= NOTICE:
            return int((step[:, 0] > 1).sum()) <= 1
        runs = np.diff(np.flatnonzero(np.concatenate(([True], (step != 1).any(axis=1), [True]))))
        return int(runs[runs >= RUN].sum()) >= RUN_SHARE * len(template)

    @staticmethod
    def _windows(shared: np.ndarray, n: int, least: float) -> list[tuple[int, int]]:
        """Windows that hold at least ``least`` of a template's words, of
        which ``shared`` is the running count. For each length of stretch from
        ``n`` to that of the text they are dealt so that it lies within one."""
        first, last = np.searchsorted(shared, 1) - 1, np.searchsorted(shared, shared[-1])
        out: set[tuple[int, int]] = set()
        length = n
        while True:
            size = int(STRETCH * length) + 1
            starts = np.arange(first, last, size - length)
            ends = np.minimum(starts + size, last)
            full = shared[ends] - shared[starts] >= least
            # Windows of the same words of the template are one.
            inner = zip(np.searchsorted(shared, shared[starts[full]], "right").tolist(), np.searchsorted(shared, shared[ends[full]]).tolist(), strict=True)
            out |= {(a - 1, b) for a, b in inner}
            if length >= last - first:
                return sorted(out)
            length *= 2

    def _possible(self, ids: np.ndarray) -> list[int]:
        if len(ids) < self.least.min():
            return []
        held = np.bincount(ids, minlength=self.counts.shape[1])
        shared = np.minimum(held, self.counts)[:, 1:].sum(axis=1)
        return [k for k in np.flatnonzero(shared >= self.least).tolist() if held[self.must[k]].all()]


def templates_from(spark: SparkSession, path: str, most_bytes: int = 8 << 20) -> dict[str, str]:
    """Templates from a folder of text files, the file's name being the license's;
    refuses more than ``most_bytes``, as they go to every task."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "value")
    size = files.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of templates are more than {most_bytes}")
    return {r["name"]: r["value"] for r in files.orderBy("name").collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, license (of the finding of most
    words; null without one), coverage (0 without one) and findings, each as
    license:coverage in thousandths:first word:word after the last, by place."""
    arrow_limits(docs.sparkSession)
    used = TEMPLATES if templates is None else templates

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(used)
        for batch in batches:
            texts = text_bytes(batch)
            got = [scanner.scan(t) for t in texts]
            best = [max(g, key=lambda x: (x[1] * len(scanner.templates[x[0]]), -x[2])) if g else None for g in got]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array([len(words(t)) for t in texts], pa.int64()),
                "license": pa.array([b[0] if b else None for b in best], pa.string()),
                "coverage": pa.array([b[1] if b else 0.0 for b in best], pa.float64()),
                "findings": pa.array([",".join(f"{n}:{round(1000 * c)}:{a}:{b}" for n, c, a, b in g) for g in got], pa.string())})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        each, "doc_id long, n_words long, license string, coverage double, findings string")
