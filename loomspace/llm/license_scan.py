"""License scans by patience alignment.

A document is aligned with each template of a license: words that are unique to both texts and stand in both are anchors, the longest
increasing subsequence of their positions is kept, and the gaps between kept anchors are aligned in the same way; a gap without anchors
extends matches from its ends. Where that leaves words out that could be aligned, the longest common subsequence decides. The aligned share of
a template's words is its coverage.

The number of a template's words that a document has at all, each as often as in both, bounds its coverage from above. Only templates whose bound
reaches the threshold are aligned, which leaves out nothing that could be reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, bounded, id_text

#: Short forms and notices of public licenses: fixed values, to be matched as they are.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}


def _notice(name: str, version: str) -> str:
    return TEMPLATES["GPL-3.0-notice"].replace("GNU General", name).replace("version 3", f"version {version}")


TEMPLATES |= {"GPL-2.0-notice": _notice("GNU General", "2"), "LGPL-3.0-notice": _notice("GNU Lesser General", "3"), "AGPL-3.0-notice": _notice("GNU Affero General", "3")}

_AS_PUBLISHED = r" general public license(?: (?!gnu |version )\S+){1,12} version "
_LINE = r" general public license (?:l?a?gpl )?(?:version |v)?"
#: What names a license in its template, as words one after the other: no other words stand for these, as those of another license would. Long texts that name no license have none here.
NAMES = {
    "MIT": r"mit (?:x11 |expat )?license",
    "Apache-2.0": r"apache (?:software )?license (?:version |v)?2\.0",
    "Apache-2.0-notice": r"apache (?:software )?license (?:version |v)?2\.0",
    "GPL-2.0": rf"gnu{_LINE}2(?:\.0)?",
    "GPL-3.0": rf"gnu{_LINE}3(?:\.0)?",
    "LGPL-2.1": rf"gnu lesser{_LINE}2\.1",
    "LGPL-3.0": rf"gnu lesser{_LINE}3(?:\.0)?",
    "AGPL-3.0": rf"gnu affero{_LINE}3(?:\.0)?",
    "GPL-2.0-notice": rf"gnu{_AS_PUBLISHED}2",
    "GPL-3.0-notice": rf"gnu{_AS_PUBLISHED}3",
    "LGPL-3.0-notice": rf"gnu lesser{_AS_PUBLISHED}3",
    "AGPL-3.0-notice": rf"gnu affero{_AS_PUBLISHED}3",
    "MPL-2.0": r"mozilla public license (?:version |v )?2\.0",
    "MPL-2.0-notice": r"mozilla public license (?:version |v )?2\.0",
    "CC-BY-4.0": r"creative commons attribution (?:cc by )?4\.0",
    "CC-BY-4.0-line": r"cc by 4\.0",
    "CC-BY-SA-4.0": r"cc by-sa 4\.0",
    "CC-BY-SA-4.0-line": r"creative commons attribution-sharealike (?:cc by-sa )?4\.0",
    "CC-BY-NC-4.0": r"cc by-nc 4\.0",
    "CC-BY-NC-SA-4.0": r"cc by-nc-sa 4\.0",
    "BSD": r"bsd license",
    "BSD-2-Clause": r"bsd 2-clause",
    "BSD-3-Clause": r"bsd 3-clause",
}

_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    top_at: list[int] = []
    below = [-1] * len(values)
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        below[k] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = v, k
    out, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        out.append(k)
        k = below[k]
    return out[::-1]


def patience(doc: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (document, template) word positions, increasing in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(doc), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and doc[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and doc[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        there = Counter(template[c:d])
        here = Counter(doc[a:b])
        unique = {w: k for k, w in enumerate(template[c:d], c) if there[w] == 1 and here[w] == 1}
        anchors = [(k, unique[w]) for k, w in enumerate(doc[a:b], a) if w in unique]
        kept = [anchors[k] for k in increasing([t for _, t in anchors])]
        if not kept:
            continue
        edges = [(a - 1, c - 1), *kept, (b, d)]
        pairs += kept
        gaps += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False) if x + 1 < y and u + 1 < v]
    return sorted(pairs)


def common(doc: list[str], template: list[str]) -> list[int]:
    """Length of the longest common subsequence of each beginning of doc with template, word by word in the bits of one number."""
    bits: dict[str, int] = {}
    for k, w in enumerate(template):
        bits[w] = bits.get(w, 0) | 1 << k
    full = (1 << len(template)) - 1
    free, n, out = full, 0, []
    for w in doc:
        if w in bits:
            hit = free & bits[w]
            free = ((free + hit) | (free - hit)) & full
            n = len(template) - free.bit_count()
        out.append(n)
    return out


def aligned(doc: list[str], template: list[str], most: int) -> int:
    """The largest number of aligned words: by patience where that reaches `most`, an upper bound, else (words stand there repeatedly, or a stray one is an anchor) by the longest common subsequence."""
    n = len(patience(doc, template))
    return n if n == most or not doc else common(doc, template)[-1]


def coverage(doc: list[str], template: list[str], threshold: float = 0.8) -> tuple[float, int, int]:
    """Largest aligned share of the template in any passage of the document, and the first and last aligned word there (-1: none).

    A passage has at most span words: what lies scattered over more than about twice the template's length is no match. Shares under the
    threshold count as none. A passage that reaches it begins with one of the first words of the template, as the others are too few; each place
    of such a word begins a window, which is aligned if it shares enough words with the template and more than the best one so far.
    """
    m = len(template)
    span = 2 * m + 16
    least = next((n for n in range(1, m + 1) if n / m >= threshold), m + 1)
    wanted, early = Counter(template), set(template[: m - least + 1])
    at = [k for k, w in enumerate(doc) if w in wanted]
    words = [doc[k] for k in at]
    best, end, most = (0, -1, -1), 0, 0
    n, upto = m, 0
    have: Counter = Counter()
    for k, w in enumerate(words):
        while end < len(at) and at[end] < at[k] + span:
            have[words[end]] += 1
            most += have[words[end]] <= wanted[words[end]]
            end += 1
        # a window has at most what the last aligned one had, and what came in since
        if w in early and min(most, n + end - upto) >= max(least, best[0] + 1):
            n, upto = aligned(words[k:end], template, most), end
            if n >= max(least, best[0] + 1):
                last = k + common(words[k:end], template).index(n)
                first = last - common(words[k : last + 1][::-1], template[::-1]).index(n)
                best = (n, at[first], at[last])
                if n == m:
                    break
        most -= have[w] <= wanted[w]
        have[w] -= 1
    return best[0] / m, best[1], best[2]


def spots(words: list[str], name: str) -> list[tuple[int, int]]:
    """Where words one after the other match name: first word, and the one after the last."""
    text, out, at, k = " ".join(words), [], 0, 0
    for m in re.finditer(rf"(?<!\S)(?:{name})(?!\S)", text):
        k += text.count(" ", at, m.start())
        out.append((k, k + m[0].count(" ") + 1))
        at = m.start()
    return out


def named_coverage(doc: list[str], template: list[str], name: str, threshold: float = 0.8) -> tuple[float, int, int]:
    """As coverage, of the passages in which the name of the license stands: what is before and after it is aligned with what is before and after it in the template.

    Both sides are aligned by patience, outward from the name. Where that leaves words out or reaches over more than the span, the longest common
    subsequences of all beginnings of either side decide.
    """
    m = len(template)
    span = 2 * m + 16
    c, d = spots(template, name)[0]
    best = (0, -1, -1)
    for p, q in spots(doc, name):
        if q - p > span or best[0] == m:
            continue
        before, after = doc[max(0, q - span) : p][::-1], doc[q : p + span]
        middle = common(doc[p:q], template[c:d])[-1]
        left_pairs, right_pairs = patience(before, template[:c][::-1]), patience(after, template[d:])
        reach = [pairs[-1][0] + 1 if pairs else 0 for pairs in (left_pairs, right_pairs)]
        if len(left_pairs) == c and len(right_pairs) == m - d and sum(reach) + q - p <= span:
            if c + middle + m - d > best[0]:
                best = (c + middle + m - d, p - reach[0], q + reach[1] - 1)
            continue
        left, right = [0, *common(before, template[:c][::-1])], [0, *common(after, template[d:])]
        for k, n in enumerate(left):
            j = min(len(right) - 1, span - (q - p) - k)
            if n + middle + right[j] > best[0]:
                best = (n + middle + right[j], p - left.index(n), q + right.index(right[j]) - 1)
    return (best[0] / m, best[1], best[2]) if best[0] / m >= threshold else (0.0, -1, -1)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, names: dict[str, str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, licenses (matched names, sorted, comma-joined), n_licenses, best, coverage (of the best), first, last.

    A license matches where its coverage reaches the threshold, and its name stands there if names has one (NAMES unless there are other
    templates); best is the name of largest coverage, then of the longest template, then
    the first by name, or null. Null and empty texts have no words and match nothing. Texts and templates of any length are scanned whole: windows grow with
    the template, and every place where one could begin is looked at. Repeated rows each give a row, null ids are kept, an empty
    table gives no rows. Only doc_id and text are looked at.
    """
    cut = {name: words_of(text) for name, text in (templates or TEMPLATES).items()}
    cut = {name: ws for name, ws in cut.items() if ws}
    called = names if names is not None else NAMES if templates is None else {}
    need = {name: Counter(ws) for name, ws in cut.items()}
    vocabulary = {w for ws in cut.values() for w in ws}

    def found(text: str) -> tuple:
        doc = words_of(text)
        have = Counter(w for w in doc if w in vocabulary)
        hits = []
        for name, ws in cut.items():
            if sum(min(n, have[w]) for w, n in need[name].items()) >= threshold * len(ws):
                share, first, last = named_coverage(doc, ws, called[name], threshold) if name in called else coverage(doc, ws, threshold)
                if share >= threshold:
                    hits.append((-share, -len(ws), name, first, last))
        hits.sort()
        if not hits:
            return len(doc), "", 0, None, 0.0, None, None
        share, _, name, first, last = hits[0]
        return len(doc), ",".join(sorted(h[2] for h in hits)), len(hits), name, -share, first, last

    kinds = [("n_words", pa.int64(), "bigint"), ("licenses", pa.string(), "string"), ("n_licenses", pa.int64(), "bigint"), ("best", pa.string(), "string"), ("coverage", pa.float64(), "double"), ("first", pa.int64(), "bigint"), ("last", pa.int64(), "bigint")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            rows = [found(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, (_, kind, _) in enumerate(kinds))], ["doc_id", *(k[0] for k in kinds)])

    return bounded(id_text(docs)).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} {s}" for n, _, s in kinds))
