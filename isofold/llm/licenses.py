"""License scans: winnowed fingerprints in an inverted index, then banded alignment.

Texts and templates are words of letters and digits in lower case. Every longer template's winnowed runs of words stand in an
inverted index, which is as large as the templates are. A text's runs are looked up in it; hits of one template near one diagonal are
a candidate, and an alignment within a band about that diagonal gives the words matched, the coverage and the span in the text.

Where templates resemble each other, as licenses of one family do, each place is given to the one that explains it best: words put in between
count against a template as words that lack do.

The coverage leaves no long run in a short template, so short ones are found by their single words: where enough of them stand within the
template's length and the band, all spans from there that reach the coverage are measured, and the best that don't overlap stay.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, lowered, slices, text_buffer

#: Words of a run, and runs of which the least is kept: a shared span of GRAM + KEEP - 1 words has a fingerprint.
GRAM, KEEP = 3, 2
#: Templates of up to so many words are found by single words: in longer ones a fifth of the words changed leaves GRAM + KEEP - 1 in a run.
SHORT = 15
BAND = 8
COVERAGE = 0.8

#: The wording of public licenses' notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
        OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
        TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
    "BSD-2-Clause-grant": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
        OF THIS SOFTWARE.""",
    "ISC-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"].replace(
    "THIS SOFTWARE IS PROVIDED",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED",
    1,
)
TEMPLATES["Unlicense"] = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
        DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEMPLATES["CC0-1.0"] = """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the
        Creative Commons CC0 1.0 Universal public domain dedication."""

#: Licenses of one wording. Each has the two notices of its family.
CREATIVE_COMMONS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}
for _code, _long in CREATIVE_COMMONS.items():
    for _text in (f"This work is licensed under a Creative Commons {_long} 4.0 International License.", f"Licensed under CC {_code} 4.0."):
        if _text not in TEMPLATES.values():
            _name = f"CC-{_code}-4.0"
            TEMPLATES[_name if _name not in TEMPLATES else f"{_name}-notice"] = _text
for _name, (_kind, _version) in GNU.items():
    TEMPLATES.setdefault(_name, f"This work is licensed under the GNU {_kind} Public License, version {_version}.")
    TEMPLATES.setdefault(f"{_name}-header", TEMPLATES["GPL-3.0-header"].replace("General", _kind).replace("version 3 ", f"version {_version} "))

#: First parts of whole texts: reported where the whole text isn't.
PARTS = {"MIT-grant": "MIT-text", "BSD-2-Clause-grant": "BSD-2-Clause", "ISC-grant": "ISC"}

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first) of the words of rows that stand one after another."""
    low = lowered(buf)
    inside = _WORD[low]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    before = np.append(True, ~inside[:-1])
    before[offsets[:-1][offsets[:-1] < len(buf)]] = True
    after = np.append(~inside[1:], True)
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return SpanHash(low)(starts, ends), starts, ends, np.searchsorted(starts, offsets)


def _grams(words: np.ndarray) -> np.ndarray:
    at = np.arange(max(0, len(words) - GRAM + 1))
    return SpanHash(words)(at, at + GRAM) if len(at) else np.zeros(0, np.uint64)


@dataclass
class Index:
    """Templates as word hashes; fingerprints of the longer ones: sorted hashes with template and place; sorted words of the short ones."""

    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    template: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    place: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    short: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, templates: dict[str, str]) -> Index:
        out = cls([], [])
        keys, template, place = [out.keys], [out.template], [out.place]
        for name, text in templates.items():
            buf = np.frombuffer(text.encode(), np.uint8)
            words = _words(buf, np.array([0, len(buf)]))[0]
            if len(words) < GRAM:
                raise ValueError(f"the template {name} has fewer than {GRAM} words")
            out.names.append(name)
            out.words.append(words)
            if len(words) <= SHORT:
                out.short.append(len(out.names) - 1)
                continue
            grams = _grams(words)
            # both sides keep the least of each KEEP runs; a text's runs are all looked up, which finds the same and more
            kept = sorted({i + int(np.argmin(grams[i : i + KEEP])) for i in range(max(1, len(grams) - KEEP + 1))})
            keys.append(grams[kept]), place.append(np.array(kept)), template.append(np.full(len(kept), len(out.names) - 1))
        order = np.argsort(np.concatenate(keys), kind="stable")
        out.keys, out.template, out.place = (np.concatenate(x)[order] for x in (keys, template, place))
        out.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(out.words[t] for t in out.short)]))
        return out


def aligned(text: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """(words matched, first, last + 1) of the best alignment of the template to words of the text within `band` of a diagonal.

    Longest common subsequence of the template (rows) and text (columns from row + diagonal - band to row + diagonal + band); of equal
    counts the alignment with the shortest span.
    """
    width, n = 2 * band + 1, len(template)
    score = np.zeros((n + 1, width + 1), np.int64)
    came = np.zeros((n + 1, width + 1), np.int8)
    for i in range(1, n + 1):
        for b in range(width):
            j = i - 1 + diagonal - band + b
            # row i - 1 has this column's left neighbour at b, its own column at b + 1
            up = score[i - 1, b + 1] if b + 1 < width else -1
            side = score[i, b - 1] if b else -1
            best, move = (up, 1) if up >= side else (side, 2)
            if 0 <= j < len(text) and text[j] == template[i - 1] and score[i - 1, b] + 1 > best:
                best, move = score[i - 1, b] + 1, 3
            score[i, b], came[i, b] = max(best, 0), move
    i, b = n, int(np.argmax(score[n, :width]))
    matched, first, last = int(score[n, b]), -1, -1
    while i > 0 and b >= 0:
        move = came[i, b]
        if move == 3:
            j = i - 1 + diagonal - band + b
            first, last = j, (j if last < 0 else last)
            i -= 1
        elif move == 1:
            i, b = i - 1, b + 1
        else:
            b -= 1
        if b >= width:
            break
    return matched, first, last + 1


def matches(words: np.ndarray, index: Index, band: int = BAND, coverage: float = COVERAGE) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, words matched, first word, last word + 1) in one text's words."""
    grams = _grams(words)
    lo, hi = np.searchsorted(index.keys, grams), np.searchsorted(index.keys, grams, "right")
    at = np.flatnonzero(hi > lo)
    short = short_starts(words, np.array([0, len(words)]), index, band, coverage)
    return _best(_aligned(words, index, at, lo[at], hi[at], band, coverage) + _spans(words, index, *short, band, coverage), index)


def short_starts(words: np.ndarray, first: np.ndarray, index: Index, band: int, coverage: float) -> tuple[np.ndarray, np.ndarray]:
    """(template, word) where a short template's words begin to stand close enough for the coverage, in rows that begin at `first`."""
    at = np.minimum(np.searchsorted(index.vocabulary, words), max(0, len(index.vocabulary) - 1))
    hits = np.flatnonzero(index.vocabulary[at] == words) if len(index.vocabulary) else np.zeros(0, np.int64)
    ends = first[np.searchsorted(first, hits, "right")]
    found_t, found_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    which = at[hits]
    counts = np.bincount(which, minlength=len(index.vocabulary))
    for t in index.short:
        template = index.words[t]
        need = _needed(template, coverage)
        # a match lacks so few words that it has one of the template's rarest here: most places are passed over for want of those
        names, often = np.unique(np.searchsorted(index.vocabulary, template), return_counts=True)
        rare = names[np.argsort(counts[names], kind="stable")]
        often = often[np.argsort(counts[names], kind="stable")]
        rare = rare[: int(np.searchsorted(np.cumsum(often), len(template) - need, "right")) + 1]
        if not counts[rare].any():
            continue
        marks = np.zeros(len(index.vocabulary), np.int8)
        marks[names] = 1
        marks[rare] = 2
        kind = marks[which]
        anchors = hits[kind == 2]
        own = np.flatnonzero(kind)
        after = np.searchsorted(anchors, hits[own])
        gap = np.minimum(np.abs(anchors[np.minimum(after, len(anchors) - 1)] - hits[own]), np.abs(hits[own] - anchors[np.maximum(after - 1, 0)]))
        own = own[gap < len(template) + band]
        place, end = hits[own], ends[own]
        if need > len(place):
            continue
        begin, last = place[: len(place) - need + 1], place[need - 1 :]
        close = begin[(last < end[: len(begin)]) & (last - begin < len(template) + band)]
        found_t.append(np.full(len(close), t)), found_w.append(close)
    return np.concatenate(found_t), np.concatenate(found_w)


def _needed(template: np.ndarray, coverage: float) -> int:
    return max(1, int(np.ceil(coverage * len(template) - 1e-9)))


def _spans(words: np.ndarray, index: Index, templates: np.ndarray, starts: np.ndarray, band: int, coverage: float):
    """From each start the shortest span for every number of matched words that reaches the coverage, with up to `band` words put in between."""
    found = []
    for t, x in zip(templates.tolist(), starts.tolist()):
        template = index.words[t].tolist()
        need, here = _needed(index.words[t], coverage), words[x : x + len(template) + band].tolist()
        if len(set(template) & set(here)) < len(set(template)) - (len(template) - need):
            continue
        row, most = [0] * (len(template) + 1), need - 1
        for j, word in enumerate(here):
            before = 0
            for i, other in enumerate(template, 1):
                now = row[i]
                row[i] = before + 1 if word == other else max(now, row[i - 1])
                before = now
            if row[-1] > most:
                most = row[-1]
                found.append((t, most / len(template), most, x, x + j + 1))
    return found


def _aligned(words, index: Index, at, lo, hi, band: int, coverage: float):
    seeds: dict[int, list[int]] = {}
    for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
        for k in range(a, b):
            seeds.setdefault(int(index.template[k]), []).append(p - int(index.place[k]))
    found = []
    for t, diagonals in seeds.items():
        template, done = index.words[t], None
        # no wider than the template: else its next copy would fall into it
        own = min(band, len(template) - 1)
        for d in sorted(set(diagonals)):
            if done is not None and d - done <= own:
                continue
            done = d
            near = sorted(x for x in diagonals if d <= x <= d + own)
            middle = near[len(near) // 2]
            # no more can match than have their word there at all
            if np.isin(template, words[max(0, middle - own) : max(0, middle + len(template) + own)]).sum() < coverage * len(template):
                continue
            matched, first, last = aligned(words, template, middle, own)
            if matched >= coverage * len(template):
                found.append((t, matched / len(template), matched, first, last))
    return found


def _best(found, index: Index):
    """Of overlapping spans of one template the better stays; a part of a text goes where it overlaps a span of the whole; then the templates are told apart."""
    names, sizes = index.names, [len(w) for w in index.words]
    out: list[tuple[int, float, int, int, int]] = []
    kept: dict[int, list[tuple[int, int]]] = {}
    for m in sorted(found, key=lambda m: (m[0], -m[2], m[4] - m[3], m[3])):
        spans = kept.setdefault(m[0], [])
        k = bisect_left(spans, (m[3], m[4]))
        if (k == 0 or spans[k - 1][1] <= m[3]) and (k == len(spans) or m[4] <= spans[k][0]):
            spans.insert(k, (m[3], m[4]))
            out.append(m)
    whole = {names[t]: spans for t, spans in kept.items()}

    def covered(m) -> bool:
        spans = whole.get(PARTS.get(names[m[0]], ""), [])
        k = bisect_left(spans, (m[4], 0))
        return k > 0 and spans[k - 1][1] > m[3]

    return _settled([m for m in out if not covered(m)], sizes)


def _settled(found, sizes: list[int]):
    """Between templates: of spans that share over half of the shorter one's words, the one with the most words matched, less those that lack or are put in, stays; then the earlier, then the template that is listed first."""
    rest: list[tuple[int, float, int, int, int]] = []
    for m in sorted(found, key=lambda m: (m[4] - m[3] + sizes[m[0]] - 3 * m[2], m[3], m[0])):
        if all(2 * (min(m[4], o[4]) - max(m[3], o[3])) <= min(m[4] - m[3], o[4] - o[3]) for o in rest):
            rest.append(m)
    return sorted(rest, key=lambda m: (m[3], m[0]))


SCHEMA = "doc_id long, license string, coverage double, n_matched long, first_word long, end_word long, first_char long, end_char long"


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """A row for each place where a template is covered to `coverage` or more: its share of words matched, and the span in words and characters.

    Null, empty and wordless texts match nothing. Rows with a null or repeated doc_id are scanned each for themselves. One pass, no
    shuffle; other columns are ignored.
    """
    index = Index.of(TEMPLATES if templates is None else templates)
    table = np.zeros(1 << 16, bool)
    table[(index.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            buf, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets):
                part, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                words, starts, ends, first = _words(part, at)
                grams = _grams(words)
                maybe = np.flatnonzero(table[(grams & np.uint64(0xFFFF)).astype(np.int64)])
                lo, hi = np.searchsorted(index.keys, grams[maybe]), np.searchsorted(index.keys, grams[maybe], "right")
                keep = hi > lo
                maybe, lo, hi = maybe[keep], lo[keep], hi[keep]
                row = np.searchsorted(first, maybe, "right") - 1
                inside = maybe + GRAM <= first[row + 1]
                maybe, lo, hi, row = maybe[inside], lo[inside], hi[inside], row[inside]
                short, begin = short_starts(words, first, index, band, coverage)
                begin_row = np.searchsorted(first, begin, "right") - 1
                for r in np.union1d(row, begin_row).tolist():
                    mine, ours = row == r, begin_row == r
                    own = slice(first[r], first[r + 1])
                    found = _aligned(words[own], index, maybe[mine] - first[r], lo[mine], hi[mine], band, coverage)
                    found = _best(found + _spans(words[own], index, short[ours], begin[ours] - first[r], band, coverage), index)
                    if found:
                        raw = part[at[r] : at[r + 1]].tobytes()
                        for t, share, n, x, y in found:
                            chars = [len(raw[: int(z) - int(at[r])].decode("utf-8", "replace")) for z in (starts[own][x], ends[own][y - 1])]
                            out.append((batch.column(0)[a + r].as_py(), index.names[t], share, n, x, y, *chars))
            if out:
                kinds = (pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op8_license_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
