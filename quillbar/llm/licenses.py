"""Operator 9: scans for license notices.

Method: templates (whole public license texts, and the short notices that refer to them) are indexed by
their k-grams of words. A document keeps the winnowed fingerprints of its k-grams (the least of every
`WINDOW` neighbours), so any run of K + WINDOW - 1 words in common is met. Fingerprints that the index
knows propose (template, place) candidates; one is pursued if a template of n words has n / `WORDS_A_HIT`
fingerprints along it (one at least). A banded alignment of template and document words then reports how
many template words match, in order, and where; the band is BAND words, and wider for long templates. Notices that cover at least `COVERAGE` of a template count;
where two overlap, the one with more matched words stays, then the one that covers more of its template,
then the earlier, then the one named first. One scan and one map stage; all candidates of a slice of texts
are aligned together, template by template, and given up once too many words are missing.

Long templates are indexed by their rare k-grams only (up to `MOST_PLACES` places), which bounds the
candidates that a word of any text can propose.

Cases: a null text has no notices; documents without one give no row; repeated rows are reported each;
an empty table gives no rows; other columns are dropped first; nested and partial notices are reported
by their best template; very long texts cost time in proportion to their length.
"""

from __future__ import annotations

import bisect
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbar.llm.common import slices, table
from quillbar.llm.words import NOT_ALNUM, mix, word_hashes

K, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
WORDS_A_HIT = 64
#: Words from which a template is long, and places of a k-gram in long templates.
LONG, MOST_PLACES = 128, 4
#: Candidates aligned together, and rows between two looks at which may still reach the coverage.
TOGETHER, LOOK = 2048, 32
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_GNU_END = "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."

# Public license notices. The longer texts lie in license_texts, one file each.
TEMPLATES = {
    "MIT": _MIT,
    "MIT-full": f"{_MIT} {_WARRANTY}",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": f"This program is free software: {_GNU.format('General Public License', ',', 3)} {_GNU_END.format('This program', 'General Public License')}",
    "GPL-3.0-grant": f"This program is free software: {_GNU.format('General Public License', ',', 3)}",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": f"This program is free software; {_GNU.format('General Public License', ';', 2)} {_GNU_END.format('This program', 'General Public License')}",
    "GPL-2.0-grant": f"This program is free software; {_GNU.format('General Public License', ';', 2)}",
    "LGPL-2.1": f"This library is free software; {_GNU.format('Lesser General Public License', ';', '2.1')} {_GNU_END.format('This library', 'Lesser General Public License')}",
    "LGPL-2.1-grant": f"This library is free software; {_GNU.format('Lesser General Public License', ';', '2.1')}",
    "LGPL-3.0": f"This library is free software: {_GNU.format('Lesser General Public License', ',', 3)}",
    "AGPL-3.0": f"This program is free software: {_GNU.format('Affero General Public License', ',', 3)} {_GNU_END.format('This program', 'Affero General Public License')}",
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-2-Clause-grant": _BSD,
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}


def public_templates() -> dict[str, str]:
    """TEMPLATES and the whole texts of license_texts, named after their files."""
    found = dict(TEMPLATES)
    for name in sorted(os.listdir(TEXTS)):
        with open(os.path.join(TEXTS, name), encoding="utf-8") as f:
            found[name.removesuffix(".txt") + "-text"] = f.read()
    return found


def grams(words: np.ndarray) -> np.ndarray:
    """Hash of each run of K words."""
    n = max(0, len(words) - K + 1)
    total = np.zeros(n, np.uint64)
    for i in range(K):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[i : n + i]
    return mix(total)


class Index:
    """Inverted index of the templates: sorted k-gram hashes with (template, place) of each."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [word_hashes([t.encode()], NOT_ALNUM)[0] for t in templates.values()]
        self.size = np.array([len(w) for w in self.words])
        self.band = BAND + self.size // WORDS_A_HIT  # what is filled in moves long texts further
        gram = [grams(w) for w in self.words]
        template = np.repeat(np.arange(len(gram)), [len(g) for g in gram])
        place = np.concatenate([np.arange(len(g)) for g in gram])
        gram = np.concatenate(gram)
        long = self.size[template] >= LONG
        met, number, count = np.unique(gram[long], return_inverse=True, return_counts=True)
        kept = np.ones(len(gram), bool)
        kept[long] = count[number] <= MOST_PLACES
        gram, template, place = gram[kept], template[kept], place[kept]
        order = np.lexsort((place, template, gram))
        self.gram, self.template, self.place = gram[order], template[order], place[order]
        self.mark = np.zeros(1 << 18, bool)
        self.mark[(self.gram & np.uint64(0x3FFFF)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, text, place in words where it would start) of the candidates in the texts whose words
        are words[edges[i] : edges[i + 1]]; one for every few words of difference in place."""
        gram = grams(words)
        text = np.searchsorted(edges, np.arange(len(gram)), "right") - 1
        whole = np.arange(len(gram)) + K <= edges[text + 1]
        beside = (text[1:] == text[:-1]) & whole[1:]
        least = np.zeros(len(gram), bool)
        least[:-1] |= beside & (gram[:-1] <= gram[1:])
        least[1:] |= beside & (gram[1:] < gram[:-1])
        alone = np.ones(len(gram), bool)  # with no neighbour in its text
        alone[:-1] &= ~beside
        alone[1:] &= ~beside
        at = np.flatnonzero((least | alone) & whole & self.mark[(gram & np.uint64(0x3FFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(self.gram, gram[at], "left"), np.searchsorted(self.gram, gram[at], "right")
        hit = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
        at = np.repeat(at, hi - lo)
        template, text, start = self.template[hit], text[at], at - self.place[hit]
        order = np.lexsort((start, text, template))
        template, text, start = template[order], text[order], start[order]
        if not len(start):
            return template, text, start
        new = np.concatenate([[True], (template[1:] != template[:-1]) | (text[1:] != text[:-1])])
        shift = np.cumsum(new) * (4 * len(words) + 4 * int(self.size.max()))  # so that runs never meet
        key = shift + start
        band = self.band[template]
        hits = np.searchsorted(key, key + band, "right") - np.searchsorted(key, key - band, "left")
        able = hits >= np.maximum(1, self.size[template] // WORDS_A_HIT)
        step = np.floor_divide(start, band // 2)
        first = new | np.concatenate([[True], step[1:] != step[:-1]])
        of = np.cumsum(first) - 1
        pursued = np.zeros(of[-1] + 1, bool)
        pursued[of[able]] = True
        chosen = np.flatnonzero(first)[pursued]
        return template[chosen], text[chosen], start[chosen]


_BITS = 21
_MASK = (1 << _BITS) - 1


def align(template: np.ndarray, words: np.ndarray, start: np.ndarray, lowest: np.ndarray, highest: np.ndarray, coverage: float = 0.0, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matched template words, first, last matched place) of the best in-order matching of the template
    with words from each start on, every word moved by `band` places at most and inside lowest to highest.
    The most matches win, then the latest first and the earliest last place. Where the coverage is out of
    reach the result is (0, -1, -1)."""
    n, width = len(template), 2 * band + 1
    out = np.zeros(len(start), np.int64), np.full(len(start), -1), np.full(len(start), -1)
    alive, offset = np.arange(len(start)), np.arange(width)
    # Column d of row i stands for place start - band + i + d; a cell packs matches, first and last place.
    cell = np.zeros((len(start), width), np.int64)
    for i in range(n):
        if i % LOOK == 0 and i:
            able = (cell[:, -1] >> (2 * _BITS)) + n - i >= coverage * n
            if not able.all():
                alive, cell = alive[able], cell[able]
            if not len(alive):
                return out
        place = (start[alive] - band + i)[:, None] + offset
        inside = (place >= lowest[alive, None]) & (place < highest[alive, None])
        match = inside & (words[np.clip(place, 0, len(words) - 1)] == template[i])
        above = np.zeros_like(cell)
        above[:, :-1] = cell[:, 1:]
        if match.any():
            row, d = np.nonzero(match)
            before = cell[row, d]
            first = np.where(before > 0, (before >> _BITS) & _MASK, i + d)
            above[row, d] = np.maximum(above[row, d], (((before >> (2 * _BITS)) + 1) << (2 * _BITS)) | (first << _BITS) | (_MASK - i - d))
        cell = np.maximum.accumulate(above, axis=1)
    best = cell[:, -1]
    some = best > 0
    alive, best = alive[some], best[some]
    out[0][alive] = best >> (2 * _BITS)
    out[1][alive] = ((best >> _BITS) & _MASK) + start[alive] - band
    out[2][alive] = _MASK - (best & _MASK) + start[alive] - band
    return out


def notices(index: Index, words: np.ndarray, edges: np.ndarray, coverage: float = COVERAGE) -> list[tuple[int, int, int, int, int]]:
    """(text, template, matched words, first and last place in words) of every notice, in order of place."""
    template, text, start = index.candidates(words, edges)
    found = []
    for t in np.unique(template).tolist():
        of, size = np.flatnonzero(template == t), int(index.size[t])
        for lo in range(0, len(of), TOGETHER):
            c = of[lo : lo + TOGETHER]
            matched, first, last = align(index.words[t], words, start[c], edges[text[c]], edges[text[c] + 1], coverage, int(index.band[t]))
            good = matched >= max(1, coverage * size)
            found += zip(text[c][good].tolist(), [t] * int(good.sum()), matched[good].tolist(), first[good].tolist(), last[good].tolist(), strict=True)
    found.sort(key=lambda x: (-x[2], -x[2] / int(index.size[x[1]]), x[3], x[1]))
    kept: list[tuple[int, int]] = []
    out = []
    for x in found:
        at = bisect.bisect(kept, (x[3], x[4]))
        if (at == 0 or kept[at - 1][1] < x[3]) and (at == len(kept) or x[4] < kept[at][0]):
            kept.insert(at, (x[3], x[4]))
            out.append(x)
    return sorted(out, key=lambda x: x[3])


def scan(df: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """key, license, coverage, n_matched, span_start, span_end (characters) of every notice."""
    shared = df.sparkSession.sparkContext.broadcast(Index(templates or public_templates()))  # 2 MB
    kind = df.schema[key].dataType.simpleString()
    names = ["key", "license", "coverage", "n_matched", "span_start", "span_end"]

    def run(batches):
        index = shared.value
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices(texts, 4 << 20):
                raw = [t or b"" for t in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                words, begin, end, count = word_hashes(raw, NOT_ALNUM)
                rows, out = [], []
                for i, t, matched, first, last in notices(index, words, np.concatenate([[0], np.cumsum(count)]), coverage) if len(words) >= K else ():
                    rows.append(lo + i)
                    place = [len(raw[i][:x].decode()) for x in (int(begin[first]), int(end[last]))]
                    out.append((index.names[t], matched / int(index.size[t]), matched, *place))
                if rows:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(columns[0]), pa.array(columns[1]), *(pa.array(c, pa.int64()) for c in columns[2:])], names)

    found = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, license string, coverage double, n_matched long, span_start long, span_end long")
    return found.withColumnRenamed("key", key)


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9}
ORACLES: dict[str, str] = {}
