"""License scans by patience alignment of texts with license templates.

Words that stand once in a stretch of the text and once in the template are anchors; of these
the longest run in increasing order is kept, and the gaps between its members are aligned in the
same way. Coverage is the share of the template's words that are aligned.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_COVERAGE = 0.8
#: A passage may hold so many times the template's words, foreign ones included.
SPREAD = 4
_WORD = re.compile(r"[^\W_]+")

# Short notices, whole public licenses, and the notices by which files refer to long ones.
TEMPLATES = {
    "mit-notice": 'Released under the MIT License.',
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0.',
    "gpl-3.0-notice": 'This work is licensed under the GNU General Public License, version 3.',
    "cc-by-nc-4.0-notice": 'Licensed under CC BY-NC 4.0.',
    "mit": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "isc": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "bsd-2-clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "bsd-3-clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
""",
    "unlicense": """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.
""",
    "bsl-1.0": """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare
derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "apache-2.0": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.
""",
    "gpl-3.0": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.
""",
}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, ordered by their first, whose seconds increase."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect.bisect_left(tops, b)
        back[i] = last[at - 1] if at else -1
        tops[at : at + 1] = [b]
        last[at : at + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), both increasing."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: c + i for i, w in enumerate(template[c:d]) if there[w] == 1 and here[w] == 1}
        anchors = _rising([(a + i, place[w]) for i, w in enumerate(text[a:b]) if w in place])
        found += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True) if anchors else []:
            if i + 1 < k and j + 1 < m:
                gaps.append((i + 1, k, j + 1, m))
    return sorted(found)


class Scanner:
    """Finds templates in texts. A text is cut into stretches of ``spread`` + 1 template lengths, all but one of them
    shared with the next stretch, so each passage of up to ``spread`` lengths lies in one as a whole;
    stretches that hold too few of the template's words are passed over."""

    def __init__(self, templates: Mapping[str, str], min_coverage: float, spread: int = SPREAD):
        self.spread = spread
        self.templates = {name: words_of(t) for name, t in templates.items()}
        self.min_coverage = min_coverage
        self.counts = {name: Counter(t) for name, t in self.templates.items()}
        markers: set[str] = set()
        for t in self.templates.values():
            # at most this many words may be missing, so one of any more has to be there
            spare = len(t) - self.needed(t)
            kinds, taken = sorted(set(t), key=lambda w: (-len(w), w)), 0
            for w in kinds:
                if taken <= spare:
                    markers.add(w)
                    taken += t.count(w)
        self.marker = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, markers))) + r")(?![^\W_])")

    def needed(self, template: list[str]) -> int:
        return max(1, -int(-(self.min_coverage * len(template) - 1e-9) // 1))

    def best(self, words: list[str], name: str) -> tuple[int, int, int] | None:
        """Aligned words, first and last place in the text, of the best stretch: that with most aligned words, less a quarter of the other words among them (the first of equals)."""
        template, counts = self.templates[name], self.counts[name]
        needed, n = self.needed(template), len(template)
        places = [i for i, w in enumerate(words) if w in counts]
        if len(places) < needed:
            return None
        best, top = None, 0
        begin = 0
        while begin < len(places):
            at = places[begin] // n * n  # stretches without any word of the template are passed over
            end = at + (self.spread + 1) * n
            lo, hi = bisect.bisect_left(places, at), bisect.bisect_left(places, end)
            here = Counter(words[i] for i in places[lo:hi])
            if sum(min(k, counts[w]) for w, k in here.items()) >= needed:
                for a, b in [(at, end), *((i, i + n) for i in places[lo:hi] if words[i] == template[0])]:
                    got = align(words[a:b], template)
                    if len(got) < needed or got[-1][0] - got[0][0] >= self.spread * n:
                        continue
                    worth = 5 * len(got) - (got[-1][0] - got[0][0] + 1)
                    if best is None or worth > top:
                        best, top = (len(got), a + got[0][0], a + got[-1][0]), worth
            begin = bisect.bisect_left(places, at + n)
        return best

    def every(self, words: list[str], name: str) -> list[tuple[int, int, int]]:
        """The best stretch, then those of what lies before and after it, until none is left."""
        found, waiting = [], [(0, len(words))]
        while waiting:
            a, b = waiting.pop()
            if got := self.best(words[a:b], name):
                found.append((got[0], a + got[1], a + got[2]))
                waiting += [(a, a + got[1]), (a + got[2] + 1, b)]
        return found

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """name, template's words, aligned words, first and last word in the text, of the best template of each passage, in order of the text.

        Of templates whose passages overlap by half of the shorter one, that with most words aligned
        is told (of equal ones that with the higher coverage, then the first by name).
        """
        low = (text or "").lower()
        if not self.marker.search(low):
            return []
        words = _WORD.findall(low)
        found = [(name, len(t), *got) for name, t in self.templates.items() for got in self.every(words, name)]
        out: list[tuple[str, int, int, int, int]] = []
        for hit in sorted(found, key=lambda x: (-x[2], x[1], x[0], x[3])):
            if all(2 * (min(hit[4], o[4]) - max(hit[3], o[3]) + 1) < min(hit[4] - hit[3], o[4] - o[3]) + 1 for o in out):
                out.append(hit)
        return sorted(out, key=lambda x: (x[3], x[0]))


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], min_coverage: float, spread: int) -> Scanner:
    return Scanner(dict(templates), min_coverage, spread)


def license_scan(df: DataFrame, key: str, text: str, templates: Mapping[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, spread: int = SPREAD) -> DataFrame:
    """``key``, ``license``, ``coverage``, ``matched``, ``first_word``, ``last_word``: a row for each place in a text where a template is found.

    A template is found where at least ``min_coverage`` of its words are aligned within a passage of
    at most ``spread`` times its length, of any text however long; of templates that overlap in a
    passage the best is told. Places count the words of the whole text from 0. A text without any gives one row with a null ``license`` and
    coverage 0; so do null and empty texts. A template that comes several times gives a row for each time.
    Repeated rows give repeated rows; an empty table gives none; only ``key`` and ``text`` of
    ``df`` are read. Nothing is shuffled.
    """
    fixed = tuple(templates.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(fixed, min_coverage, spread).scan
        for batch in batches:
            rows: list[tuple] = []
            for i, value in enumerate(batch.column(1)):
                rows += [(i, name, matched / n, matched, first, last) for name, n, matched, first, last in scan(value.as_py())] or [(i, None, 0.0, 0, None, None)]
            which, name, coverage, matched, first, last = zip(*rows, strict=True) if rows else ((),) * 6
            arrays = [batch.column(0).take(pa.array(which, pa.int64())), pa.array(name, pa.string()), pa.array(coverage, pa.float64()), *(pa.array(x, pa.int64()) for x in (matched, first, last))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_key", "license", "coverage", "matched", "first_word", "last_word"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key), F.col(text)).mapInArrow(run, f"_key {kind}, license string, coverage double, matched long, first_word long, last_word long")
    return out.withColumnRenamed("_key", key)
