"""License scan by patience alignment.

Words unique to both a region of the text and a template are anchors; the longest increasing
subsequence of their positions splits both into gaps that are aligned again; coverage is the share
of template words aligned. A statement of the wanted coverage holds at least one of any
(1 - coverage) * length + 1 words of its template, so the rarest of them in this very text, with all
their occurrences, name every region; texts that lack them all are done. Each region is aligned
closely first and then with a quarter of the template's length of room on each side. All statements
are returned; where two templates overlap, the one with more words aligned and then the better
covered one stays. Whole texts are searched. Null and empty texts have no license; ties go to the
earlier template; repeated rows repeat the result; ids of any type, nulls included, and other
columns are left to Spark; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

COVERAGE = 0.8
# lower case by code point, so spans are those of the text
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[a-z0-9]+")

# Public license texts, notices and one-line statements.
TEXTS = [
    ("Apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("MIT", "released under the MIT license"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0"),
    ("All-Rights-Reserved", "All rights reserved"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
    THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
    3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
    THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
    You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
    You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
    This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
    This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
    You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
    Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
    1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
    2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
    3. This notice may not be removed or altered from any source distribution."""),
]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(LOWER))


TEMPLATES = [(name, words_of(text)) for name, text in TEXTS]


def align(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int, out: list[tuple[int, int]]) -> None:
    while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
        out.append((a0, b0))
        a0, b0 = a0 + 1, b0 + 1
    while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
        a1, b1 = a1 - 1, b1 - 1
        out.append((a1, b1))
    if a0 >= a1 or b0 >= b1:
        return
    ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
    where = {b[j]: j for j in range(b0, b1)}
    pairs = [(i, where[a[i]]) for i in range(a0, a1) if ca[a[i]] == 1 and cb.get(a[i]) == 1]
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        x = bisect.bisect_left(tails, j)
        back[k] = ends[x - 1] if x else -1
        tails[x : x + 1], ends[x : x + 1] = [j], [k]
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    if not chain:
        return
    pa, pb = a0, b0
    for i, j in [*reversed(chain), (a1, b1)]:
        align(a, b, pa, i, pb, j, out)
        if i < a1:
            out.append((i, j))
        pa, pb = i + 1, j + 1


def statements(words: list[str], at: dict[str, list[int]], template: list[str], coverage: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, last word) of every region of the text that covers the template."""
    n, found = len(template), []
    most = int((1 - coverage) * n + 1e-9) + 1
    rarest = sorted(range(n), key=lambda j: (len(at.get(template[j], ())), j))[:most]
    diagonals = sorted({i - j for j in rarest for i in at.get(template[j], ())})
    last, done = None, -1
    for d in diagonals:
        if last is not None and d - last <= n // 8 or d + n // 2 <= done:
            continue
        last = d
        for room in (n // 8 + 1, max(6, n // 4)):
            out: list[tuple[int, int]] = []
            lo, hi = max(0, done + 1, d - room), min(len(words), d + n + n // 8 + room)
            align(words, template, lo, hi, 0, n, out)
            if len(out) >= coverage * n - 1e-9:
                done = max(i for i, _ in out)
                found.append((len(out) / n, min(i for i, _ in out), done))
                break
    return found


def licenses(text: str | None, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, start, end) by code point, in text order, without overlaps."""
    low = (text or "").translate(LOWER)
    have = set(WORD.findall(low))
    likely = [(k, t) for k, (_, t) in enumerate(TEMPLATES) if sum(MANY[k][w] for w in DISTINCT[k] - have) <= (1 - coverage) * len(t) + 1e-9]
    if not likely:
        return []
    spans = [m.span() for m in WORD.finditer(low)]
    words = [low[x:y] for x, y in spans]
    vocabulary: set[str] = set().union(*(DISTINCT[k] for k, _ in likely))
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in vocabulary:
            at.setdefault(w, []).append(i)
    found = [(-round(share * len(t)), -share, k, lo, hi) for k, t in likely for share, lo, hi in statements(words, at, t, coverage)]
    kept: list[tuple[int, int, str, float]] = []
    for _, share, k, lo, hi in sorted(found):
        x = bisect.bisect_left(kept, (lo,))
        if not (x and kept[x - 1][1] >= lo) and not (x < len(kept) and kept[x][0] <= hi):
            kept.insert(x, (lo, hi, TEMPLATES[k][0], -share))
    return [(name, share, spans[lo][0], spans[hi][1]) for lo, hi, name, share in kept]


MANY = [Counter(t) for _, t in TEMPLATES]
DISTINCT = [set(t) for _, t in TEMPLATES]


def row(text: str | None) -> tuple[str | None, float, str, str]:
    found = licenses(text)
    best = max(found, key=lambda x: x[1], default=(None, 0.0))
    return best[0], round(best[1], 6), ",".join(sorted({x[0] for x in found})), ",".join(f"{x[0]}:{x[2]}:{x[3]}" for x in found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license (the best covered), coverage, licenses and spans of all statements."""

    @F.pandas_udf("license string, coverage double, licenses string, spans string")
    def found_in(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(t) for t in texts], columns=["license", "coverage", "licenses", "spans"])

    return docs.select("doc_id", found_in("text").alias("_found")).select("doc_id", "_found.*")


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
