"""License scans: normalised passages compared to licence templates by the Dice coefficient over word bigrams.

Passages are all word windows of the normalised whole text, whatever lines and sentences they cross. The best window of a
template begins and ends with a bigram of it, and its first bigram does not come again in it: without such an edge the
Dice is no smaller. So windows start at shared bigrams, and grow until the first one returns, all of the template is
found, or they have more bigrams than the size bound allows. A passage and a template with a and b distinct bigrams can
only reach Dice t if ``2 * min(a, b) >= t * (a + b)``; a template is skipped where a text has too few of its bigrams.
A place of a text is in at most b windows of a template. Templates are a parameter; their bigrams are held in each task.

Defined results: null, empty and word-less texts have no finds; a template of one word is compared with single words; of
several such windows that match a licence the best, then the earliest, is returned; licences whose texts are within the
threshold of each other (BSD-2-Clause and BSD-3-Clause) are both found in either; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, NOT_ALNUM

THRESHOLD = 0.8
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Short licence notices and texts, by SPDX name (fixed values).
TEMPLATES = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _AS_IS + "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
]
#: Full texts of longer licences, from files beside this one.
TEMPLATES += [
    (x.name.removesuffix(".txt"), x.read_text(encoding="utf-8")) for x in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda x: x.name) if x.name.endswith(".txt")
]
_TABLE = bytes(0x20 if NOT_ALNUM[LOWER[i]] else int(LOWER[i]) for i in range(256))
_WORD = re.compile(rb"[^\x20]+")


def bigrams(passage: bytes) -> frozenset:
    w = passage.translate(_TABLE).split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset((x,) for x in w)


class Templates:
    def __init__(self, templates: list[tuple[str, str]]):
        self.all = sorted(((bigrams(text.encode()), name) for name, text in templates), key=lambda x: (len(x[0]), x[1]))
        self.all = [x for x in self.all if x[0]]
        self.sizes = [len(x[0]) for x in self.all]
        self.single = 1 in {len(g) for own, _ in self.all for g in own}
        self.having: dict[tuple, list[int]] = {}
        for i, (own, _) in enumerate(self.all):
            for g in own:
                self.having.setdefault(g, []).append(i)

    def near(self, passage: bytes, threshold: float) -> list[tuple[str, float]]:
        own = bigrams(passage)
        n = len(own)
        low, high = bisect_left(self.sizes, n * threshold / (2 - threshold) - 1e-9), bisect_right(self.sizes, n * (2 - threshold) / threshold + 1e-9)
        if not n or low >= high:
            return []
        common: dict[int, int] = {}
        for g in own:
            for i in self.having.get(g, ()):
                if low <= i < high:
                    common[i] = common.get(i, 0) + 1
        return [(self.all[i][1], 2 * c / (n + self.sizes[i])) for i, c in common.items() if 2 * c >= threshold * (n + self.sizes[i])]

    def scan(self, text: str | None, threshold: float) -> list[tuple[str, float, int]]:
        """(licence, Dice, first byte) of the best window of each licence found."""
        data = (text or "").encode().translate(_TABLE)
        w = data.split()
        best: dict[str, tuple[float, int]] = {}
        for grams in (list(zip(w, w[1:], strict=False)), [(x,) for x in w] if self.single else []):
            hits: dict[int, list[int]] = {}
            for at, g in enumerate(grams):
                if g in self.having:
                    for i in self.having[g]:
                        hits.setdefault(i, []).append(at)
            for i, at in hits.items():
                own, name = self.all[i]
                least = len(own) * threshold / (2 - threshold) - 1e-9
                if len(at) >= least and len({grams[k] for k in at}) >= least:
                    found = self._window(grams, own, at, threshold)
                    if found > best.get(name, (0, 0)):
                        best[name] = found
        if not best:
            return []
        begin = [m.start() for m in _WORD.finditer(data)]
        return sorted((name, dice, begin[-a]) for name, (dice, a) in best.items())

    @staticmethod
    def _window(grams: list[tuple], own: frozenset, hits: list[int], threshold: float) -> tuple[float, int]:
        """Dice and (negative) first word of the best window; (0, 0) below the threshold."""
        size, best = len(own), (0.0, 0)
        most = size * (2 - threshold) / threshold + 1e-9
        ahead, left = set(), []  # distinct bigrams of the template from each hit on, which bound what later starts reach
        for a in reversed(hits):
            ahead.add(grams[a])
            left.append(len(ahead))
        for a in hits:
            reach = left.pop()
            reach = 2 * reach / (reach + size)
            if reach < threshold - 1e-9 or reach <= best[0]:
                break
            seen, common = {grams[a]}, 1
            if 2 >= threshold * (1 + size):
                best = max(best, (2 / (1 + size), -a))
            for k in range(a + 1, len(grams)):
                g = grams[k]
                if g == grams[a] or common == size:
                    break
                if g in seen:
                    continue
                seen.add(g)
                if len(seen) > most:
                    break
                if g in own:
                    common += 1
                    if 2 * common >= threshold * (len(seen) + size):
                        best = max(best, (2 * common / (len(seen) + size), -a))
        return best


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted names, comma-joined) and best Dice of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Templates(templates)
        for batch in batches:
            found = [held.scan(t.as_py(), threshold) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([",".join(n for n, _, _ in x) for x in found], pa.string()),
                    pa.array([max((d for _, d, _ in x), default=0.0) for x in found], pa.float64()),
                ],
                ["doc_id", "n_licenses", "licenses", "best_dice"],
            )

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_licenses long, licenses string, best_dice double")
