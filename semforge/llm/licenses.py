"""License scans: normalised text against licence templates by the Dice coefficient of word bigrams.

Units are the whole text, its paragraphs (between blank lines), its lines, and windows of consecutive words wherever they stand, so
that a notice counts whatever its line ends and layout and whatever text runs into it. Sizes bound the coefficient: a template of b bigrams can
reach it only with units of t/(2-t) b to (2-t)/t b bigrams, so most units are compared with no template. Of the others, those that
share too few hashed bigrams with any template go before the exact comparison. Windows begin and end at a bigram of the template, as the
best ones do, and only where it is dense enough for the coefficient.

Licences resemble each other, so each stretch of text counts for one: where hits of different licences overlap, the one that shares most
bigrams with its template stays, as it explains most of the text. Version numbers of a template must be there as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semforge.llm.common import arrow_map, chunks, flat_bytes, prefix_hash, range_hash

THRESHOLD = 0.8
#: Notices and texts of public licences.
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "BSD-3-Clause": (
        _BSD_CONDITIONS + _BSD_NAME,
        _BSD_CONDITIONS + _BSD_NAME + _BSD_DISCLAIMER,
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "BSD-2-Clause": (_BSD_CONDITIONS, _BSD_CONDITIONS + _BSD_DISCLAIMER),
    "0BSD": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This is free and unencumbered software released into the public domain.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Distributed under the Boost Software License, Version 1.0.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    "WTFPL": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
}

#: How the texts of long licences begin.
_COPYING = " Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
OPENINGS = {
    "Apache-2.0": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc." + _COPYING,
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc." + _COPYING,
    "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc." + _COPYING,
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc." + _COPYING,
    "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc." + _COPYING,
    "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions",
}
for _name, _texts in TEMPLATES.items():
    # Every licence also goes by its identifier.
    TEMPLATES[_name] = (*_texts, *([OPENINGS[_name]] if _name in OPENINGS else []), f"SPDX-License-Identifier: {_name}")
#: Words before a number that is a version.
_VERSIONED = ("version", "v", "license", "by", "nc", "sa", "nd", "cc0", "gpl", "lgpl", "agpl", "apache")

#: Letters, digits and bytes over 127 are kept, in lower case; all else parts words.
_KEPT = np.zeros(256, np.uint8)
_KEPT[48:58] = np.arange(48, 58)
_KEPT[97:123] = np.arange(97, 123)
_KEPT[65:91] = np.arange(97, 123)
_KEPT[128:] = np.arange(128, 256)


def normalised(text: str) -> list[str]:
    raw = _KEPT[np.frombuffer(text.encode(), np.uint8)]
    return np.where(raw, raw, 32).astype(np.uint8).tobytes().decode("utf-8", "replace").split()


def bigrams(words: list[str]) -> Counter:
    """Pairs of neighbours with their counts; a single word is paired with nothing."""
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter({(w, ""): 1 for w in words})


def dice(a: Counter, b: Counter) -> float:
    size = a.total() + b.total()
    return 2 * (a & b).total() / size if size else 0.0


def versions(pairs: Counter) -> frozenset:
    """The bigrams that say a version or begin an identifier."""
    return frozenset((a, b) for a, b in pairs if a == "identifier" or (b.isdigit() and (a.isdigit() or a in _VERSIONED)))


class Scanner:
    """Templates with their bounds, and the hashed bigrams of all of them."""

    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.templates = [(name, bigrams(normalised(t))) for name, texts in (templates or TEMPLATES).items() for t in texts]
        self.versions = [versions(b) for _, b in self.templates]
        sizes = np.array([b.total() for _, b in self.templates])
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.bounds = np.ceil(sizes * low - 1e-9).astype(int), np.floor(sizes * high + 1e-9).astype(int)
        #: For each number of bigrams, the least number that a unit must share with some template; none where no template fits.
        most = int(self.bounds[1].max())
        self.need = np.full(most + 2, np.iinfo(np.int64).max)
        for size, lo, hi in zip(sizes, *self.bounds, strict=True):
            n = np.arange(lo, hi + 1)
            self.need[n] = np.minimum(self.need[n], np.ceil((n + size) * threshold / 2 - 1e-9).astype(int))
        pairs = sorted({p for _, b in self.templates for p in b})
        joined = np.frombuffer("".join(f"{a} {b} " for a, b in pairs).encode(), np.uint8)
        length = np.array([len(f"{a} {b}".encode()) for a, b in pairs])
        start = np.cumsum(length + 1) - (length + 1)
        sums, inverse = prefix_hash(joined)
        hashes = range_hash(sums, inverse, start, start + length)
        order = np.argsort(hashes)
        self.known = hashes[order]
        #: How often each template has each known bigram; and the least that a window shares with it.
        self.times = np.array([[b[pairs[k]] for k in order.tolist()] for _, b in self.templates])
        self.least = np.ceil((self.bounds[0] + sizes) * threshold / 2 - 1e-9).astype(int)

    def windows(self, known: np.ndarray, at: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, template, first word, end, coefficient) of the best windows that do not overlap: known bigrams, the words at which they begin, rows."""
        out = []
        for t, (_, template) in enumerate(self.templates):
            size, most, least, times = template.total(), int(self.bounds[1][t]), int(self.least[t]), self.times[t]
            own = np.flatnonzero(times[known] > 0)
            if len(own) < least:
                continue
            k, p, r = known[own], at[own], rows[own]
            end = len(own) - least + 1
            found = []
            for i in np.flatnonzero((p[least - 1 :] - p[:end] < most) & (r[least - 1 :] == r[:end])).tolist():
                used: dict[int, int] = {}
                shared, best = 0, (0.0, 0)
                for j in range(i, min(i + most, len(own))):
                    n = int(p[j] - p[i]) + 1
                    if n > most or r[j] != r[i]:
                        break
                    b = int(k[j])
                    used[b] = used.get(b, 0) + 1
                    if used[b] <= times[b]:
                        shared += 1
                        best = max(best, (2 * shared / (n + size), -int(p[j])))
                if best[0] >= self.threshold - 1e-9:
                    found.append((-best[0], int(p[i]), -best[1] + 2, int(r[i])))
            taken: list[tuple[int, int]] = []
            for d, a, b, row in sorted(found):
                n = bisect_left(taken, (a, a))
                if (n == len(taken) or taken[n][0] >= b) and (n == 0 or taken[n - 1][1] <= a):
                    taken.insert(n, (a, b))
                    out.append((row, t, a, b, -d))
        return out

    def scan(self, texts: pa.ChunkedArray) -> list[tuple[int, str, float, int]]:
        """(row, licence, best coefficient, units that match) of each row and licence that match."""
        data, offsets = flat_bytes(texts)
        if not len(data):
            return []
        kept = _KEPT[data]
        inner = kept > 0
        first = inner.copy()
        first[1:] &= ~inner[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inner[cuts]
        last = inner.copy()
        last[:-1] &= ~inner[1:]
        last[cuts - 1] = inner[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(starts):
            return []
        # Words joined by one blank, as in the templates.
        size = ends - starts
        at = np.cumsum(size + 1) - (size + 1)
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        joined[np.repeat(at - starts, size) + np.flatnonzero(inner)] = kept[inner]
        sums, inverse = prefix_hash(joined)
        pair = range_hash(sums, inverse, at[:-1], at[1:] + size[1:])
        k = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
        hit = self.known[k] == pair
        shared = np.r_[0, np.cumsum(hit)]
        line_ends = np.flatnonzero(data == 10)
        gaps = line_ends[1:][line_ends[1:] == line_ends[:-1] + 1]
        #: (row, shared bigrams, coefficient, licence, first word, end, whether a window) of all that reach the threshold.
        hits: list[tuple[int, int, float, str, int, int, bool]] = []
        seen: dict[bytes, list[tuple[str, int, float]]] = {}
        for cut in (np.zeros(0, np.int64), gaps, line_ends):
            edges = np.unique(np.concatenate([offsets, cut]))
            w = np.searchsorted(starts, edges)
            a, b = w[:-1], w[1:]
            n = np.maximum(b - a - 1, 0)
            inside = np.where(n > 0, shared[np.maximum(b - 1, 0)] - shared[np.minimum(a, len(shared) - 1)], 0)
            good = np.flatnonzero((n > 0) & (n < len(self.need)) & (inside >= self.need[np.minimum(n, len(self.need) - 1)]))
            for u in good.tolist():
                text = joined[at[a[u]] : at[b[u] - 1] + size[b[u] - 1]].tobytes()
                if text not in seen:
                    seen[text] = self._fits(text, range(len(self.templates)))
                row = int(np.searchsorted(offsets, starts[a[u]], "right")) - 1
                hits += [(row, n, d, name, int(a[u]), int(b[u]), False) for name, n, d in seen[text]]
        owner = np.searchsorted(offsets, starts, "right") - 1
        near = np.flatnonzero(hit & (owner[1:] == owner[:-1]))
        for row, t, a, b, _ in self.windows(k[near], near, owner[near]):
            text = joined[at[a] : at[b - 1] + size[b - 1]].tobytes()
            hits += [(row, n, d, name, a, b, True) for name, n, d in self._fits(text, (t,))]
        return self._best(hits, len(starts))

    def _fits(self, text: bytes, templates) -> list[tuple[str, int, float]]:
        """(licence, shared bigrams, coefficient) of each licence with a template that the unit fits: of several the best."""
        own = bigrams(text.decode("utf-8", "replace").split(" "))
        total, best = own.total(), {}
        for t in templates:
            name, template = self.templates[t]
            if self.bounds[0][t] <= total <= self.bounds[1][t] and all(v in own for v in self.versions[t]):
                n = (own & template).total()
                if (d := 2 * n / (total + template.total())) >= self.threshold:
                    best[name] = max(best.get(name, (0, 0.0)), (n, d))
        return [(name, n, d) for name, (n, d) in best.items()]

    @staticmethod
    def _best(hits: list[tuple], words: int) -> list[tuple[int, str, float, int]]:
        """(row, licence, best coefficient, units) once every word counts for one licence: hits with most shared bigrams come first.

        Windows raise the coefficient of the units that they lie in; elsewhere they are units of their own.
        """
        number = {name: k for k, name in enumerate(sorted({h[3] for h in hits}))}
        owner, kept = np.full(words, -1, np.int32), []
        for h in sorted(hits, key=lambda h: (-h[1], -h[2], h[4], h[3], h[5])):
            part, own = owner[h[4] : h[5]], number[h[3]]
            if ((part == -1) | (part == own)).all():
                part[:] = own
                kept.append(h)
        found: dict[tuple[int, str], list] = {}
        spans: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for row, _, d, name, a, b, window in sorted(kept, key=lambda h: (h[6], -h[2], h[4])):
            held, own = found.setdefault((row, name), [0.0, set()]), spans.setdefault((row, name), [])
            held[0] = max(held[0], d)
            if not window or all(b <= x or y <= a for x, y in own):
                held[1].add(a)
                own.append((a, b))
        return [(row, name, d, len(at)) for (row, name), (d, at) in sorted(found.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license_id, dice, n_units) of each licence that a document holds; documents without one have no row.

    Null and empty texts hold none; an empty table has an empty result. Repeated rows give repeated results; a null doc_id stays null.
    Units that fit several templates of one licence count once, and no word counts for two licences. Whole texts are scanned. Columns of
    other names play no part.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(templates, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            found = scanner.value.scan(rows.column("text"))
            ids = rows.column("doc_id").combine_chunks().take(pa.array([r for r, *_ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n, *_ in found], pa.string()), pa.array([d for *_, d, _ in found], pa.float64()), pa.array([u for *_, u in found], pa.int64())], ["doc_id", "license_id", "dice", "n_units"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, license_id string, dice double, n_units long")
