"""Operator 5, license scans: MinHash bands over overlapping windows, then exact containment.

Templates fall into size classes by their number of 5-word shingles: class s holds those of
2**s .. 2**(s+1) - 1. For each class a text is cut into overlapping windows of 3 * 2**s shingles, one
starting every 2**s, so a whole template of the class lies in some window, whose Jaccard similarity
to it is at least 1/3 (1/4 where only four fifths of it are there). Signatures have BANDS bands of
one row, so a template is retrieved with probability 1 - (1 - 1/4)**96 > 1 - 1e-11. Windows' minima
come from minima of half the size, so a class costs half of the one below. A retrieved window and
template are verified exactly: the share of the template's distinct shingles that the window holds.

Words are compared lower-cased, without leading and trailing marks. Defined results: null or empty
text and texts under five words have no licenses; a text may hold several; repeated rows are judged
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernel import Chunk, _WHITE, chunks, mixed
from .shared import table, texts

WIDTH = 5
BANDS = 96
CONTAINMENT = 0.8

# Public license statements. Long licenses stand in parts, so that a text that holds one part is found.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "EPL-2.0 notice": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
        "is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "LGPL notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version."
    ),
    "AGPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "GPL warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "BSD third clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "BSD disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "ISC disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
        "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "zlib text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but "
        "is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."
    ),
    "BSL-1.0 grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and "
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software "
        "is furnished to do so"
    ),
}

_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def license_words(chunk: Chunk) -> Chunk:
    """The chunk with lower-case letters, and marks next to a blank or another mark made blanks."""
    low = chunk.lower
    data = low.data.copy()
    marks = np.flatnonzero(_MARK[data])
    if len(marks):
        edge = np.zeros(len(data) + 2, bool)
        edge[1:-1] = _WHITE[data] | _MARK[data]
        edge[0] = edge[-1] = True
        cut = edge[marks] | edge[marks + 2]
        starts = np.zeros(len(data) + 1, bool)
        starts[chunk.offsets] = True
        cut |= starts[marks] | starts[marks + 1]
        data[marks[cut]] = 0x20
    return Chunk(chunk.first, data, chunk.offsets)


def shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    values, bounds = license_words(chunk).shingles(WIDTH)
    return values, bounds


def permuted(values: np.ndarray, band: int) -> np.ndarray:
    """The values under the band's permutation of 64-bit numbers."""
    factor = np.uint64((0x9E3779B97F4A7C15 * (2 * band + 1)) % (1 << 64) | 1)
    x = (values ^ np.uint64(band * 0x5851F42D4C957F2D % (1 << 64))) * factor
    return x ^ (x >> np.uint64(32))


@dataclass
class Templates:
    names: list[str]
    sets: list[np.ndarray]

    def classes(self) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            found.setdefault(max(len(s), 1).bit_length() - 1, []).append(i)
        return found


def prepared(templates: Mapping[str, str]) -> Templates:
    names, sets = [], []
    for name, text in templates.items():
        raw = text.encode()
        values, _ = shingles(Chunk(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        names.append(name)
        sets.append(np.unique(values))
    return Templates(names, sets)


def retrieved(values: np.ndarray, templates: Templates, bands: int = BANDS) -> dict[int, np.ndarray]:
    """For each template, starts of the windows of its class whose signature meets its own in some band.

    `values` are the shingles of a whole chunk; windows run over document borders, verification doesn't.
    """
    classes = templates.classes()
    top = max(classes)
    found: dict[int, list[np.ndarray]] = {}
    for band in range(bands):
        minima = permuted(values, band)
        for level in range(top + 1):
            if level:
                pad = len(minima) % 2
                minima = np.minimum(minima[0::2], np.append(minima[1::2], minima[-1]) if pad else minima[1::2]) if len(minima) > 1 else minima
            for i in classes.get(level, ()):
                low = permuted(templates.sets[i], band).min()
                hit = np.flatnonzero(minima == low)
                if len(hit):
                    found.setdefault(i, []).append(hit)
    # a block of 2**s shingles lies in the three windows of the class that hold it
    return {i: np.unique(np.concatenate(h)[:, None] + np.array([-2, -1, 0])) * (1 << (max(len(templates.sets[i]), 1).bit_length() - 1)) for i, h in found.items()}


def best_share(values: np.ndarray, wanted: np.ndarray, width: int) -> float:
    """The greatest share of the wanted (sorted, distinct) that any `width` consecutive values hold."""
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    places = np.flatnonzero(wanted[at] == values)
    held: dict[int, int] = {}
    best = first = 0
    marks = at[places].tolist()
    for i, (place, mark) in enumerate(zip(places.tolist(), marks)):
        held[mark] = held.get(mark, 0) + 1
        while places[first] <= place - width:
            held[marks[first]] -= 1
            if not held[marks[first]]:
                del held[marks[first]]
            first += 1
        best = max(best, len(held))
    return best / len(wanted)


def find(chunk: Chunk, templates: Templates, threshold: float = CONTAINMENT) -> dict[int, list[tuple[int, float]]]:
    """Row in the chunk -> (template, containment) of the verified templates."""
    values, bounds = shingles(chunk)
    words = np.diff(license_words(chunk).words[2])
    out: dict[int, list[tuple[int, float]]] = {}
    if not len(values):
        return {}
    for i, starts in sorted(retrieved(values, templates).items()):
        wanted = templates.sets[i]
        width = 3 << (max(len(wanted), 1).bit_length() - 1)
        first, last = (np.searchsorted(bounds, x, "right") - 1 for x in (np.clip(starts, 0, len(values) - 1), np.clip(starts + width - 1, 0, len(values) - 1)))
        touched = np.unique(np.concatenate([first, last, *(np.arange(a, b) for a, b in zip(first.tolist(), last.tolist()) if b > a + 1)]))
        for doc in touched[words[touched] >= WIDTH].tolist():
            share = best_share(values[bounds[doc] : bounds[doc + 1]], wanted, width)
            if share >= threshold:
                out.setdefault(doc, []).append((i, share))
    return out


def license_hits(docs: DataFrame, key: str = "doc_id", templates: Mapping[str, str] = TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """Key, license and containment for each template found in each row's text."""
    ready = docs.sparkSession.sparkContext.broadcast(prepared(templates))  # as large as the given templates
    source = texts(docs, key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ready.value
        for batch in batches:
            rows: list[int] = []
            names: list[str] = []
            shares: list[float] = []
            for chunk in chunks(batch.column(1), 1 << 20):
                for doc, hits in sorted(find(chunk, known, threshold).items()):
                    for i, share in hits:
                        rows.append(chunk.first + doc)
                        names.append(known.names[i])
                        shares.append(share)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=[key, "license", "containment"])

    return source.mapInArrow(scan, f"`{key}` {source.schema[0].dataType.simpleString()}, license string, containment double")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_hits(table(spark, sf_dir, "documents"))
