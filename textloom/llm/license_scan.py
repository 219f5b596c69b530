"""License scans: MinHash bands over text windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, batched, buffers, chunks, col, mix, shingles, words

#: Words in a shingle.
SHINGLE = 2
#: Share of a template's shingles that a passage must hold.
CONTAINED = 0.85
#: Window lengths in shingles. A template uses the longest that it fills.
WINDOWS = (4, 8, 16, 32, 64)
#: Bands of ROWS hashes. A window whose Jaccard similarity with a template's window is s meets it with the
#: probability 1 - (1 - s^ROWS)^BANDS: over 0.99 at s = 0.6 and over 0.9 at 0.45. A template has as many windows as
#: places for them, each of which may meet it.
BANDS, ROWS = 12, 2

_SEED = mix(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x51ED27))

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Notices, openings and short whole texts of well-known licences, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def window_bands(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, band hashes of each window of size shingles), band by band. Minima of longer windows come from those of shorter ones."""
    for b in range(BANDS):
        keys: dict[int, np.ndarray] = {}
        for r in range(ROWS):
            low = (hashes ^ _SEED[b * ROWS + r]) * U(0xD6E8FEB86659FD93)
            low ^= low >> U(32)
            low *= U(0x9E3779B97F4A7C15)
            span = 1
            for size in sizes:
                while span < size:
                    step = min(span, size - span)
                    low = np.minimum(low[:-step], low[step:])
                    span += step
                keys[size] = keys[size] * U(0x9E3779B97F4A7C15) + low if r else low
        for size in sizes:
            yield size, mix(keys[size] + U(b))


@dataclass
class Template:
    license: str
    number: int
    shingles: np.ndarray
    once: np.ndarray


@dataclass
class Passage:
    """span: the passage with its room; share: containment in it; fit: share of the template's shingles met in order; places: of those, in the text."""

    row: int
    template: Template
    begin: int
    span: slice
    share: float
    fit: float
    places: np.ndarray


class Library:
    """Band hashes of the templates' windows, sorted, by window length."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.templates: list[Template] = []
        self.bands: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for number, (name, text) in enumerate(templates):
            raw = np.frombuffer(text.encode(), np.uint8)
            h, _, _, first = words(raw, np.array([0, len(raw)]))
            runs, _ = shingles(h, first, SHINGLE)
            if len(runs) < WINDOWS[0]:
                raise ValueError(f"a template needs {WINDOWS[0]} shingles: {text}")
            size = max(w for w in WINDOWS if w <= len(runs))
            self.templates.append(Template(name, number, runs, np.unique(runs, return_index=True)[1]))
            for _, band in window_bands(runs, [size]):
                found.setdefault(size, []).extend((k, number, at) for at, k in enumerate(band.tolist()))
        for size, rows in found.items():
            rows = sorted(set(rows))
            self.bands[size] = (np.array([k for k, _, _ in rows], U), np.array([t for _, t, _ in rows]), np.array([a for _, _, a in rows]))
        # a small table of the hashes' leading bits answers for most windows
        self.may = {}
        for size, (keys, _, _) in self.bands.items():
            self.may[size] = np.zeros(1 << 16, bool)
            self.may[size][(keys >> U(48)).astype(np.int64)] = True

    def scan(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, str, float]]:
        """(row, license, containment) of each licence that a text holds, with its best template."""
        h, _, _, first = words(data, off)
        runs, first = shingles(h, first, SHINGLE)
        # so that every shingle begins a window; what reaches beyond a text is not counted below
        padded = np.concatenate((runs, np.zeros(WINDOWS[-1], U)))
        hits: list[np.ndarray] = []
        for size, band in window_bands(padded, sorted(self.bands)) if len(runs) else ():
            keys, numbers, places = self.bands[size]
            maybe = np.flatnonzero(self.may[size][(band[: len(runs)] >> U(48)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, band[maybe], "left"), np.searchsorted(keys, band[maybe], "right")
            n = hi - lo
            if n.any():
                k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                i = np.repeat(maybe, n)
                row = np.searchsorted(first, i, "right") - 1
                # row, template and begin, which may lie before the first shingle, in one number
                hits.append((row * len(self.templates) + numbers[k]) * (2 * len(padded)) + (i - places[k]) + len(padded))
        if not hits:
            return
        met, votes = np.unique(np.concatenate(hits), return_counts=True)
        which, begins = np.divmod(met[np.argsort(-votes, kind="stable")], 2 * len(padded))
        held: list[Passage] = []
        near: dict[tuple[int, int, int], list[Passage]] = {}
        failed: dict[tuple[int, int], list[tuple[int, float]]] = {}
        # the place that most windows agree on comes first; others near it meet the same passage
        for at, begin in zip(which.tolist(), (begins - len(padded)).tolist(), strict=True):
            row, number = divmod(at, len(self.templates))
            t = self.templates[number]
            # the passage where the template would lie, with room for words put in
            room = max(2, len(t.shingles) // 4)
            slot = begin // (room + 1)
            if any(abs(p.begin - begin) <= room for k in (slot, slot - 1, slot + 1) for p in near.get((row, number, k), ())):
                continue
            # a passage a few places from another has at most so many shingles that the other lacks
            if any(share + abs(begin - at) / len(t.once) < CONTAINED for at, share in failed.get((row, number), ())):
                continue
            a, b = max(int(first[row]), begin - room), min(int(first[row + 1]), begin + len(t.shingles) + room)
            equal = runs[a:b, None] == t.shingles
            share = float(equal.any(axis=0)[t.once].mean()) if b > a else 0.0
            if share < CONTAINED:
                failed.setdefault((row, number), []).append((begin, share))
                continue
            # each shingle of the template takes its equal that lies nearest to where it would be
            far = np.where(equal, np.abs(np.arange(a - begin, b - begin)[:, None] - np.arange(len(t.shingles))), room + 1)
            at = far.argmin(axis=0)[there := far.min(axis=0) <= room]
            held.append(found := Passage(row, t, begin, slice(a, b), share, float(there.mean()), np.unique(a + at)))
            near.setdefault((row, number, slot), []).append(found)
        # of licences with much the same text, the one that fits a passage best has its shingles
        owner = np.full(len(runs) if held else 0, -1)
        names = {name: k for k, name in enumerate(dict.fromkeys(t.license for t in self.templates))}
        best: dict[tuple[int, str], float] = {}
        for p in sorted(held, key=lambda p: (p.row, -p.fit, -len(p.template.shingles), p.template.license, p.begin)):
            name, t = p.template.license, p.template
            lost = (owner[p.span] >= 0) & (owner[p.span] != names[name])
            if lost.any() and 2 * (runs[p.span, None][~lost] == t.shingles).any(axis=0)[t.once].mean() < p.share:
                continue
            owner[p.places[owner[p.places] < 0]] = names[name]
            best[p.row, name] = max(best.get((p.row, name), 0.0), p.share)
        for row, name in sorted(best):
            yield row, name, best[row, name]


_LIBRARY: list[Library] = []


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment) of each licence whose notice or opening a document holds.

    Every window of every text is hashed. A passage counts where it holds at least CONTAINED of the distinct two-word
    shingles of a template, ignoring case, punctuation and line breaks; containment is the best template's share, where most windows
    agree that it lies. A
    document with several licences has several rows, however close their notices stand; of licences that match the same
    words, the one that fits them best counts. One with none, a null or an empty text has none. A null id is carried.
    Repeated rows give repeated rows. An empty table gives no rows. Other columns play no part; texts are read whole,
    however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _LIBRARY:
            _LIBRARY.append(Library())
        for batch in batches:
            off, data = buffers(batch.column(1))
            rows, names, shares = [], [], []
            for lo, hi in chunks(off):
                for row, name, share in _LIBRARY[0].scan(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]):
                    rows.append(lo + row)
                    names.append(name)
                    shares.append(round(share, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["doc_id", "license", "containment"])

    ids = batched(docs).select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.where(F.col("text").isNotNull()).mapInArrow(run, f"doc_id {kind}, license string, containment double")
