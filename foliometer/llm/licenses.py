"""License scans: MinHash bands over overlapping text windows, then exact containment.

Words are lower-cased runs of letters, digits and characters outside ASCII; a
shingle is five consecutive words, a template of fewer words is one shingle. Each
template is matched with windows of its own number of words that begin every
stride = max(1, words // 16) words, so every stretch of the text that holds the template
lies within half a stride of a window. Texts are scanned end to end; where they are together
shorter than a template, shingles that no text has fill the window up.

A template matches where at least `containment` of its distinct shingles stand in a
window widened by one stride to either side. Such a window and the template, of m
shingles each, share at least s = ceil(containment m) shingles (less by the stride, if it
is over 1), hence have a Jaccard similarity of at least J = s / (2 m - s). With bands of
r rows the number of bands b is the least for which 1 - (1 - J^r)^b is `sure` or
more; where s = m, signatures are equal and one band is certain. Window signatures that agree with a template's in a band are candidates, and
those are verified on the shingles' words, so what is returned is exact. Of matches that
overlap, one whose template stands for the most part in a longer one's is not told beside it,
and of templates that are much alike only that of greater containment (then the later name).

Templates are few and go along with the task; their number and length are set by the
caller, not by the data. Documents are scanned whole, where they are read, without
a shuffle. A null text has no words. Rows that repeat give repeated results. A
template without words never matches. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table
from .words import ALNUM, BASE, Words, mix, slices, windows

SHINGLE = 5

# Notices and grants of well-known licenses, word for word.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def bands_for(shingles: int, stride: int, containment: float, rows: int, sure: float) -> int:
    """Bands of `rows` rows that retrieve a matching window with probability `sure` at least."""
    shared = max(math.ceil(containment * shingles - 1e-9) - (stride if stride > 1 else 0), 1)
    if shared >= shingles:
        return 1  # equal sets have equal signatures
    j = shared / (2 * shingles - shared)
    return max(1, math.ceil(math.log(1 - sure) / math.log(1 - j**rows)))


class Template:
    def __init__(self, name: str, text: str, containment: float, rows: int, sure: float) -> None:
        words = Words(pa.array([text], pa.large_string()), ALNUM, lower=True)
        self.name, self.words = name, len(words)
        self.k = min(SHINGLE, self.words)
        if not self.words:
            return
        tokens = [words.text(i) for i in range(self.words)]
        self.shingles = {tuple(tokens[i : i + self.k]) for i in range(self.words - self.k + 1)}
        self.size = self.words - self.k + 1
        self.stride = max(1, self.words // 16)
        self.rows, self.bands = rows, bands_for(len(self.shingles), self.stride, containment, rows, sure)
        own = windows(words.hash, self.k)
        least = [int(_permuted(own, p).argmin()) for p in range(self.bands * rows)]
        self.signature = np.array([_permuted(own[x : x + 1], p)[0] for p, x in enumerate(least)], dtype=np.uint64)
        self.anchors = np.unique(own[least])  # the shingles that the signature's values come from

    def starts(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the windows among n shingles, which begin every stride and at the end, those that hold one of the places `at`."""
        steps = -(-self.size // self.stride) + 1
        out = (at // self.stride * self.stride)[:, None] - np.arange(steps) * self.stride
        out = np.where((out >= 0) & (out > at[:, None] - self.size) & (out <= n - self.size), out, -1).reshape(-1)
        if len(at) and at[-1] >= n - self.size:
            out = np.append(out, n - self.size)
        out = np.unique(out)
        return out[out >= 0]


def _permuted(shingles: np.ndarray, number: int) -> np.ndarray:
    seed = mix(np.array([number + 1], dtype=np.uint64))[0] | np.uint64(1)
    h = shingles * seed
    h ^= h >> np.uint64(29)
    return h


def _places(shingles: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles stand that are among the sorted keys, and which."""
    low = np.zeros(1 << 16, dtype=bool)
    low[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(low[(shingles & np.uint64(0xFFFF)).astype(np.int64)])
    which = np.minimum(np.searchsorted(keys, shingles[maybe]), len(keys) - 1)
    there = keys[which] == shingles[maybe]
    return maybe[there], keys[which[there]]


def candidates(shingles: np.ndarray, templates: list[Template], most: int = 1 << 20) -> list[np.ndarray]:
    """For each template (all of one shingle length), the starts of windows that agree with it in a band.

    A window can agree in a row only if it holds the shingle that gives the template's value there, so signatures are worked out
    for windows that hold one of these, and for no others.
    """
    at, found = _places(shingles, np.unique(np.concatenate([t.anchors for t in templates])))
    short = max(t.size for t in templates) - len(shingles)
    if len(at) and short > 0:  # a slice shorter than a template may still hold most of it
        shingles = np.concatenate((shingles, mix(np.arange(1, short + 1, dtype=np.uint64) ^ BASE)))
    out = []
    for t in templates:
        starts, kept = t.starts(at[np.isin(found, t.anchors)], len(shingles)), []
        for a in range(0, len(starts), max(1, most // t.size)):
            part = starts[a : a + max(1, most // t.size)]
            own = shingles[part[:, None] + np.arange(t.size)]
            agree = np.stack([_permuted(own, p).min(axis=1) == x for p, x in enumerate(t.signature)], axis=1)
            kept.append(part[agree.reshape(len(part), t.bands, t.rows).all(axis=2).any(axis=1)])
        out.append(np.concatenate(kept) if kept else starts)
    return out


def most_specific(found: list[tuple[int, str, float, int, int]], templates: list[Template], containment: float) -> list[tuple[int, str, float, int, int]]:
    """found without the matches whose place overlaps that of a better one: a longer template that holds theirs, or of templates much alike the one of greater containment."""
    sets = {t.name: t.shingles for t in templates if t.words}

    def gives_way(a: tuple, b: tuple) -> bool:
        """Whether a is not to be told beside b."""
        ours, theirs = sets[a[1]], sets[b[1]]
        if a[1] == b[1] or a[3] >= b[4] or b[3] >= a[4] or len(ours & theirs) < containment * len(ours):
            return False
        mutual = len(ours & theirs) >= containment * len(theirs)
        return (b[2], b[1]) > (a[2], a[1]) if mutual else len(theirs) > len(ours)

    by_text: dict[int, list[tuple]] = {}
    for x in found:
        by_text.setdefault(x[0], []).append(x)
    return [a for own in by_text.values() for a in own if not any(gives_way(a, b) for b in own)]


def find_licenses(words: Words, templates: list[Template], containment: float) -> list[tuple[int, str, float, int, int]]:
    """(text, template, containment, first word, end word) of the best place of each template in each text."""
    out, usable = [], [t for t in templates if t.words]
    pairs = []
    for k in sorted({t.k for t in usable}):
        own = [t for t in usable if t.k == k]
        # windows run over all texts end to end; the verification keeps to one text
        pairs += zip(own, candidates(windows(words.hash, k), own), strict=True)
    for t, starts in pairs:
        best: dict[int, tuple[float, int, int]] = {}
        for s in starts.tolist():
            low, high = s - t.stride, s + t.words + t.stride
            for i in range(int(np.searchsorted(words.first, max(low, 0), side="right")) - 1, len(words.first) - 1):
                a, b = max(low, int(words.first[i])), min(high, int(words.first[i + 1]))
                if words.first[i] >= high:
                    break
                if b - a < t.k:
                    continue
                tokens = [words.text(k) for k in range(a, b)]
                at = [k for k in range(len(tokens) - t.k + 1) if tuple(tokens[k : k + t.k]) in t.shingles]
                share = len({tuple(tokens[k : k + t.k]) for k in at}) / len(t.shingles)
                if share >= containment and share > best.get(i, (0.0,))[0]:
                    best[i] = (share, a + at[0] - int(words.first[i]), a + at[-1] + t.k - int(words.first[i]))
        out += [(i, t.name, *x) for i, x in best.items()]
    return most_specific(out, usable, containment)


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, containment: float = 0.8, rows: int = 2, sure: float = 0.9999) -> DataFrame:
    """doc_id, license, containment, first_word, end_word: one row for each template that a document holds."""
    known = [Template(k, v, containment, rows, sure) for k, v in (TEMPLATES if templates is None else templates).items()]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = find_licenses(Words(batch.column("text"), ALNUM, lower=True), known, containment)
            if found:
                text, name, share, first, end = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text)), pa.array(name), pa.array(share), pa.array(first, pa.int64()), pa.array(end, pa.int64())], ["doc_id", "license", "containment", "first_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, containment double, first_word long, end_word long")


def op3(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
