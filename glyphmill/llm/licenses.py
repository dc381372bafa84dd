"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment confirms them.

Windows are runs of shingles at scales of 4, 8, 16, ...; each starts a quarter of its length after the one before it.  A
template of n shingles is looked for at the least scale with n <= 3/4 of a window, so every occurrence lies wholly in
some window and makes up at least 3/8 of it (1/4 at the least scale).  With BANDS bands of one MinHash value each, a
window with a whole template collides with probability at least 1 - (1 - 3/8) ** BANDS (99.98 %; 99.5 % for a template
of a single shingle, which two to four windows hold), and one with three quarters of it at least 1 - (1 - 0.257) ** BANDS.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import words
from glyphmill.llm.session import tune

BANDS = 18
LEAST_CONTAINMENT = 0.75
LEAST_SCALE = 4
#: Bits of the table that tells whether a value can be a template's at all.
_TABLE = 16

# Short forms and notices of well-known licences.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-line": "Released under the MIT License.",
    "MIT-line-licensed": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
    "All-rights-reserved": "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}

_RANDOM = np.random.default_rng(90210)
_XOR = _RANDOM.integers(0, 2**63, BANDS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: Mapping[str, str], least: float = LEAST_CONTAINMENT):
        self.names = list(templates)
        self.least = least
        raw = [templates[n].encode() for n in self.names]
        hashed, _, _, bounds = words.word_spans(raw, words.MARKS)
        grams, offsets = words.shingle_hashes(hashed, bounds)
        self.sets = [np.unique(grams[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.places = [int(b - a) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.scales: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}  # by scale and band: table, values, templates
        of: dict[int, list[int]] = {}
        for t, n in enumerate(self.places):
            if n:
                scale = LEAST_SCALE
                while 4 * n > 3 * scale:
                    scale *= 2
                of.setdefault(scale, []).append(t)
        for scale, own in of.items():
            for x, m in zip(_XOR, _TIMES, strict=True):
                values = np.array([((self.sets[t] ^ x) * m).min() for t in own], dtype=np.uint64)
                table = np.zeros(1 << _TABLE, dtype=bool)
                table[(values >> np.uint64(64 - _TABLE)).astype(np.int64)] = True
                order = np.argsort(values)
                self.scales.setdefault(scale, []).append((table, values[order], np.array(own)[order]))

    def candidates(self, grams: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first shingle, end shingle) of windows that collide in a band; windows may reach past a text's end."""
        if not len(grams) or not self.scales:
            return
        last = max(self.scales)
        for band in range(BANDS):
            least = (grams ^ _XOR[band]) * _TIMES[band]
            width = 1
            while width < last:
                # the least over twice the width, by start; at coarse scales only every quarter window is kept
                hop = max(1, width // 4)
                later = least[width // hop :]
                least = least.copy()
                np.minimum(least[: len(later)], later, out=least[: len(later)])
                width *= 2
                if width >= 8:
                    least = least[::2]  # the hop is a quarter of the new width again
                if width in self.scales:
                    table, values, own = self.scales[width][band]
                    some = np.flatnonzero(table[(least >> np.uint64(64 - _TABLE)).astype(np.int64)])
                    lo, hi = np.searchsorted(values, least[some], "left"), np.searchsorted(values, least[some], "right")
                    start = some * max(1, width // 4)
                    for i in np.flatnonzero(hi > lo).tolist():
                        for t in own[lo[i] : hi[i]].tolist():
                            yield t, int(start[i]), int(start[i] + width)

    def matches(self, texts: list[bytes]) -> list[tuple[int, str, int, int, float]]:
        """(text, template, first byte, end byte, containment) of every confirmed occurrence, in order."""
        hashed, first, end, bounds = words.word_spans(texts, words.MARKS)
        grams, offsets = words.shingle_hashes(hashed, bounds)
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        spans: dict[int, set[tuple[int, int]]] = {}
        for t, a, b in self.candidates(grams, offsets):
            spans.setdefault(t, set()).add((a, b))
        out = []
        for t, found in spans.items():
            n = self.places[t]
            regions: set[tuple[int, int, int]] = set()
            for a, b in found:  # the same window may reach into several texts
                for text in range(int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, min(b, len(grams)), "left"))):
                    regions.add((text, max(int(offsets[text]), a - n), min(int(offsets[text + 1]), b + n)))
            merged: list[list[int]] = []
            for text, a, b in sorted(regions):
                if merged and merged[-1][0] == text and a <= merged[-1][2]:
                    merged[-1][2] = max(b, merged[-1][2])
                else:
                    merged.append([text, a, b])
            for text, a, b in merged:
                at = a + np.flatnonzero(np.isin(grams[a:b], self.sets[t]))
                # occurrences apart: runs of template shingles with gaps of no more than half the template
                for run in np.split(at, np.flatnonzero(np.diff(at) > max(words.SHINGLE + 1, n // 2)) + 1):
                    share = len(np.unique(grams[run])) / len(self.sets[t]) if len(run) else 0.0
                    if share >= self.least:
                        word = int(bounds[text] + run[0] - offsets[text])
                        stop = int(min(bounds[text + 1], bounds[text] + run[-1] - offsets[text] + words.SHINGLE)) - 1
                        out.append((text, self.names[t], int(first[word] - begin[text]), int(end[stop] - begin[text]), share))
        return sorted(out)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """Every occurrence of a template: doc_id, template, start_byte, end_byte, containment.

    A template is there if at least ``least`` of its distinct five-word shingles (words without marks, A-Z lower-cased)
    stand near each other in the text; a template of fewer words is one shingle.  Whole texts are scanned, in windows
    that do not depend on their length.  A row is scanned by itself: repeated rows and null ids stay; null and empty
    texts have no matches; of templates that hold one another each is told.  No rows, no templates: an empty result.
    Further columns are ignored.
    """
    tune(docs.sparkSession)
    given = dict(templates)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, least)
        for batch, texts in words.batches(rows):
            found = scanner.matches(texts)
            ids = batch.column(0).take(pa.array([m[0] for m in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([m[k] for m in found], kind) for k, kind in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.float64())))], names=["doc_id", "template", "start_byte", "end_byte", "containment"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, template string, start_byte bigint, end_byte bigint, containment double")
