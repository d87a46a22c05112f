"""License scans: MinHash bands over overlapping windows, then exact containment.

Each template has a window length near its own; windows overlap so far that an occurrence lies
in one of them as a whole. A window's MinHash values are looked up among the templates', one band after
another; there are so many bands that a template three quarters of whose word 5-grams stand in a
window is missed with a probability under MISS. Whatever a band retrieves is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.blobs import bounded
from quillon.llm.wordhash import TOKEN, distinct, grams, hash_words, mix

U = np.uint64
WORDS, PERCENT = 5, 75
#: Rows of a band, and the greatest probability of missing a window that has the wanted share.
ROWS, MISS = 1, 0.001

#: Notices and opening texts of public licenses. Not a whole catalogue: licenses and wordings that
#: aren't here aren't found; callers may pass their own.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "terms of the GNU Affero General Public License as published"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication"],
    "EPL-2.0": ["the Eclipse Public License 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def bands_for(share: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of so many rows in which sets of this Jaccard similarity agree at least once, but for ``miss``."""
    p = share**rows
    return 1 if p >= 1 else math.ceil(math.log(miss) / math.log(1 - p))


def _text_grams(text: str) -> np.ndarray:
    h = hash_words(pa.array([text]), True, TOKEN).hash
    return distinct(grams(h, min(WORDS, len(h)) or 1))


class Templates:
    """Templates by window step, with their MinHash values."""

    def __init__(self, texts: dict[str, list[str]], percent: int = PERCENT, seed: int = 1):
        self.percent = percent
        self.names = [n for n, ts in texts.items() for _ in ts]
        self.sets = [_text_grams(t) for ts in texts.values() for t in ts]
        if any(len(hash_words(pa.array([t]), True, TOKEN).hash) < WORDS for ts in texts.values() for t in ts):
            raise ValueError(f"a template needs {WORDS} words")
        # a template of n 5-grams starts in one step and ends within two more, if a step is n / 2
        self.steps: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            step = 1
            while 2 * step < len(s):
                step = max(step + 1, step * 5 // 4)
            self.steps.setdefault(step, []).append(i)
        self.bands: dict[int, int] = {}
        for step, members in self.steps.items():
            shares = []
            for i in members:
                n = len(self.sets[i])
                least = -(-n * percent // 100)
                shares.append(least / (3 * step + n - least))
            self.bands[step] = bands_for(min(shares))
        count = ROWS * max(self.bands.values(), default=0)
        self.odd = mix(np.arange(1, count + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)

    def values(self, grams_: np.ndarray, k: int) -> np.ndarray:
        return grams_ * self.odd[k]


def scan(column: pa.Array, t: Templates) -> list[dict[int, tuple[float, int, int]]]:
    """For each text: template -> (share of its 5-grams, first word, word after the last) of its best window."""
    words = hash_words(column, True, TOKEN)
    g = grams(words.hash, WORDS)
    first = words.first
    out: list[dict] = [{} for _ in range(len(first) - 1)]
    if not len(g):
        return out
    n_grams = np.maximum(np.diff(first) - (WORDS - 1), 0)
    for step, members in t.steps.items():
        # blocks of `step` 5-grams, of each text alone; a window is three blocks in a row
        blocks = -(-n_grams // step)
        text_of = np.repeat(np.arange(len(n_grams)), blocks)
        if not len(text_of):
            continue
        head = np.cumsum(blocks) - blocks
        begin = first[text_of] + (np.arange(len(text_of)) - head[text_of]) * step
        end = np.minimum(begin + step, first[text_of] + n_grams[text_of])
        edges = np.stack([begin, end], axis=1).ravel()
        # the end of a block may be the number of 5-grams, which reduceat doesn't take
        padded = np.r_[g, np.zeros(1, U)]
        following = np.r_[text_of[1:] == text_of[:-1], False]
        after = np.r_[text_of[2:] == text_of[:-2], False, False][: len(text_of)] if len(text_of) > 1 else np.zeros(len(text_of), bool)
        found: set[tuple[int, int]] = set()
        for band in range(t.bands[step]):
            key = template_key = None
            for k in range(band * ROWS, band * ROWS + ROWS):
                least = np.minimum.reduceat(t.values(padded, k), edges)[::2]
                window = least.copy()
                window[:-1] = np.where(following[:-1], np.minimum(window[:-1], least[1:]), window[:-1])
                window[:-2] = np.where(after[:-2], np.minimum(window[:-2], least[2:]), window[:-2])
                own = np.array([t.values(t.sets[i], k).min() for i in members], U)
                key = window if key is None else mix(key) + window
                template_key = own if template_key is None else mix(template_key) + own
            order = np.argsort(template_key)
            names = template_key[order]
            at = np.minimum(np.searchsorted(names, key), len(names) - 1)
            for w in np.flatnonzero(names[at] == key).tolist():
                for j in np.flatnonzero(template_key == key[w]).tolist():
                    found.add((w, members[j]))
        for w, i in sorted(found):
            low = begin[w]
            high = min(low + 3 * step, first[text_of[w]] + n_grams[text_of[w]])
            inside = np.isin(g[low:high], t.sets[i])
            share = len(np.unique(g[low:high][inside])) / len(t.sets[i])
            if 100 * share >= t.percent:
                where = np.flatnonzero(inside)
                base = first[text_of[w]]
                hit = (share, int(low + where[0] - base), int(low + where[-1] + WORDS - base))
                held = out[text_of[w]]
                if i not in held or hit[0] > held[i][0]:
                    held[i] = hit
    return out


def _scan(t: Templates):
    kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(source):
            ids, names, matches = b.column("doc_id"), [], []
            for found in scan(b.column("text"), t):
                names.append(",".join(sorted({t.names[i] for i in found})))
                matches.append([{"license": t.names[i], "containment": share, "start": a, "end": z} for i, (share, a, z) in sorted(found.items(), key=lambda x: (x[1][1], x[0]))])
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(set(n.split(","))) if n else 0 for n in names], pa.int64()), pa.array(names, pa.string()), pa.array(matches, kind)], ["doc_id", "n_licenses", "licenses", "matches"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document for the licenses in ``templates`` (TEMPLATES by default: 16 licenses, by notices and opening texts
    only): doc_id, n_licenses, licenses (sorted, comma-joined), matches.

    matches: for each template found license, containment (share of its word 5-grams in the best window) and
    the words they span. Words are lower-cased runs of letters, digits and characters beyond ASCII. Null and empty texts have none.
    Rows that repeat a doc_id, and rows with a null one, each give a row. Further columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n_licenses long, licenses string, matches array<struct<license: string, containment: double, start: long, end: long>>"
    return docs.mapInArrow(_scan(Templates(templates or TEMPLATES, percent)), schema)
