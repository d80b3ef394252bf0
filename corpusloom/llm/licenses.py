"""Licence notices: normalised text compared to templates by the Dice coefficient over word bigrams.

Units are the lines of a text, the whole text, and every run of consecutive lines: a notice is often wrapped and stands inside other
text. Runs are also compared with the full texts of licences. Two bigram multisets of sizes a and b have a Dice coefficient of at most
2 min(a, b) / (a + b), so a template is compared only with units whose size is within the bound that the threshold sets; most lines of
prose fall to that and to the next bound, the bigrams that any template has at all. The templates are a fixed, small table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._columns import append, text_blocks
from ._words import ALNUM_SPLIT, LOWER, mix, prefix_sums, range_hashes, word_ranges
from .license_bodies import BODIES

THRESHOLD = 0.7

#: Notices by licence, as they are put into files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word bigrams of each text (a text of one word has that word), and each text's first."""
    low = LOWER[data]
    begins, ends, first = word_ranges(low, offsets, ALNUM_SPLIT)
    words = range_hashes(prefix_sums(low), begins, ends)
    n = np.diff(first)
    pairs = words.copy()
    pairs[:-1] = mix(words[:-1] * np.uint64(5) + words[1:])
    keep = np.ones(len(words), bool)
    keep[first[1:][n > 1] - 1] = False
    pairs[first[:-1][n == 1]] = words[first[:-1][n == 1]]
    return pairs[keep], np.concatenate([[0], np.cumsum(np.where(n > 1, n - 1, n))])


class Templates:
    """Template multisets, sorted by size."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float, bodies: list[tuple[str, str]] = ()):
        texts = [t.encode() for _, t in templates]
        grams, first = _bigrams(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        own = [(b - a, name, Counter(grams[a:b].tolist())) for (name, _), a, b in zip(templates, first[:-1].tolist(), first[1:].tolist()) if b > a]
        self.own = sorted(own, key=lambda x: (x[0], x[1]))
        self.sizes = np.array([x[0] for x in self.own])
        self.known = np.unique(grams)
        self.threshold = threshold
        # 2 min(a, b) / (a + b) >= t  <=>  a within [b t / (2 - t), b (2 - t) / t]
        self.ratio = threshold / (2 - threshold)
        self._of_runs([*templates, *bodies])

    def _of_runs(self, templates: list[tuple[str, str]]) -> None:
        """What runs are compared with: each template's count of each bigram that any of them has."""
        texts = [t.encode() for _, t in templates]
        grams, first = _bigrams(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        self.run_grams, index = np.unique(grams, return_inverse=True)
        full = np.flatnonzero(np.diff(first) > 0)
        self.run_names = [templates[k][0] for k in full]
        self.run_sizes = np.diff(first)[full]
        self.run_counts = np.zeros((len(full), len(self.run_grams)), np.int32)
        for row, k in enumerate(full):
            np.add.at(self.run_counts[row], index[first[k] : first[k + 1]], 1)
        # the smallest unit within the bounds shares this many bigrams
        self.run_least = self.threshold / 2 * (1 + self.ratio) * self.run_sizes - 1e-9

    def runs_of(self, gram: np.ndarray, line: np.ndarray, wanted: np.ndarray) -> list[tuple[float, str, int, int]]:
        """(dice, licence, first line, last line) of the runs of a text's lines that reach the threshold, against the templates `wanted`.
        gram: the index of each bigram in run_grams, or -1; line: that of each word. A run that begins or ends with lines that share
        nothing is left to the shorter one without them, which is better."""
        out = []
        begin, end = np.searchsorted(line, line, "left"), np.searchsorted(line, line, "right")
        for t in wanted.tolist():
            size, counts = int(self.run_sizes[t]), self.run_counts[t]
            hit = np.flatnonzero((gram >= 0) & (counts[gram] > 0))
            if not len(hit):
                continue
            ends = np.unique(end[hit + 1])
            for a in np.unique(begin[hit]).tolist():
                lo, hi = np.searchsorted(ends, [a + 1 + size * self.ratio - 1e-9, a + 1 + size / self.ratio + 1e-9])
                stop = ends[lo:hi]
                own = hit[np.searchsorted(hit, a) :]
                if not len(stop) or 2 * len(own) + 1e-9 < self.threshold * size:
                    continue
                until = np.searchsorted(own, stop - 1)  # bigrams of a run end before its last word
                units = stop - 1 - a
                able = 2 * until + 1e-9 >= self.threshold * (units + size)
                if not able.any():
                    continue
                own = own[: until.max()]
                g = gram[own]
                order = np.argsort(g, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))
                nth = np.empty(len(g), np.int64)
                nth[order] = np.arange(len(g)) - np.repeat(starts, np.diff([*starts, len(g)]))
                shared = np.concatenate([[0], np.cumsum(nth < counts[g])])
                dice = 2 * shared[until[able]] / (units[able] + size)
                for d, z in zip(dice.tolist(), stop[able].tolist()):
                    if d >= self.threshold:
                        out.append((d, self.run_names[t], int(line[a]), int(line[z - 1])))
        return out

    def add_runs(self, data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, grams: np.ndarray, first: np.ndarray, out: list[list[dict]]) -> None:
        """Add to each text's matches the best runs of lines. Of runs that overlap the best stays; one goes if a line in it matches the same
        licence, or any at least as well, or if the whole text matches the same licence."""
        at = np.minimum(np.searchsorted(self.run_grams, grams), len(self.run_grams) - 1)
        at = np.where(self.run_grams[at] == grams, at, -1) if len(self.run_grams) else np.full(len(grams), -1)
        known = np.flatnonzero(at >= 0)
        text = np.searchsorted(first, known, "right") - 1
        words = None
        bounds = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]])) if len(text) else np.empty(0, np.int64)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo < self.run_least.min():
                continue
            d = int(text[lo])
            has, n = np.unique(at[known[lo:hi]], return_counts=True)
            wanted = np.flatnonzero(np.minimum(self.run_counts[:, has], n).sum(axis=1) >= self.run_least)
            if not len(wanted):
                continue
            if words is None:
                begins, _, words = word_ranges(LOWER[data], offsets, ALNUM_SPLIT)
                lines = np.searchsorted(ends, begins, "right")
            if words[d + 1] - words[d] < 2:
                continue  # its one word was compared as a line
            line = lines[words[d] : words[d + 1]] - np.searchsorted(ends, offsets[d], "right") + 1
            taken: dict[int, tuple[float, str]] = {m["line"]: (m["dice"], m["license"]) for m in out[d] if m["line"]}
            whole = {m["license"] for m in out[d] if not m["line"]}
            free = np.ones(int(line[-1]) + 1, bool)
            for dice, name, a, z in sorted(self.runs_of(at[first[d] : first[d + 1]], line, wanted), key=lambda x: (-x[0], x[3] - x[2], x[2], x[1])):
                if not free[a : z + 1].all() or any(k in taken and (taken[k][1] == name or taken[k][0] >= dice) for k in range(a, z + 1)):
                    continue
                free[a : z + 1] = False
                if name not in whole:
                    out[d].append({"line": a, "license": name, "dice": dice})

    def best(self, unit: np.ndarray) -> tuple[float, str] | None:
        lo, hi = np.searchsorted(self.sizes, [len(unit) * self.ratio - 1e-9, len(unit) / self.ratio + 1e-9])
        if lo >= hi:
            return None
        counts, best = Counter(unit.tolist()), None
        for size, name, template in self.own[lo:hi]:
            dice = 2 * sum(min(n, counts[g]) for g, n in template.items() if g in counts) / (size + len(unit))
            if dice >= self.threshold and (best is None or (-dice, name) < (-best[0], best[1])):
                best = dice, name
        return best

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[dict]]:
        """For each text its matches: line (0 for the whole text, else from 1), licence, dice."""
        ends = np.flatnonzero(data == 0x0A) + 1
        cuts = np.unique(np.concatenate([offsets, ends]))
        out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        text = np.searchsorted(offsets, cuts[:-1], "right") - 1
        for bounds, whole in ((cuts, False), (offsets, True)):
            grams, first = _bigrams(data, bounds)
            known = np.concatenate([[0], np.cumsum(np.isin(grams, self.known))])
            size = np.diff(first)
            hits = known[first[1:]] - known[first[:-1]]
            least = np.maximum(self.sizes.min() if len(self.sizes) else 0, size * self.ratio)
            # at most all known bigrams of the unit are shared: 2 hits / (size + template) >= t needs this many
            able = np.flatnonzero((size > 0) & (2 * hits + 1e-9 >= self.threshold * (size + least)))
            for k in able.tolist():
                d = k if whole else int(text[k])
                if whole and size[k] and not (data[offsets[d] : offsets[d + 1]] == 0x0A).any():
                    continue  # its one line was compared
                found = self.best(grams[first[k] : first[k + 1]])
                if found:
                    line = 0 if whole else int(np.searchsorted(ends, cuts[k], "right") - np.searchsorted(ends, offsets[d], "right")) + 1
                    out[d].append({"line": line, "license": found[1], "dice": found[0]})
        self.add_runs(data, offsets, ends, grams, first, out)
        return out


_MATCHES = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())]))


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with licenses: line (from 1; 0 for a text of several lines as a whole; the first of a run of lines), license and dice of each
    unit whose best template reaches the threshold, and of runs as add_runs says. The full texts of licences are templates of runs unless
    templates are given. Of equal templates the first by name. A null or empty text has none. A column of this name is replaced;
    repeated rows have equal results."""
    own = TEMPLATES if templates is None else templates
    at = [c for c in docs.columns if c.lower() != "licenses"].index(text)
    kind = pa.list_(pa.struct([("line", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))

    def make():
        wanted = Templates(own, threshold, BODIES if templates is None else [])

        def work(batch: pa.RecordBatch) -> list:
            out = []
            for _, _, data, offsets in text_blocks(batch.column(at)):
                out += wanted.scan(data, offsets)
            return [pa.array(out, kind)]

        return work

    return append(docs, [T.StructField("licenses", _MATCHES)], make)
