"""License scans: min-hash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts are compared as words (letters and digits; bytes beyond ASCII count as letters) in lower case. Shingles of three
words are hashed. A window is a run of 2, 4, 8, 16, 32 or 64 shingles; windows of one size start every
quarter of it, so an occurrence of a template overlaps some window of the largest size that fits it by at least 7/8 or contains one
whole. Every window of that size over a template is indexed. Min-hashes of all sizes come from one doubling scheme.
With BANDS bands of ROWS rows two windows of Jaccard index j meet with probability 1 - (1 - j**ROWS)**BANDS: at 0.7 that
is above 0.9997, and windows that are equal always meet. Candidates are verified exactly: the share of a template's
shingles that occur in the stretch of the text around the window must reach CONTAINED.

Defined results: null text counts as empty and has no license; a template of fewer than four words is rejected; several
occurrences of a template in one text give one row each, unless they overlap; equal hits from several windows give one
row; repeated rows each give their rows; empty tables give empty results; columns other than the two named ones are
ignored. Positions are word numbers, ends exclusive.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varfold.llm.common import blocks, span_hashes, table

SHINGLE = 3
BANDS, ROWS = 12, 2
SIZES = (2, 4, 8, 16, 32, 64)
CONTAINED = 0.8
#: Bytes of text scanned together, and shingles whose min-hashes are held at a time (a multiple of all strides).
_TOGETHER, _CHUNK = 1 << 20, 1 << 17

#: Statements and notices of well-known licenses.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

_WORD = np.zeros(256, bool)
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
for _c in range(128):
    _WORD[_c] = chr(_c).isalnum()
    _LOWER[_c] = _c + 32 * (65 <= _c <= 90)
_RNG = np.random.default_rng(6)
_MIX = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _RNG.integers(1, 1 << 63, (2, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles, the text each is in, and the number of its first word in its text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    solid = np.concatenate(([False], _WORD[data], [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edge[::2], edge[1::2]
    if len(starts) < SHINGLE:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
    first = np.searchsorted(doc, np.arange(len(texts)))
    h = span_hashes(data, starts, ends)
    mixed = h[: len(h) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SHINGLE + 1 + k]
    mixed ^= mixed >> np.uint64(29)
    whole = doc[SHINGLE - 1 :] == doc[: len(doc) - SHINGLE + 1]
    at = np.flatnonzero(whole)
    return mixed[at], doc[at], at - first[doc[at]]


def _band_keys(h: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size the keys [band, window] of the windows that start at each shingle; windows may run past a text's end."""
    least = h[None, :] * _MIX[:, None]
    size = 1
    for want in sizes:
        while size < want and least.shape[1] > size:
            least = np.minimum(least[:, :-size], least[:, size:])
            size *= 2
        if size < want:
            return
        pair = least.reshape(BANDS, ROWS, -1)
        yield want, pair[:, 0] * _FOLD[0][:, None] + pair[:, 1] * _FOLD[1][:, None]


class Index:
    """Band keys of all templates, and their shingle sets."""

    def __init__(self, templates: dict[str, tuple[str, ...]]) -> None:
        self.names: list[str] = []
        self.sets: list[np.ndarray] = []
        self.lengths: list[int] = []
        entries: dict[int, list[tuple[np.ndarray, int]]] = {s: [] for s in SIZES}
        for name, variants in templates.items():
            for text in variants:
                h, _, _ = shingles([text.encode()])
                if len(h) < 2:
                    raise ValueError(f"a template of {name} is too short: {text!r}")
                size = max(s for s in SIZES if s <= len(h))
                for s, keys in _band_keys(h, SIZES):
                    if s == size:
                        entries[s].append((keys, len(self.names)))
                self.names.append(name)
                self.sets.append(np.unique(h))
                self.lengths.append(len(h))
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for s, found in entries.items():
            if not found:
                continue
            keys = np.concatenate([k for k, _ in found], 1)
            owner = np.concatenate([np.full(k.shape[1], t) for k, t in found])
            self.tables[s] = []
            for band in keys:
                order = np.argsort(band, kind="stable")
                known = np.zeros(1 << 16, bool)
                known[(band >> np.uint64(48)).astype(np.int64)] = True
                self.tables[s].append((band[order], owner[order], known))

    def scan(self, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
        """(text, template, containment, first word, end word) of the verified occurrences."""
        h, doc, word = shingles(texts)
        if not len(h):
            return []
        spots: set[tuple[int, int, int]] = set()
        for begin in range(0, len(h), _CHUNK):  # bounded memory for a very long text
            self._retrieve(h[begin : begin + _CHUNK + SIZES[-1] - 1], begin, spots)
        hits: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for at, t, size in sorted(spots):
            reach = self.lengths[t]
            a, b = max(at - reach, 0), min(at + size + reach, len(h))
            for d in {int(doc[at]), int(doc[min(at + size, len(h)) - 1])}:
                inside = np.flatnonzero(doc[a:b] == d) + a
                among = inside[np.isin(h[inside], self.sets[t])]
                if len(among) < CONTAINED * len(self.sets[t]):
                    continue
                best = self._stretch(h, among, t)
                if best is not None:
                    share, first, last = best
                    hits.setdefault((d, t), []).append((share, int(word[first]), int(word[last]) + SHINGLE))
        out = []
        for (d, t), found in sorted(hits.items()):
            taken: list[tuple[int, int]] = []
            for share, first, end in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
                k = bisect(taken, (first, end))  # those taken are disjoint and in order, so only the nearest two matter
                if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or end <= taken[k][0]):
                    taken.insert(k, (first, end))
                    out.append((d, t, share, first, end))
        return out

    def _retrieve(self, h: np.ndarray, begin: int, spots: set[tuple[int, int, int]]) -> None:
        """Add (first shingle, template, size) of the windows that meet a template's in a band."""
        for size, keys in _band_keys(h, SIZES):
            if size not in self.tables:
                continue
            stride = max(1, size // 4)
            sampled = np.arange(begin, begin + min(keys.shape[1], _CHUNK), stride)
            for (bands, owner, known), every in zip(self.tables[size], keys, strict=True):
                mine = every[:_CHUNK:stride]
                at = np.flatnonzero(known[(mine >> np.uint64(48)).astype(np.int64)])
                low, high = np.searchsorted(bands, mine[at]), np.searchsorted(bands, mine[at], side="right")
                for i in np.flatnonzero(high > low):
                    for t in set(owner[low[i] : high[i]].tolist()):
                        spots.add((int(sampled[at[i]]), t, size))

    def _stretch(self, h: np.ndarray, among: np.ndarray, t: int) -> tuple[float, int, int] | None:
        """The stretch of at most 1.25 template lengths that holds most of the template's shingles."""
        reach, best = int(self.lengths[t] * 1.25) + 1, None
        for i, first in enumerate(among):
            last = among[i : np.searchsorted(among, first + reach)]
            share = len(np.unique(h[last])) / len(self.sets[t])
            if share >= CONTAINED and (best is None or share > best[0]):
                best = (share, int(first), int(last[-1]))
                if share == 1:
                    break
        return best


def find_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, first_word, end_word): verified occurrences in each row of ``docs``; no shuffle."""
    given = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(given)
        for batch in blocks(batches, 1, _TOGETHER):
            ids = batch.column(0).to_pylist()
            found = index.scan([(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()])
            rows = [(ids[d], index.names[t], share, first, end) for d, t, share, first, end in found]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "license", "containment", "first_word", "end_word"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, license string, containment double, first_word int, end_word int")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    """Licenses in all documents: the best occurrence of each license, and how many there are."""
    found = find_licenses(table(spark, sf_dir, "documents"))
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("first"), (-F.col("end_word")).alias("end"))).alias("best")
    grouped = found.groupBy("id", "license").agg(best, F.count("*").alias("occurrences"))
    return grouped.select(
        F.col("id").alias("doc_id"),
        "license",
        F.col("best.containment").alias("containment"),
        (-F.col("best.first")).alias("first_word"),
        (-F.col("best.end")).alias("end_word"),
        "occurrences",
    )
