"""License scan: MinHash bands over overlapping windows, then exact containment.

Words of a text are lower-cased runs without punctuation; shingles are five
words (all words of a shorter template).  Each template belongs to the smallest
window size that holds it twice over, so that a copy, even with a quarter more
words between, lies whole inside one of the half-overlapping windows.  A window
and the template in it then share at least a known part of their union, and the
number of one-row bands is set from that part so that a copy is missed with a
chance below ``miss``.  Windows that meet a template in any band are verified
exactly: the share of the template's shingles that the window holds.

Window minima are taken over blocks of half a window; those of larger windows
come from smaller ones, so hashing is paid once for all sizes.

Defined results: null, empty and too short texts give no rows; repeated rows are
scanned each on its own; of several windows with one template the best is
reported, on ties the first; any number of templates per text is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from gateledger.llm.common import slices, slim, table

SHINGLE = 5
U = np.uint64

# Public notices (fixed texts).
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "bsd-2-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
}

_OTHER = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(_OTHER).split()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words in a row."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    value = np.zeros(n, U)
    for k in range(size):
        value = mix(value ^ codes[k:k + n])
    return value


@dataclass
class Template:
    name: str
    words: int
    shingles: np.ndarray


class Scanner:
    """All templates of one shingle size class, by window size."""

    def __init__(self, templates: dict[str, str], miss: float = 1e-4, contained: float = 0.8):
        self.hashes, self.contained = Hashes(), contained
        self.levels: dict[tuple[int, int], list[Template]] = {}
        least = 1.0
        for name, text in templates.items():
            codes = self.codes(words_of(text))
            if not len(codes):
                continue
            size = min(SHINGLE, len(codes))
            found = np.unique(shingles(codes, size))
            half = 4
            while half < 1.25 * len(codes):
                half *= 2
            self.levels.setdefault((size, half), []).append(Template(name, len(codes), found))
            kept = contained * len(found)
            least = min(least, kept / (2 * half + len(found) - kept))
        # 1 - (1 - j)^bands >= 1 - miss for the least union share j of a copy and its window
        self.bands = max(1, math.ceil(math.log(miss) / math.log(1 - least))) if least < 1 else 1
        rng = np.random.default_rng(7)
        self.keys = rng.integers(0, 2**63, self.bands, U) * U(2) + U(1)
        self.salts = rng.integers(0, 2**63, self.bands, U)
        self.minima = {
            level: np.array([[((t.shingles ^ s) * k).min() for s, k in zip(self.salts, self.keys, strict=True)]
                             for t in held])
            for level, held in self.levels.items()}

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, words), U, len(words))

    def scan(self, texts: list[str]) -> list[tuple[int, str, float, int, int]]:
        """(text, template, containment, first word, end word) of each match."""
        best: dict[tuple[int, str], tuple[float, int, int]] = {}
        codes = [self.codes(words_of(t)) for t in texts]
        for size in {s for s, _ in self.levels}:
            runs = [shingles(c, size) for c in codes]
            for text, window, template in self.candidates(runs, size):
                half = window[1]
                first = window[0] * half
                part = runs[text][first:first + 2 * half]
                inside = np.flatnonzero(np.isin(part, template.shingles))
                share = len(np.unique(part[inside])) / len(template.shingles)
                if share < self.contained:
                    continue
                key = (text, template.name)
                found = (share, first + int(inside[0]), first + int(inside[-1]) + size)
                if key not in best or (-found[0], found[1]) < (-best[key][0], best[key][1]):
                    best[key] = found
        return [(text, name, *found) for (text, name), found in sorted(best.items())]

    def candidates(self, runs: list[np.ndarray], size: int):
        """Windows that meet a template in any band, over all texts of a batch at once."""
        lengths = np.array([len(r) for r in runs])
        owners = np.flatnonzero(lengths)
        if not len(owners):
            return
        joined = np.concatenate([runs[i] for i in owners])
        halves = sorted(h for s, h in self.levels if s == size)
        met: dict[int, np.ndarray] = {}
        grids = {}
        for half in halves:
            blocks = -(-lengths[owners] // half)
            first = np.cumsum(blocks) - blocks
            text = np.repeat(np.arange(len(owners)), blocks)
            number = np.arange(blocks.sum()) - first[text]
            grids[half] = (blocks, first, text, number)
            met[half] = np.zeros((len(self.levels[size, half]), len(text)), bool)
        starts = np.cumsum(lengths[owners]) - lengths[owners]
        for band in range(self.bands):
            values, before = (joined ^ self.salts[band]) * self.keys[band], None
            for half in halves:
                _, first, text, number = grids[half]
                if before is None:
                    cuts = starts[text] + number * half
                else:
                    cuts = grids[before][1][text] + number * (half // before)
                values = np.minimum.reduceat(values, cuts)
                before = half
                window = values.copy()
                pairs = np.flatnonzero(text[1:] == text[:-1])
                window[pairs] = np.minimum(values[pairs], values[pairs + 1])
                for t, low in enumerate(self.minima[size, half][:, band]):
                    met[half][t] |= window == low
        for half in halves:
            _, _, text, number = grids[half]
            for t, template in enumerate(self.levels[size, half]):
                for at in np.flatnonzero(met[half][t]):
                    yield int(owners[text[at]]), (int(number[at]), half), template


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, contained: float = 0.8, miss: float = 1e-4,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document and template found: containment and word span."""
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, miss, contained)
        for batch in batches:
            for part in slices(batch):
                ids = part.column(0).to_pylist()
                rows = scanner.scan(part.column(1).to_pylist()) if scanner.levels else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[r[0]] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64()),
                ], ["doc_id", "license", "containment", "first_word", "end_word"])

    return slim(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, license string, containment double, first_word long, end_word long")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
