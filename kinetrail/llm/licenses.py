"""License scans: minwise bands over overlapping windows find templates, exact containment verifies them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches
from .shingles import SHINGLE, MinHash, shingle_hashes

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bands of one row each; smallest scale; shares in hundredths.
BANDS, SMALLEST, PERCENT = 96, 4, 75
#: Low bits of a shingle's hash in the bitmap of all templates' shingles.
OWN_BITS = 22

#: Notices as their publishers word them: (name, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
)


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The distinct shingles; fewer words are one."""
    size = min(SHINGLE, len(words))
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if words else set()


def templates_in(spark: SparkSession, folder: str) -> tuple[tuple[str, str], ...]:
    """Every file of a folder of full license texts, such as a system keeps, as a template named by it: a parameter, so bounded."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1), F.col("content").cast("string")).collect()
    return tuple(sorted((name, text) for name, text in files if text))


@dataclass
class Template:
    name: str
    hashes: np.ndarray  # distinct, sorted
    grams: frozenset  # the shingles themselves
    scale: int


class Library:
    """Templates by scale, and for each band the table of their minima.

    A template of n shingles belongs to the power of two, L, that is at least 1.25 n and SMALLEST. Windows of
    2 L shingles, L apart, hold every stretch of up to L shingles whole. If such a window holds three quarters of
    the template, their similarity is at least 0.75 n / (2 L + 0.25 n): 0.11 for one
    shingle and over 0.13 for longer ones (n > 0.4 L), so all of 96 one-row bands miss with a probability below 1.4e-5.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...], bands: int = BANDS, smallest: int = SMALLEST):
        self.minhash, self.smallest = MinHash(bands), smallest
        self.templates: list[Template] = []
        self.own = np.zeros(1 << OWN_BITS, bool)
        for name, text in templates:
            words = WORDS.findall(text.encode().lower())
            h = np.unique(shingle_hashes(words, SHINGLE))
            if len(h):
                scale = smallest
                while 4 * scale < 5 * len(h):
                    scale *= 2
                self.templates.append(Template(name, h, frozenset(grams(words)), scale))
                self.own[h & np.uint64(len(self.own) - 1)] = True
        self.scales = sorted({t.scale for t in self.templates})
        #: by scale: a bitmap of the low 16 bits of the minima, by band; then (band, minimum) -> templates
        self.bitmaps: dict[int, np.ndarray] = {}
        self.lookup: dict[int, dict[tuple[int, int], list[int]]] = {}
        for k, t in enumerate(self.templates):
            low = self.minhash.minima(t.hashes)
            bitmap = self.bitmaps.setdefault(t.scale, np.zeros((bands, 1 << 16), bool))
            bitmap[np.arange(bands), low & 0xFFFF] = True
            for j, x in enumerate(low.tolist()):
                self.lookup.setdefault(t.scale, {}).setdefault((j, x), []).append(k)

    def stretches(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Where a window that holds a shingle of any template can stand, aligned to all scales; the rest of a text holds no part of one."""
        width = 2 * self.scales[-1]
        hit = np.unique(np.flatnonzero(self.own[hashes & np.uint64(len(self.own) - 1)]) // width)
        if not len(hit):
            return []
        breaks = np.flatnonzero(np.diff(hit) > 2)
        first, last = hit[np.append(0, breaks + 1)], hit[np.append(breaks, len(hit) - 1)]
        return [(max(0, (a - 1) * width), (b + 2) * width) for a, b in zip(first.tolist(), last.tolist(), strict=True)]

    def candidates(self, hashes: np.ndarray) -> set[tuple[int, int]]:
        """(template, window) pairs that share a band; window i of scale L holds shingles [i L, i L + 2 L)."""
        found: set[tuple[int, int]] = set()
        step = self.smallest
        if not len(hashes):
            return found
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        pad = -len(h) % step
        if pad:
            h = np.concatenate([h, np.repeat(h[-1:], pad)])  # repeats leave minima as they are
        a, b = self.minhash.a, self.minhash.b
        blocks = np.concatenate(
            [(a * h[None, at : at + 2048] + b).reshape(len(a), -1, step).min(axis=2) for at in range(0, len(h), 2048)], axis=1
        )
        scale, band = step, np.arange(len(a))[:, None]
        while scale <= self.scales[-1]:
            if scale in self.bitmaps:
                windows = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
                if windows is not blocks:
                    windows = np.concatenate([windows, blocks[:, -1:]], axis=1)
                for j, i in zip(*np.nonzero(self.bitmaps[scale][band, windows & 0xFFFF]), strict=True):
                    for k in self.lookup[scale].get((int(j), int(windows[j, i])), ()):
                        found.add((k, int(i)))
            if blocks.shape[1] % 2:
                blocks = np.concatenate([blocks, blocks[:, -1:]], axis=1)
            blocks = np.minimum(blocks[:, ::2], blocks[:, 1::2])
            scale *= 2
        return found

    def matches(self, text: bytes, percent: int = PERCENT) -> list[dict]:
        """Verified matches: name, first and last word (end exclusive), share of the template's shingles.

        Windows with at least `percent` hundredths of a template's shingles count; neighbouring ones of one
        template are one match, whose words reach from its first to its last common shingle.
        """
        words = WORDS.findall(text.lower())
        hashes = shingle_hashes(words, SHINGLE)
        good: dict[int, list[tuple[int, float, int, int]]] = {}
        found: set[tuple[int, int]] = set()
        for a, b in self.stretches(hashes):
            found |= {(k, i + a // self.templates[k].scale) for k, i in self.candidates(hashes[a:b])}
        for k, i in sorted(found):
            t = self.templates[k]
            at = np.flatnonzero(np.isin(hashes[i * t.scale : (i + 2) * t.scale], t.hashes)) + i * t.scale
            held = [(p, g) for p in at.tolist() if (g := tuple(words[p : p + SHINGLE])) in t.grams]
            common = len({g for _, g in held})
            if common * 100 >= percent * len(t.grams):
                good.setdefault(k, []).append((i, common / len(t.grams), held[0][0], held[-1][0] + min(SHINGLE, len(words))))
        out: list[dict] = []
        for k, windows in good.items():
            last = -2
            for i, share, first, end in windows:
                if i == last + 1:
                    out[-1]["end"] = max(out[-1]["end"], end)
                    out[-1]["share"] = max(out[-1]["share"], share)
                else:
                    out.append({"license": self.templates[k].name, "template": k, "start": first, "end": end, "share": share})
                last = i
        return sorted(out, key=lambda m: (m["start"], m["template"]))


@cache
def _library(templates: tuple[tuple[str, str], ...]) -> Library:
    return Library(templates)


MATCHES = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("template", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("share", T.DoubleType()),
        ]
    )
)
_MATCHES = pa.list_(
    pa.struct([("license", pa.string()), ("template", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
)


def _scan(text: Column, templates: tuple[tuple[str, str], ...], percent: int) -> Column:
    @F.arrow_udf(MATCHES)
    def scan(texts: pa.Array) -> pa.Array:
        library = _library(templates)
        return pa.array([library.matches(t or b"", percent) for t in texts.to_pylist()], _MATCHES)

    return scan(text.cast("binary"))


def find_licenses(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT, text_col: str = "text"
) -> DataFrame:
    """Adds `licenses`: array of license, template, start, end (words, end exclusive), share.

    One Arrow pass over whole texts: a bitmap of all templates' shingles leaves the stretches that can hold part of one. There, minima of blocks of shingles are merged pairwise into
    windows of every scale, looked up band by band among the templates' (a parameter, so
    bounded), and each candidate window's share of the template's shingles is counted exactly, by their words.

    Null, empty or blank text: no matches. Repeated rows match alike; several templates may match one stretch. A
    column of the name licenses is replaced, others stay. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn("licenses", _scan(F.col(text_col), tuple(templates), percent))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and places of the license notices in every document."""
    found = find_licenses(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "licenses")
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("licenses.license")), ",").alias("names"),
        F.array_join(F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"], m["end"])), ",").alias("spans"),
        F.coalesce(F.array_max("licenses.share"), F.lit(0.0)).alias("best_share"),
    )
