"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment
verifies them.

Texts are lower-cased and cut into words (letters, digits, code points beyond ASCII), words into shingles
of five.  A document carries a template if the words of some window hold `containment` (0.8) or more of
the template's distinct shingles.

1. Windows.  For a template of L words, windows have 2L words and begin every ceil(L / 2) words, so any
   run of 1.5 L words lies in a window whole.
2. Retrieval.  A window gets the minima of HASHES hash functions over its shingles, cut into bands; a
   template is retrieved where a band agrees with its own.  A window that holds `containment` of a
   template has a Jaccard similarity of J to it at least, which follows from L; a band has as many hashes
   (r) as keep the chance to miss, (1 - J ** r) ** (HASHES // r), below MISS.  So bands are longer, and
   chance meetings rarer, the longer the template.  (A minimum can only agree where the window holds the
   template's shingle it comes from; windows without any shingle of a template of their size are passed
   over, which changes nothing.)
3. Verification.  A retrieved template's distinct shingles in the window are counted.  The place given is
   that of the template's shingles in the window with the highest containment (the first of equals).

Templates with fewer words than five are one shingle.  The template table is cut into blocks of at most
BLOCK_WORDS words, one pass over the documents for each.

Nulls: null texts have no words; a null doc_id stays null; templates without words match nothing.
Repeated rows each give their rows; empty tables give none.  Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import license_texts, shared, textbytes as tb
from .textbytes import U64

K, CONTAINMENT = 5, 0.8
#: Hash functions of a signature, and the chance to miss a window that bands may leave.
HASHES, MISS = 256, 1e-6
BLOCK_WORDS = 500_000

#: The customary one-line and first-paragraph notices of common licenses, the short Creative
#: Commons forms, the further paragraphs of license texts (found where the first one is missing), and whole
#: license texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("Apache-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    *((f"CC-{kind}-{version}-short", f"Licensed under CC {kind} {version}") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("4.0", "3.0")),
    ("CC0-1.0-short", "Licensed under CC0 1.0"),
    ("MIT-text-2", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MIT-text-3", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("ISC-text-2", "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("BSD-text-2", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSD-text-3", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("GPL-text-2", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("GPL-text-3", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("Apache-text-2", "Terms and conditions for use, reproduction, and distribution"),
    ("Apache-text-3", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("Unlicense-2", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    *license_texts.WHOLE,
)


@cache
def _salts() -> np.ndarray:
    return tb.mix(np.arange(1, HASHES + 1, dtype=np.uint64))


def signature(g: np.ndarray) -> np.ndarray:
    """The minima of HASHES hash functions over the shingles g."""
    return tb.mix(g[:, None] ^ _salts()).min(0)


def lowest_jaccard(size: int, shingles: int, k: int, containment: float = CONTAINMENT) -> float:
    """Of a window of 2 * size words that holds `containment` of a template's distinct shingles."""
    held = math.ceil(containment * shingles - 1e-9)
    return held / (2 * size - k + 1 + shingles - held)


def band_rows(jaccard: float) -> int:
    """The most hashes a band may have."""
    rows = 1
    while rows < 8 and (1 - jaccard ** (rows + 1)) ** (HASHES // (rows + 1)) <= MISS:
        rows += 1
    return rows


def bands(minima: np.ndarray, rows: int) -> np.ndarray:
    """One number for each band of a signature."""
    n = HASHES // rows
    out = np.arange(n, dtype=np.uint64)
    for j in range(rows):
        out = tb.mix(out * U64(0xD6E8FEB86659FD93) + minima[j * n : (j + 1) * n])
    return out


class Templates:
    """The templates of one pass, by number of words."""

    def __init__(self, names: list[str], texts: list[str], containment: float = CONTAINMENT):
        data, offs = tb.buffers(pa.array([t.lower() for t in texts], pa.string()))
        _, _, row, h = tb.words(data, offs, tb.NOT_WORD)
        at = tb.row_starts(row, len(texts))
        self.names, self.containment = names, containment
        self.size = np.diff(at)
        self.k = np.minimum(self.size, K)
        cut = lambda w, k: np.unique(tb.shingles(w, np.zeros(len(w), np.int64), int(k))[0]) if k else np.empty(0, np.uint64)
        self.grams = [cut(h[a:b], k) for a, b, k in zip(at, at[1:], self.k)]
        self.known = np.unique(np.concatenate([*self.grams, np.empty(0, np.uint64)]))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.known >> U64(44)).astype(np.int64)] = True
        #: For each number of words: the shingles of its templates; and for each length of bands that they
        #: have, the templates of every band.
        self.own: dict[int, np.ndarray] = {}
        self.buckets: dict[int, dict[int, dict[int, list[int]]]] = {}
        for size in np.unique(self.size[self.size > 0]).tolist():
            items = np.flatnonzero(self.size == size).tolist()
            self.own[size] = np.unique(np.concatenate([self.grams[i] for i in items]))
            by_rows = self.buckets[size] = {}
            for i in items:
                rows = band_rows(lowest_jaccard(size, len(self.grams[i]), int(self.k[i]), containment))
                for band in bands(signature(self.grams[i]), rows).tolist():
                    by_rows.setdefault(rows, {}).setdefault(band, []).append(i)

    def hits(self, g: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.seen[(g >> U64(44)).astype(np.int64)])
        return maybe[_among(g[maybe], self.known)]

    def retrieve(self, g: np.ndarray, size: int) -> set[int]:
        """The templates of `size` words that a band of a window with the shingles g has."""
        minima, out = signature(g), set()
        for rows, table in self.buckets[size].items():
            for band in bands(minima, rows).tolist():
                out.update(table.get(band, ()))
        return out

    def scan(self, g: np.ndarray, k: int, hit: np.ndarray):
        """(template, first word, words, containment) for a document's k-shingles g, hit by known ones."""
        best: dict[int, tuple[int, int, float]] = {}
        for size, own in self.own.items():
            if min(size, K) != k:
                continue
            at = hit[_among(g[hit], own)]
            step, wide = math.ceil(size / 2), 2 * size - k + 1
            first = np.maximum(0, -(-(at - wide + 1) // step))
            count = at // step - first + 1
            windows = np.unique(np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
            for w in windows.tolist():
                part = g[w : w + wide]
                for i in self.retrieve(part, size):
                    held = np.flatnonzero(_among(part, self.grams[i]))
                    share = len(np.unique(part[held])) / len(self.grams[i])
                    if share >= self.containment - 1e-9 and (i not in best or share > best[i][2]):
                        best[i] = (w + int(held[0]), int(held[-1] - held[0]) + k, share)
        for i, found in sorted(best.items()):
            yield (i, *found)


def _among(g: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of g are in the sorted `known`."""
    if not len(known):
        return np.zeros(len(g), bool)
    return known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g


def _blocks(templates):
    names, texts, n = [], [], 0
    for name, text in templates:
        size = len((text or "").split())
        if names and n + size > BLOCK_WORDS:
            yield names, texts
            names, texts, n = [], [], 0
        names.append(name)
        texts.append(text or "")
        n += size
    if names:
        yield names, texts


def scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, first_word, n_words, containment: one row for each template a document carries."""
    spark = docs.sparkSession
    shared.ship(spark)
    kind = "doc_id long, template string, first_word long, n_words long, containment double"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    out = None
    for names, texts in _blocks(templates):

        def run(batches, names=names, texts=texts):
            t = Templates(names, texts, containment)
            kinds = sorted(set(t.k[t.k > 0].tolist()))
            for batch in batches:
                data, offs = tb.buffers(batch.column(1))
                found = []
                for i, j in tb.row_slices(offs):
                    _, _, row, h = tb.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tb.NOT_WORD)
                    for k in kinds:
                        g, at = tb.shingles(h, row, k)
                        hit = t.hits(g)
                        of = row[at[hit]]
                        for r in np.unique(of).tolist():
                            a, b = np.searchsorted(row[at], (r, r + 1))
                            found += [(i + r, *x) for x in t.scan(g[a:b], k, hit[of == r] - a)]
                columns = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array([t.names[x] for x in columns[1]], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array([round(x, 6) for x in columns[4]], pa.float64())], ["doc_id", "template", "first_word", "n_words", "containment"])

        part = own.mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], kind)


def op10_license_scan(spark, sf_dir) -> DataFrame:
    return scan(shared.documents(spark, sf_dir))


_WORDS = r"regexp_extract_all(lower({}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Every window that holds a shingle of the template, without any index.
OP10_SQL = (
    "WITH t AS (SELECT template, w, len(w) AS size, least(len(w), 5) AS k, (len(w) + 1) // 2 AS step FROM (SELECT template, "
    + _WORDS.format("text")
    + " AS w FROM (VALUES "
    + ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in TEMPLATES)
    + ") v(template, text)))"
    + """, tg AS (
  SELECT DISTINCT template, size, k, step, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM t)
), tn AS (
  SELECT template, count(*) AS n FROM tg GROUP BY template
), d AS (
  SELECT row_number() OVER () AS r, doc_id, """
    + _WORDS.format("text")
    + """ AS w FROM documents
), dg AS (
  SELECT r, i - 1 AS p, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)
), hit AS (
  SELECT dg.r, dg.p, dg.g, tg.template, tg.k, tg.step, 2 * tg.size - tg.k + 1 AS wide FROM dg JOIN tg ON tg.k = dg.k AND tg.g = dg.g
), win AS (
  SELECT r, template, k, s, count(DISTINCT g) AS held, min(p) AS first, max(p) AS last
  FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((p - wide + 1) / step::DOUBLE) AS BIGINT)), p // step + 1)) * step AS s FROM hit) GROUP BY ALL
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY held DESC, s) AS rank FROM win
)
SELECT d.doc_id, best.template, best.first AS first_word, best.last - best.first + best.k AS n_words, round(best.held / tn.n::DOUBLE, 6) AS containment
FROM best JOIN tn USING (template) JOIN d USING (r) WHERE rank = 1 AND best.held >= 0.8 * tn.n - 1e-9
"""
)
