"""License scans: MinHash bands over text windows, then exact containment.

Texts and templates are words (runs of letters and digits, ASCII lower
case) and their 5-word shingles; a text of fewer words is one shingle. A
template of m shingles is looked for in windows of 3 * s shingles, one
starting every s, s = ceil((m - 1) / 2): any m shingles in a row lie in one
window as a whole. If the row holds the share ``CONTAINS`` of the template,
its window's Jaccard with the template is at least about 0.47, so of
``BANDS`` bands of one MinHash value each one agrees but with odds of 1e-17,
and with a quarter of that Jaccard (a part of the template between others)
still with odds of 0.9996; single shingles (m = 1) are their own windows and
always agree. Bands can be that short as texts that share no shingle with a
template never agree with it. Around a window with
an agreeing band, the template's shingles are counted over all that follow
each other within 2 * m + ``GAP`` places, so passages that stand between parts
of a notice (headers, copyright lines, names) don't hide it: a match holds at
least ``CONTAINS`` of the template's distinct shingles. Of matches that overlap, those of lesser containment than
another go: notices of one family share most of their words.

Windows start anew in every document, so results don't depend on how rows
are batched. Scale: one vectorised pass without a shuffle; the templates'
signatures travel with the task, and their number is a parameter's size.

Defined results: null and empty texts match nothing; repeated rows are
scanned each, and a null doc_id is kept; several matches of a template in a
document give one row, the fullest and then the first; extra columns are
ignored. Without templates or rows there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as K
from .common import released, small_batches, table

WORDS, BANDS, CONTAINS, GAP = 5, 64, 0.8, 150

#: Notices of public licenses, by SPDX identifier and part.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT/line": "Released under the MIT License.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause/clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0/notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1/notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "EPL-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Zlib/notice": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0/line": "Distributed under the Boost Software License, Version 1.0.",
    "MIT/disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "BSD/disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
}

_TERM = np.zeros(256, bool)
_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True

_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(0, 1 << 32, BANDS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS, dtype=np.uint32)


def shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, where each document's begin) of a slice, in text order."""
    data = K.LOWER[data]
    starts, ends = K.spans(_TERM[data], offs)
    h = K.span_hashes(data, starts, ends)
    at = np.searchsorted(starts, offs)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    win = K.windows(h, WORDS)
    inside = doc[: len(win)] == doc[WORDS - 1 :] if len(win) else np.zeros(0, bool)
    counts = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    out = np.empty(counts.sum(), K.U)
    to = np.concatenate([[0], np.cumsum(counts)])
    long = np.repeat(n >= WORDS, counts)
    out[long] = win[inside]
    for d in np.flatnonzero((n > 0) & (n < WORDS)).tolist():
        out[to[d]] = K.windows(h[at[d] : at[d + 1]], int(n[d]))[0]
    return out, to


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.sets: dict[str, np.ndarray] = {}
        self.steps: dict[int, list[tuple[str, np.ndarray]]] = {}
        self.step_of: dict[str, int] = {}
        for name, text in sorted(texts.items()):
            data = np.frombuffer(text.encode(), np.uint8)
            got, _ = shingles(data, np.array([0, len(data)]))
            if not len(got):
                continue
            self.sets[name] = np.unique(got)
            x = (got >> K.U(32)).astype(np.uint32)
            self.step_of[name] = -(-(len(got) - 1) // 2)
            self.steps.setdefault(self.step_of[name], []).append((name, (_A[:, None] * x + _B[:, None]).min(axis=1)))


class Windows:
    """The windows of every document of a slice for templates of one step."""

    def __init__(self, to: np.ndarray, step: int):
        width, step = max(1, 3 * step), max(1, step)
        sizes = np.diff(to)
        full = np.flatnonzero(sizes >= width)
        count = -(-(sizes[full] - width) // step) + 1
        doc = np.repeat(full, count)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        # The last window of a document ends with it.
        first = np.minimum(to[doc] + number * step, to[doc + 1] - width)
        short = np.flatnonzero((sizes > 0) & (sizes < width))
        self.width, self.n_full, self.power = width, len(first), width.bit_length() - 1
        self.first, self.doc = np.concatenate([first, to[short]]), np.concatenate([doc, short])
        self.after = np.concatenate([first + width, to[short + 1]])
        self.short = np.column_stack([to[short], to[short + 1]]).ravel()
        self.second = first + width - (1 << self.power)

    def low(self, levels: list[np.ndarray]) -> np.ndarray:
        """Smallest value of each window; levels[j] has those of the 2**j values from each place."""
        out = np.empty(len(self.first), np.uint32)
        if self.n_full:
            level = levels[self.power]
            np.minimum(level[self.first[: self.n_full]], level[self.second], out=out[: self.n_full])
        if len(self.short):
            out[self.n_full :] = np.minimum.reduceat(np.append(levels[0], np.uint32(0xFFFFFFFF)), self.short)[::2]
        return out


def agreeing(x: np.ndarray, windows: dict[int, Windows], templates: Templates) -> dict[str, np.ndarray]:
    """Per template, which windows of its step agree with it in a band."""
    hit = {name: np.zeros(len(windows[step].first), bool) for step, members in templates.steps.items() for name, _ in members}
    most = max(w.power for w in windows.values())
    for k in range(BANDS):
        levels = [_A[k] * x + _B[k]]
        for j in range(most):
            last = levels[-1]
            if len(last) <= 1 << j:
                break
            levels.append(np.minimum(last[: -(1 << j)], last[1 << j :]))
        for step, members in templates.steps.items():
            low = windows[step].low(levels)
            for name, sig in members:
                hit[name] |= low == sig[k]
    return hit


def scan_slice(data: np.ndarray, offs: np.ndarray, templates: Templates) -> list[tuple[int, str, int, int, int]]:
    """(document, template, shingles held, first word, word after the last) of the matches."""
    hashes, to = shingles(data, offs)
    if not len(hashes) or not templates.steps:
        return []
    windows = {step: Windows(to, step) for step in templates.steps}
    best: dict[int, dict[str, tuple[int, int, int]]] = {}
    for name, hit in agreeing((hashes >> K.U(32)).astype(np.uint32), windows, templates).items():
        wanted, w = templates.sets[name], windows[templates.step_of[name]]
        hits = np.flatnonzero(hit)
        for d in np.unique(w.doc[hits]).tolist():
            mine = hits[w.doc[hits] == d]
            own = hashes[to[d] : to[d + 1]]
            where = np.flatnonzero(held_in(own, wanted))
            if len(where) < CONTAINS * len(wanted) - 1e-9:
                continue
            # Runs of the template's shingles, as far as they follow each other; those that a window hit.
            ends = np.append(np.flatnonzero(np.diff(where) > 2 * len(wanted) + GAP) + 1, len(where))
            for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
                run = where[lo:hi]
                if not ((w.first[mine] - to[d] <= run[-1]) & (w.after[mine] - to[d] > run[0])).any():
                    continue
                held = len(np.unique(own[run]))
                if held >= CONTAINS * len(wanted) - 1e-9:
                    new = (held, -int(run[0]), int(run[-1]) + WORDS)
                    old = best.setdefault(d, {}).get(name)
                    if old is None or new[:2] > old[:2]:
                        best[d][name] = new
    out = []
    for d, found in best.items():
        share = {name: held / len(templates.sets[name]) for name, (held, *_) in found.items()}
        for name, (held, at, end) in found.items():
            if not any(share[other] > share[name] and -x[1] < end and -at < x[2] for other, x in found.items()):
                out.append((d, name, held, -at, end))
    return out


def held_in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, template, n_shingles, n_held, containment, first_word, after_word) of the matches."""
    small_batches(docs.sparkSession)
    known = Templates(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[lo + d], name, len(known.sets[name]), held, held / len(known.sets[name]), at, end) for lo, data, offs in K.slices(batch.column(1), 1 << 19) for d, name, held, at, end in scan_slice(data, offs, known)]
            kinds = [("doc_id", pa.int64()), ("template", pa.string()), ("n_shingles", pa.int64()), ("n_held", pa.int64()), ("containment", pa.float64()), ("first_word", pa.int64()), ("after_word", pa.int64())]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, template string, n_shingles long, n_held long, containment double, first_word long, after_word long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
