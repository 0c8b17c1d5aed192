"""License scan: MinHash bands over overlapping windows, then exact containment.

Texts and templates are word shingles of five (a shorter template is one). For a
template of T shingles the text's windows are T + T // 4 shingles long and start
every T // 8. A window that holds NEED / OF of the template has a similarity of
at least 0.75 / (1.25 + 0.25) = 0.5 with it, less what falls between two starts
(0.44 at worst). BANDS bands of one row each then miss it with probability under
(1 - 0.44)^24 < 1e-6. Minima of all windows come from one table of minima over
powers of two. A window that shares a band with a template is verified: the
distinct shingles that each window in its reach shares with the template are
counted, all windows in one sweep, and their share is its containment. Of windows
of a template that overlap and reach NEED / OF the best stays (the first of
equals), so every occurrence is a match of its own.

The templates are a table (license_id, text) of bounded size that tasks carry; by
default notices and the full texts in license_texts. Before the bands, a template
is left out of a text that doesn't have NEED / OF of its shingles anywhere, which
loses nothing. Of matches of different licenses that share half of the smaller
one's places, the one with the highest containment stays, and of equal ones the
longest, then the one listed first.

Defined results: null or wordless text has no licenses. A text shorter than the
window is one window; a text of any length is scanned whole. Every row is judged
by itself, so null or repeated doc_ids do no harm. Templates without a word or an
id are left out. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches, shingles, store
from .token_files import _blocks

NEED, OF = 75, 100
BANDS = 24
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Notices and grants of common licenses, by identifier.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

_random = np.random.RandomState(77)
FACTORS = (_random.randint(0, 2**31, BANDS).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
SHIFTS = _random.randint(0, 2**31, BANDS).astype(np.uint32)[:, None]


def words_of(text: str | None) -> list[bytes]:
    return [w for w in GAP.split(text.encode("utf-8", "surrogatepass").lower()) if w] if text else []


def _rows(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(17)).astype(np.uint32)[None, :] * FACTORS + SHIFTS


class Template:
    def __init__(self, license_id: str, text: str):
        self.license_id = license_id
        self.runs = np.unique(shingles.runs(shingles.word_hashes(words_of(text))))
        self.words = len(words_of(text))
        n = len(self.runs)
        self.window, self.stride = n + n // 4, max(1, n // 8)
        self.minima = _rows(self.runs).min(axis=1)

    def occurrences(self, runs: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """Windows near one of the starts that hold NEED / OF of the template: first shingle, distinct shingles, their places.

        The best window of a stretch of text is an occurrence, up to the last shingle that it needs; then the stretches on both sides of it are searched.
        """
        at = np.searchsorted(self.runs, runs)
        at[at == len(self.runs)] = 0
        hit = np.flatnonzero(self.runs[at] == runs)
        out = []
        open_ = [x for x in np.split(hit, np.flatnonzero(np.diff(hit) >= self.window) + 1)]
        while open_:
            places = open_.pop()
            if OF * len(places) < NEED * len(self.runs):
                continue
            lows, shared = self._shared(places, at[places], starts)
            if not len(lows) or OF * shared.max() < NEED * len(self.runs):
                continue
            low = lows[shared.argmax()]
            inside = places[np.searchsorted(places, low) : np.searchsorted(places, low + self.window)]
            _, new = np.unique(at[inside], return_index=True)
            inside = inside[: new.max() + 1]
            out.append((int(low), len(new), inside))
            open_ += [places[places < low], places[places > inside[-1]]]
        return sorted(out, key=lambda x: x[0])

    def _shared(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows that begin at one of the places, near a start, and the distinct values in each, in one sweep."""
        reach = self.window + self.stride
        lows = places[np.searchsorted(starts, places + reach, side="right") > np.searchsorted(starts, places - reach)]
        first, last = np.searchsorted(places, lows), np.searchsorted(places, lows + self.window)
        # a place counts in the windows that hold it, but not the place before it with the same value
        k, by = np.arange(len(places)), np.argsort(values, kind="stable")
        before = np.full(len(places), -1)
        same = np.flatnonzero(values[by][1:] == values[by][:-1])
        before[by[same + 1]] = by[same]
        low = np.maximum(np.searchsorted(first, before + 1), np.searchsorted(last, k, side="right"))
        high = np.searchsorted(first, k, side="right")
        change = np.zeros(len(lows) + 1, np.int64)
        counted = low < high
        np.add.at(change, low[counted], 1)
        np.add.at(change, high[counted], -1)
        return lows, np.cumsum(change[:-1])


class Known(list):
    """Templates with the shingles of all of them, by shingle size."""

    def __init__(self, known: list[Template]):
        super().__init__(known)
        sizes = {min(shingles.SIZE, t.words) for t in known}
        self.all_runs = {s: np.unique(np.concatenate([t.runs for t in known if min(shingles.SIZE, t.words) == s])) for s in sizes}
        self.places = [np.searchsorted(self.all_runs[min(shingles.SIZE, t.words)], t.runs) for t in known]

    def present(self, size: int, runs: np.ndarray) -> np.ndarray | None:
        """Which of the shingles of that size the text has anywhere; None if it has none."""
        union = self.all_runs[size]
        at = np.searchsorted(union, runs)
        at[at == len(union)] = 0
        hit = union[at] == runs
        if not hit.any():
            return None
        flags = np.zeros(len(union), bool)
        flags[at[hit]] = True
        return flags


MOST_TEMPLATES, MOST_BYTES = 5_000, 16 << 20


def builtin() -> list[tuple[str, str]]:
    """Identifier and text of the notices and full texts that are known by default."""
    full = [(f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")]
    return [*((n, x) for n, texts in TEMPLATES.items() for x in texts), *full]


def collected(table: DataFrame) -> list[tuple[str, str]]:
    """The rows of a template table (license_id, text), within MOST_TEMPLATES and MOST_BYTES."""
    rows = table.select(F.col("license_id").cast("string"), F.col("text").cast("string")).dropna()
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if n > MOST_TEMPLATES or (size or 0) > MOST_BYTES:
        raise ValueError(f"tasks carry at most {MOST_TEMPLATES} templates and {MOST_BYTES} bytes of them")
    return sorted(map(tuple, rows.collect()))


def templates(texts: list[tuple[str, str]] | None = None) -> Known:
    return Known([Template(name, text) for name, text in (builtin() if texts is None else texts) if words_of(text)])


Match = tuple[str, int, float]


def strongest(found: list[tuple[str, int, float, np.ndarray]]) -> list[Match]:
    """The matches that no stronger match of another license takes the places of, in the given order."""
    kept: list[int] = []
    for i in sorted(range(len(found)), key=lambda i: (-found[i][2], -len(found[i][3]), i)):
        name, _, _, places = found[i]
        beside = [found[k][3] for k in kept if found[k][0] != name and found[k][3][0] <= places[-1] and places[0] <= found[k][3][-1]]
        if all(2 * len(np.intersect1d(x, places)) < min(len(x), len(places)) for x in beside):
            kept.append(i)
    return [found[i][:3] for i in sorted(kept)]


def window_minima(levels: list[np.ndarray], n: int, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and minima of the windows of n shingles: a start every `stride`, and the last one."""
    size = min(window, n)
    starts = np.arange(0, n - size + 1, stride)
    if starts[-1] != n - size:
        starts = np.append(starts, n - size)
    k = size.bit_length() - 1
    return starts, np.minimum(levels[k][:, starts], levels[k][:, starts + size - (1 << k)])


def matches(text: str | None, known: Known) -> tuple[int, list[Match]]:
    """The number of words, and (license, first word, containment) of every match."""
    words = words_of(text)
    if not words:
        return 0, []
    hashes = shingles.word_hashes(words)
    by_size: dict[int, tuple[np.ndarray, np.ndarray | None]] = {}
    near: list[tuple[Template, int]] = []
    for template, places in zip(known, known.places):
        size = min(shingles.SIZE, template.words)
        if len(words) < size:
            continue
        if size not in by_size:
            runs = shingles.runs(hashes, size)
            by_size[size] = runs, known.present(size, runs)
        present = by_size[size][1]
        if present is not None and OF * int(present[places].sum()) >= NEED * len(places):
            near.append((template, size))
    levels: dict[int, list[np.ndarray]] = {}
    found = []
    for template, size in near:
        runs = by_size[size][0]
        if size not in levels:
            longest = max(min(t.window, len(runs)) for t, s in near if s == size)
            levels[size] = [_rows(runs)]
            for k in range(longest.bit_length() - 1):
                last = levels[size][-1]
                levels[size].append(np.minimum(last[:, : -(1 << k)], last[:, 1 << k :]))
        starts, least = window_minima(levels[size], len(runs), template.window, template.stride)
        shared = (least == template.minima[:, None]).any(axis=0)
        if not shared.any():
            continue
        found += [(template.license_id, low, n / len(template.runs), places) for low, n, places in template.occurrences(runs, starts[shared])]
    return len(words), strongest(found)


FOUND = "doc_id long, n_words long, matches array<struct<license:string,first_word:long,containment:double>>"


def _scan(texts: list[tuple[str, str]]):
    kind = pa.list_(pa.struct([("license", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))

    @caches.worker("words")
    def run(batches):
        known = templates(texts)
        for whole in batches:
            for batch in _blocks(whole):
                rows = [matches(t, known) for t in batch.column("text").to_pylist()] if known else [(len(words_of(t)), []) for t in batch.column("text").to_pylist()]
                spans = [[{"license": a, "first_word": int(b), "containment": float(c)} for a, b, c in f] for _, f in rows]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array(spans, kind)], names=["doc_id", "n_words", "matches"])

    return run


def scan(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words and matches (license, first_word, containment) of each row, by the templates of a table or those known by default."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store.written(rows.mapInArrow(_scan(builtin() if table is None else collected(table)), FOUND), "licenses")


def digest(docs: DataFrame) -> DataFrame:
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"])))
    return scan(docs).select("doc_id", "n_words", F.size(ids).cast("long").alias("n_licenses"), F.array_join(ids, ",").alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"))
