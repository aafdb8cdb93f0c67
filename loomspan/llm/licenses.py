"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Words are runs of letters and digits, lower-cased; shingles are word trigrams. A template of s shingles belongs to the
class S, the power of two with S/2 < s <= S. Windows of class S hold 3 S/2 shingles and begin every S/2, so any passage
as long as the template lies whole in some window, and a passage that holds a share c of the template's shingles has a
Jaccard similarity with its window of at least c s / (3 S/2 + (1 - c) s) > c / (4 - c). With BANDS bands of one row that
window shares a band with probability 1 - (1 - J)**BANDS: 99.9 % for c = 0.8 (see collision_probability). A band's value
for a window is the least of its three blocks' values, so each shingle is hashed once a band whatever the overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, arrow_map, base_of, mix, shingle_hashes, slices, utf8, words

GRAM, BANDS, LEAST = 3, 24, 0.8
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

TEMPLATES = {
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
_MULT = mix(np.arange(101, 101 + BANDS, dtype=U64)) | U64(1)


def collision_probability(c: float, bands: int = BANDS) -> float:
    """Least probability that a passage with a share c of a template's shingles retrieves it."""
    return 1 - (1 - c / (4 - c)) ** bands


def shingles(texts: pa.Array):
    """(hash, owner, first word, word starts, word ends, text offsets) of all shingles of all texts, in order."""
    data, off = utf8(texts)
    h, start, end, before = words(data, off, _APART)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(before))
    sh = shingle_hashes(h, GRAM)
    inside = np.flatnonzero(owner[: len(sh)] == owner[GRAM - 1 :]) if len(sh) else np.zeros(0, np.int64)
    return sh[inside], owner[inside], inside, start, end, data, off


class Index:
    """Templates by class, band and band value."""

    def __init__(self, templates: dict[str, list[str]]):
        self.sets: list[tuple[str, np.ndarray]] = []
        self.classes: dict[int, dict[str, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for name, texts in templates.items():
            for t in texts:
                sh = np.unique(shingles(pa.array([t]))[0])
                if not len(sh):
                    raise ValueError(f"template of {name} has fewer than {GRAM} words")
                size = 1 << max(1, int(len(sh) - 1).bit_length())
                for b in range(BANDS):
                    found.setdefault(size, []).append((b, int((sh * _MULT[b]).min()), len(self.sets)))
                self.sets.append((name, sh))
        for size, rows in found.items():
            rows.sort()
            self.classes[size] = {"band": np.array([r[0] for r in rows]), "value": np.array([r[1] for r in rows], U64), "set": np.array([r[2] for r in rows])}


def find(texts: pa.Array, index: Index, least: float = LEAST) -> list[tuple[int, str, int, int, float]]:
    """(row, license, start, end, containment); code points of the text, end exclusive; overlapping finds of one license are one, and
    of different licenses the better one counts."""
    sh, owner, first, start, end, data, off = shingles(texts)
    out: dict[tuple[int, str], list[list]] = {}
    if not len(sh):
        return []
    n_docs = len(off) - 1
    bounds = np.searchsorted(owner, np.arange(n_docs + 1))
    seen = set()
    for size, c in index.classes.items():
        half = size // 2
        count = -(-np.diff(bounds) // half)
        doc_of = np.repeat(np.arange(n_docs), count)
        rank = np.arange(len(doc_of)) - np.repeat(np.cumsum(count) - count, count)
        block = bounds[doc_of] + rank * half
        same1 = np.append(doc_of[1:] == doc_of[:-1], False)
        same2 = np.append(doc_of[2:] == doc_of[:-2], [False] * min(2, len(doc_of)))[: len(doc_of)]
        top = U64(2**64 - 1)
        for b in range(BANDS):
            low = np.minimum.reduceat(sh * _MULT[b], block)
            one = np.where(same1, np.append(low[1:], top), top)
            two = np.where(same2, np.append(low[2:], [top] * min(2, len(low)))[: len(low)], top)
            win = np.minimum(np.minimum(low, one), two)
            of = c["band"] == b
            vals, sets = c["value"][of], c["set"][of]
            at = np.searchsorted(vals, win)
            hit = np.flatnonzero(vals[np.minimum(at, len(vals) - 1)] == win)
            for w in hit.tolist():
                k = int(at[w])
                while k < len(vals) and vals[k] == win[w]:
                    seen.add((int(doc_of[w]), int(block[w]), size, int(sets[k])))
                    k += 1
    for d, at, size, k in sorted(seen):
        name, want = index.sets[k]
        lo, hi = max(int(bounds[d]), at - size // 2), min(int(bounds[d + 1]), at + 2 * size)
        there = np.flatnonzero(np.isin(sh[lo:hi], want)) + lo
        if not len(there):
            continue
        # the stretch no longer than the template and a half that holds most of its shingles
        span, best = len(want) * 3 // 2 + 1, (0, 0, 0)
        for i in range(len(there)):
            j = int(np.searchsorted(there, there[i] + span))
            n = len(np.unique(sh[there[i:j]]))
            if n > best[0]:
                best = (n, int(there[i]), int(there[j - 1]))
        if best[0] < least * len(want):
            continue
        a, b = int(start[first[best[1]]]), int(end[first[best[2]] + GRAM - 1])
        points = lambda x, y: int(((data[x:y] & 0xC0) != 0x80).sum())
        s = points(int(off[d]), a)
        out.setdefault((d, name), []).append([s, s + points(a, b), best[0] / len(want)])
    result = []
    for (d, name), spans in out.items():
        spans.sort()
        merged = [spans[0]]
        for x in spans[1:]:
            if x[0] < merged[-1][1]:
                merged[-1] = [merged[-1][0], max(merged[-1][1], x[1]), max(merged[-1][2], x[2])]
            else:
                merged.append(x)
        result += [(d, name, *m) for m in merged]
    # of licenses that are found in one place, those that fit it less are out
    by: dict[int, list] = {}
    for r in result:
        by.setdefault(r[0], []).append(r)
    result = [r for rs in by.values() for r in rs if not any(o[4] > r[4] and o[2] < r[3] and r[2] < o[3] for o in rs)]
    return sorted(result, key=lambda x: (x[0], x[2], x[1]))


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, start, end, containment: a row for each find. Texts without a find, null and empty ones too, give
    no row; rows that repeat are scanned each."""
    index = Index(templates or TEMPLATES)

    def scan(batches):
        for batch in batches:
            for b in slices(batch):
                rows = find(b.column(1), index, least)
                if rows:
                    ids = b.column(0)
                    yield pa.record_batch([pa.array([ids[r[0]].as_py() for r in rows], pa.int64()), *(pa.array([r[k] for r in rows]) for k in range(1, 5))], ["doc_id", "license", "start", "end", "containment"])

    return arrow_map(base_of(docs, id_col, text_col), scan, "doc_id long, license string, start long, end long, containment double")


def op2_license_scan(spark, sf_dir):
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
