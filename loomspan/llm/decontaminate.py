"""Benchmark decontamination by the q-gram lemma.

A benchmark item is cut into passages of 80 bytes that overlap by half (a shorter item is one passage). A passage of m
bytes that occurs with at most e edits shares at least m - q + 1 - q e of its q-grams with the place, all of them on at
most e + 1 neighbouring diagonals. So: look up each q-gram of a text (8 bytes, one 64-bit number), count hits by passage
and cell of e + 1 diagonals, keep pairs of neighbouring cells (the overlapping bands) that reach the bound, and verify
those regions by banded alignment. No passage that meets the edit budget is missed. An excerpt of an item that holds none of its
passages isn't looked for: that can be so up to 118 bytes.

Items of fewer than 8 bytes hold no q-gram; they are searched for as whole words.

Texts are compared with A-Z lower-cased and runs of white space as one space.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _IS_WS, _LOWER, U64, arrow_map, base_of, mix, runs, slices, utf8

Q, PASSAGE, STRIDE, EDIT_SHARE = 8, 80, 40, 0.1
BLOCK_BYTES = 4 << 20
HITS, REGIONS = 1 << 20, 4096
_TABLE_BITS = 20


def squeeze(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, place in data of each byte) with white space squeezed and letters lowered."""
    ws = _IS_WS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(ws[1:] & ws[:-1])
    begins = off[:-1][off[:-1] < len(data)]
    keep[begins] = True
    at = np.flatnonzero(keep)
    return np.where(ws[at], np.uint8(32), _LOWER[data[at]]), np.searchsorted(at, off), at


def budget(m: int, q: int = Q, share: float = EDIT_SHARE) -> int:
    """Edits allowed: a share of the length, as far as the lemma still asks for a q-gram."""
    return max(0, min(int(m * share), (m - q) // q))


def grams(b: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(b) - q + 1
    out = np.zeros(max(0, n), U64)
    for i in range(q if n > 0 else 0):
        out |= b[i : i + n].astype(U64) << U64(8 * i)
    return out


class Passages:
    """Passages of the items and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.text, self.at = [], [], []
        self.short: list[tuple[int, re.Pattern]] = []
        for i, t in items:
            raw = np.frombuffer((t or "").encode(), np.uint8)
            b = squeeze(raw, np.array([0, len(raw)]))[0]
            b = np.frombuffer(b.tobytes().strip(), np.uint8)
            if len(b) < Q:  # no q-gram: whole words are compared
                if len(b):
                    self.short.append((i, re.compile(b"(?<![0-9a-z\x80-\xff])" + re.escape(b.tobytes()) + b"(?![0-9a-z\x80-\xff])")))
                continue
            starts = [0] if len(b) <= PASSAGE else [*range(0, len(b) - PASSAGE, STRIDE), len(b) - PASSAGE]
            for s in starts:
                self.item.append(i)
                self.at.append(s)
                self.text.append(b[s : s + PASSAGE])
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.array([budget(len(t)) for t in self.text], np.int64)
        self.bound = np.array([len(t) - Q + 1 - Q * e for t, e in zip(self.text, self.edits)], np.int64)
        g = [grams(t) for t in self.text]
        flat = np.concatenate(g) if g else np.zeros(0, U64)
        who = np.repeat(np.arange(len(g)), [len(x) for x in g]) if g else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        order = np.lexsort((pos, who, flat))
        flat, self.who, self.pos = flat[order], who[order], pos[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        self.gram, self.first = flat[first], np.append(first, len(flat))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(mix(self.gram) >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True


def align(p: np.ndarray, regions: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits between each column of p and a part of its region, with the end of that part, inside a band of width + 1
    diagonals.

    Regions are columns too, width bytes longer; bytes outside their text are 0, which squeezed text doesn't hold, so that letters of p
    aligned there cost an edit each, as if they were left out.
    """
    d = np.zeros((width + 1, regions.shape[1]), np.int8)
    for i, x in enumerate(p):
        new = d + (regions[i : i + width + 1] != x)
        np.minimum(new[:-1], d[1:] + np.int8(1), out=new[:-1])
        by = 1
        while by <= width:  # letters of the text left out: by doubling, which numpy does faster than a running minimum
            np.minimum(new[by:], new[:-by] + np.int8(by), out=new[by:])
            by *= 2
        d = new
    end = d.argmin(axis=0)
    return d[end, np.arange(d.shape[1])].astype(np.int64), len(p) + end


def tally(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    low = key.min()
    if key.max() - low < 4 * len(key):
        count = np.bincount(key - low)
        seen = np.flatnonzero(count)
        return seen + low, count[seen]
    return np.unique(key, return_counts=True)


def search(texts: pa.Array, P: Passages) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, passages found, fewest edits, first byte, last byte + 1) by row and item; bytes of the original text."""
    raw, raw_off = utf8(texts)
    if not len(raw):
        return []
    b, off, back = squeeze(raw, raw_off)
    found: dict[tuple[int, int], list] = {}
    for d in range(len(off) - 1 if P.short else 0):
        one = b[off[d] : off[d + 1]].tobytes()
        for i, pattern in P.short:
            if hits := [m.span() for m in pattern.finditer(one)]:
                found[d, i] = [{-1}, 0, int(back[off[d] + hits[0][0]] - raw_off[d]), int(back[off[d] + hits[-1][1] - 1] + 1 - raw_off[d])]
    long_items(b, off, back, raw_off, P, found)
    return [(d, i, len(f[0]), f[1], f[2], f[3]) for (d, i), f in sorted(found.items())]


def long_items(b: np.ndarray, off: np.ndarray, back: np.ndarray, raw_off: np.ndarray, P: Passages, found: dict) -> None:
    """Adds what the passages give to found: (row, item) -> [passages, fewest edits, first byte, last byte + 1]."""
    g = grams(b)
    if not len(g) or not len(P.gram):
        return
    near = np.flatnonzero(P.table[(mix(g) >> U64(64 - _TABLE_BITS)).astype(np.int64)])
    k = np.searchsorted(P.gram, g[near])
    ok = P.gram[np.minimum(k, len(P.gram) - 1)] == g[near]
    near, k = near[ok], k[ok]
    doc = np.searchsorted(off, near, side="right") - 1
    inside = near + Q <= off[doc + 1]
    near, k, doc = near[inside], k[inside], doc[inside]
    n = P.first[k + 1] - P.first[k]
    if not n.sum():
        return
    kinds = len(P.text)
    width = (len(b) + 2 * PASSAGE) // (int(P.edits.min()) + 1) + 2
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    total = np.cumsum(n)
    at = 0
    while at < len(n):  # a gram may be at many places of the passages: hits are counted HITS at a time
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HITS, side="right")))
        m = n[at:end]
        place = np.repeat(P.first[k[at:end]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        who, diag = P.who[place], np.repeat(near[at:end], m) - P.pos[place] + PASSAGE
        parts.append(tally((np.repeat(doc[at:end], m) * width + diag // (P.edits[who] + 1)) * kinds + who))
        if len(parts) > 16 or end >= len(n):
            key, count = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            key, count = key[order], count[order]
            head = runs(key)
            parts = [(key[head], np.add.reduceat(count, head))]
        at = end
    key, count = parts[0]
    after = np.minimum(np.searchsorted(key, key + kinds), len(key) - 1)
    both = count + np.where(key[after] == key + kinds, count[after], 0)
    full = key[both >= np.maximum(P.bound[key % kinds], 1)]
    who, cell = full % kinds, full // kinds
    sizes = P.size[who]
    for m in np.unique(sizes).tolist():
        same = np.flatnonzero(sizes == m)
        e = budget(m)
        band = 2 * (e + 1) + 2 * e
        for some in (same[i : i + REGIONS] for i in range(0, len(same), REGIONS)):
            d = cell[some] // width
            lo = cell[some] % width * (e + 1) - PASSAGE - e
            at = lo[None, :] + np.arange(m + band)[:, None]
            inside = (at >= off[d]) & (at < off[d + 1])
            edits, end = align(np.stack([P.text[p] for p in who[some].tolist()], axis=1), np.where(inside, b[np.clip(at, 0, len(b) - 1)], np.uint8(0)), band)
            for j in np.flatnonzero(edits <= e).tolist():
                p = int(who[some[j]])
                last = int(min(lo[j] + end[j], off[d[j] + 1]))
                first = int(max(last - m - e, off[d[j]]))
                f = found.setdefault((int(d[j]), P.item[p]), [set(), 10**9, 10**18, -1])
                f[0].add(p)
                f[1] = min(f[1], int(edits[j]))
                f[2] = min(f[2], int(back[first] - raw_off[d[j]]))
                f[3] = max(f[3], int(back[last - 1] + 1 - raw_off[d[j]]))



def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_passages, edits, start, end: a row for each document and item whose passage it holds.

    start and end are bytes of the text. Benchmark items are the query set: they go to the tasks in blocks of at most
    4 MB of text, a scan of the documents for each block. Null or empty texts and items match nothing; an item of
    fewer than 8 bytes is found where it stands as a whole word or words. Rows that repeat are searched each; items that repeat an id are joined under it.
    """
    items = bench.select(bench[item_col].cast("long").alias("i"), bench[item_text].cast("string").alias("t")).filter("t is not null").orderBy("i", "t")
    src = base_of(docs, id_col, text_col)
    blocks, held = [[]], 0
    for r in items.toLocalIterator():
        if held + len(r.t) > BLOCK_BYTES and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append((r.i, r.t))
        held += len(r.t)

    def searcher(block):
        def scan(batches):
            P = Passages(block)
            for batch in batches:
                for b in slices(batch):
                    rows = search(b.column(1), P)
                    if rows:
                        ids = b.column(0)
                        yield pa.record_batch([pa.array([ids[r[0]].as_py() for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6))], ["doc_id", "item_id", "n_passages", "edits", "start", "end"])

        return scan

    out = None
    for block in blocks:
        part = arrow_map(src, searcher(block), "doc_id long, item_id long, n_passages long, edits long, start long, end long")
        out = part if out is None else out.unionByName(part)
    if len(blocks) > 1:  # an id may be in two blocks
        out = out.groupBy("doc_id", "item_id").agg(F.sum("n_passages").alias("n_passages"), F.min("edits").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end"))
    return out


def op7_decontaminate(spark, sf_dir):
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
