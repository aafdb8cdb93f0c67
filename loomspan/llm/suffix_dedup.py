"""Removal of repeated 100-byte strings, exact over the whole corpus.

Whether a 100-byte string also starts earlier is a question about all 100-byte strings of the corpus; a suffix array
of it all would take many times the input in disk. Only strings near differences need sorting, so:

1. Each string of 100 bytes is given to one anchor, the least hashed 20-gram in it (the last one, if several are equal).
   That depends on the string alone. Neighbouring strings share anchors, some 41 of them on average; a run of strings
   with one anchor is a context, known by anchor hash and a hash of its bytes, 128 bits together.
2. Contexts that repeat are decided there and then: all but the first in (document, place) are covered. Each task does
   so for its own before it sends anything, so a passage that a third of all documents hold costs a row a task.
3. An anchor with several different contexts (around edits and the ends of passages) needs byte by byte comparison. Two of
   them share a string of 100 bytes only if they agree in the 40 bytes before the anchor or in the 40 after it, as 80 of the
   string's bytes lie around it; hashes of both sides tell which contexts may share one. In a large corpus nearly every
   20-gram repeats somewhere, but few of 60 bytes do. The first of each such context goes, with its bytes, to a shard,
   where all suffixes are sorted by induced sorting (induced.py), in memory at this size of shard, and neighbours that
   agree in 100 bytes are the repeats.
4. Anchors with very many different contexts, told by a bitmap of fixed size, give way to anchors of 60 bytes in step 1: a
   context is cut in two, strings with at least 40 bytes before the old anchor, and the others. Where such an anchor has
   very many contexts too, the part is cut into single strings, which step 2 settles; so no shard gets an unbounded group.

Rows that share an id count as one document: they must be copies of each other. Spans found for an id are applied to
each of its rows, within its length. Null and empty texts and those under 100 bytes lose nothing. A null id is an id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, U64, arrow_map, base_of, bitmap, filter_by, in_bitmap, materialise, mix, powers, scratch, slices, utf8, where
from .induced import repeats

WIDTH, GRAM = 100, 20
SLICE = 256 << 10
FLUSH = 250_000
SHARD_BYTES = 1 << 19
NULL_ID = -(2**63)
_P, _R = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _pow(base: int, n: int, inverse: bool = False) -> np.ndarray:
    key = (base, inverse)
    if key not in _POWERS or len(_POWERS[key]) < n:
        _POWERS[key] = powers(pow(base, -1, 2**64) if inverse else base, max(n, SLICE * 2))
    return _POWERS[key][:n]


def _prefix(data: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _pow(base, len(data)), dtype=U64, out=out[1:])
    return out


def _hash(total: np.ndarray, base: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (total[b] - total[a]) * _pow(base, len(total), True)[a]


def contexts(data: np.ndarray, off: np.ndarray, hot: bytes | None, width: int = WIDTH, gram: int = GRAM):
    """(anchor hash, context hash, row, start in text, length, hash of the anchor with half of the other bytes before it, the
    same with those after it) of all contexts of these texts. The last two are 0 where the context ends before; where hot
    anchors were cut, they are alike for all."""
    n = np.diff(off)
    rows = np.flatnonzero(n >= width)
    empty = np.zeros(0, np.int64)
    if not len(rows):
        return empty.view(U64), empty.view(U64), empty, empty, empty, empty.view(U64), empty.view(U64)
    per = n[rows] - width + 1
    row = np.repeat(rows, per)
    pos = np.repeat(off[rows], per) + np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    first, second = _prefix(data, _P), _prefix(data, _R)
    at = np.arange(len(data) - gram + 1)
    h = mix(_hash(first, _P, at, at + gram))
    if len(h) >= 1 << 28:
        raise ValueError("texts of more than 256 MB aren't supported")
    key = (h >> U64(28) << U64(28)) | (U64((1 << 28) - 1) - at.astype(U64))
    w = width - gram + 1
    blocks = -(-len(key) // w) + 1
    padded = np.full(blocks * w, U64(2**64 - 1))
    padded[: len(key)] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[pos], ahead[pos + w - 1])
    begin = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])]))
    end = np.append(begin[1:], len(low)) - 1
    lo, hi, row = pos[begin], pos[end] + width, row[begin]
    anchor = (U64((1 << 28) - 1) - (low[begin] & U64((1 << 28) - 1))).astype(np.int64)
    a = h[anchor]
    half = (width - gram) // 2

    def context(lo, hi, anchor):
        return mix(_hash(second, _R, lo, hi) ^ mix(((anchor - lo) << 32 | (hi - lo)).astype(U64)))

    def side(inside, begin, salt):
        begin = np.where(inside, begin, 0)
        return np.where(inside, mix(_hash(first, _P, begin, begin + np.where(inside, gram + half, 0)) ^ U64(salt)) | U64(1 << 32), U64(0))

    before = side(anchor - lo >= half, anchor - half, 2)
    after = side(hi - anchor >= gram + half, anchor, 3)
    if hot is None or not (many := in_bitmap(hot, a.view(np.int64))).any():
        return a, context(lo, hi, anchor), row, lo - off[row], hi - lo, before, after
    k, rest = np.flatnonzero(many), ~many
    # strings with at least half before the anchor, and the others
    left, right = k[before[k] > 0], k[hi[k] - width >= anchor[k] - half + 1]
    new_a = np.concatenate([before[left], after[right]])
    new_lo = np.concatenate([lo[left], np.maximum(lo[right], anchor[right] - half + 1)])
    new_hi = np.concatenate([np.minimum(anchor[left] - half + width, hi[left]), hi[right]])
    new_row, new_anchor = row[np.concatenate([left, right])], anchor[np.concatenate([left, right])]
    again = in_bitmap(hot, new_a.view(np.int64))
    k = np.flatnonzero(again)
    count = new_hi[k] - new_lo[k] - width + 1
    s = np.repeat(new_lo[k], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    x, y = mix(_hash(first, _P, s, s + width) + U64(1)), mix(_hash(second, _R, s, s + width))
    k = np.flatnonzero(~again)
    a = np.concatenate([a[rest], new_a[k], x])
    c = np.concatenate([context(lo[rest], hi[rest], anchor[rest]), context(new_lo[k], new_hi[k], new_anchor[k]), y])
    lo = np.concatenate([lo[rest], new_lo[k], s])
    hi = np.concatenate([hi[rest], new_hi[k], s + width])
    row = np.concatenate([row[rest], new_row[k], np.repeat(new_row[again], count)])
    alike = np.ones(len(k) + len(s), U64) << U64(32)
    return a, c, row, lo - off[row], hi - lo, np.concatenate([before[rest], alike]), np.concatenate([after[rest], alike])


#: sides: 32 bits each of the hashes with the bytes before and after the anchor.
ROW = "kind byte, a long, c long, doc long, lo int, len int, sides long"
COLS = ["kind", "a", "c", "doc", "lo", "len", "sides"]


def _batch(kind: int, a, c, doc, lo, size, sides) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(doc), kind, np.int8)), *(pa.array(np.asarray(x).view(np.int64)) for x in (a, c, doc)), pa.array(lo.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(sides)], COLS)


def _may_share(anchor: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which of these different contexts agree with another one of their anchor (numbered) on a side."""
    out = np.zeros(len(anchor), bool)
    for shift in (32, 0):
        s = sides.view(U64) >> U64(shift) & U64(0xFFFFFFFF)
        k = np.flatnonzero(s)
        order = k[np.lexsort((s[k], anchor[k]))]
        same = (anchor[order[1:]] == anchor[order[:-1]]) & (s[order[1:]] == s[order[:-1]])
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def _leaders(a, c, doc, lo):
    """For rows sorted by (a, c, doc, lo): which begin a group, and which are covered by the one that does."""
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return new, (doc != doc[head]) | (lo != lo[head])


def repeated_spans(docs: DataFrame, width: int = WIDTH, hot_contexts: int = 2000, local_contexts: int = 3) -> DataFrame:
    """(doc, lo, len) of byte spans that are covered, many overlapping; docs: doc_id, text."""
    spark = docs.sparkSession

    def collected(batches, hot):
        held, size = [], 0
        for batch in batches:
            for b in slices(batch, limit=SLICE):
                ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                a, c, row, lo, n, before, after = contexts(*utf8(b.column(1)), hot, width)
                held.append((a, c, ids[row], lo, n, before, after))
                size += len(a)
                if size >= FLUSH:
                    yield [np.concatenate(x) for x in zip(*held)]
                    held, size = [], 0
        if size:
            yield [np.concatenate(x) for x in zip(*held)]

    def crowded(batches):
        for a, c, _, _, _, before, after in collected(batches, None):
            order = np.lexsort((c, a))
            new = np.concatenate([[True], (a[order[1:]] != a[order[:-1]]) | (c[order[1:]] != c[order[:-1]])])
            k = order[new]
            _, number, n = np.unique(a[k], return_inverse=True, return_counts=True)
            k = k[n[number] >= local_contexts]
            v = np.concatenate([a[k], before[k], after[k]])  # what takes the place of an anchor can be crowded itself
            v, n = np.unique(v[v > 0], return_counts=True)
            many = n >= local_contexts
            yield pa.record_batch([pa.array(v[many].view(np.int64)), pa.array(n[many])], ["a", "n"])

    hot = bitmap(arrow_map(docs, crowded, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot_contexts), "a")

    def send(batches):
        for a, c, doc, lo, n, before, after in collected(batches, hot):
            sides = (before >> U64(32) << U64(32) | after >> U64(32)).view(np.int64)
            order = np.lexsort((lo, doc, c, a))
            a, c, doc, lo, n, sides = (x[order] for x in (a, c, doc, lo, n, sides))
            new, covered = _leaders(a, c, doc, lo)
            yield _batch(0, a[new], c[new], doc[new], lo[new], n[new], sides[new])
            if covered.any():
                yield _batch(1, a[covered], c[covered], doc[covered], lo[covered], n[covered], np.zeros(int(covered.sum()), np.int64))

    def settle(batches):
        """kind 1: covered; kind 2: one of several contexts of an anchor, of which another may share a string."""

        def decide(m):
            new, covered = _leaders(m[:, 0], m[:, 1], m[:, 2], m[:, 3])
            heads = np.flatnonzero(new)
            anchor = np.cumsum(np.concatenate([[0], (m[heads[1:], 0] != m[heads[:-1], 0]).astype(np.int64)])) if len(heads) else np.zeros(0, np.int64)
            many = np.flatnonzero(np.bincount(anchor)[anchor] > 1) if len(heads) else heads
            several = heads[many]
            several = several[_may_share(anchor[many], m[several, 5].copy())]
            for kind, k in ((1, np.flatnonzero(covered)), (2, several)):
                if len(k):
                    yield _batch(kind, *(m[k, i].copy() for i in range(6)))

        held = np.zeros((0, 6), np.int64)
        for b in batches:
            kind = b.column(0).to_numpy()
            if (kind == 1).any():
                yield b.filter(pa.array(kind == 1))
            m = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 7)])[kind == 0]
            m = np.concatenate([held, m])
            if not len(m):
                continue
            cut = np.flatnonzero(m[:, 0] != m[-1, 0])
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield from decide(m[:cut])
            held = m[cut:].copy()
        if len(held):
            yield from decide(held)

    sent = arrow_map(docs, send, ROW)
    to = F.when(F.col("kind") == 1, F.col("doc")).otherwise(F.col("a"))
    settled = materialise(arrow_map(sent.repartition(to).sortWithinPartitions("kind", "a", "c", "doc", "lo"), settle, ROW))
    spans = settled.filter("kind = 1").select("doc", "lo", "len")
    open_rows = settled.filter("kind = 2").select("a", "doc", "lo", "len")

    near = filter_by(docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text"), "doc_id", bitmap(open_rows, "doc"))
    wanted = open_rows.groupBy("doc").agg(F.collect_list(F.struct("a", "lo", "len")).alias("want"))

    def cut_out(batches):
        for batch in batches:
            for b in slices(batch):
                data, off = utf8(b.column(1))
                raw = data.tobytes()
                A, D, L, T = [], [], [], []
                for i, (d, want) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                    for x in want:
                        s = int(off[i]) + x["lo"]
                        if s + x["len"] <= off[i + 1]:
                            A.append(x["a"])
                            D.append(d)
                            L.append(x["lo"])
                            T.append(raw[s : s + x["len"]])
                yield pa.record_batch([pa.array(A, pa.int64()), pa.array(D, pa.int64()), pa.array(L, pa.int32()), pa.array(T, pa.binary())], ["a", "doc", "lo", "bytes"])

    pieces = arrow_map(near.join(wanted, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "want"), cut_out, "a long, doc long, lo int, bytes binary")
    folder = scratch(spark) + "/queues"

    def sort_shards(batches):
        def solve(parts):
            doc, lo, texts = (np.concatenate([p[k] for p in parts]) if k < 2 else [x for p in parts for x in p[2]] for k in range(3))
            if len(texts) < 2:
                return None
            size = np.array([len(x) for x in texts])
            begin = np.cumsum(size + 1) - size - 1
            t = np.zeros(int((size + 1).sum()), np.int64)
            inside = np.ones(len(t), bool)
            inside[begin + size] = False
            t[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
            valid = np.zeros(len(t), bool)
            who = np.repeat(np.arange(len(texts)), size - width + 1)
            at = np.repeat(begin, size - width + 1) + np.arange(len(who)) - np.repeat(np.cumsum(size - width + 1) - (size - width + 1), size - width + 1)
            valid[at] = True
            group = repeats(t, valid, width, folder)[at]
            k = np.flatnonzero(group >= 0)
            if not len(k):
                return None
            g, d, s = group[k], doc[who[k]], lo[who[k]] + at[k] - begin[who[k]]
            order = np.lexsort((s, d, g))
            g, d, s = g[order], d[order], s[order]
            new = np.concatenate([[True], g[1:] != g[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
            covered = (d != d[head]) | (s != s[head])
            d, s = d[covered], s[covered]
            if not len(d):
                return None
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)]))
            last = np.append(first[1:], len(s)) - 1
            return pa.record_batch([pa.array(d[first]), pa.array(s[first].astype(np.int32)), pa.array((s[last] + width - s[first]).astype(np.int32))], ["doc", "lo", "len"])

        held, size, last = [], 0, None
        for b in batches:
            a = b.column(0).to_numpy(zero_copy_only=False)
            if not len(a):
                continue
            cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(a)]):
                if size >= SHARD_BYTES and a[x] != last:
                    if (r := solve(held)) is not None:
                        yield r
                    held, size = [], 0
                texts = b.column(3).slice(x, y - x).to_pylist()
                held.append((b.column(1).slice(x, y - x).to_numpy(zero_copy_only=False), b.column(2).slice(x, y - x).to_numpy(zero_copy_only=False).astype(np.int64), texts))
                size += sum(map(len, texts))
                last = a[x]
        if held and (r := solve(held)) is not None:
            yield r

    found = arrow_map(pieces.repartition("a").sortWithinPartitions("a", "doc", "lo"), sort_shards, "doc long, lo int, len int")
    return spans.unionByName(materialise(found))


def cut_spans(docs: DataFrame, spans: DataFrame, with_kept: bool = False) -> DataFrame:
    """Removes the spans (doc, lo, len) from their documents."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept

    def finish(batches):
        for b in batches:
            out = []
            texts = b.column(1).to_pylist()
            lists = b.column(2) if b.num_columns > 2 else None
            for i, (d, t) in enumerate(zip(b.column(0).to_pylist(), texts)):
                raw = (t or "").encode()
                spans = lists[i].as_py() if lists is not None else None
                removed = count = 0
                kept = raw
                if spans:
                    parts, at, reach = [], 0, -1
                    for lo, n in sorted((x["lo"], x["len"]) for x in spans):
                        hi = min(lo + n, len(raw))
                        if lo >= hi:
                            continue
                        if lo > reach:
                            count += 1
                            parts.append(raw[at:lo])
                            reach = at = hi
                            removed += hi - lo
                        elif hi > reach:
                            removed += hi - reach
                            reach = at = hi
                    kept = b"".join([*parts, raw[at:]])
                out.append((None if d == NULL_ID else d, len(raw), removed, count, hashlib.sha256(kept).hexdigest(), kept))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_kept]
                yield pa.record_batch([pa.array(c, k) for c, k in list(zip(zip(*out), kinds))[: len(names)]], names)

    docs = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    bits = bitmap(spans, "doc")
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "len")).alias("spans"))
    some = filter_by(docs, "doc_id", bits).join(lists, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")
    return arrow_map(some, finish, schema).unionByName(arrow_map(docs, lambda batches: finish(where(b, ~in_bitmap(bits, b.column(0).to_numpy(zero_copy_only=False))) for b in batches), schema))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay), a row for each row."""
    src = base_of(docs, id_col, text_col)
    return cut_spans(src, repeated_spans(src), with_kept)


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
