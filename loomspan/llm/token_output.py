"""Token ids in Simple-8b files.

A file is a run of segments. A segment holds whole documents: magic, counts, document ids, document lengths, the word
offset of each block of 4096 ids, then 64-bit words. A word's top four bits select how many values its other 60 bits
hold; selector 0 escapes to a full 64-bit value in the next word. No word holds values of two blocks, so a block can be
decoded alone, and decoding is by selector, not by word: vectorised.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, base_of, filesystem, scratch
from .tokens import encoder, vocabulary

#: (values, bits) by selector; 0 is the escape.
TABLE = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 4096
MAGIC = b"S8B1"
SEGMENT_IDS = 2_000_000
AT_ONCE = 1 << 17
NULL_ID = -(2**63)


_SHORT = np.array([x.bit_length() for x in range(1 << 16)])


def _bit_length(v: np.ndarray) -> np.ndarray:
    if not len(v) or v.max() < 1 << 16:
        return _SHORT[v.astype(np.int64)]
    out = np.zeros(len(v), np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        big = v >= (np.uint64(1) << np.uint64(s))
        out[big] += s
        v = np.where(big, v >> np.uint64(s), v)
    return out + (v > 0)


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block) of unsigned 64-bit values, some blocks at a time: what that takes stays in a
    processor's cache."""
    size = max(1, AT_ONCE // block) * block
    words, offsets, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for k in range(0, len(values), size):
        w, o = _pack_blocks(values[k : k + size].astype(np.uint64), block)
        words.append(w)
        offsets.append(o + at)
        at += len(w)
    return np.concatenate(words), np.concatenate(offsets)


def _pack_blocks(v: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(v)
    bits = _bit_length(v)
    left = block - np.arange(n) % block  # values up to the end of the block
    left = np.minimum(left, n - np.arange(n))
    pick = np.zeros(n, np.int64)
    undone = np.ones(n, bool)
    for sel in range(1, 16):
        count, width = TABLE[sel]
        # only where enough small values follow each other; past the end of a block zeros pad the word
        borders = np.concatenate([[-1], np.flatnonzero(bits > width), [n + TABLE[1][0]]])
        gap = np.diff(borders) - 1
        k = np.flatnonzero(gap >= count)
        if not len(k):
            continue
        size = gap[k] - count + 1
        at = np.repeat(borders[k] + 1, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = at[at < n]
        at = at[undone[at]]
        pick[at] = sel
        undone[at] = False
    counts = np.array([c for c, _ in TABLE])[pick]
    step = np.minimum(counts, left).tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    sel = pick[at]
    size = 1 + (sel == 0)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate([v, np.zeros(128, np.uint64)])
    lim = left[at]
    for s in np.unique(sel):
        m = np.flatnonzero(sel == s)
        if s == 0:
            out[place[m] + 1] = v[at[m]]
            continue
        count, width = TABLE[s]
        w = np.full(len(m), np.uint64(s) << np.uint64(60))
        if width:
            a, end = at[m], lim[m]
            for j in range(count):
                x = np.where(j < end, padded[a + j], np.uint64(0))
                w |= x << np.uint64(j * width)
        out[place[m]] = w
    return out, place[np.searchsorted(at, np.arange(0, n, block))]


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n values again."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    esc = np.flatnonzero(sel == 0)
    for e in esc.tolist():  # the word after an escape is data, whatever its top bits say
        if head[e]:
            head[e + 1] = False
    at = np.flatnonzero(head)
    s = sel[at]
    counts = np.array([c for c, _ in TABLE])[s]
    block_of = np.searchsorted(offsets, at, side="right") - 1
    ends = np.cumsum(counts)
    first = np.flatnonzero(np.concatenate([[True], block_of[1:] != block_of[:-1]]))
    base = np.zeros(len(offsets), np.int64)
    base[block_of[first]] = (ends - counts)[first]
    place = ends - counts - base[block_of] + block_of * block
    limit = np.minimum((block_of + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for k in np.unique(s):
        m = np.flatnonzero(s == k)
        if k == 0:
            out[place[m]] = words[at[m] + 1]
            continue
        count, width = TABLE[k]
        if not width:
            continue
        w, mask = words[at[m]], np.uint64(2**width - 1)
        for j in range(count):
            to = place[m] + j
            ok = to < limit[m]
            out[to[ok]] = (w[ok] >> np.uint64(j * width)) & mask
    return out


def segment(ids: list[int], docs: list[bytes]) -> bytes:
    lengths = np.array([len(d) // 4 for d in docs], "<u4")
    words, offsets = pack(np.frombuffer(b"".join(docs), "<u4"))
    head = MAGIC + struct.pack("<IQII", len(docs), int(lengths.sum()), len(offsets), len(words))
    return head + np.array(ids, "<i8").tobytes() + lengths.tobytes() + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes()


HEAD = 4 + struct.calcsize("<IQII")


def read_segments(f):
    """(document ids, lengths, ids) of each segment of an open file."""
    while head := f.read(HEAD):
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        docs, n, blocks, words = struct.unpack("<IQII", head[4:])
        ids = np.frombuffer(f.read(8 * docs), "<i8")
        lengths = np.frombuffer(f.read(4 * docs), "<u4").astype(np.int64)
        offsets = np.frombuffer(f.read(4 * blocks), "<u4").astype(np.int64)
        yield ids, lengths, unpack(np.frombuffer(f.read(8 * words), "<u8"), offsets, n).astype("<u4")


def _targets(spark, n: int) -> list[int]:
    """For each partition 0..n-1 a number that hash partitioning into n sends there."""
    got: dict[int, int] = {}
    for r in spark.range(n * 40 + 200).select("id", F.pmod(F.hash(F.col("id")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect():
        got[r.p] = r.id
    return [got[i] for i in range(n)]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Writes part files in ascending id order; returns (file, documents, ids) of each, in order.

    Only the id column is read to find the borders of the parts; texts then cross the network once, and are encoded
    where they are written. Part files appear by renaming, so a task that runs twice does no harm. Null ids come first;
    rows of one id are in order of their ids' bytes; an empty table gives no files.
    """
    spark = docs.sparkSession
    src = base_of(docs, id_col, text_col)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(src.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    cuts = [int(x) for x in cuts]
    parts = len(cuts) + 1
    to = _targets(spark, parts)

    def route(batches):
        where, bounds = np.array(to), np.array(cuts, np.int64)
        for b in batches:
            ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            k = np.searchsorted(bounds, ids, side="right")
            yield pa.record_batch([pa.array(k), pa.array(where[k]), pa.array(ids), b.column(1)], ["part", "target", "doc_id", "text"])

    def write(batches):
        enc, fs, out, state = encoder(tokenizer), *filesystem(folder), {}
        end = np.array([end_id], "<u4").tobytes()

        def flush(part):
            s = state[part]
            if s["ids"]:
                s["f"].write(segment(s["ids"], s["docs"]))
                s["n"], s["d"] = s["n"] + sum(map(len, s["docs"])) // 4, s["d"] + len(s["ids"])
                s["ids"], s["docs"], s["held"] = [], [], 0

        import uuid

        for b in batches:
            for part, i, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), enc.encode_all(b.column(3).to_pylist())):
                if part not in state:
                    temp = f"{out}/.{part:08d}-{uuid.uuid4().hex}"
                    state[part] = {"f": fs.open_output_stream(temp), "temp": temp, "ids": [], "docs": [], "held": 0, "n": 0, "d": 0}
                s = state[part]
                ids += end
                s["ids"].append(i)
                s["docs"].append(ids)
                s["held"] += len(ids) // 4
                if s["held"] >= SEGMENT_IDS:
                    flush(part)
        for part, s in state.items():
            flush(part)
            s["f"].close()
            name = f"part-{part:08d}.s8b"
            if fs.get_file_info(f"{out}/{name}").type != FileType.NotFound:  # this task ran before
                fs.delete_file(f"{out}/{name}")
            fs.move(s["temp"], f"{out}/{name}")
            yield pa.record_batch([pa.array([name]), pa.array([s["d"]]), pa.array([s["n"]])], ["file", "docs", "ids"])

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    routed = arrow_map(src, route, "part long, target long, doc_id long, text string")
    ordered = routed.repartition(parts, "target").sortWithinPartitions("doc_id", "text")
    done = arrow_map(ordered, write, "file string, docs long, ids long", keep_tokens=True).collect()  # one small row a part file
    return sorted((r.file, r.docs, r.ids) for r in done)


def read_tokens(spark, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone but for their order and sizes."""
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in files])]).tolist()

    def read(batches):
        fs, root = filesystem(folder)
        for b in batches:
            for k in b.column(0).to_pylist():
                at = starts[k]
                with fs.open_input_stream(f"{root}/{files[k][0]}") as f:
                    for ids, lengths, v in read_segments(f):
                        ends = np.cumsum(lengths)
                        raw = memoryview(v.tobytes())
                        crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                        yield pa.record_batch([pa.array(ids, mask=ids == NULL_ID), pa.array(at + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        at += int(ends[-1])

    return arrow_map(spark.range(0, len(files), 1, max(1, len(files))), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_output(spark, sf_dir):
    folder = scratch(spark)
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), 1, folder)
    return read_tokens(spark, folder, files)
