"""What the corpus operators share: scratch tables, fixed-size filters, text in numpy, joins that stand hot keys.

Conventions: operators take a DataFrame with an id column and a text column, pick those two at once (so any other
column, whatever its name, is harmless), and treat a null text as the empty one.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
WS = " \t\n\x0b\x0c\r"
SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


# --- scratch space and shipping -------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder (URI) in the shared folder that spark.checkpoint.dir names; removed when the application ends.

    Only where that is unset, and only on one machine, as in tests, a local folder of our own takes its place.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        sc.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base[7:], True)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[5:]
    if not _MADE:
        atexit.register(_clear)
    _MADE.append(f"{base.rstrip('/')}/loomspan-{uuid.uuid4().hex}")
    return _MADE[-1]


_MADE: list[str] = []


def _clear() -> None:
    for uri in _MADE:
        fs, path = filesystem(uri)
        try:
            fs.delete_dir(path)
        except OSError:  # never written to, or gone with its parent
            pass


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_loomspan_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(os.path.join(root, "loomspan")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), root))
    folder = scratch(spark)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/loomspan_package.zip") as f:
        f.write(held.getvalue())
    sc.addPyFile(f"{folder}/loomspan_package.zip")
    sc._loomspan_shipped = True


def materialise(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage in a way that survives lost executors."""
    path = scratch(df.sparkSession) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(keep_tokens: bool = False) -> None:
    """Gives back memory that earlier tasks of this worker hold: workers live on from job to job.

    That is what modules remember, Arrow's own pool, objects in cycles, and free pages of the C library.
    """
    global _POW
    tokens, suffixes = (sys.modules.get(f"{__package__}.{m}") for m in ("tokens", "suffix_dedup"))
    if tokens is not None and not keep_tokens:
        tokens.forget()
    if suffixes is not None:
        suffixes._POWERS.clear()
    _POW = _POW[: 1 << 12].copy()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call, and needs none
        pass


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep_tokens: bool = False) -> DataFrame:
    """mapInArrow that ships this package, bounds batches by their bytes (BATCH_BYTES, unless the session says otherwise), since
    10,000 long texts at once would fill an executor, and leaves the worker without what the task held.

    Don't chain two in one stage: each would take a worker of its own.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))

    def run(batches):
        tokens = sys.modules.get(__package__ + ".tokens")
        if tokens is not None and not keep_tokens:
            tokens.forget()
        yield from fn(batches)
        del batches
        tidy(keep_tokens)

    return df.mapInArrow(run, schema)


def base_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


# --- text in numpy --------------------------------------------------------------------------------------------------


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary array; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = col.type in (pa.large_string(), pa.large_binary())
    n, kind = len(col), np.int64 if large else np.int32
    bufs = col.buffers()
    if not n or bufs[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + n + 1].astype(np.int64)
    if bufs[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Whole rows of a batch in pieces of about limit bytes of text: bounds what numpy needs besides one document."""
    _, off = utf8(batch.column(batch.schema.get_field_index(col)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix), a bijection."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


_BYTE = mix(np.arange(1, 257, dtype=U64))
_IS_WS = np.zeros(256, bool)
_IS_WS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = _BYTE[_LOWER]
_POW = powers(0x9E3779B97F4A7C15, 1 << 12)


def words(data: np.ndarray, off: np.ndarray, apart: np.ndarray = _IS_WS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` (or of bytes that aren't `apart`), A-Z lower-cased, of all texts: (hash, start, end, words
    before each text)."""
    global _POW
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(len(off), np.int64)
    black = ~apart[data]
    first = black.copy()
    first[1:] &= ~black[:-1]
    bounds = off[:-1][off[:-1] < n]
    first[bounds] = black[bounds]
    starts = np.flatnonzero(first)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(len(off), np.int64)
    last = black.copy()
    last[:-1] &= ~black[1:]
    ends_at = off[1:][off[1:] > 0] - 1
    last[ends_at] = black[ends_at]
    ends = np.flatnonzero(last) + 1
    chars = np.flatnonzero(black)
    lens = ends - starts
    if (longest := int(lens.max())) > len(_POW):
        _POW = powers(0x9E3779B97F4A7C15, 2 * longest)
    first_char = np.cumsum(lens) - lens
    place = np.arange(len(chars)) - np.repeat(first_char, lens)
    v = _LOWER_BYTE[data[chars]] * _POW[place]
    h = np.add.reduceat(v, first_char)
    return mix(h ^ lens.astype(U64)), starts, ends, np.searchsorted(starts, off)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, len(h) - k + 1 of them; document borders are the caller's matter."""
    if len(h) < k:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - k + 1, U64)
    for i in range(k):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[i : len(h) - k + 1 + i]
    return mix(out)


def runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


# --- a filter of a fixed size ---------------------------------------------------------------------------------------


BITMAP_LOG2 = 25


def bitmap(df: DataFrame, col: str, log2: int = BITMAP_LOG2) -> bytes:
    """2**log2 bits (4 MB by default, whatever the input) with a bit set for the mixed value of each row's long.

    It goes to all tasks, so its size is fixed: with very many keys it only lets more through. Whoever uses it as a
    filter must join exactly afterwards.
    """
    shift, parts = U64(64 - log2), 64

    def slots(batches):
        for b in batches:
            i = (mix(b.column(0).to_numpy(zero_copy_only=False).view(U64)) >> shift).astype(np.int64)
            i = np.unique(i)
            yield pa.record_batch([pa.array(i >> (log2 - 6)), pa.array(i)], ["part", "slot"])

    def pack(batches):
        have: dict[int, np.ndarray] = {}
        for b in batches:
            p, i = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in np.unique(p):
                bits = have.setdefault(int(k), np.zeros(2**log2 // parts, bool))
                bits[i[p == k] - k * (2**log2 // parts)] = True
        for k, bits in have.items():
            yield pa.record_batch([pa.array([k], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["part", "bits"])

    df = df.select(F.col(col).cast("long").alias("k")).filter("k is not null")
    got = arrow_map(arrow_map(df, slots, "part long, slot long").repartition("part"), pack, "part long, bits binary").collect()
    out = bytearray(2**log2 // 8)
    for r in got:
        out[r.part * len(out) // parts : (r.part + 1) * len(out) // parts] = r.bits
    return bytes(out)


def in_bitmap(bits: bytes, keys: np.ndarray) -> np.ndarray:
    b = np.frombuffer(bits, np.uint8)
    i = mix(keys.view(U64)) >> U64(64 - (len(bits) * 8).bit_length() + 1)
    return (b[(i >> U64(3)).astype(np.int64)] >> (U64(7) - (i & U64(7))).astype(np.uint8)) & 1 == 1


def where(batch: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(keep))


def filter_by(df: DataFrame, col: str, bits: bytes, present: bool = True) -> DataFrame:
    """Rows whose long id is (perhaps) in the bitmap, or surely isn't."""

    def keep(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index(col))
            ids = ids.cast(pa.int64())
            hit = in_bitmap(bits, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
            yield where(b, hit if present else ~hit)

    return arrow_map(df, keep, df.schema)


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs but for the rows whose id is in dropped (doc_id). Only rows that the bitmap can't clear are shuffled, not the texts
    of all that stays. Rows without an id stay."""
    dropped = materialise(dropped.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct())
    bits = bitmap(dropped, "doc_id")
    gone = "__gone"
    while gone in docs.columns:
        gone += "_"
    unclear = filter_by(docs, id_col, bits).join(dropped.withColumnRenamed("doc_id", gone), F.col(id_col) == F.col(gone), "left_anti")
    return filter_by(docs, id_col, bits, present=False).unionByName(unclear.select(docs.columns))


# --- joins ----------------------------------------------------------------------------------------------------------


HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with the one row of their group, though a group may hold most rows.

    Groups of more than total / 1000 rows are at most 1000, so broadcasting those is safe; no other group is large
    enough to skew a shuffle. Both parts together are the whole join.
    """
    bound = max(1, total // HOT_SHARE)
    hot = groups.filter(F.col(size) > bound)
    light = groups.filter(F.col(size) <= bound)
    marks = F.broadcast(hot.select(*keys, F.lit(True).alias("__hot")))
    tagged = rows.join(marks, keys, "left")
    a = tagged.filter("__hot").drop("__hot").join(F.broadcast(hot), keys)
    b = tagged.filter("__hot is null").drop("__hot").join(light, keys)
    return a.unionByName(b)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for each node of the edges (a, b): root is the smallest id that can be reached.

    Alternating large-star and small-star steps, each a grouping by node; every round is written to the shared
    folder. Neighbours of a node are never gathered: stars only need the smallest one.
    """
    e = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialise(small.filter("u != v").distinct())
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
