"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each input split hashes its texts (white space deleted) to 44 bits, sorts the distinct hashes by owner, and sends each
   owner one Rice-coded list of gaps, some 4 bytes a document instead of the text, with a bit for each that says whether the split
   holds it more than once. So a text that a third of all rows hold costs an owner one value a split.
2. An owner decodes its lists, finds the fingerprints that occur in two splits or twice in one, and answers each split with a bitmap.
3. Splits scan again: rows that the bitmap clears are final; the others, the suspects, send their bytes, and rows are
   grouped by the bytes themselves, so no collision can join different texts.

Splits are known by file and block, so scan and bitmap agree though tasks are run again elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WS, arrow_map, base_of, join_groups, materialise, scratch

BITS = 44
_DROP = WS.encode()


def rice(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct-or-equal values below 2**BITS as Rice-coded gaps with k low bits."""
    gaps = np.diff(np.concatenate([[U64(0)], values.astype(U64)]))
    q = (gaps >> U64(k)).astype(np.int64)
    size = q + 1 + k
    ends = np.cumsum(size)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    stops = ends - k - 1
    place = np.arange(len(bits)) - np.repeat(ends - size, size)
    bits |= place < np.repeat(q, size)
    for b in range(k):
        bits[stops + 1 + b] = (gaps >> U64(k - 1 - b)) & U64(1) == 1
    return np.packbits(bits).tobytes()


def unrice(blob: bytes, n: int, k: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    zeros = np.flatnonzero(bits == 0).tolist()
    at, j, stops = 0, 0, np.empty(n, np.int64)
    starts = np.empty(n, np.int64)
    for i in range(n):
        while zeros[j] < at:
            j += 1
        starts[i], stops[i] = at, zeros[j]
        at = zeros[j] + 1 + k
    out = (stops - starts).astype(U64)
    for b in range(k):
        out = (out << U64(1)) | bits[stops + 1 + b].astype(U64)
    return np.cumsum(out, dtype=U64)


def _fingerprint(norm: bytes) -> int:
    return xxhash.xxh3_64_intdigest(norm) >> (64 - BITS)


def _splits(docs: DataFrame) -> DataFrame:
    """docs with the id of their input split. What doesn't come straight from files is written first."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    if not docs.inputFiles() or any(x in plan for x in ("Exchange", "Sample", "Limit", "Generate", "InPandas", "InArrow", "Python", "InMemoryTableScan", "LocalTableScan", "Scan ExistingRDD")):
        docs = materialise(docs)
    return docs.withColumn("split", F.xxhash64(F.input_file_name(), F.input_file_block_start()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_rows: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null is empty, and all empty texts are one group. The row with
    the longest original text stays, then the smallest doc_id. Where whole rows repeat (id and text), all of them are
    returned and the kept id is marked on each. No rows in, no rows out.
    """
    spark = docs.sparkSession
    src = _splits(base_of(docs, id_col, text_col))
    total = src.count()
    owners = max(1, -(-total // owner_rows))

    def encode(batches):
        prints: dict[int, list[int]] = {}
        for b in batches:
            for split, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                prints.setdefault(split, []).append(_fingerprint((text or "").encode().translate(None, _DROP)))
        for split, got in prints.items():
            v, often = np.unique(np.array(got, U64), return_counts=True)
            k = max(0, int(np.log2(2**BITS / max(1, len(v)))))
            who = (v * U64(owners)) >> U64(BITS)
            for o in np.unique(who):
                own = v[who == o]
                many = np.packbits(often[who == o] > 1).tobytes()
                yield pa.record_batch([pa.array([int(o)]), pa.array([split]), pa.array([len(own)], pa.int32()), pa.array([k], pa.int32()), pa.array([rice(own - own[0], k)]), pa.array([int(own[0])]), pa.array([many])], ["owner", "split", "n", "k", "code", "base", "many"])

    def answer(key, table):
        rows = table.to_pylist()
        lists = [unrice(r["code"], r["n"], r["k"]) + U64(r["base"]) for r in rows]
        here = [v[np.unpackbits(np.frombuffer(r["many"], np.uint8))[: len(v)] == 1] for r, v in zip(rows, lists)]
        allv = np.sort(np.concatenate(lists))  # each value once a split
        twice = np.unique(np.concatenate([allv[1:][allv[1:] == allv[:-1]], *here]))
        marks = [np.packbits(np.isin(v, twice)).tobytes() for v in lists]
        return table.drop_columns("many").append_column("twice", pa.array(marks, pa.binary()))

    schema = "owner long, split long, n int, k int, code binary, base long"
    codes = arrow_map(src.select("split", "text"), encode, schema + ", many binary")
    buckets = max(1, min(4096, total // 50_000))
    folder = scratch(spark) + "/bitmaps"
    answers = codes.groupBy("owner").applyInArrow(answer, schema + ", twice binary")
    answers.withColumn("bucket", F.pmod("split", F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").parquet(folder)

    def check(batches):
        import pyarrow.dataset as ds

        from .common import filesystem

        known: dict[int, set[int]] = {}
        fs, root = filesystem(folder)
        for b in batches:
            split, ids, text = (b.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for s, i, t in zip(split, ids, text):
                if s not in known:
                    at = ds.dataset(f"{root}/bucket={s % buckets}", filesystem=fs, format="parquet")
                    known[s] = set()
                    for r in at.to_table(filter=ds.field("split") == s).to_pylist():
                        v = unrice(r["code"], r["n"], r["k"]) + U64(r["base"])
                        known[s].update(v[np.unpackbits(np.frombuffer(r["twice"], np.uint8))[: len(v)] == 1].tolist())
                t = t or ""
                norm = t.encode().translate(None, _DROP)
                suspect = _fingerprint(norm) in known[s]
                out.append((i, len(t), hashlib.sha256(norm).hexdigest(), norm if suspect else None))
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "cp", "text_sha256", "norm"]) if out else pa.record_batch([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string(), pa.binary())], ["doc_id", "cp", "text_sha256", "norm"])

    seen = materialise(arrow_map(src.select("split", "doc_id", "text"), check, "doc_id long, cp long, text_sha256 string, norm binary"))
    # one row a distinct text and task crosses the network: the grouping combines before it shuffles
    rank = F.col("cp").cast("decimal(38,0)") * F.lit("18446744073709551616").cast("decimal(20,0)") - F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(38,0)")
    groups = seen.filter("norm is not null").groupBy("norm").agg(F.count("*").alias("group_size"), F.max(rank).alias("best"), F.first("text_sha256").alias("text_sha256"))
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    low = F.pmod(-F.col("best"), two64)
    keep = F.when(low >= F.lit("9223372036854775808").cast("decimal(20,0)"), low - two64).otherwise(low).cast("long")
    groups = materialise(groups.select("text_sha256", "group_size", keep.alias("keep_id")))
    single = seen.filter("norm is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    many = join_groups(seen.filter("norm is not null").select("doc_id", "text_sha256"), groups, ["text_sha256"], "group_size", total)
    many = many.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return single.unionByName(many)


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS kept,
  sha256(norm) AS text_sha256
FROM t
"""
