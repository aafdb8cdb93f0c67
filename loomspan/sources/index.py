"""A corpus that grows: Parquet segments and tombstones, added to in batches or by a stream.

A segment holds the documents of one addition under its version. Deleting an id writes a tombstone with a newer version;
a row is alive if no tombstone of its id is newer than its segment. Nothing is rewritten until compact().
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..operators.engine import Engine
from . import corpus


class Index:
    def __init__(self, spark: SparkSession, path: str, max_tokens: int = corpus.MAX_TOKENS):
        self.spark, self.path, self.max_tokens = spark, path.rstrip("/"), max_tokens
        self._last = 0

    def _version(self) -> int:
        self._last = max(self._last + 1, time.time_ns())
        return self._last

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _write(self, df: DataFrame, table: str, version: int) -> None:
        # a folder a version: writing one again, as after a lost driver, replaces it
        df.write.mode("overwrite").parquet(f"{self._at(table)}/v={version}")

    def _read(self, table: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self._at(table))
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema + ", v long")
        return self.spark.read.schema(schema + ", v long").option("basePath", self._at(table)).parquet(self._at(table))

    # --- changes ----------------------------------------------------------------------------------------------------

    def add(self, documents: DataFrame, version: int | None = None) -> None:
        """Adds parsed documents (corpus.parse_documents, read_json, from_strings). Bad ones go to the table of errors."""
        v = version or self._version()
        self._write(documents, "segments", v)

    def add_files(self, path: str) -> None:
        self.add(corpus.read_json(self.spark, path, self.max_tokens))

    def delete(self, doc_id: str) -> None:
        """Deletes all documents of that id; an unknown id does no harm."""
        self._write(self.spark.createDataFrame([(doc_id,)], "doc_id string"), "tombstones", self._version())

    def update(self, documents: DataFrame, version: int | None = None) -> None:
        """Puts documents in the place of those of the same ids."""
        v = version or self._version()
        self._write(documents.filter("error is null").select("doc_id").distinct(), "tombstones", v)
        self.add(documents, v + 1)
        self._last = max(self._last, v + 1)

    def compact(self, target: str) -> Index:
        """A new index at target with what is alive, in one segment."""
        new = Index(self.spark, target, self.max_tokens)
        new.add(self.documents().drop("v"))
        return new

    # --- reading ----------------------------------------------------------------------------------------------------

    def documents(self) -> DataFrame:
        """All documents that are alive."""
        seg = self._read("segments", corpus.DOCUMENT).filter("error is null")
        dead = self._read("tombstones", "doc_id string").groupBy("doc_id").agg(F.max("v").alias("gone"))
        return seg.join(dead, "doc_id", "left").filter("gone is null or gone < v").drop("gone")

    def errors(self) -> DataFrame:
        return self._read("segments", corpus.DOCUMENT).filter("error is not null").select("file_name", "error")

    def engine(self, **k) -> Engine:
        d = self.documents().drop("v")
        return Engine(corpus.sentences_of(d), corpus.docs_of(d), **k)

    def count(self) -> int:
        return self.documents().count()

    def document(self, doc_id: str) -> DataFrame:
        return self.documents().filter(F.col("doc_id") == doc_id)

    def fields(self) -> list[str]:
        """Metadata fields that occur."""
        d = self.documents()
        names = d.select(F.explode(F.concat(F.map_keys("text_fields"), F.map_keys("num_fields"))).alias("n")).distinct()
        return sorted(r.n for r in names.collect())

    def vocabulary(self) -> DataFrame:
        """Edge labels that occur, with how often."""
        return corpus.sentences_of(self.documents()).select(F.explode("edges").alias("e")).groupBy(F.col("e.label").alias("label")).count()

    def postings(self, field: str = "norm") -> DataFrame:
        """(term, doc_key, sent_id) of a layer: write it partitioned or bucketed by term to answer rare terms without a scan."""
        s = corpus.sentences_of(self.documents())
        if field not in s.columns:
            raise QueryError(f"there is no layer {field!r}")
        col = F.flatten(field) if field in ("norm", "incoming", "outgoing") else F.col(field)
        return s.select(F.explode(F.array_distinct(col)).alias("term"), "doc_key", "sent_id")
