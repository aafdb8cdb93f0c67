"""Mentions kept between runs: a folder of Parquet that grammars add to and build on."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.engine import MENTION


class State:
    """Use it as a context manager to have it emptied at the end. Mentions added twice are kept once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, mentions: DataFrame) -> None:
        mentions.write.parquet(f"{self.path}/{time.time_ns()}-{uuid.uuid4().hex}")

    def all(self) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], MENTION)
        return self.spark.read.schema(MENTION).option("recursiveFileLookup", "true").parquet(self.path).distinct()

    def get(self, label: str, doc_key: int | None = None, sent_id: int | None = None) -> DataFrame:
        out = self.all().filter(F.col("label") == label)
        if doc_key is not None:
            out = out.filter(F.col("doc_key") == doc_key)
        return out if sent_id is None else out.filter(F.col("sent_id") == sent_id)

    def clear(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def __enter__(self) -> State:
        return self

    def __exit__(self, *error) -> None:
        self.clear()
