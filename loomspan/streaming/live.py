"""Documents that arrive as files, indexed as they come, and mentions of a stream of sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.engine import Engine
from ..sources import corpus
from ..sources.index import Index


def index_stream(index: Index, folder: str, checkpoint: str, every: str | None = None):
    """Starts a query that adds new JSON files to the index; every: a processing time, else what is there now and no more.

    A batch's segment is named by the batch's number, so a batch that runs again replaces its segment. Documents take
    the place of those with the same id.
    """
    raw = index.spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").text(folder)
    name = F.col("_metadata.file_path")
    docs = corpus.parse_documents(raw.select(F.xxhash64(name, "value").alias("doc_key"), name.alias("file_name"), "value"), index.max_tokens)
    base = index._version()

    def put(batch: DataFrame, number: int) -> None:
        index.update(batch, base + 2 * number)

    writer = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def mention_stream(sentences: DataFrame, pattern: str, **k) -> DataFrame:
    """Mentions of a pattern in a streaming table of sentences: a narrow plan, so append mode without state."""
    return Engine(sentences).query(pattern, **k)
