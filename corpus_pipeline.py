"""The corpus pipeline: stages over the table documents, each written and read back by whoever runs them.

Every stage works on all that the stage before kept. All but the last return the columns of documents, whatever others there are.

What every filtering stage does with odd rows: null and empty texts are texts of length 0, read whole like any other, so they
count as clean and as exact copies of each other. Decisions are about ids: rows that share an id are one document, which stays or goes
with all its rows, and goes if one of them is to go; rows without an id always stay. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspan.llm.common import materialise, without
from loomspan.llm.decontaminate import contamination
from loomspan.llm.exact_dedup import exact_dedup
from loomspan.llm.jaccard_join import jaccard_components
from loomspan.llm.packing import best_fit_packing
from loomspan.llm.tokens import vocabulary
from loomspan.llm.toxicity import fit, toxicity


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier rejects go. It learns from the labelled rows of documents that aren't held out; without
    labels of both kinds it rejects what the only kind says (nothing, if there are none)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without(docs, toxicity(docs, fit(docs, labels)).filter("predicted = 1"))


def drop_exact_copies(spark, docs, sf_dir):
    """Of documents with texts equal but for white space, the one with the longest text stays, then the smallest id."""
    return without(docs, exact_dedup(docs).filter("not kept"))


def drop_near_copies(spark, docs, sf_dir):
    """Of each component of linked documents, the one with the smallest id stays. Texts without words link with nothing."""
    return without(docs, jaccard_components(docs).filter(F.col("doc_id") != F.col("component_id")))


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold a passage of the benchmark go; null and empty items are in no document."""
    return without(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark, docs, sf_dir):
    """Pieces of at most 1024 tokens in sequences of at most 1024, for each row, repeated ones and those without text or id too."""
    return best_fit_packing(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("jaccard_join", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: A trained classifier and tokenisers are beyond SQL; tests/llm/test_pipeline.py
#: compares what each stage keeps with brute force on a small corpus.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
