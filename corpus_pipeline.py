"""The corpus pipeline: toxicity filter, line dedup, near-duplicate removal, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's
``docs``.  Filtering stages return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from gatewatch.llm.common import saved, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is below one half; the model is fitted on what is labelled of them."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated passages cut out; ``n_chars`` follows the text."""
    out = line_dedup.dedup(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a similarity of 0.8 or more connect."""
    return jaccard.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [("toxicity", without_toxic), ("line_dedup", without_repeated_passages), ("ngram_jaccard", without_near_copies),
          ("decontamination", without_benchmarks), ("packing", packed)]
#: Models, tokens and routed joins are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
