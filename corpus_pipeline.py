"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm.common import forget, materialize, table
from tessera.llm.exact_dedup import keep_first
from tessera.llm.ngram_join import keep_least
from tessera.llm.packing import pack_pow2

#: a document below the first score, or at the second or above, goes
LEAST_QUALITY, MOST_TOXIC = 0.7, 0.5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on labelled rows of its own input."""
    model = quality.fit_labels(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, "__score").filter(F.col("__score") >= LEAST_QUALITY).drop("__score")


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity classifier, fitted on labelled rows of its own input."""
    model = toxicity.fit_labels(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model, "__score").filter(F.col("__score") < MOST_TOXIC).drop("__score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the least doc_id stays; of repeated rows, one.
    Rows without an id come last."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their five-word shingles, the one
    with the least doc_id stays; rows without an id come last."""
    return keep_least(docs, k=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences; the rows carry the token ids."""
    return pack_pow2(docs)


STAGES = [("quality", keep_good), ("toxicity", keep_civil), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("packing", pack)]

#: models and tokens are beyond SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole of ``documents``; what a stage has read is deleted
    when its own rows are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
            if before:
                forget(before)
            before = docs
    return docs
