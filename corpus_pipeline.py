"""From raw documents to packed sequences: quality, toxicity, exact and near copies, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chunkmill.llm import exact_dedup, near_dedup, packing, quality, toxicity
from chunkmill.llm.shared import stored
from chunkmill.sources.resources import keep_batches_small


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns. Null and empty texts are
    scored as texts without words; rows without an id, repeated rows and ties are judged each for itself."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not mark, with all their columns; null text is empty,
    and every row is judged for itself."""
    keep_batches_small(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.5)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (A-Z folded, null as empty): that of the largest id; repeated rows count once."""
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that share 80 % of their five-word shingles, the rows of the smallest id.
    Null, empty and one-word texts are linked with equal ones only, rows without an id with none."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, in sequences of at most 2,048 ids; null and empty texts are their
    end id, and an empty table has no pieces."""
    keep_batches_small(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048, ids_too=True)


STAGES = [("quality", good), ("toxicity", clean), ("exact dedup", without_copies), ("near dedup", without_near_copies), ("packing", packed)]

#: The fitted models and the packing are not expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again by the next. Other columns of
    ``documents``, whatever their names, are kept up to the packing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
