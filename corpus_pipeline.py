"""A corpus pipeline: quality rules, near-duplicates, source mix, packing.

Each stage takes all that the one before kept, and all but the last return the
columns of documents, whatever else these are named.  A null text is an empty one:
the quality rules reject it.  Null languages, sources and ids are values like any
other.  Repeated rows are copies, of which one stays.  Ties are broken by values
or their hashes.  Texts of any length are taken whole.  An empty table passes
through all stages and gives no sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoplane.llm import dedup, mixing, packing, quality
from chronoplane.llm.shared import materialize

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject: short, null or repetitive texts and outliers of their source."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates, that with the least id; one of repeated rows."""
    return dedup.deduplicate(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources, null last, meet their target weights; repeated rows each count."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mixed documents into training sequences, a row per sequence; an empty text is its end id."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packed_sequences)]

#: Near-duplicate classes, the dual's solution and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
