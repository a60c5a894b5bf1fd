"""The corpus pipeline: quality rules, quality classifier, near-duplicates, source mixing, packing, each over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import byte_cnn, mixing, packing, quality_rules, simhash
from quillstream.llm.common import materialise


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep, under limits learnt from the good labelled ones among them; a null or empty text goes."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on labelled documents of the whole table, since the rules before it leave few bad ones."""
    weights = byte_cnn.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return byte_cnn.keep_good(docs, weights)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, Jaccard 0.8); rows without a doc_id stay."""
    return simhash.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighed by the square root of their size; a document comes as often as its draw says. All columns as they are."""
    return mixing.mix_sources(docs, copy="__copy", key="__mix_key").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4,096 ids; a document that comes twice is packed twice."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_duplicates", near_duplicates), ("source_mix", mix), ("packing", pack)]

#: SQL can express neither zstandard ratios nor the network nor the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
