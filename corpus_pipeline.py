"""The corpus pipeline: documents are filtered, deduplicated by line, document and passage, and packed into windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. A
stage's result is written as Parquet under ``spark.checkpoint.dir`` and read back as the next stage's input, so a lost
executor never costs more than one stage, and every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadlane.llm import line_dedup, packing, quality_rules, simhash, suffix_dedup
from leadlane.llm.common import workers_find_package
from leadlane.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base rule and the learned decision list keep."""
    return quality_rules.quality_stage(spark, docs, sf_dir)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a smaller doc_id holds as well; a document left with nothing but white space stays as it is left."""
    workers_find_package(spark)
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component."""
    workers_find_package(spark)
    return simhash.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops passages of 50 words that a smaller doc_id holds as well, and documents left without a word by that."""
    workers_find_package(spark)
    return suffix_dedup.drop_passages(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into windows of 2048 tokens; one row per piece."""
    workers_find_package(spark)
    return packing.pack(docs, packing.default_tokenizer(), with_ids=False).drop("ids")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash", near_copies), ("suffix_dedup", passages), ("packing", pack)]

#: The learned rules, SimHash and the packing order have no SQL form; tests/llm/test_pipeline.py holds each stage
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
