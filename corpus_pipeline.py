"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``. Nulls, empty texts and tables are treated as the
operators say; a document left without a word by line dedup goes, near-duplicates keep
the smallest id of each group, the mix holds a row for each reading of a document.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from unitscope.llm.common import small_batches, table  # noqa: E402
from unitscope.llm.lines import drop_repeated_lines  # noqa: E402
from unitscope.llm.mixing import mix_corpus  # noqa: E402
from unitscope.llm.near_dup import drop_near_duplicates  # noqa: E402
from unitscope.llm.packing import pack  # noqa: E402
from unitscope.llm.quality import fit, keep_good  # noqa: E402
from unitscope.session import scratch  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_corpus(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The stages learn rules, confirm similarities and call a tokenizer: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
