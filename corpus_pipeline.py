"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, best-fit packing.

Each stage takes what its predecessor kept, written as Parquet and read again, and calls one operator of
lodestar.llm. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontam, line_dedup, near_dedup, packing, quality
from lodestar.llm.queries import QUALITY_MODELS, TOKENIZER
from lodestar.llm.shared import saved

_WORD = "[^ \t-\r]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, by bands fitted on those of them that labels call clean."""
    return quality.keep_good(docs, QUALITY_MODELS, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY_MODELS))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; a document of which no word is left goes with them."""
    return line_dedup.dedup(docs).where(F.col("text").rlike(_WORD))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages cut out; those that are mostly such passages go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its training sequence and its place there."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: Tokenisers, components and automata are beyond SQL; tests/llm holds the first four stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
