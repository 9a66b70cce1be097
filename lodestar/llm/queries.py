"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, html_extract, id_files, line_dedup, lm_score, near_dedup, packing, phrases, quality, secret_scan, url_filter, warc

#: Files of the public tokenizers.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
QUALITY_MODELS = quality.Vocabularies(public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its lines that match an earlier one; null and empty texts stay as they are."""
    return line_dedup.dedup(_read(spark, sf_dir, "documents")).select("doc_id", "text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's rule or template and its verdict; a null url has an empty host and path."""
    return url_filter.judge(_read(spark, sf_dir, "pages"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base matches and the spans that randomness tests add; a null text has none."""
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; a null text is its end id alone."""
    return packing.pack(_read(spark, sf_dir, "documents"), TOKENIZER)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id of its component of near duplicates; texts without words are linked with nothing."""
    return near_dedup.groups(_read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null and empty pages have an empty one."""
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives tells; null html is an empty payload."""
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows; a null text has none."""
    return decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("spans")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores by the unigram base and the model; a null text is its end alone."""
    return lm_score.score(_read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, measures and verdict by bands fitted on labelled ones; a null text has no words and fails."""
    docs = _read(spark, sf_dir, "documents")
    return quality.judge(docs, QUALITY_MODELS, quality.fit(docs, _read(spark, sf_dir, "labels"), QUALITY_MODELS))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words keep together most; null texts are empty."""
    return phrases.mine(_read(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written to files of byte planes and read back; a null text has its end id alone."""
    return id_files.round_trip(_read(spark, sf_dir, "documents"), BYTE_TOKENIZER)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of a language and the terms that set each apart; nulls are empty strings."""
    return divergence.audit(_read(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_secrets, op4_packing, op5_near_dedup, op6_html, op7_warc, op8_decontamination, op9_lm_score, op10_quality, op11_phrases, op12_token_files, op13_source_divergence)}


def oracle_sql():
    return {"op2_url_filter": url_filter.oracle_sql(), "op11_phrases": phrases.oracle_sql(), "op13_source_divergence": divergence.oracle_sql()}
