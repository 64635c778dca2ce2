"""The registered queries of the training-data operators, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_fingerprint, context_mixing, jaccard_join, line_dedup, pii_tagger, quality_rules, sentencepiece_codec, source_mix, suffix_dedup, url_rules
from .common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.encode(docs).select("doc_id", "n_tokens", "ids", "round_trip")


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op3_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_tagger.report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict", "mined")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return source_mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), shingle=4, pct=85)


def op9_chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("fail_bits"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sentencepiece, op2_context_mixing, op3_pii_tagger, op4_line_dedup, op5_url_rules, op6_suffix_dedup, op7_source_mix, op8_jaccard_join, op9_chunk_fingerprint, op10_quality_rules)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {"op4_line_dedup": oracles.OP4, "op8_jaccard_join": oracles.OP8, "op10_quality_rules": oracles.OP10}
