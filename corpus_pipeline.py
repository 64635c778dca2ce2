"""The corpus pipeline: quality rules, line dedup, near-duplicate join, source mix, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
``run`` writes every stage's rows as Parquet to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import jaccard_join, line_dedup, quality_rules, sentencepiece_codec, source_mix
from wayloom.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality_rules.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; a document of which no word is left goes with them."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    rest = out.where("n_lines > n_removed or n_removed = 0")
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the least doc_id stays."""
    return jaccard_join.keep_one(docs.select(*COLUMNS), shingle=5, pct=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it doesn't take go."""
    out = source_mix.mix(docs.select(*COLUMNS)).where("taken > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids; copies of a document are encoded alike."""
    out = sentencepiece_codec.encode(docs.select(*COLUMNS))
    return out.select("doc_id", "source", "ids", "n_tokens", "round_trip")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram jaccard join", near_duplicates), ("source mix", mix), ("sentencepiece", tokens)]

#: SQL has no SentencePiece encoding and no seeded knapsack. The first three stages together are tested against brute force, of the last two only that they return kept documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
