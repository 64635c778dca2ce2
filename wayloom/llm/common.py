"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java regular expression class body.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="wayloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Cut lineage: write the rows as Parquet to the shared folder and read them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wayloom-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+")
    return F.filter(parts, lambda w: w != "")


def has_columns(df: DataFrame, **types: str) -> DataFrame:
    """The named columns only, cast; a missing one is null."""
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in types.items()])
