"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def entropy(df: DataFrame, keys: list[str], n: str, into: str) -> DataFrame:
    """Normalised base-2 entropy of the positive counts ``n`` of each key; one class has 0."""
    pos = df.where(F.col(n) > 0)
    p = F.col(n) / F.sum(n).over(Window.partitionBy(*keys))
    return pos.withColumn("__p", p).groupBy(*keys).agg(
        F.when(F.count("*") > 1, -F.sum(F.col("__p") * F.log2("__p")) / F.log2(F.count("*").cast("double"))).otherwise(0.0).alias(into)
    )


def iqr_filter(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Rows within 1.5 interquartile ranges of their key's quartiles (linear percentiles)."""
    q = df.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"))
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    return df.join(q, keys).where(F.col(x).between(lo - 1.5 * (hi - lo), hi + 1.5 * (hi - lo))).drop("__q")
