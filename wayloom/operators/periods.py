"""Month windows, sliding periods and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import timeparts


def month_pair_counts(orders: DataFrame) -> DataFrame:
    m = orders.select("uid", F.explode(timeparts.month_pairs(F.month("ts"))).alias("first_month"))
    return m.groupBy("uid", "first_month").agg(F.count("*").alias("n"))


def periods(spark: SparkSession, first: int, last: int, width: int = 4) -> DataFrame:
    """Periods of whole months [lo, hi) as month numbers, sliding by one; the label month is hi."""
    return spark.range(last - first - width + 1).select(F.col("id").alias("idx"), (F.col("id") + first).alias("lo"), (F.col("id") + first + width).alias("hi"))


def assign(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with a month number -> one row per period that holds it."""
    return rows.join(F.broadcast(spans), (F.col("month") >= F.col("lo")) & (F.col("month") < F.col("hi")))


def labels(rows: DataFrame, hits: DataFrame, spans: DataFrame) -> DataFrame:
    """(uid, idx, label): users active in a period, and whether a hit follows in the next month."""
    active = assign(rows, spans).select("uid", "idx", F.col("hi").alias("month")).distinct()
    hit = hits.select("uid", "month").distinct().withColumn("hit", F.lit(1))
    return active.join(hit, ["uid", "month"], "left").select("uid", "idx", F.coalesce("hit", F.lit(0)).alias("label"))


def first_per_month(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("uid", "month").orderBy("ts", "id")
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def first_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, by an explicit order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__k = 1").drop("__k")


def train_test(labelled: DataFrame) -> DataFrame:
    """(uid, idx, train_label, test_label): each user's labels of a period and of the one after."""
    nxt = labelled.select("uid", (F.col("idx") - 1).alias("idx"), F.col("label").alias("test_label"))
    return labelled.select("uid", "idx", F.col("label").alias("train_label")).join(nxt, ["uid", "idx"])


def inner_months(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows whose time, a month earlier, is not before ``lo``, and a month later is before ``hi``."""
    shift = lambda n: F.add_months(F.col("ts").cast("date"), n)
    return rows.where((shift(-1) >= F.lit(lo).cast("date")) & (shift(1) < F.lit(hi).cast("date")))
