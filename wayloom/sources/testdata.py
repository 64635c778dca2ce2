"""The driver's tables as positions, events and crashes: places are made up from row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import epoch

GAP_S = 43200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        u.alias("uid"), e.alias("pid"), "ts", epoch("ts").alias("t"),
        (F.lit(12.4) + F.lit(1.0e-2) * (u % 10) + F.lit(2.0e-2) * (e % 5) + F.lit(1.0e-4) * ((e * 31) % 7)).alias("lon"),
        (F.lit(41.8) + F.lit(1.0e-2) * (u % 7) + F.lit(1.5e-2) * (e % 5) + F.lit(1.0e-4) * ((e * 17) % 5)).alias("lat"),
        F.when(F.col("event_type") == "error", 1).otherwise(3).alias("gps_quality"),
        F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 2).otherwise(1).alias("status"),
        (e % 5).alias("lid"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("uid"), e.alias("eid"), "ts", epoch("ts").alias("t"),
        F.when(kind == "click", "A").when(kind == "view", "B").when(kind == "purchase", "C").when(kind == "error", "Q").otherwise("start").alias("event_type"),
        F.floor("value").cast("int").alias("speed"), (e % 9).cast("int").alias("max_acc"), (e % 5).cast("int").alias("avg_acc"),
        ((e * 13) % 360).cast("int").alias("angle"), (e % 3).cast("string").alias("location_type"), (e % 60).cast("int").alias("duration"),
    )


def crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'signup' and value >= 100").select(F.col("user_id").alias("uid"), F.col("event_id").alias("cid"), "ts", epoch("ts").alias("t"))
