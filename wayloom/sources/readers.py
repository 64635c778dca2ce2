"""Sources and sinks: positions, events, crashes, user lists, trips and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType()), T.StructField("t", T.DoubleType())])
MICRO = 1.0e6


def degrees(micro) -> Column:
    return F.col(micro) / MICRO


def positions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw positions with coordinates in millionths of degrees -> typed rows, partition-local order by user and time."""
    raw = spark.read.format(fmt).load(path)
    rows = raw.select(
        F.col("`T&K_VOUCHER_ID`").cast("string").alias("uid"), F.col("TIMESTAMP_LOCAL").cast("timestamp_ntz").alias("ts"),
        degrees("LONGITUDE").alias("lon"), degrees("LATITUDE").alias("lat"),
        F.col("GPS_QUALITY").cast("int").alias("gps_quality"), F.col("STATUS").cast("int").alias("status"),
    )
    return rows.repartition("uid").sortWithinPartitions("uid", "ts")


def crashes(raw: DataFrame) -> DataFrame:
    """Only rows flagged as valid are crashes."""
    return raw.where("FLAG_VALIDITY = 'Y'")


def clean_events(raw: DataFrame) -> DataFrame:
    """Accelerations without sign, whole numbers truncated."""
    return raw.withColumns({"max_acc": F.abs("max_acc").cast("int"), "avg_acc": F.abs("avg_acc").cast("int"), "speed": F.col("speed").cast("int"), "angle": F.col("angle").cast("int"), "duration": F.col("duration").cast("int")})


def users(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The first column of a CSV list."""
    df = spark.read.csv(path, header=header)
    return df.select(F.col(df.columns[0]).cast("string").alias("uid")).distinct()


def distinct_users(df: DataFrame) -> DataFrame:
    return df.select("uid").distinct()


def trips(spark: SparkSession, path: str, min_km: float = 0.0, min_s: float = 0.0) -> DataFrame:
    """Stored trips longer than both bounds; the filter reaches the scan."""
    return spark.read.parquet(path).where((F.col("length_km") > min_km) & (F.col("duration_s") > min_s))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def geojson_points(text) -> Column:
    """The coordinates of a GeoJSON line with times as points."""
    line = F.from_json(text, "coordinates array<array<double>>")["coordinates"]
    return F.transform(line, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"), p[2].alias("t")))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, gzipped or not."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def extended_json(spark: SparkSession, path: str, lo: str, hi: str, multi_line: bool = True) -> DataFrame:
    """Documents with ``$date`` and ``$numberLong`` wrappers; those with lo <= time < hi."""
    raw = spark.read.option("multiLine", multi_line).json(path)
    ts = F.to_timestamp_ntz(F.substring(F.col("TIMESTAMP_LOCAL")["$date"], 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    flat = [F.col(f"`{f.name}`")["$numberLong"].cast("long").alias(f.name) if isinstance(f.dataType, T.StructType) and "$numberLong" in f.dataType.names else F.col(f"`{f.name}`") for f in raw.schema.fields if f.name != "TIMESTAMP_LOCAL"]
    return raw.select(*flat, ts.alias("ts")).where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz")))


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Replace a table as a whole; a failed job leaves no part of it."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_dataset(parts: list[DataFrame], path: str) -> None:
    """Feature rows of several sources, with the union of their columns, as gzipped CSV."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.mode("overwrite").csv(path, header=True, compression="gzip")


def unfinished(todo: DataFrame, done: DataFrame, key: str = "uid") -> DataFrame:
    """Rows whose key is not among those already processed."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def of_users(df: DataFrame, wanted: DataFrame, key: str = "uid") -> DataFrame:
    """The rows of several users at once, each with its own user only, in order within its task."""
    return df.join(wanted.select(key).distinct(), key, "left_semi").sortWithinPartitions(key)


def with_rejects(df: DataFrame, **checks: Column) -> DataFrame:
    """Adds ``reject``: the name of the first check that a row fails (a null check fails too), or null."""
    out = F.lit(None).cast("string")
    for name, good in reversed(checks.items()):
        out = F.when(F.coalesce(good, F.lit(False)), out).otherwise(F.lit(name))
    return df.withColumn("reject", out)


def write_json(df: DataFrame, path: str) -> None:
    """Rows of features as gzipped JSON lines; nulls are kept as such."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression="gzip")


def write_network(places: DataFrame, movements: DataFrame, path: str, key: str = "uid") -> None:
    """A user's mobility network as one JSON line: places and movements nested, in order."""
    nest = lambda df, name: df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(name))
    write_json(nest(places, "places").join(nest(movements, "movements"), key, "full"), path)


def write_cells(cells: DataFrame, path: str, by: str = "month_idx") -> None:
    """The counters of all cells as one table, a folder per month."""
    write_table(cells, path, by)


def write_model(model, scores: DataFrame, path: str) -> None:
    """A fitted Spark model with its evaluation as JSON lines beside it."""
    model.write().overwrite().save(f"{path}/model")
    write_json(scores, f"{path}/evaluation")
