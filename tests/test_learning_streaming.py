"""Oversampling, scores, and trips from a stream against trips of the whole table."""

import math

import pytest
from pyspark.sql import functions as F

from wayloom.operators import learning, trips
from wayloom.sources import testdata as td
from wayloom.streaming import segments

SF = "/root/testdata/sf0.001"


def test_smote_evens_out_between_neighbours(spark):
    rows = [(i, 1, float(i), 2.0 * i) for i in range(4)] + [(10 + i, 0, 50.0, 1.0) for i in range(11)] + [(99, 1, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    got = learning.smote(df, "id", "y", ["a", "b"], block=2).collect()
    assert len(got) == 7 and all(math.isclose(r.b, 2 * r.a) and 0 <= r.a <= 3 for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, learning.smote(df, "id", "y", ["a", "b"], block=100).collect()))
    assert learning.smote(df.where("y = 0"), "id", "y", ["a", "b"]).count() == 0


def test_scale_and_report(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0)], "id long, a double, b double")
    got = {r.id: (r.a, r.b) for r in learning.scale(df, learning.fit_scaling(df, ["a", "b"]), ["a", "b"]).collect()}
    assert got == {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (None, 0.0)}
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "t int, g int")
    one = {r["class"]: r for r in learning.report(df, "t", "g").collect()}[1]
    assert (one.support, one.precision, one.recall, one.accuracy) == (2, 1.0, 0.5, 0.75)


def test_search_and_risk(spark):
    df = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 3.0 + (F.col("id") % 5) * 0.1).alias("a"), F.lit(1.0).alias("b"))
    model, pick = learning.search(df, "y", ["a", "b"], model="tree", metric="recall", draws=2, folds=2)
    assert set(pick) == set(learning.GRID) and learning.importances(model, ["a", "b"])[0][0] == "a"
    assert learning.risk(model, df, ["a", "b"]).where("flag <> y").count() == 0


def test_stream_gives_the_same_trips(spark, tmp_path):
    pos = td.positions(spark, SF).where("gps_quality >= 3").select("uid", "pid", F.timestamp_seconds("t").alias("ts"), "t", "lon", "lat")
    end = pos.agg(F.max("t")).first()[0] + 10 * td.GAP_S
    cuts = pos.approxQuantile("t", [0.3, 0.6], 0) + [1e18]
    low = -1e18
    src = str(tmp_path / "in")
    for k, hi in enumerate(cuts):
        pos.where((F.col("t") > low) & (F.col("t") <= hi)).select("uid", "ts", "lon", "lat").coalesce(1).write.mode("append").parquet(f"{src}/p{k}")
        low = hi
    # A user who comes much later moves the watermark past all others.
    for k in (1, 2):
        spark.createDataFrame([(-1, 0.0, 0.0)], "uid long, lon double, lat double").withColumn("ts", F.timestamp_seconds(F.lit(end * 1.0 + k))).select("uid", "ts", "lon", "lat").coalesce(1).write.parquet(f"{src}/q{k}")
    stream = spark.readStream.schema("uid long, ts timestamp, lon double, lat double").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = segments.trips(stream, td.GAP_S).writeStream.format("memory").queryName("stream_trips").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    q.stop()
    own = lambda df: sorted((r.uid, r.tid, r.n_points, round(r.t0, 3), round(r.t1, 3), round(r.length_km, 6)) for r in df.collect())
    whole = own(trips.trips_of(trips.gap_points(td.positions(spark, SF), td.GAP_S)))
    got = own(spark.table("stream_trips"))
    assert [r[0] for r in got] and got == whole
