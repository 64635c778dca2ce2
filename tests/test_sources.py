"""Readers and sinks: round trips, with bad rows, nulls and empty tables."""

import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wayloom.operators import movements, periods
from wayloom.sources import readers


def test_positions(spark, tmp_path):
    rows = [("u1", "2017-01-02 03:04:05", 12_500_000, 41_900_000, 3, 1), ("u1", None, None, 41_000_000, None, 0), ("u0", "2017-01-01 00:00:00", -1_000_000, 0, 1, 2)]
    spark.createDataFrame(rows, "`T&K_VOUCHER_ID` string, TIMESTAMP_LOCAL string, LONGITUDE long, LATITUDE long, GPS_QUALITY int, STATUS int").write.parquet(f"{tmp_path}/p")
    got = sorted(map(tuple, readers.positions(spark, f"{tmp_path}/p").collect()), key=str)
    assert got == sorted([("u1", datetime(2017, 1, 2, 3, 4, 5), 12.5, 41.9, 3, 1), ("u1", None, None, 41.0, None, 0), ("u0", datetime(2017, 1, 1), -1.0, 0.0, 1, 2)], key=str)


def test_crashes_and_events(spark):
    c = spark.createDataFrame([(1, "Y"), (2, "N"), (3, None)], "id int, FLAG_VALIDITY string")
    assert [r.id for r in readers.crashes(c).collect()] == [1]
    e = spark.createDataFrame([(-3.7, 2.2, 50.9, 10.0, 1.0), (None, -1.0, None, None, None)], "max_acc double, avg_acc double, speed double, angle double, duration double")
    assert [tuple(r) for r in readers.clean_events(e).collect()] == [(3, 2, 50, 10, 1), (None, 1, None, None, None)]


def test_user_lists(spark, tmp_path):
    (tmp_path / "u.csv").write_text("uid,x\n7,a\n8,b\n7,c\n")
    assert sorted(r.uid for r in readers.users(spark, f"{tmp_path}/u.csv").collect()) == ["7", "8"]
    df = spark.createDataFrame([("7", 1), ("9", 2), ("7", 3), (None, 4)], "uid string, n int")
    assert sorted(r.n for r in readers.of_users(df, spark.createDataFrame([("7",), ("7",), ("8",)], "uid string")).collect()) == [1, 3]
    assert readers.distinct_users(df).count() == 3
    assert sorted(r.n for r in readers.unfinished(df, spark.createDataFrame([("7",)], "uid string")).collect()) == [2, 4]


def test_trips(spark, tmp_path, capsys):
    spark.createDataFrame([(1, 5.0, 100.0), (2, 0.0, 100.0), (3, 5.0, 0.0), (4, None, 9.0)], "tid int, length_km double, duration_s double").write.parquet(f"{tmp_path}/t")
    df = readers.trips(spark, f"{tmp_path}/t")
    assert [r.tid for r in df.collect()] == [1]
    df.explain("formatted")
    assert "GreaterThan(length_km,0.0)" in capsys.readouterr().out.replace("\n", "")


def test_geojson(spark):
    line = json.dumps({"type": "LineString", "coordinates": [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]})
    df = spark.createDataFrame([(line,), ("broken",), (None,)], "g string")
    assert [r.p for r in df.select(readers.geojson_points("g").alias("p")).collect()] == [[(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], None, None]


def test_json(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"uid": "1", "x": 2}\n{"uid": "2"}\n')
    assert sorted((r.uid, r.x) for r in readers.json_lines(spark, f"{tmp_path}/a.json.gz").collect()) == [("1", 2), ("2", None)]
    docs = [{"TIMESTAMP_LOCAL": {"$date": f"2017-0{m}-01T00:00:00.000Z"}, "n": {"$numberLong": str(m)}, "s": "x"} for m in (1, 2, 3)]
    (tmp_path / "b.json").write_text(json.dumps(docs))
    got = readers.extended_json(spark, f"{tmp_path}/b.json", "2017-02-01 00:00:00", "2017-03-01 00:00:00").collect()
    assert [(r.n, r.s, r.ts) for r in got] == [(2, "x", datetime(2017, 2, 1))]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.5), ("b", None, None)], "uid string, n int, x double")
    readers.write_table(df, f"{tmp_path}/t", "uid")
    readers.write_table(df.where("uid = 'a'"), f"{tmp_path}/t", "uid")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    readers.write_json(df, f"{tmp_path}/j")
    assert sorted((r.uid, r.n) for r in readers.json_lines(spark, f"{tmp_path}/j", df.schema).collect()) == [("a", 1), ("b", None)]
    readers.write_dataset([df, spark.createDataFrame([("c", "z")], "uid string, more string")], f"{tmp_path}/d")
    got = spark.read.csv(f"{tmp_path}/d", header=True)
    assert got.columns == ["uid", "n", "x", "more"] and got.count() == 3
    readers.write_cells(spark.createDataFrame([(24288, "0123", 4), (24289, "0123", 5)], "month_idx int, path string, n int"), f"{tmp_path}/c")
    assert spark.read.schema("month_idx int, path string, n int").parquet(f"{tmp_path}/c").where("month_idx = 24289").first().n == 5
    readers.write_network(spark.createDataFrame([("u", 1, 9), ("u", 0, 3)], "uid string, lid int, support int"), spark.createDataFrame([("u", 0, 1, 2)], "uid string, src int, dst int, n int"), f"{tmp_path}/n")
    line = spark.read.json(f"{tmp_path}/n").first()
    assert [p.lid for p in line.places] == [0, 1] and line.movements[0].n == 2


def test_model_sink(spark, tmp_path):
    from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    data = spark.createDataFrame([(Vectors.dense([float(i)]), float(i > 4)) for i in range(10)], ["features", "label"])
    readers.write_model(DecisionTreeClassifier().fit(data), spark.createDataFrame([("f1", 1.0)], "metric string, value double"), f"{tmp_path}/m")
    assert DecisionTreeClassificationModel.load(f"{tmp_path}/m/model").numNodes == 3
    assert spark.read.json(f"{tmp_path}/m/evaluation").first().value == 1.0


def test_rejects_and_finite_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (float("nan"), 2.0), (float("-inf"), 2.0), (500.0, 2.0)], "lon double, lat double")
    named = readers.with_rejects(df, lon=F.col("lon").between(-180, 180), lat=F.col("lat").between(-90, 90))
    assert [r.reject for r in named.collect()] == [None, "lon", "lon", "lon", "lon"]
    assert movements.finite(df, "lon", "lat").count() == 2
    assert [r.lon for r in movements.clean(df, "lon").collect()] == [1.0, 0.0, 0.0, 0.0, 500.0]


EMPTY = "uid long, tid long, src long, dst long, t0 double, t1 double, length_km double, duration_s double"


@pytest.mark.parametrize("f", [movements.movement_stats, movements.travel_minutes, movements.place_days, movements.movement_days, movements.first_seen])
def test_movements_of_none_and_of_nulls(spark, f):
    assert f(spark.createDataFrame([], EMPTY)).count() == 0
    one = [(1, 1, 5, 6, 100.0, 8000.0, 2.0, 7900.0)]
    odd = [*one, *one, (1, 2, None, 6, None, None, None, None)]
    assert f(spark.createDataFrame(odd, EMPTY)).count() >= 1


def test_periods_of_none(spark):
    none = spark.createDataFrame([], "uid long, idx long, label int")
    assert periods.train_test(none).count() == 0
