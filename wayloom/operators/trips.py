"""Trips: segmentation of positions, speeds, and interval joins of events to trips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

def gap_points(pos: DataFrame, gap_s: float, quality: int = 3) -> DataFrame:
    """Points of good quality with their trip number: a pause longer than the gap begins a new one."""
    good = pos.where(F.col("gps_quality") >= quality)
    own = Window.partitionBy("uid").orderBy("t", "pid")
    new = F.when(F.col("t") - F.lag("t").over(own) > gap_s, 1).otherwise(0)
    return good.withColumn("__new", new).withColumn("tid", F.sum("__new").over(own).cast("long")).drop("__new")


def steps(points: DataFrame) -> DataFrame:
    """Points of trips with the step from the point before: km, seconds, km/h."""
    w = Window.partitionBy("uid", "tid").orderBy("t", "pid")
    p = points.withColumns({"plon": F.lag("lon").over(w), "plat": F.lag("lat").over(w), "pt": F.lag("t").over(w), "k": F.row_number().over(w)})
    p = p.withColumns({"km": geo.haversine_km("plon", "plat", "lon", "lat"), "dt": F.col("t") - F.col("pt")})
    return p.withColumn("speed", geo.speed_kmh("km", "dt"))


def trips_of(points: DataFrame) -> DataFrame:
    """A row per trip of more than one point."""
    out = steps(points).groupBy("uid", "tid").agg(
        F.count("*").alias("n_points"), F.min("t").alias("t0"), F.max("t").alias("t1"),
        F.coalesce(F.sum("km"), F.lit(0.0)).alias("length_km"), (F.max("t") - F.min("t")).alias("duration_s"),
        F.min_by("lid", F.struct("t", "pid")).alias("src"), F.max_by("lid", F.struct("t", "pid")).alias("dst"),
        F.min_by(F.struct("lon", "lat"), F.struct("t", "pid")).alias("first"), F.max_by(F.struct("lon", "lat"), F.struct("t", "pid")).alias("last"),
    )
    return out.where("n_points > 1")


def long_enough(trips: DataFrame, min_km: float, min_s: float) -> DataFrame:
    return trips.where((F.col("length_km") > min_km) & (F.col("duration_s") > min_s))


def busy_users(trips: DataFrame, least: int) -> DataFrame:
    return trips.withColumn("__n", F.count("*").over(Window.partitionBy("uid"))).where(F.col("__n") >= least).drop("__n")


def interval_join(events: DataFrame, trips: DataFrame) -> DataFrame:
    """Events within a trip of their user, both bounds included.

    The user is the hash key and the range a residual; a day bucket on both sides keeps
    users with very many trips from comparing each event with all of them.
    """
    day = lambda x: F.floor(x / 86400).cast("long")
    t = trips.select("uid", "tid", "t0", "t1", F.explode(F.sequence(day(F.col("t0")), day(F.col("t1")))).alias("__day"))
    return events.withColumn("__day", day(F.col("t"))).join(t, ["uid", "__day"]).where("t between t0 and t1").drop("__day")


class Segmenter:
    """Exact segmentation of one user's ordered points by pauses, stays and jumps."""

    def __init__(self, max_speed: float = 0.07, space_km: float = 0.05, time_s: float = 1200.0, min_gap_s: float = 300.0):
        self.max_speed, self.space_km, self.time_s, self.min_gap_s = max_speed, space_km, time_s, min_gap_s

    @staticmethod
    def km(a: tuple, b: tuple) -> float:
        lon1, lat1, lon2, lat2 = np.radians([a[1], a[2], b[1], b[2]])
        h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
        return float(2 * geo.RADIUS_KM * np.arcsin(np.sqrt(min(h, 1.0))))

    def run(self, points: Iterator[tuple]) -> tuple[list[tuple], list[tuple]]:
        """(t, lon, lat, status, quality) in order -> trips (tid, points, km), start and stop events (tid, kind, t, lon, lat)."""
        trips, marks = [], []
        own: list[tuple] = []
        tid, length, fresh, ref, good = 0, 0.0, True, None, None  # good: the last point, if of quality and a stop
        for t, lon, lat, status, quality in points:
            if quality >= 3:
                good = (lon, lat) if status == 2 else None
            elif status == 0 and good is not None:
                lon, lat = good
                good = None
            else:
                good = None
                continue
            p = (t, lon, lat)
            if status in (0, 2):
                marks.append((tid, "start" if status == 0 else "stop", t, lon, lat))
            if not own:
                own, ref, fresh = [p], p, True
                continue
            step, far, waited = self.km(own[-1], p), self.km(ref, p), t - ref[0]
            if far > self.max_speed * waited:
                continue
            if t - own[-1][0] > self.time_s or (waited > self.time_s and far < self.space_km):
                if len(own) > 1 and not fresh:
                    trips.append((tid, own, length))
                left = own[-1]
                own, ref, length, fresh, tid = [left, p], p, 0.0, True, tid + 1
                before = left[0]
                continue
            if fresh:
                # The first place of a trip is held back until it is known when it was left.
                head = own[0]
                if len(own) > 1:
                    leave = own[1][0] - (t - own[1][0])
                    own = [(leave, head[1], head[2]), own[1]] if leave > before + self.min_gap_s else [own[1]]
                else:
                    own = []
                fresh = False
            own.append(p)
            length += step
            if far > self.space_km:
                ref = p
        if len(own) > 1 and not fresh:
            trips.append((tid, own, length))
        return trips, marks


SEGMENTS = "uid long, kind string, tid long, k long, t double, lon double, lat double, length_km double"


def segment_exact(pos: DataFrame, **limits: float) -> DataFrame:
    """Trip points and start/stop events in one schema; one user's points are one group."""
    seg = Segmenter(**limits)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "pid"])
        trips, marks = seg.run(pdf[["t", "lon", "lat", "status", "gps_quality"]].itertuples(index=False, name=None))
        uid = pdf["uid"].iloc[0]
        rows = [(uid, "point", tid, k, *p, km) for tid, own, km in trips for k, p in enumerate(own)]
        rows += [(uid, kind, tid, k, t, lon, lat, None) for k, (tid, kind, t, lon, lat) in enumerate(marks)]
        return pd.DataFrame(rows, columns=["uid", "kind", "tid", "k", "t", "lon", "lat", "length_km"])

    return pos.select("uid", "pid", "t", "lon", "lat", "status", "gps_quality").groupBy("uid").applyInPandas(one, SEGMENTS)
