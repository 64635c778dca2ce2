"""Feature vectors of trips and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeparts

TYPES = ("Q", "B", "A", "C", "stop", "start")
PLACES = ("0", "1", "2")


def _or(value: Column, empty: float) -> Column:
    return F.coalesce(value.cast("double"), F.lit(float(empty)))


def trip_features(trips: DataFrame) -> DataFrame:
    """51 features per user: totals, averages and deviations, per active day, per part of the day."""
    t = trips.withColumns({"day": F.floor(F.col("t0") / timeparts.DAY), "part": timeparts.part_of_day(F.col("t0")), "speed": F.try_divide(F.col("length_km"), F.col("duration_s") / 3600)})
    days = t.groupBy("uid", "day").agg(F.count("*").alias("traj"), F.sum("length_km").alias("km"), F.sum("duration_s").alias("traveltime"), F.max("speed").alias("max_speed"), F.min("speed").alias("min_speed"))
    per_day = days.groupBy("uid").agg(*[f(c).alias(f"{n}_{c}_per_day") for c in ("traj", "km", "traveltime", "max_speed", "min_speed") for n, f in (("avg", F.avg), ("std", F.stddev_pop))])
    aggs = [F.count("*").cast("double").alias("tot_traj"), F.sum("length_km").alias("tot_km"), F.sum("duration_s").alias("tot_traveltime")]
    for n, c in (("km", "length_km"), ("traveltime", "duration_s"), ("speed", "speed")):
        aggs += [F.avg(c).alias(f"avg_{n}"), F.stddev_pop(c).alias(f"std_{n}")]
    for k, p in enumerate(timeparts.PARTS):
        own = lambda c, k=k: F.when(F.col("part") == k, F.col(c))
        aggs += [F.count_if(F.col("part") == k).cast("double").alias(f"{p}_traj"), _or(F.sum(own("length_km")), 0).alias(f"{p}_km"), _or(F.sum(own("duration_s")), 0).alias(f"{p}_ttime"), _or(F.avg(own("speed")), -1).alias(f"{p}_avg_speed"), _or(F.stddev_pop(own("speed")), -1).alias(f"{p}_std_speed")]
    out = t.groupBy("uid").agg(*aggs).join(per_day, "uid")
    for p in timeparts.PARTS:
        for n, whole in (("traj", "tot_traj"), ("km", "tot_km"), ("ttime", "tot_traveltime")):
            out = out.withColumn(f"{p}_n{n}", F.coalesce(F.try_divide(F.col(f"{p}_{n}"), F.col(whole)), F.lit(0.0)))
    return out


def event_features(events: DataFrame, by: str, name: str) -> DataFrame:
    """Rows (uid, class) with counts, shares, per-day and per-time-of-day rates, durations and accelerations."""
    e = events.withColumns({"day": F.floor(F.col("t") / timeparts.DAY), "tod": timeparts.second_of_day(F.col("t"))})
    keys = ["uid", by]
    rate = lambda c: e.groupBy(*keys, c).count().groupBy(*keys).agg(F.avg("count").alias(f"avg_events_per_{name}_{c}"), F.stddev_pop("count").alias(f"std_events_per_{name}_{c}"))
    main = e.groupBy(*keys).agg(
        F.count("*").alias("tot_events"), F.sum("duration").alias("tot_duration"),
        *[f(c).alias(f"{n}_{c}") for c in ("duration", "avg_acc", "max_acc", "angle") for n, f in (("avg", F.avg), ("std", F.stddev_pop))],
    )
    user = Window.partitionBy("uid")
    main = main.withColumns({"p_events": F.col("tot_events") / F.sum("tot_events").over(user), "p_duration": F.coalesce(F.try_divide(F.col("tot_duration"), F.sum("tot_duration").over(user)), F.lit(0.0))})
    return main.join(rate("day"), keys).join(rate("tod"), keys)


def event_cross(events: DataFrame) -> DataFrame:
    """Wide counts and shares of types by location types."""
    pairs = [(a, b) for a in TYPES for b in PLACES]
    n = lambda a, b: F.count_if((F.col("event_type") == a) & (F.col("location_type") == b))
    return events.groupBy("uid").agg(*[n(a, b).alias(f"tot_events_type_{a}_loc{b}") for a, b in pairs], *[(n(a, b) / F.count("*")).alias(f"ptot_events_type_{a}_loc{b}") for a, b in pairs])


def event_grouping_sets(events: DataFrame) -> DataFrame:
    """Counts by user: over all, by type, by location type, by both."""
    flat = events.select("uid", "event_type", "location_type", "duration")
    sets = [[F.col("uid")], [F.col("uid"), F.col("event_type")], [F.col("uid"), F.col("location_type")], [F.col("uid"), F.col("event_type"), F.col("location_type")]]
    return flat.groupingSets(sets, "uid", "event_type", "location_type").agg(F.count("*").alias("n_events"), F.sum("duration").alias("tot_duration"))
