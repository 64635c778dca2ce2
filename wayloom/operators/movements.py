"""Statistics of movements between places: lengths, durations, hours of travel, regular ones, and their events.

Trips carry uid, tid, src, dst, t0, t1, length_km, duration_s. Defined results: trips without
a place or a time count nowhere; repeated trips count each time; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, timeparts


def movement_stats(trips: DataFrame) -> DataFrame:
    """Per movement (uid, src, dst): support, and median, mean and deviation of length and duration within their quartile fences."""
    keys = ["uid", "src", "dst"]
    out = trips.groupBy(*keys).agg(F.count("*").alias("support"))
    for c, n in (("length_km", "km"), ("duration_s", "s")):
        own = stats.iqr_filter(trips.select(*keys, c), keys, c).groupBy(*keys)
        out = out.join(own.agg(F.percentile(c, 0.5).alias(f"median_{n}"), F.avg(c).alias(f"avg_{n}"), F.stddev_pop(c).alias(f"std_{n}")), keys)
    return out


def user_movements(trips: DataFrame, regular: DataFrame) -> DataFrame:
    """Per user: lengths and durations of all trips and of those between regular places (uid, lid), each within quartile fences.

    Without regular trips their lengths are null, and their durations those of all trips.
    """
    place = regular.select("uid", "lid").distinct()
    between = trips.join(place.withColumnRenamed("lid", "src"), ["uid", "src"], "left_semi").join(place.withColumnRenamed("lid", "dst"), ["uid", "dst"], "left_semi")
    out = trips.select("uid").distinct()
    for rows, n in ((trips, "mov"), (between, "reg_mov")):
        for c, m in (("length_km", "length"), ("duration_s", "duration")):
            own = stats.iqr_filter(rows.select("uid", c), ["uid"], c).groupBy("uid")
            out = out.join(own.agg(F.avg(c).alias(f"avg_{n}_{m}"), F.stddev_pop(c).alias(f"std_{n}_{m}")), "uid", "left")
    n = between.groupBy("uid").agg(F.count("*").alias("n_reg_traj"), F.countDistinct("src", "dst").alias("n_reg_movs"))
    out = out.join(n, "uid", "left").na.fill(0, ["n_reg_traj", "n_reg_movs"])
    return out.withColumns({f"{s}_reg_mov_duration": F.coalesce(f"{s}_reg_mov_duration", f"{s}_mov_duration") for s in ("avg", "std")})


def travel_minutes(trips: DataFrame) -> DataFrame:
    """Trips by next place and minute of the day on the way, both ends included; those over midnight add nothing."""
    a, b = (F.floor(timeparts.second_of_day(F.col(c)) / 60) for c in ("t0", "t1"))
    own = trips.select("uid", "dst", a.alias("a"), b.alias("b")).where("a <= b")
    return own.select("uid", "dst", F.explode(F.sequence("a", "b")).alias("minute")).groupBy("uid", "dst", "minute").agg(F.count("*").alias("n"))


def hourly(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Every full hour from ``a`` on, up to ``b``, as ``t``; rows whose end is before their start have none."""
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col(b) - F.col(a)) / 3600))
    return rows.where(F.col(b) >= F.col(a)).withColumn("k", F.explode(steps)).withColumn("t", F.col(a) + 3600 * F.col("k")).drop("k")


def _days(times: DataFrame, *keys: str) -> DataFrame:
    t = F.col("t")
    s = times.select(*keys, timeparts.is_weekend(t).alias("weekend"), timeparts.slot_of_day(t).alias("slot"), F.floor(t / timeparts.DAY).alias("day"))
    return s.groupBy(*keys, "weekend", "slot").agg(F.countDistinct("day").alias("n_days"))


def place_days(trips: DataFrame) -> DataFrame:
    """Distinct days at a place by weekend and slot: when trips leave and arrive, and every hour until the next trip leaves."""
    w = Window.partitionBy("uid").orderBy("t0", "tid")
    waits = trips.select("uid", F.lag("dst").over(w).alias("lid"), F.lag("t1").over(w).alias("a"), F.col("t0").alias("b")).where("lid is not null")
    times = trips.select("uid", F.col("src").alias("lid"), F.col("t0").alias("t")).union(trips.select("uid", "dst", "t1")).union(hourly(waits, "a", "b").select("uid", "lid", "t"))
    return _days(times, "uid", "lid")


def movement_days(trips: DataFrame) -> DataFrame:
    """Distinct days on a movement by weekend and slot, at every hour of its trips and at their ends."""
    times = hourly(trips, "t0", "t1").select("uid", "src", "dst", "t").union(trips.select("uid", "src", "dst", "t1"))
    return _days(times, "uid", "src", "dst")


def first_seen(trips: DataFrame) -> DataFrame:
    """Movements of a user numbered from 0 as they are first made; (uid, src, dst, mid, n)."""
    m = trips.groupBy("uid", "src", "dst").agg(F.min(F.struct("t0", "tid")).alias("o"), F.count("*").alias("n"))
    return m.select("uid", "src", "dst", (F.row_number().over(Window.partitionBy("uid").orderBy("o")) - 1).cast("long").alias("mid"), "n")


def destination_entropy(events: DataFrame) -> DataFrame:
    """Per user and event type the entropy of the destinations of the trips with such events (uid, event_type, dst)."""
    n = events.groupBy("uid", "event_type", "dst").agg(F.count("*").alias("n"))
    return stats.entropy(n, ["uid", "event_type"], "n", "entropy")


def max_normalised(df: DataFrame, key: str, x: str) -> DataFrame:
    """``x`` as a share of the key's greatest; 0 where that is 0."""
    return df.withColumn("share", stats.share(F.col(x), F.max(x).over(Window.partitionBy(key))))


def finite(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    good = F.lit(True)
    for c in cols:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return df.where(good)


def clean(df: DataFrame, *cols: str, fill: float = 0.0) -> DataFrame:
    """The columns with ``fill`` for null, not a number and infinity."""
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), fill).otherwise(F.coalesce(c, F.lit(fill))) for c in cols})
