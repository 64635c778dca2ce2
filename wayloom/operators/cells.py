"""Quadtree cell counters, their roll-up to periods, and users' means over the cells they pass.

Defined results: points without coordinates or time, and events of users without a trip in
that month, count nowhere; repeated rows count each time; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, stats, timeparts

#: Event types, those with speeds and accelerations, and the counters of a cell.
TYPES = ("A", "B", "C", "Q", "start", "stop")
MEASURED = ("A", "B", "C", "Q")
SUMS = ("speed", "max_acc", "avg_acc")
COUNTERS = (
    "nbr_traj_start", "nbr_traj_stop", "nbr_traj_move", "traj_speed_sum", "traj_speed_count", *[f"nbr_evnt_{t}" for t in TYPES],
    *[f"{s}_{t}_sum" for t in MEASURED for s in SUMS], "nbr_crash",
)
#: The measures made of them: counts as they are, and means per event or step.
MEASURES = (
    "nbr_traj_start", "nbr_traj_stop", "nbr_traj_move", "avg_traj_speed", *[f"nbr_evnt_{t}" for t in TYPES], *[f"avg_{s}_{t}" for t in MEASURED for s in SUMS], "nbr_crash",
)
DEPTH = 16


def month_of(t) -> Column:
    return timeparts.month_index(F.timestamp_seconds(F.floor(t)))


def _part(df: DataFrame, **values: Column) -> DataFrame:
    zero = lambda c: F.lit(0.0) if c == "traj_speed_sum" else F.lit(0).cast("long")
    return df.select("month_idx", geo.quadtree_path("lon", "lat").alias("path"), *[(values[c].cast("long") if c in values and c != "traj_speed_sum" else values.get(c, zero(c))).alias(c) for c in COUNTERS])


def counters(steps: DataFrame, trips: DataFrame, events: DataFrame, crashes: DataFrame) -> DataFrame:
    """24 counters per month and cell: starts, stops, moves, speeds, events by type with their sums, crashes.

    Points belong to the month their trip starts in; events and crashes (lon, lat, t) to their own, if the user has a trip then.
    """
    own = trips.select("uid", "tid", F.col("n_points").alias("size"), month_of(F.col("t0")).alias("month_idx"))
    s = steps.join(own, ["uid", "tid"])
    first, end = F.col("k") == 1, F.col("k") == F.col("size")
    moved = _part(s, nbr_traj_start=first, nbr_traj_stop=end & ~first, nbr_traj_move=~first & ~end, traj_speed_count=~first, traj_speed_sum=F.when(first, 0.0).otherwise(F.col("speed")))
    active = own.select("uid", "month_idx").distinct()
    at = lambda df: df.withColumn("month_idx", month_of(F.col("t"))).join(active, ["uid", "month_idx"], "left_semi")
    kind = lambda t: F.col("event_type") == t
    happened = _part(at(events), **{f"nbr_evnt_{t}": kind(t) for t in TYPES}, **{f"{m}_{t}_sum": F.when(kind(t), F.col(m)).otherwise(0) for t in MEASURED for m in SUMS})
    every = moved.union(happened).union(_part(at(crashes), nbr_crash=F.lit(1)))
    return every.groupBy("month_idx", "path").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def _sums(df: DataFrame) -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTERS if c in df.columns]


def roll_up(cells: DataFrame, depth: int) -> DataFrame:
    """Counters of the ancestors at a depth, over all months."""
    return cells.groupBy(F.substring("path", 1, depth).alias("path")).agg(*_sums(cells))


def roll_up_periods(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """Counters per period (idx, lo, hi: months from lo to before hi) and cell; a month counts in every period that holds it."""
    joined = cells.join(F.broadcast(spans), (F.col("month_idx") >= F.col("lo")) & (F.col("month_idx") < F.col("hi")))
    return joined.groupBy("idx", "path").agg(*_sums(cells))


def tree_nodes(paths: DataFrame, least: int, depth: int = DEPTH) -> DataFrame:
    """The root and all cells with at least so many of the points."""
    flat = paths.groupBy("path").count().select("count", F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: F.substring(F.col("path"), F.lit(1), d))).alias("node"))
    return flat.groupBy("node").agg(F.sum("count").alias("n")).where((F.col("n") >= least) | (F.col("node") == "")).select(F.col("node").alias("path"))


def in_tree(paths: DataFrame, nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Each distinct path's deepest ancestor among the tree's nodes."""
    flat = paths.select("path").distinct().select("path", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn("node", F.expr("substring(path, 1, d)"))
    return flat.join(nodes.select(F.col("path").alias("node")), "node").groupBy("path").agg(F.max_by("node", "d").alias("ancestor"))


def measures() -> list[Column]:
    """The 23 measures of a cell from its counters; a mean over nothing is 0."""
    mean = lambda m: stats.share(F.col("traj_speed_sum"), F.col("traj_speed_count")) if m == "avg_traj_speed" else stats.share(F.col(f"{m[4:]}_sum"), F.col(f"nbr_evnt_{m[-1]}"))
    return [(mean(m) if m.startswith("avg_") else F.col(m).cast("double")).alias(m) for m in MEASURES]


def collective(visits: DataFrame, cells: DataFrame, regular: DataFrame, nodes: DataFrame) -> DataFrame:
    """46 features per user: means of the cells' measures, weighted by trips through the cell, over regular and occasional cells.

    Cells of one ancestor in the tree are summed first. A user without cells of one sort has nulls there.
    """
    w = visits.groupBy("uid", "path").agg(F.countDistinct("tid").alias("w"))
    up = in_tree(visits, nodes)
    flagged = w.join(cells, "path").join(up, "path").join(regular.select("uid", "path", F.lit(True).alias("reg")).distinct(), ["uid", "path"], "left").withColumn("reg", F.coalesce("reg", F.lit(False)))
    grouped = flagged.groupBy("uid", "reg", "ancestor").agg(F.sum("w").alias("w"), *_sums(cells)).select("uid", "reg", "w", *measures())
    mean = lambda m, r: F.try_divide(F.sum(F.when(F.col("reg") == r, F.col(m) * F.col("w"))), F.sum(F.when(F.col("reg") == r, F.col("w"))))
    return grouped.groupBy("uid").agg(*[mean(m, r).alias(f"{n}_{m}") for m in MEASURES for n, r in (("reg", True), ("occ", False))])
