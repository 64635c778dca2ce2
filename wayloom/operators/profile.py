"""Wide features of users: events by class, mobility networks by window, and the table of all 409.

Trips carry uid, tid, src, dst, t0, t1, first, last, length_km, duration_s; those given to the
network features also ``win``, the number of their time window from 0 to below ``n_windows``.
Place ids mean the same place in all windows (``network.match_windows`` makes them so).

Defined results: a mean over nothing is -1, a count or share of nothing 0; a third place that a
window lacks is left out of the mean over windows, as are the first two; a measure that some
window cannot define (assortativity of equal degrees) is -1 altogether; events of unknown type
count in totals only; repeated rows count each time; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats, timeparts
from . import cells, features, movements, network, places

#: Suffixes of the classes that events are counted in: all, by type, by location type.
CLASSES = ("", *[f"_{t}" for t in features.TYPES], *[f"_loc{p}" for p in features.PLACES])
MEANS = ("duration", "avg_acc", "max_acc", "angle")
#: Ordered pairs of the three most visited places.
PAIRS = tuple(permutations((1, 2, 3), 2))
NAN = float("nan")


def _filled(df: DataFrame, *keep: str) -> DataFrame:
    """Undefined numbers as 0 where they count or share, else as -1."""
    empty = lambda c: 0.0 if c.startswith(("tot_", "ptot_")) else -1.0
    own = lambda c: F.when(F.isnan(c), empty(c)).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(empty(c)))).alias(c)
    return df.select(*[F.col(c) if c in keep else own(c) for c in df.columns])


def event_wide(users: DataFrame, events: DataFrame) -> DataFrame:
    """194 features of each of ``users`` (uid): 14 over all events, 16 by type and by location type, 36 by both."""
    named = F.array(F.lit(""), F.concat(F.lit("_"), "event_type"), F.concat(F.lit("_loc"), "location_type"))
    e = events.withColumns({"cls": F.explode(named), "day": F.floor(F.col("t") / timeparts.DAY), "time": timeparts.second_of_day(F.col("t"))}).where(F.col("cls").isin(*CLASSES))
    keys = ["uid", "cls"]
    by_class = e.groupBy(*keys).agg(F.count("*").alias("tot_events"), F.sum("duration").alias("tot_duration"), *[f(c).alias(f"{n}_{c}") for c in MEANS for n, f in (("avg", F.avg), ("std", F.stddev_pop))])
    for c in ("day", "time"):
        n = e.groupBy(*keys, c).count().groupBy(*keys)
        by_class = by_class.join(n.agg(F.avg("count").alias(f"avg_events_per_{c}"), F.stddev_pop("count").alias(f"std_events_per_{c}")), keys)
    metrics = [c for c in by_class.columns if c not in keys]
    of = lambda m, s: F.max(F.when(F.col("cls") == s, F.col(m))).alias(f"{m}{s}")
    wide = by_class.groupBy("uid").agg(*[of(m, s) for s in CLASSES for m in metrics])
    shares = [stats.share(F.col(f"{m}{s}"), F.col(m)).alias(f"{m}_p{s[1:]}") for s in CLASSES[1:] for m in ("tot_events", "tot_duration")]
    wide = wide.select("*", *shares).join(features.event_cross(events), "uid")
    return _filled(users.select("uid").distinct().join(wide, "uid", "left"), "uid")


def _ranked(sup: DataFrame, place: str, rank: str) -> DataFrame:
    return sup.where("rank < 3").select("uid", F.col("lid").alias(place), (F.col("rank") + 1).alias(rank))


def window_features(trips: DataFrame, events: DataFrame) -> DataFrame:
    """Per key ``uid`` the network's sizes, degrees, the three most visited places and the ways between them, and the events there.

    Events carry uid, tid, event_type, src, dst of their trip; those at a place are those of trips that arrive there.
    """
    ends, edge = network.endpoints(trips), network.edges(trips)
    sup = network.support(ends)
    at = lambda c, i: F.max(F.when(F.col("rank") == i - 1, F.col(c)))
    out = sup.groupBy("uid").agg(F.count("*").alias("nbr_locations"), *[at("support", i).alias(f"l{i}_count") for i in (1, 2, 3)])
    out = out.join(network.gyration(ends).withColumnRenamed("gyration_m", "radius_of_gyration"), "uid").join(stats.entropy(sup, ["uid"], "support", "entropy"), "uid")
    ranked = edge.join(_ranked(sup, "src", "a"), ["uid", "src"], "left").join(_ranked(sup, "dst", "b"), ["uid", "dst"], "left")
    a, b, n = F.col("a"), F.col("b"), F.col("nbr_locations")
    ways = ranked.groupBy("uid").agg(
        F.count("*").alias("nbr_movements"),
        *[F.count_if(b == i).alias(f"l{i}_indegree") for i in (1, 2, 3)], *[F.count_if(a == i).alias(f"l{i}_outdegree") for i in (1, 2, 3)],
        *[F.coalesce(F.sum(F.when((a == i) & (b == j), F.col("weight"))), F.lit(0)).alias(f"l{i}l{j}_count") for i, j in PAIRS],
    )
    out = out.join(ways, "uid")
    for i in (1, 2, 3):
        there = lambda x, i=i: F.when(n >= i, x)
        both = F.col(f"l{i}_indegree") + F.col(f"l{i}_outdegree")
        out = out.withColumn(f"l{i}_dcentrality", there(F.when(n == 1, 1.0).otherwise(F.try_divide(both, n - 1))))
        out = out.withColumns({f"l{i}_{d}": there(F.col(f"l{i}_{d}")) for d in ("indegree", "outdegree")})
    deg = network.degrees(edge).select("uid", "density", "avg_degree", "avg_indegree", F.col("avg_indegree").alias("avg_outdegree"))
    out = out.join(deg, "uid").join(network.triangles(edge), "uid", "left").withColumn("triangles", 3 * F.coalesce("triangles", F.lit(0)) / n)
    e = events.join(_ranked(sup, "src", "a"), ["uid", "src"], "left").join(_ranked(sup, "dst", "b"), ["uid", "dst"], "left")
    kind = lambda t: F.col("event_type") == t
    happened = e.groupBy("uid").agg(
        *[F.count_if(kind(t) & (b == i)).alias(f"l{i}_{t}") for t in features.TYPES for i in (1, 2, 3)],
        *[F.count_if(kind(t) & (a == i) & (b == j)).alias(f"l{i}l{j}_{t}") for t in features.TYPES for i, j in PAIRS],
    )
    spread = movements.destination_entropy(events).groupBy("uid").agg(*[F.max(F.when(kind(t), F.col("entropy"))).alias(f"mov_entropy_{t}") for t in features.TYPES])
    made = [c for c in (*happened.columns, *spread.columns) if c != "uid"]
    return out.join(happened, "uid", "left").join(spread, "uid", "left").na.fill(0, made)


def change_features(trips: DataFrame) -> DataFrame:
    """Per user the distance of the first window's places and movements from the last's: 1 less Jaccard, 1 less cosine, and differences of numbers."""
    w = trips.groupBy("uid").agg(F.min("win").alias("w0"), F.max("win").alias("w1"))
    ends = network.endpoints(trips.withColumn("tid", F.struct("win", "tid"))).withColumn("win", F.col("tid.win"))
    out = w.select("uid")
    for rows, keys, n, s in ((ends, ["lid"], "locations", ""), (trips, ["src", "dst"], "movements", "_mov")):
        c = rows.groupBy("uid", "win", *keys).agg(F.count("*").alias("n")).join(w, "uid")
        c = c.groupBy("uid", *keys).agg(*[F.coalesce(F.sum(F.when(F.col("win") == F.col(k), F.col("n"))), F.lit(0)).cast("double").alias(x) for k, x in (("w0", "p"), ("w1", "q"))])
        p, q = F.col("p"), F.col("q")
        out = out.join(
            c.groupBy("uid").agg(
                (F.count_if(q > 0) - F.count_if(p > 0)).alias(f"delta_{n}"),
                (1 - F.count_if((p > 0) & (q > 0)) / F.count_if((p > 0) | (q > 0))).alias(f"jaccard{s}"),
                (1 - F.sum(p * q) / F.sqrt(F.sum(p * p) * F.sum(q * q))).alias(f"cosine{s}"),
            ),
            "uid",
        )
    return out


def keyed(df: DataFrame, n_windows: int) -> DataFrame:
    """Each window of a user as a user of its own."""
    return df.withColumn("uid", F.col("uid") * n_windows + F.col("win")).drop("win")


def _mean_over_windows(rows: DataFrame, n_windows: int) -> DataFrame:
    names = [c for c in rows.columns if c != "uid"]
    return rows.withColumn("uid", F.floor(F.col("uid") / n_windows)).groupBy("uid").agg(*[F.avg(c).alias(c) for c in names])


def place_features(trips: DataFrame, events: DataFrame, n_windows: int) -> DataFrame:
    """The network features that need no graph search: means of the windows, and the change from the first to the last."""
    own = _mean_over_windows(window_features(keyed(trips, n_windows), keyed(events, n_windows)), n_windows)
    return _filled(own.join(change_features(trips), "uid"), "uid")


def _searched(trips: DataFrame) -> DataFrame:
    """Per key ``uid`` what graph search and regular places tell."""
    ends, edge = network.endpoints(trips), network.edges(trips)
    sup = network.support(ends)
    regular = places.regular_places(ends, edge)
    stay = ends.join(regular.select("uid", "lid"), ["uid", "lid"], "left_semi")
    own = regular.groupBy("uid").agg(F.count("*").alias("nbr_reg_locations"))
    own = own.join(network.gyration(stay).withColumnRenamed("gyration_m", "regular_radius_of_gyration"), "uid")
    own = own.join(stats.entropy(regular, ["uid"], "support", "rentropy"), "uid")
    moved = movements.user_movements(trips, regular).drop("n_reg_traj", "avg_reg_mov_length", "std_reg_mov_length").withColumnRenamed("n_reg_movs", "nbr_reg_movements")
    g = network.graph_measures(edge)
    top = sup.where("rank < 3").groupBy("uid").agg(*[F.max(F.when(F.col("rank") == i - 1, F.col("lid"))).alias(f"p{i}") for i in (1, 2, 3)])
    pick = lambda rows, hit: F.element_at(F.transform(F.filter(rows, hit), lambda x: x["b"]), 1)
    node = lambda i: pick(F.col("node_b"), lambda x: x["lid"] == F.col(f"p{i}"))
    way = lambda i, j: F.coalesce(F.try_element_at(F.transform(F.filter("edge_b", lambda x: (x["src"] == F.col(f"p{i}")) & (x["dst"] == F.col(f"p{j}"))), lambda x: x["b"]), F.lit(1)), F.lit(0.0))
    graph = g.join(top, "uid").select(
        "uid", F.col("clustering").alias("clustering_coefficient"), "diameter", "eccentricity", F.coalesce("assortativity", F.lit(NAN)).alias("assortativity"),
        *[F.when(F.col(f"p{i}").isNotNull(), node(i)).alias(f"l{i}_bcentrality") for i in (1, 2, 3)], *[way(i, j).alias(f"l{i}l{j}_betweenness") for i, j in PAIRS],
    )
    return graph.join(moved, "uid").join(own, "uid", "left")


def imn_features(trips: DataFrame, events: DataFrame, n_windows: int) -> DataFrame:
    """118 features per user of the mobility networks of the user's windows."""
    rows = _searched(keyed(trips, n_windows))
    mean = _mean_over_windows(rows, n_windows)
    win = F.pmod("uid", F.lit(n_windows))
    user = F.floor(F.col("uid") / n_windows)
    ends = rows.select(user.alias("uid"), win.alias("win"), "nbr_reg_locations").join(_rg(trips, n_windows), ["uid", "win"])
    last, first = (lambda c: F.max_by(c, "win")), (lambda c: F.min_by(c, "win"))
    delta = ends.groupBy("uid").agg((last("nbr_reg_locations") - first("nbr_reg_locations")).alias("delta_reg_locations"), (last("rg") - first("rg")).alias("delta_rg"))
    return place_features(trips, events, n_windows).join(_filled(mean.join(delta, "uid"), "uid"), "uid")


def _rg(trips: DataFrame, n_windows: int) -> DataFrame:
    g = network.gyration(network.endpoints(keyed(trips, n_windows)))
    return g.select(F.floor(F.col("uid") / n_windows).alias("uid"), F.pmod("uid", F.lit(n_windows)).alias("win"), F.col("gyration_m").alias("rg"))


def joined(*parts: DataFrame) -> DataFrame:
    """The features of all families per user of the first one; what another one lacks is undefined."""
    return _filled(reduce(lambda a, b: a.join(b, "uid", "left"), parts), "uid", "crash")


def measured_names() -> list[str]:
    """The 46 names of features of passed cells."""
    return [f"{n}_{m}" for m in cells.MEASURES for n in ("reg", "occ")]


def labelled(table: DataFrame, crashes: DataFrame) -> DataFrame:
    """With ``crash`` 1 for users of ``crashes`` (uid), else 0."""
    bad: Column = F.coalesce("crash", F.lit(0))
    return table.join(crashes.select("uid").distinct().withColumn("crash", F.lit(1)), "uid", "left").withColumn("crash", bad)
