"""All registered queries by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, stats, timeparts
from ..operators import cells, features, learning, movements, network, periods, places, profile, trajectories, trips
from ..sources import testdata as td
from . import oracles


def r6(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles rounded to 6 decimals, as the SQL has them; sums of floats depend on their order beyond that."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _points(s, d):
    return trips.gap_points(td.positions(s, d), td.GAP_S)


def _trips(s, d):
    return trips.trips_of(_points(s, d))


def _steps(s, d):
    return trips.steps(_points(s, d)).where("pt is not null")


def trip_gap_sessions(s, d):
    return r6(_trips(s, d).select("uid", "tid", "n_points", "length_km", "duration_s", "src", "dst"))


def trip_features(s, d):
    return r6(features.trip_features(_trips(s, d)))


def trip_segment_exact(s, d):
    return trips.segment_exact(td.positions(s, d), time_s=td.GAP_S)


def distance_spherical(s, d):
    return r6(_steps(s, d).select("pid", geo.spherical_m("plon", "plat", "lon", "lat").alias("d_m")))


def distance_haversine(s, d):
    return r6(_steps(s, d).select("pid", F.col("km").alias("d_km")))


def bearing(s, d):
    b = geo.bearing("plon", "plat", "lon", "lat")
    return r6(_steps(s, d).where("plon <> lon or plat <> lat").select("pid", b.alias("bearing")))


def point_speed(s, d):
    return r6(_steps(s, d).select("pid", "speed"))


def closest_point(s, d):
    c = geo.closest_on_segment("plon", "plat", "lon", "lat", F.lit(12.45), F.lit(41.85))
    return r6(_steps(s, d).select("pid", c.alias("c")).select("pid", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"), F.col("c.u").alias("u")))


def point_at_time(s, d):
    p = geo.point_at("plon", "plat", "pt", "lon", "lat", "t", F.col("pt") + 600)
    return r6(_steps(s, d).select("pid", p.alias("p")).select("pid", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat")))


def quadtree_path(s, d):
    return td.positions(s, d).select("pid", geo.quadtree_path("lon", "lat").alias("path"))


def geohash_cells(s, d):
    p = td.positions(s, d)
    return p.groupBy("uid").agg(F.countDistinct(geo.geohash_cell("lon", "lat", 5)).alias("k_min"), F.countDistinct(geo.geohash_cell("lon", "lat", 7)).alias("k_max"))


def _cells(s, d):
    at = td.positions(s, d).select(F.col("pid").alias("eid"), "lon", "lat")
    crash = td.crashes(s, d).select(F.col("cid").alias("eid"), "uid", "t")
    p = _points(s, d)
    return cells.counters(trips.steps(p), trips.trips_of(p), td.events(s, d).join(at, "eid"), crash.join(at, "eid"))


def cell_counters(s, d):
    return r6(_cells(s, d))


def cell_rollup(s, d):
    return r6(cells.roll_up(_cells(s, d), 12))


#: The months that periods of test positions start in.
CELL_FIRST, CELL_LAST = 2024 * 12 - 3, 2024 * 12 + 5


def cell_period_rollup(s, d):
    return r6(cells.roll_up_periods(_cells(s, d), periods.periods(s, CELL_FIRST, CELL_LAST)))


def event_interval_join(s, d):
    return trips.interval_join(td.events(s, d), _trips(s, d)).select("eid", "uid", "tid")


def crash_interval_join(s, d):
    return trips.interval_join(td.crashes(s, d), _trips(s, d)).select("cid", "uid", "tid")


def event_features_type(s, d):
    return r6(features.event_features(td.events(s, d), "event_type", "type"))


def event_features_location(s, d):
    return r6(features.event_features(td.events(s, d), "location_type", "loc"))


def event_features_cross(s, d):
    return r6(features.event_cross(td.events(s, d)))


def event_grouping_sets(s, d):
    return features.event_grouping_sets(td.events(s, d))


def movement_event_stats(s, d):
    e = trips.interval_join(td.events(s, d), _trips(s, d)).join(_trips(s, d).select("uid", "tid", "src", "dst"), ["uid", "tid"])
    return r6(e.groupBy("src", "dst", "event_type").agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for c in ("speed", "max_acc", "avg_acc", "duration") for n, f in (("avg", F.avg), ("std", F.stddev_pop))]))


def od_edges(s, d):
    return network.edges(_trips(s, d))


def location_support_rank(s, d):
    return network.support(network.endpoints(_trips(s, d)))


def next_location_entropy(s, d):
    return r6(network.next_entropy(network.edges(_trips(s, d))))


def radius_of_gyration(s, d):
    return r6(network.gyration(network.endpoints(_trips(s, d))))


def iqr_movement_stats(s, d):
    return r6(movements.movement_stats(_trips(s, d)))


def _regular(t):
    return network.support(network.endpoints(t)).where("rank < 2").select("uid", "lid")


def user_movement_stats(s, d):
    t = _trips(s, d)
    return r6(movements.user_movements(t, _regular(t)))


def travel_minute_hist(s, d):
    return movements.travel_minutes(_trips(s, d))


def movement_slot_days(s, d):
    return movements.movement_days(_trips(s, d))


def first_seen_movements(s, d):
    return movements.first_seen(_trips(s, d))


def regular_gyration_entropy(s, d):
    t = _trips(s, d)
    e = network.endpoints(t).join(_regular(t), ["uid", "lid"], "left_semi")
    n = e.groupBy("uid", "lid").agg(F.count("*").alias("n"))
    return r6(network.gyration(e).join(stats.entropy(n, ["uid"], "n", "entropy"), "uid"))


def support_share(s, d):
    return r6(movements.max_normalised(network.support(network.endpoints(_trips(s, d))).select("uid", "lid", "support"), "uid", "support"))


def event_destination_entropy(s, d):
    t = _trips(s, d)
    e = trips.interval_join(td.events(s, d), t).select("uid", "tid", "event_type").join(t.select("uid", "tid", "dst"), ["uid", "tid"])
    return r6(movements.destination_entropy(e))


def top_place_events(s, d):
    """Events by type at (trips that arrive) and between the three most visited places."""
    t = _trips(s, d)
    top = network.support(network.endpoints(t)).where("rank < 3").select("uid", "lid", "rank")
    e = trips.interval_join(td.events(s, d), t).select("uid", "tid", "event_type").join(t.select("uid", "tid", "src", "dst"), ["uid", "tid"])
    to = top.select("uid", F.col("lid").alias("dst"), F.col("rank").alias("to_rank"))
    start = top.select("uid", F.col("lid").alias("src"), F.col("rank").alias("from_rank"))
    return e.join(to, ["uid", "dst"]).join(start, ["uid", "src"], "left").groupBy("uid", "event_type", "from_rank", "to_rank").agg(F.count("*").alias("n"))


def finite_speeds(s, d):
    """Speeds over the time since the last point, without those that are no finite number, and as features with 0 for them."""
    x = _steps(s, d).select("pid", F.when(F.col("pid") % 7 == 0, F.lit(float("nan"))).when(F.col("pid") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("speed")).alias("x"))
    kept = movements.finite(x, "x").select("pid", F.lit("kept").alias("how"), "x")
    return r6(kept.union(movements.clean(x, "x").select("pid", F.lit("cleaned"), "x")))


def support_knee(s, d):
    return network.knee(network.support(network.endpoints(_trips(s, d))))


def stay_durations(s, d):
    st = network.stays(_trips(s, d))
    return r6(st.groupBy("uid", "lid").agg(F.count("*").alias("n"), F.avg("stay_s").alias("avg_s"), F.stddev_pop("stay_s").alias("std_s")))


def stay_minute_hist(s, d):
    return network.stay_minutes(network.stays(_trips(s, d)))


def stay_minute_share(s, d):
    h = network.stay_minutes(network.stays(_trips(s, d)))
    return r6(h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("uid", "minute"))).drop("n"))


def timeslot_day_counts(s, d):
    return movements.place_days(_trips(s, d))


def _orders(s, d):
    o = td.table(s, d, "orders")
    ts = F.col("o_orderdate")
    return o.select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("id"), ts.alias("ts"), timeparts.month_index(ts).cast("long").alias("month"), F.col("o_orderstatus").alias("status"))


#: Where the second half of the test positions begins, epoch seconds.
HALF = 1705276800.0
FIRST, LAST = 1995 * 12, 1995 * 12 + 13


def month_pair_windows(s, d):
    return periods.month_pair_counts(_orders(s, d))


def sliding_periods(s, d):
    return periods.assign(_orders(s, d), periods.periods(s, FIRST, LAST)).groupBy("idx").agg(F.count("*").alias("n"), F.countDistinct("uid").alias("n_users"))


def period_labels(s, d):
    o = _orders(s, d)
    return periods.labels(o, o.where("status = 'F'"), periods.periods(s, FIRST, LAST))


def anti_join_users(s, d):
    e = td.events(s, d)
    return e.join(td.crashes(s, d).select("uid").distinct(), "uid", "left_anti").groupBy("uid").agg(F.count("*").alias("n"))


def first_event_per_month(s, d):
    return periods.first_per_month(_orders(s, d)).select("uid", "month", "id")


def dedup_first(s, d):
    return periods.first_of(_orders(s, d), "uid", "ts", "id").select("uid", "id")


def _half(s, d, late: bool):
    t = F.col("t") >= HALF
    p = td.positions(s, d).where(t if late else ~t)
    return p.groupBy("uid", "lid").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def nearest_center(s, d):
    c = _half(s, d, False).select("uid", F.col("lid").alias("cid"), F.col("lon").alias("clon"), F.col("lat").alias("clat"))
    return network.nearest(td.positions(s, d).select("uid", "pid", "lon", "lat"), c).select("pid", "cid")


def cross_window_match(s, d):
    old = _half(s, d, False).select("uid", F.col("lid").alias("oid"), F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    return r6(network.match_windows(_half(s, d, True), old))


def jaccard_cosine_change(s, d):
    t = _trips(s, d)
    late = F.col("t0") >= HALF
    n = network.endpoints(t).withColumn("t0", F.col("t")).groupBy("uid", "lid").agg(F.count_if(~late).alias("a"), F.count_if(late).alias("b"))
    one = F.count_if((F.col("a") > 0) & (F.col("b") > 0)) / F.count_if((F.col("a") > 0) | (F.col("b") > 0))
    cosine = F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a"))) * F.sqrt(F.sum(F.col("b") * F.col("b"))))
    return r6(n.groupBy("uid").agg(one.alias("jaccard"), (1 - cosine).alias("cosine")))


def edge_change(s, d):
    """Movements of one half of the time among those of both."""
    t = _trips(s, d)
    late = F.col("t0") >= HALF
    n = t.groupBy("uid", "src", "dst").agg(F.count_if(~late).alias("a"), F.count_if(late).alias("b"))
    return r6(n.groupBy("uid").agg((F.count_if((F.col("a") > 0) & (F.col("b") > 0)) / F.count("*")).alias("jaccard")))


def first_last_month(s, d):
    """The orders of each user's first and last month, and the months."""
    m = _orders(s, d).groupBy("uid", "month").agg(F.count("*").alias("n"))
    return m.groupBy("uid").agg(F.min("month").alias("first"), F.max("month").alias("last"), F.min_by("n", "month").alias("n_first"), F.max_by("n", "month").alias("n_last"))


def train_test_pairs(s, d):
    """Users active in a period and in the next: the labels to learn from and to test on."""
    o = _orders(s, d)
    return periods.train_test(periods.labels(o, o.where("status = 'F'"), periods.periods(s, FIRST, LAST)))


def near_months(s, d):
    """Orders whose months before and after lie in the period as well."""
    return periods.inner_months(_orders(s, d), "1995-01-01", "1996-01-01").groupBy("uid").agg(F.count("*").alias("n"))


def graph_degree_density(s, d):
    return r6(network.degrees(network.edges(_trips(s, d))))


def graph_triangles(s, d):
    return network.triangles(network.edges(_trips(s, d)))


def graph_metrics(s, d):
    return network.graph_metrics(network.edges(_trips(s, d)))


def graph_betweenness(s, d):
    return r6(network.edge_betweenness(network.edges(_trips(s, d))))


def graph_shortest_paths(s, d):
    return r6(network.graph_metrics(network.edges(_trips(s, d))).select("uid", "diameter", "eccentricity"))


def _windows(s, d):
    """Trips by half of the time, and the events on them."""
    t = _trips(s, d).withColumn("win", (F.col("t0") >= HALF).cast("long"))
    return t, trips.interval_join(td.events(s, d), t).select("uid", "tid", "event_type").join(t.select("uid", "tid", "win", "src", "dst"), ["uid", "tid"])


def event_features_wide(s, d):
    return r6(profile.event_wide(_trips(s, d).select("uid"), td.events(s, d)))


def imn_place_features(s, d):
    return r6(profile.place_features(*_windows(s, d), 2))


def imn_features(s, d):
    return r6(profile.imn_features(*_windows(s, d), 2))


def user_features(s, d):
    """All 409 features of each user with trips, and whether the user had a crash."""
    t = _trips(s, d)
    passed = collective_features(s, d)
    table = profile.joined(features.trip_features(t), profile.event_wide(t.select("uid"), td.events(s, d)), profile.imn_features(*_windows(s, d), 2), passed)
    return r6(profile.labelled(table, td.crashes(s, d)))


#: Positions that make a cell a node of the tree.
NODE = 50


def collective_features(s, d):
    pts = _points(s, d).withColumn("path", geo.quadtree_path("lon", "lat"))
    regular = pts.join(_regular(trips.trips_of(_points(s, d))), ["uid", "lid"], "left_semi").select("uid", "path").distinct()
    return r6(cells.collective(pts.select("uid", "tid", "path"), cells.roll_up(_cells(s, d), 16), regular, cells.tree_nodes(pts, NODE)))


def minmax_scale(s, d):
    c = td.table(s, d, "customer")
    bounds = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return r6(c.join(F.broadcast(bounds)).select("c_custkey", F.coalesce(F.try_divide(F.col("c_acctbal") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)).alias("scaled")))


def deviation_from_mean(s, d):
    c = td.table(s, d, "customer")
    b = c.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"), F.avg("c_acctbal").alias("mean"))
    return r6(c.join(F.broadcast(b)).select("c_custkey", F.try_divide(F.col("c_acctbal") - F.col("mean"), F.col("hi") - F.col("lo")).alias("deviation")))


def quantile_bins(s, d):
    c = td.table(s, d, "customer")
    q = c.agg(F.percentile("c_acctbal", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    x = F.col("c_acctbal")
    return c.join(F.broadcast(q)).select("c_custkey", F.when(x <= F.col("q")[0], 0).when(x <= F.col("q")[1], 1).when(x <= F.col("q")[2], 2).otherwise(3).alias("bin"))


def regular_locations(s, d):
    t = _trips(s, d)
    return places.regular_places(network.endpoints(t), network.edges(t))


def tosca_locations(s, d):
    return places.detect_places(network.endpoints(_trips(s, d)), ["uid"])


def kmeans_cells(s, d):
    return places.global_kmeans(td.table(s, d, "embeddings"), "embedding", 8).groupBy("cluster").agg(F.count("*").alias("n"))


def _ways(s, d):
    p = _points(s, d)
    return trajectories.with_points(p, trips.trips_of(p))


def trajectory_medoid(s, d):
    return r6(trajectories.movement_prototypes(_ways(s, d)))


def trajectory_inclusion(s, d):
    """Rides between trips of different users on the same day; ``cell`` is where the ride's guest begins."""
    w = _ways(s, d).withColumns({"day": F.floor(F.col("t0") / timeparts.DAY), "cell": geo.geohash_cell(F.col("first.lon"), F.col("first.lat"), 5)})
    return r6(trajectories.rides(w, 500.0, 14400.0))


def _risk_table(s, d):
    f = features.trip_features(_trips(s, d)).select("uid", *RISK)
    return f.join(td.crashes(s, d).select("uid", F.lit(1).alias("crash")).distinct(), "uid", "left").withColumn("crash", F.coalesce("crash", F.lit(0)))


RISK = ["tot_traj", "tot_km", "avg_km", "avg_speed", "std_speed", "night_traj"]


def smote(s, d):
    t = td.table(s, d, "labels").join(td.table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return r6(learning.smote(t, "doc_id", "toxic", ["n_chars", "quality"]))


def risk_score(s, d):
    t = _risk_table(s, d)
    t = learning.scale(t, learning.fit_scaling(t, RISK), RISK)
    return r6(learning.risk(learning.train(t, "crash", RISK), t, RISK).select("uid", "crash", "risk", "flag"))


_ALL = (
    trip_gap_sessions, trip_features, trip_segment_exact, distance_spherical, distance_haversine, bearing, point_speed, closest_point, point_at_time,
    quadtree_path, geohash_cells, cell_counters, cell_rollup, cell_period_rollup, event_interval_join, crash_interval_join, event_features_type, event_features_location,
    event_features_cross, event_grouping_sets, movement_event_stats, od_edges, location_support_rank, next_location_entropy, radius_of_gyration,
    iqr_movement_stats, support_knee, stay_durations, stay_minute_hist, stay_minute_share, timeslot_day_counts, month_pair_windows, sliding_periods,
    period_labels, anti_join_users, first_event_per_month, dedup_first, nearest_center, cross_window_match, jaccard_cosine_change, graph_degree_density,
    graph_triangles, graph_metrics, graph_betweenness, graph_shortest_paths, collective_features, event_features_wide, imn_place_features, imn_features, user_features, minmax_scale, deviation_from_mean, quantile_bins,
    user_movement_stats, travel_minute_hist, movement_slot_days, first_seen_movements, regular_gyration_entropy, support_share, event_destination_entropy,
    top_place_events, finite_speeds, edge_change, first_last_month, train_test_pairs, near_months,
    regular_locations, tosca_locations, kmeans_cells, trajectory_medoid, trajectory_inclusion, smote, risk_score,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
