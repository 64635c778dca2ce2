"""Wide features: graph measures against all shortest paths, and users without events, places or windows."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from wayloom.operators import network, profile

TRIP = "uid long, tid long, win long, src long, dst long, t0 double, t1 double, length_km double, duration_s double, first struct<lon:double,lat:double>, last struct<lon:double,lat:double>"
EVENT = "uid long, eid long, t double, event_type string, location_type string, duration int, avg_acc int, max_acc int, angle int"


def trip(uid, tid, win, src, dst):
    return (uid, tid, win, src, dst, 1000.0 * tid, 1000.0 * tid + 600, 3.0, 600.0, (12.0 + src / 100, 41.0), (12.0 + dst / 100, 41.0))


def shortest(edges, a, b):
    """All shortest paths from a to b."""
    paths = [[a]]
    while paths:
        done = [p for p in paths if p[-1] == b]
        if done:
            return done
        paths = [[*p, y] for p in paths for x, y in edges if x == p[-1] and y not in p]
    return []


def test_betweenness_against_all_paths(spark):
    r = random.Random(5)
    graphs = {u: sorted({(r.randrange(6), r.randrange(6)) for _ in range(9)}) for u in range(6)}
    df = spark.createDataFrame([(u, a, b, 1) for u, g in graphs.items() for a, b in g], "uid long, src long, dst long, weight long")
    got = {m.uid: m for m in network.graph_measures(df).collect()}
    for u, g in graphs.items():
        nodes = sorted({x for e in g for x in e})
        n, node, way = len(nodes), dict.fromkeys(nodes, 0.0), dict.fromkeys(g, 0.0)
        for a, b in permutations(nodes, 2):
            paths = shortest(g, a, b)
            for p in paths:
                for v in p[1:-1]:
                    node[v] += 1 / len(paths) / ((n - 1) * (n - 2))
                for e in zip(p, p[1:], strict=False):
                    way[e] += 1 / len(paths) / (n * (n - 1))
        assert {x.lid: x.b for x in got[u].node_b} == pytest.approx(node)
        assert {(x.src, x.dst): x.b for x in got[u].edge_b} == pytest.approx(way)


def test_names_and_empties(spark):
    """User 1 has one place in one window, user 2 different places in two windows; only user 2 has events."""
    trips = spark.createDataFrame([trip(1, 1, 0, 4, 4), trip(2, 1, 0, 0, 1), trip(2, 2, 0, 1, 0), trip(2, 3, 1, 2, 3)], TRIP)
    events = spark.createDataFrame([(2, 1, 1100.0, "A", "0", 5, 1, 2, 90), (2, 2, 1200.0, "A", None, 7, 1, 2, 90), (2, 3, 1300.0, None, "9", 9, 1, 2, 90)], EVENT)
    wide = {r.uid: r for r in profile.event_wide(trips, events).collect()}
    assert len(wide[1]) == 195
    assert (wide[1].tot_events, wide[1].avg_duration, wide[1].tot_events_pA, wide[1].std_angle_loc2) == (0, -1, 0, -1)
    assert (wide[2].tot_events, wide[2].tot_events_A, wide[2].tot_events_loc0, wide[2].avg_duration_A) == (3, 2, 1, 6)
    assert wide[2].tot_duration_pA == pytest.approx(12 / 21)
    on = events.where("event_type is not null").withColumns({"tid": F.lit(1), "win": F.lit(0), "src": F.lit(0), "dst": F.lit(1)}).select("uid", "tid", "event_type", "win", "src", "dst")
    imn = {r.uid: r for r in profile.imn_features(trips, on, 2).collect()}
    assert len(imn[1]) == 119 and all(x is not None and x == x for r in imn.values() for x in r)
    assert (imn[1].nbr_locations, imn[1].l1_count, imn[1].l2_count, imn[1].l1l2_betweenness, imn[1].jaccard, imn[1].delta_rg, imn[1].assortativity) == (1, 2, -1, 0, 0, 0, -1)
    assert (imn[2].jaccard, imn[2].cosine, imn[2].jaccard_mov, imn[2].delta_locations, imn[2].l2_A, imn[2].l1l2_A) == (1, 1, 1, 0, 1, 1)


def test_empty_tables(spark):
    none, events = spark.createDataFrame([], TRIP), spark.createDataFrame([], EVENT)
    on = spark.createDataFrame([], "uid long, tid long, event_type string, win long, src long, dst long")
    assert profile.event_wide(none, events).count() == 0
    assert profile.imn_features(none, on, 2).count() == 0
