"""Clustering and trajectory comparisons on small cases with known answers."""

import math

import numpy as np
import pytest

from wayloom.functions.sphere import metres
from wayloom.operators import clustering as c
from wayloom.operators import trajectories as tr
from wayloom.operators.network import directed_clustering
from wayloom.operators.places import prune, steady_seed
from wayloom.plans import registry

RNG = np.random.default_rng(1)
BLOBS = np.concatenate([RNG.normal(m, 0.01, (40, 2)) for m in ((0, 0), (1, 0), (0, 1), (3, 3))])
TRUTH = np.repeat(range(4), 40)


def same_groups(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("init", ["k-means++", BLOBS[[0, 40, 80, 120]], lambda x, k, rng: x[[0, 40, 80, 120]]])
def test_kmeans_finds_blobs(init):
    m = c.KMeans(4, init=init).fit(BLOBS)
    assert same_groups(m.labels, TRUTH) and (m.predict(BLOBS) == m.labels).all()
    assert m.score(BLOBS) == pytest.approx(-m.inertia) and m.transform(BLOBS).shape == (160, 4)


def test_kmeans_needs_points():
    with pytest.raises(ValueError):
        c.KMeans(3).fit(np.zeros((2, 2)))


def test_mini_batches_find_blobs():
    assert same_groups(c.MiniBatchKMeans(4, batch=60, seed=3).fit(BLOBS).labels, TRUTH)


def test_xmeans_reruns_agree():
    a, b = c.XMeans(2, 8, seed=5).fit(BLOBS), c.XMeans(2, 8, seed=5).fit(BLOBS)
    assert (a.labels == b.labels).all() and 2 <= len(a.centres) <= 8


def test_tosca_merges_near_places():
    x = np.concatenate([RNG.normal(m, 1e-5, (20, 2)) for m in ((12.4, 41.8), (12.45, 41.8), (12.4, 41.9))])
    labels = c.Tosca(1, 6, min_dist=50).fit(x).labels
    assert all(len(set(labels[i : i + 20])) == 1 for i in (0, 20, 40))
    one = c.Tosca(1, 1).fit(np.full((3, 2), 12.4))
    assert one.labels.tolist() == [0, 0, 0]


def test_bisective_bounds_every_cluster():
    labels = c.bisective(BLOBS, 0.5)
    assert same_groups(labels, TRUTH)
    assert c.bisective(np.zeros((0, 2)), 1).size == 0


def test_medoid_and_dispersion():
    assert c.medoid(np.array([[0, 0], [1, 0], [2, 0]])) == 1
    assert c.medoid(BLOBS, rows=7) == c.medoid(BLOBS)
    d = c.dispersion(np.array([[0.0, 0], [2, 0]]), np.array([0, 0]), np.array([[1.0, 0]]))
    assert d == {"sse": 2.0, "ssb": 0.0}


def test_linkage_against_all_pairs():
    x = RNG.random((12, 2))
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    for cut in (0.1, 0.2, 0.3):
        reach = np.linalg.matrix_power((d <= cut).astype(int) + np.eye(12, dtype=int), 12) > 0
        labels = c.flat(c.single_linkage(d), 12, cut)
        assert (reach == (labels[:, None] == labels)).all()


def test_t_quantile_table():
    assert c.t_quantile(0.975, 2) == pytest.approx(4.3027, abs=1e-4)
    assert c.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-4)


def test_outliers_and_cut():
    v = np.array([1.0, 1.1, 0.9, 1.0, 1.05])
    assert all(f(v, 9.0) and not f(v, 1.0) for f in (c.thompson, c.chauvenet, c.quartile_range))
    assert c.cut_distance([1, 2, 90], min_dist=50) == 2
    assert c.cut_distance([1, 2, 3], min_k=1, min_dist=50) == 1.5
    assert c.cut_distance([5.0]) == c.cut_distance([]) == 0.0


def line(*lons, lat=41.9, t0=0.0):
    return np.array([(x, lat, t0 + 60 * k) for k, x in enumerate(lons)])


def test_trajectory_distance():
    a, b = line(12.5, 12.51, 12.52), line(12.5, 12.51, 12.52, lat=41.901)
    apart = float(metres(a[0], b[0]))
    assert tr.distance(a, a) == pytest.approx(0, abs=1e-6)
    # b steps first, being nearer the pole: six samples lie straight across, and a's middle meets b's end.
    assert tr.distance(a, b) == pytest.approx((6 * apart + float(metres(a[1], b[2]))) / 7, rel=1e-3)
    assert tr.distance(a, line(12.5, 12.505, 12.52)) == tr.distance(line(12.5, 12.505, 12.52), a)
    assert tr.distance_synch(a, a + [0, 0, 7200], 3600) == math.inf
    with pytest.raises(ValueError):
        tr.distance(a, a[:1])


def test_inclusion():
    way, part = line(12.5, 12.51, 12.52, 12.53), line(12.505, 12.525, t0=30)
    assert tr.inclusion(way, part, 500) < 1
    assert tr.inclusion(way, part[::-1], 500) == tr.inclusion(way, part, 5000) == math.inf
    got = tr.inclusion_synch(way, part, 500, 600)
    assert got["start_together"] and got["end_together"] and got["pick_up_m"] < 1
    assert tr.inclusion_synch(way, part + [0, 0, 20000], 500, 600) is None


def every_ride(trips, space_m, time_s):
    """Of (day, uid, tid, way) rows, the pairs of one day and different users that are rides."""
    return {(x[1], x[2], y[1], y[2]) for x in trips for y in trips if x[0] == y[0] and x[1] != y[1] and tr.inclusion_synch(x[3], y[3], space_m, time_s)}


def test_rides_of_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    trips = [(r.t0 // 86400, r.uid, r.tid, tr.as_array(r.points)) for r in registry._ways(spark, sf).collect()]
    got = [(r.a_uid, r.a_tid, r.b_uid, r.b_tid) for r in registry.trajectory_inclusion(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == every_ride(trips, 500.0, 14400.0)


def test_ride_candidates(spark):
    assert tr.cell_of(np.array([-179.9995, -17.0]), 250.0) in tr.way_cells(np.array([[179.98, -17.0], [179.9995, -17.0]]), 250.0)
    rng = np.random.RandomState(3)
    trips = []
    for uid in range(160):
        lon0, lat0 = ((12.5, 41.9), (179.7, -17.0), (25.0, 70.0))[uid % 3]
        way = np.cumsum(np.vstack([[lon0, lat0] + rng.uniform(-0.02, 0.02, 2), rng.uniform(-0.01, 0.02, (5, 2))]), 0)
        if uid % 8 < 5 and uid > 8:
            # A part of an earlier trip, moved by at most some 300 m.
            other = trips[uid - 9][3]
            lo, hi = sorted(rng.uniform(0, len(other) - 1, 2))
            way = np.array([[np.interp(x, range(len(other)), other[:, k]) for k in (0, 1)] for x in (lo, hi)]) + rng.uniform(-0.003, 0.003, 2)
        if uid % 5 == 0:
            way = np.insert(way, len(way) - 1, way[-2], 0)
        trips.append((0, uid, 0, np.column_stack([way, 30000.0 + 60 * np.arange(len(way))])))
    rows = [(d, u, k, [(float(t), i, float(x), float(y)) for i, (x, y, t) in enumerate(w)]) for d, u, k, w in trips]
    frame = spark.createDataFrame(rows, "day long, uid long, tid long, points array<struct<t: double, pid: int, lon: double, lat: double>>")
    got = [tuple(r)[1:] for r in tr.ride_candidates(frame, 500.0).collect()]
    want = every_ride(trips, 500.0, 14400.0)
    assert len(want) > 20 and len(got) == len(set(got)) and want <= set(got) and len(got) < 160 * 159 / 4


def test_rides_in_blocks(spark, monkeypatch):
    """Rides of a crowded day without a row for each pair, over blocks of ways; segments without length too."""
    monkeypatch.setattr(tr, "BLOCK", 12)
    rng, trips = np.random.RandomState(6), []
    for uid in range(90):
        lo, hi = sorted(rng.uniform(0, 0.05, 2)) if uid % 3 else (0.0, 0.05)
        way = np.array([(12.5 + x, 41.9 + rng.uniform(-0.001, 0.001), 30000.0 + 40000 * rng.rand() * (uid % 2) + 60 * k) for k, x in enumerate(np.linspace(lo, hi, 5))])
        trips.append((uid % 2, uid // 2, uid, np.insert(way, 3, way[3 + uid % 2], 0) if uid % 5 == 0 else way))
    rows = [(d, 0, u, k, [(float(t), i, float(x), float(y)) for i, (x, y, t) in enumerate(w)]) for d, u, k, w in trips]
    frame = spark.createDataFrame(rows, "day long, cell long, uid long, tid long, points array<struct<t: double, pid: int, lon: double, lat: double>>")
    out = tr.rides(frame, 500.0, 14400.0)
    got = [(r.a_uid, r.a_tid, r.b_uid, r.b_tid) for r in out.collect()]
    want = every_ride(trips, 500.0, 14400.0)
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "")


def test_cuts():
    way = line(12.5, 12.51, 12.52, 12.53)
    assert tr.between(way, 60, 120)[:, 2].tolist() == [60, 120] and tr.between(way, 500, 600) is None
    step = tr.length_m(way) / 3
    assert len(tr.keep_end(way, 1.5 * step)) == 2 and tr.keep_end(way, 9e9) is way
    head, tail, far = tr.approximate(line(12.5, 12.51, 12.521), way, 500)
    assert len(head) >= 2 and tail[-1][2] == 180 and far < 1
    assert tr.approximate(line(13.5, 13.51), way, 500)[2] == math.inf


def test_graphs():
    assert directed_clustering([(1, 2), (2, 3), (3, 1)], [1, 2, 3]) == 0.5
    assert directed_clustering([(a, b) for a in range(3) for b in range(3)], [0, 1, 2]) == 1.0
    assert prune([1, 2, 3, 4], {1: {2}, 2: {1}, 3: {3, 9}, 4: {3}}) == [1, 2]
    assert steady_seed(1, "a") == steady_seed(1, "a") != steady_seed(2, "a")
