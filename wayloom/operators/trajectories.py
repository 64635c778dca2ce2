"""Comparing and cutting trajectories: arrays of (lon, lat, t) rows, t in seconds.

End-point distances are column expressions on trip rows; the sequential comparisons run in Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, timeparts
from ..functions.sphere import metres, project

DAY = timeparts.DAY


def length_m(tr: np.ndarray) -> float:
    return float(metres(tr[:-1], tr[1:]).sum())


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Mean distance in metres of two trajectories walked side by side.

    The one with the shorter next step goes to its next point, the other to the nearest place on its
    current segment. When one ends, the points not passed are compared with the other's end.
    """
    if min(len(a), len(b)) < 2:
        raise ValueError("a trajectory needs two points")
    ways, at, here = (a, b), [0, 0], [a[0], b[0]]
    seen = [float(metres(a[0], b[0]))]
    while at[0] < len(a) - 1 and at[1] < len(b) - 1:
        ahead = [ways[s][at[s] + 1] for s in (0, 1)]
        step = [float(metres(here[s], ahead[s])) for s in (0, 1)]
        if step[0] == step[1]:
            here, at = ahead, [at[0] + 1, at[1] + 1]
        else:
            s = int(step[1] < step[0])
            at[s] += 1
            here[s], other = ahead[s], 1 - s
            here[other] = project(here[other][None], ahead[other][None], here[s])[0]
        seen.append(float(metres(here[0], here[1])))
    rest = np.concatenate([metres(a[at[0] :], b[-1]), metres(b[at[1] :], a[-1])])
    return (sum(seen) + float(rest.sum())) / (len(seen) + len(rest))


def _ends(a: str, b: str, end: str) -> Column:
    return geo.spherical_m(f"{a}.{end}.lon", f"{a}.{end}.lat", f"{b}.{end}.lon", f"{b}.{end}.lat")


def start_distance(a: str, b: str) -> Column:
    """Metres between the first points of two aliased trip tables."""
    return _ends(a, b, "first")


def end_distance(a: str, b: str) -> Column:
    return _ends(a, b, "last")


def start_end_distance(a: str, b: str) -> Column:
    return start_distance(a, b) + end_distance(a, b)


def synchronous(value: Column, a: str, b: str, within_s: float, at: tuple[str, ...] = ("t0", "t1")) -> Column:
    """The distance where the times of day at the named ends differ by less than the bound, else infinity; midnight does not wrap."""
    tod = lambda s, c: timeparts.second_of_day(F.col(f"{s}.{c}"))
    near = [F.abs(tod(a, c) - tod(b, c)) < within_s for c in at]
    ok = near[0]
    for n in near[1:]:
        ok = ok & n
    return F.when(ok, value).otherwise(float("inf"))


def distance_synch(a: np.ndarray, b: np.ndarray, within_s: float, at: tuple[int, ...] = (0, -1)) -> float:
    """``distance`` under the same condition; ``at`` names the ends by position."""
    late = any(abs(a[i][2] % DAY - b[i][2] % DAY) >= within_s for i in at)
    return math.inf if late else distance(a, b)


def _boarding(a: np.ndarray, p: np.ndarray, reach: float, within_s: float) -> tuple[int, float, np.ndarray] | None:
    """The segment of a nearest to p, its distance and the place on it, among those near enough in space and time of day."""
    on = project(a[:-1], a[1:], p)
    d = metres(on, p)
    d = np.where((d <= reach) & (np.abs(on[:, 2] % DAY - p[2] % DAY) <= within_s), d, np.inf)
    k = int(d.argmin())
    return (k, float(d[k]), on[k]) if np.isfinite(d[k]) else None


def _within(a: np.ndarray, b: np.ndarray, space_m: float, reach: float, within_s: float) -> tuple | None:
    size = length_m(b)
    if size <= space_m or len(a) < 2:
        return None
    on, off = _boarding(a, b[0], reach, within_s), _boarding(a, b[-1], reach, within_s)
    if on is None or off is None or on[0] >= off[0] or metres(on[2], off[2]) < space_m or on[1] + off[1] > size:
        return None
    return on, off


def inclusion(a: np.ndarray, b: np.ndarray, space_m: float) -> float:
    """Metres that b's traveller walks to and from a's way if b lies within a, in a's direction; else infinity."""
    found = _within(a, b, space_m, math.inf, math.inf)
    return math.inf if found is None else found[0][1] + found[1][1]


def inclusion_synch(a: np.ndarray, b: np.ndarray, space_m: float, time_s: float) -> dict | None:
    """How a can carry b's traveller, close to both ends in space and time of day; None if it cannot."""
    (a0, a1), (b0, b1) = ((x[0][2] % DAY, x[-1][2] % DAY) for x in (a, b))
    if b0 - time_s > a1 or b0 + time_s < a0 or b1 + time_s < a0 or b1 - time_s > a1:
        return None
    found = _within(a, b, space_m, space_m / 2, time_s)
    if found is None:
        return None
    (i, to, _), (j, back, _) = found
    t_on, t_off = a[i][2] % DAY, a[j][2] % DAY
    return {"pick_up_m": to, "drop_off_m": back, "pick_up_s": abs(b0 - t_on), "drop_off_s": abs(b1 - t_off), "ride_s": abs(t_on - t_off), "start_together": i == 0, "end_together": j == len(a) - 2}


def between(tr: np.ndarray, lo: float, hi: float) -> np.ndarray | None:
    """Points with a time of day from lo to hi, up to the first later one; None if the trajectory lies outside."""
    tod = tr[:, 2] % DAY
    if hi < tod[0] or lo > tod[-1]:
        return None
    lo, hi = max(lo, tod[0]), min(hi, tod[-1])
    late = np.flatnonzero(tod > hi)
    head = tr[: late[0]] if len(late) else tr
    return head[(head[:, 2] % DAY >= lo) & (head[:, 2] % DAY <= hi)]


def keep_end(tr: np.ndarray, size_m: float) -> np.ndarray:
    """The longest tail whose way is shorter than the size; the whole trajectory if it fits."""
    steps = metres(tr[:-1], tr[1:])
    if size_m >= steps.sum():
        return tr
    gone = np.cumsum(steps[::-1])
    return tr[len(tr) - 1 - int((gone < size_m).sum()) :]


def approximate(running: np.ndarray, routine: np.ndarray, most_m: float, share: float = 0.0) -> tuple[np.ndarray | None, np.ndarray | None, float]:
    """The passed and the coming part of a routine for a running trip, and their distance; (None, None, inf) if it is no match.

    With a share, the last share of both ways is compared instead of the last point.
    """
    none = (None, None, math.inf)
    last = running[-1]
    if len(routine) < 2:
        return none
    k = int(metres(routine[:-1], last).argmin())
    near = project(routine[k : k + 1], routine[k + 1 : k + 2], last)[0]
    far = float(metres(near, last))
    if share == 0 and far >= most_m:
        return none
    head = between(routine, routine[0][2] % DAY, near[2] % DAY)
    if head is None or len(head) < 3:
        return none
    tail = between(routine, near[2] % DAY, routine[-1][2] % DAY)
    tail = np.vstack([head[-1:], routine[-1:] if tail is None else tail])
    if length_m(running) < length_m(head):
        head = keep_end(head, length_m(running))
    if share > 0:
        x, y = keep_end(running, length_m(running) * share), keep_end(head, length_m(head) * share)
        if len(x) >= 2 and len(y) >= 2:
            far = distance(x, y)
            if far >= most_m:
                return none
    return head, tail, far


def with_points(points: DataFrame, trips: DataFrame) -> DataFrame:
    """Trips with their points as one array of (t, lon, lat) in order."""
    p = points.groupBy("uid", "tid").agg(F.array_sort(F.collect_list(F.struct("t", "pid", "lon", "lat"))).alias("points"))
    return trips.join(p, ["uid", "tid"])


def as_array(points) -> np.ndarray:
    return np.array([(p["lon"], p["lat"], p["t"]) for p in points], float)


def movement_prototypes(trips: DataFrame) -> DataFrame:
    """The medoid trip of each movement (uid, src, dst) of more than two trips, else its first; the first of equals.

    A movement's trips are those of one person between two places; the pairs are compared inside the group.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t0", "tid"])
        ways, best, cost = [as_array(p) for p in pdf["points"]], 0, None
        if len(ways) > 2:
            d = np.zeros((len(ways), len(ways)))
            for i in range(len(ways)):
                for j in range(i):
                    d[i, j] = d[j, i] = distance(ways[i], ways[j])
            best = int(d.sum(1).argmin())
            cost = float(d.sum(1)[best])
        r = pdf.iloc[best]
        return pd.DataFrame([(r["uid"], r["src"], r["dst"], len(ways), r["tid"], cost)], columns=["uid", "src", "dst", "n", "tid", "cost_m"])

    return trips.select("uid", "src", "dst", "tid", "t0", "points").groupBy("uid", "src", "dst").applyInPandas(one, "uid long, src long, dst long, n long, tid long, cost_m double")


def _columns(lon: np.ndarray, row: np.ndarray, tall: float) -> np.ndarray:
    """Grid columns of longitudes in a row, about as wide as the rows are tall."""
    return np.floor(lon * (np.maximum(np.cos(np.radians((row + 0.5) * tall)), 1e-3) / tall)).astype(np.int64)


def _code(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return row * (1 << 32) + col


def cells_of(p: np.ndarray, reach_m: float) -> np.ndarray:
    """The grid cells of places, twice the reach tall."""
    tall = math.degrees(2 * reach_m / geo.RADIUS_M)
    row = np.floor(p[:, 1] / tall).astype(np.int64)
    return _code(row, _columns((p[:, 0] + 180) % 360 - 180, row, tall))


def cell_of(p: np.ndarray, reach_m: float) -> int:
    return int(cells_of(p[None], reach_m)[0])


def way_cells(way: np.ndarray, reach_m: float) -> np.ndarray:
    """The cells of all places within reach of a way (away from the poles); segments without length have none."""
    tall, found = math.degrees(2 * reach_m / geo.RADIUS_M), []
    for a, b in zip(way[:-1, :2], way[1:, :2], strict=True):
        if not ((b - a) ** 2).sum():
            continue
        at = a + np.linspace(0, 1, 2 + int(np.abs(b - a).max() / tall))[:, None] * (b - a)
        lo, hi = np.minimum(at[:-1], at[1:]), np.maximum(at[:-1], at[1:])
        up = 1.01 * math.degrees(reach_m / geo.RADIUS_M)
        south, north = lo[:, 1] - up, hi[:, 1] + up
        side = up / np.maximum(np.cos(np.radians(np.maximum(np.abs(south), np.abs(north)))), 1e-3)
        for turn in (-360, 0, 360):
            west, east = np.maximum(lo[:, 0] - side + turn, -180), np.minimum(hi[:, 0] + side + turn, 180)
            own = west <= east
            first, last = np.floor(south / tall).astype(np.int64), np.floor(north / tall).astype(np.int64)
            for k in range(int((last - first)[own].max()) + 1 if own.any() else 0):
                row = first + k
                ok = own & (row <= last)
                row = row[ok]
                c0, c1 = _columns(west[ok], row, tall), _columns(east[ok], row, tall)
                for j in range(int((c1 - c0).max()) + 1 if len(row) else 0):
                    found.append(_code(row, c0 + j)[c0 + j <= c1])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def ride_candidates(ways: DataFrame, space_m: float) -> DataFrame:
    """Trips (day, uid, tid, points) -> pairs (day, a_uid, a_tid, b_uid, b_tid) of different users and one day that ``rides`` can accept.

    Both ends of b lie in cells within space_m / 2 of a's way. A segment of a without length
    is at every place; as b boards on an earlier segment than it leaves, its start still lies
    near a real one, and only its end may then be anywhere.
    """

    def run(batches):
        for pdf in batches:
            arrays = [as_array(p) for p in pdf["points"]]
            out = pdf[["day", "uid", "tid"]].copy()
            out["c0"], out["c1"] = [cell_of(x[0], space_m / 2) for x in arrays], [cell_of(x[-1], space_m / 2) for x in arrays]
            out["anywhere"] = [bool((((x[1:, :2] - x[:-1, :2]) ** 2).sum(1) == 0).any()) for x in arrays]
            out["cells"] = [way_cells(x, space_m / 2) for x in arrays]
            yield out

    t = ways.select("day", "uid", "tid", "points").mapInPandas(run, "day long, uid long, tid long, c0 long, c1 long, anywhere boolean, cells array<long>")
    taken = t.select("day", F.col("uid").alias("a_uid"), F.col("tid").alias("a_tid"), "anywhere", F.explode("cells").alias("c"))
    b = t.select("day", F.col("uid").alias("b_uid"), F.col("tid").alias("b_tid"), F.col("c0").alias("c"), "c1")
    start = taken.join(b, ["day", "c"]).where("a_uid <> b_uid").drop("c")
    end = start.where("not anywhere").join(taken.select("a_uid", "a_tid", F.col("c").alias("c1")), ["a_uid", "a_tid", "c1"], "left_semi")
    keys = ("day", "a_uid", "a_tid", "b_uid", "b_tid")
    return end.select(*keys).union(start.where("anywhere").select(*keys))


MATCH = "pick_up_m double, drop_off_m double, pick_up_s double, drop_off_s double, ride_s double, start_together boolean, end_together boolean"


#: Ways that a task holds while the other trips of the day pass by.
BLOCK = 4000


def _carried(a: np.ndarray, ends: np.ndarray, size: np.ndarray, space_m: float, time_s: float) -> tuple[np.ndarray, tuple]:
    """``inclusion_synch`` of one way and many trips by their (first, last) points and lengths: which are rides, and their columns."""
    found = []
    for p in (ends[:, :3], ends[:, 3:]):
        n, m = len(a) - 1, len(p)
        on = project(np.repeat(a[:-1], m, 0), np.repeat(a[1:], m, 0), np.tile(p, (n, 1))).reshape(n, m, 3)
        d = metres(on, p)
        d = np.where((d <= space_m / 2) & (np.abs(on[..., 2] % DAY - p[:, 2] % DAY) <= time_s), d, np.inf)
        k = d.argmin(0)
        found.append((k, d[k, np.arange(m)], on[k, np.arange(m)]))
    (i, to, up), (j, back, off) = found
    hit = np.flatnonzero(np.isfinite(to) & np.isfinite(back) & (i < j) & (metres(up, off) >= space_m) & (to + back <= size))
    i, j = i[hit], j[hit]
    t_on, t_off = a[i, 2] % DAY, a[j, 2] % DAY
    columns = (to[hit], back[hit], np.abs(ends[hit, 2] % DAY - t_on), np.abs(ends[hit, 5] % DAY - t_off), np.abs(t_on - t_off), i == 0, j == len(a) - 2)
    return hit, columns


def _passing(ways: list[tuple], guests: pd.DataFrame, space_m: float, time_s: float) -> pd.DataFrame:
    """The rides between held (uid, tid, way, cells, anywhere) and a batch of guests, found through the cells of both ends."""
    ends, size, uid = np.stack(guests["way"].to_numpy()), guests["size"].to_numpy(), guests["uid"].to_numpy()
    (c0, at0), (c1, at1) = (np.unique(cells_of(ends[:, k : k + 2], space_m / 2), return_inverse=True) for k in (0, 3))
    b0, b1, long = ends[:, 2] % DAY, ends[:, 5] % DAY, size > space_m
    parts = []
    for a_uid, a_tid, a, cells, anywhere in ways:
        a0, a1 = a[0, 2] % DAY, a[-1, 2] % DAY
        ok = np.isin(c0, cells)
        if not ok.any():
            continue
        ok = ok[at0] & long & (uid != a_uid) & (b0 - time_s <= a1) & (b0 + time_s >= a0) & (b1 + time_s >= a0) & (b1 - time_s <= a1)
        if not anywhere:
            ok &= np.isin(c1, cells)[at1]
        pick = np.flatnonzero(ok)
        if len(pick):
            hit, columns = _carried(a, ends[pick], size[pick], space_m, time_s)
            if len(hit):
                parts.append((a_uid, a_tid, pick[hit], columns))
    rows = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, np.int64)
    times = [len(x[2]) for x in parts]
    b = guests.iloc[rows]
    out = {"day": b["day"], "cell": b["cell"], "a_uid": np.repeat([x[0] for x in parts], times), "a_tid": np.repeat([x[1] for x in parts], times), "b_uid": b["uid"], "b_tid": b["tid"]}
    for k, name in enumerate(c.split()[0] for c in MATCH.split(", ")):
        out[name] = np.concatenate([x[3][k] for x in parts]) if parts else []
    return pd.DataFrame({k: np.asarray(v) for k, v in out.items()})


def rides(ways: DataFrame, space_m: float, time_s: float) -> DataFrame:
    """Trips (day, cell, uid, tid, points) -> the pairs of one day and different users where a can carry b, with b's cell and the match's columns.

    Each way goes to one block of its day, and the ends of every trip to all blocks of theirs: what is
    dealt grows with the trips (times the blocks of a day), not with pairs that have to be compared.
    """

    def shape(batches):
        for pdf in batches:
            arrays = [as_array(p) for p in pdf["points"]]
            out = pdf[["day", "cell", "uid", "tid"]].copy()
            out["way"], out["size"] = [x.ravel() for x in arrays], [length_m(x) for x in arrays]
            yield out

    def run(batches):
        last, held = None, []
        for pdf in batches:
            for key, own in pdf.groupby(["day", "block"], sort=False):
                if key != last:
                    last, held = key, []
                for r in own[~own["guest"]].itertuples():
                    a = r.way.reshape(-1, 3)
                    held.append((r.uid, r.tid, a, way_cells(a, space_m / 2), bool((((a[1:, :2] - a[:-1, :2]) ** 2).sum(1) == 0).any())))
                guests = own[own["guest"]]
                if len(guests) and held:
                    yield _passing(held, guests, space_m, time_s)

    parts, kind = int(ways.sparkSession.conf.get("spark.sql.shuffle.partitions")), dict(ways.dtypes)["cell"]
    trips = ways.select("day", "cell", "uid", "tid", "points").mapInPandas(shape, f"day long, cell {kind}, uid long, tid long, way array<double>, size double")
    blocks = ways.groupBy("day").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    sent = trips.join(F.broadcast(blocks), "day").withColumn("b", F.explode(F.sequence(F.lit(-1).cast("long"), F.col("blocks") - 1)))
    guest = F.col("b") >= 0
    block = F.when(guest, F.col("b")).otherwise(F.pmod(F.xxhash64("uid", "tid"), "blocks"))
    ends = F.concat(F.slice("way", 1, 3), F.slice("way", -3, 3))
    sent = sent.select("day", "cell", "uid", "tid", F.when(guest, ends).otherwise(F.col("way")).alias("way"), "size", block.alias("block"), guest.alias("guest"))
    dealt = sent.repartition(parts, "day", "block").sortWithinPartitions("day", "block", "guest")
    return dealt.mapInPandas(run, f"day long, cell {kind}, a_uid long, a_tid long, b_uid long, b_tid long, " + MATCH)
