"""Mobility networks: places, movements, stays, and the graph between places."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, stats, timeparts


def endpoints(trips: DataFrame) -> DataFrame:
    """Both ends of each trip, in order of their numbers."""
    e = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("src").alias("lid"), F.col("t0").alias("t"), F.col("first").alias("p")), F.struct(F.lit(1).alias("end"), F.col("dst").alias("lid"), F.col("t1").alias("t"), F.col("last").alias("p"))))
    return trips.select("uid", "tid", e.alias("e")).select("uid", "tid", "e.end", "e.lid", "e.t", F.col("e.p.lon").alias("lon"), F.col("e.p.lat").alias("lat"))


def edges(trips: DataFrame) -> DataFrame:
    return trips.groupBy("uid", "src", "dst").agg(F.count("*").alias("weight"))


def support(ends: DataFrame) -> DataFrame:
    """Places by visits: rank 0 is the most visited; ties by place."""
    n = ends.groupBy("uid", "lid").agg(F.count("*").alias("support"))
    return n.withColumn("rank", (F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("support"), "lid")) - 1).cast("long"))


def knee(supports: DataFrame) -> DataFrame:
    """The support farthest from the chord of the ascending support curve; the first of equals."""
    w = Window.partitionBy("uid").orderBy("support", "lid")
    whole = Window.partitionBy("uid")
    s = supports.withColumns({"x": F.row_number().over(w) - 1, "n": F.count("*").over(whole), "lo": F.min("support").over(whole), "hi": F.max("support").over(whole)})
    far = F.abs((F.col("hi") - F.col("lo")) * F.col("x") - (F.col("n") - 1) * (F.col("support") - F.col("lo")))
    return s.withColumn("far", far).groupBy("uid").agg(F.max_by("support", F.struct("far", -F.col("x"))).alias("min_support"))


def gyration(ends: DataFrame) -> DataFrame:
    """Mean distance of the visits to their centre, metres."""
    w = Window.partitionBy("uid")
    c = ends.withColumns({"clon": F.avg("lon").over(w), "clat": F.avg("lat").over(w)})
    return c.groupBy("uid").agg(F.avg(geo.spherical_m("lon", "lat", "clon", "clat")).alias("gyration_m"))


def next_entropy(edge: DataFrame) -> DataFrame:
    return stats.entropy(edge, ["uid", "src"], "weight", "entropy")


def stays(trips: DataFrame) -> DataFrame:
    """Time between arriving and leaving, where the next trip starts where the last one ended."""
    w = Window.partitionBy("uid").orderBy("t0", "tid")
    s = trips.withColumns({"at": F.lag("dst").over(w), "arrive": F.lag("t1").over(w)}).where(F.col("at") == F.col("src"))
    return s.select("uid", F.col("src").alias("lid"), "arrive", F.col("t0").alias("leave"), (F.col("t0") - F.col("arrive")).alias("stay_s"))


def stay_minutes(stay: DataFrame) -> DataFrame:
    """Visits by place and minute of the day, both ends included, at most once around midnight."""
    a, b = F.floor(F.col("arrive") / 60), F.floor(F.col("leave") / 60)
    minutes = F.sequence(a, F.least(b, a + 1439))
    m = stay.select("uid", "lid", F.explode(minutes).alias("m"))
    return m.groupBy("uid", "lid", F.pmod("m", F.lit(1440)).alias("minute")).agg(F.count("*").alias("n"))


def nearest(points: DataFrame, centres: DataFrame, key: str = "uid") -> DataFrame:
    """Each point's nearest centre of the same key; the least id of equals."""
    d = geo.spherical_m("lon", "lat", "clon", "clat")
    joined = points.join(centres, key).withColumn("d", d)
    return joined.groupBy(*points.columns).agg(F.min_by("cid", F.struct("d", "cid")).alias("cid"), F.min("d").alias("d"))


def match_windows(new: DataFrame, old: DataFrame, within_m: float = 100.0) -> DataFrame:
    """New places with the old one they continue: nearest within reach, and the old one's nearest claimant."""
    pairs = new.join(old, "uid").withColumn("d", geo.spherical_m("lon", "lat", "olon", "olat"))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("uid", "lid").orderBy("d", "oid"))).where((F.col("r") == 1) & (F.col("d") < within_m))
    return best.withColumn("r", F.row_number().over(Window.partitionBy("uid", "oid").orderBy("d", "lid"))).where("r = 1").select("uid", "lid", "oid", "d")


def degrees(edge: DataFrame) -> DataFrame:
    """Nodes, edges, density and mean degrees of each user's directed graph; a loop counts twice in the undirected degree."""
    nodes = edge.select("uid", "src").union(edge.select("uid", "dst")).distinct().groupBy("uid").agg(F.count("*").alias("n"))
    both = edge.select("uid", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    und = both.groupBy("uid").agg(F.count("*").alias("u"))
    m = edge.groupBy("uid").agg(F.count("*").alias("m"))
    out = nodes.join(m, "uid").join(und, "uid")
    return out.select("uid", "n", "m", F.coalesce(F.try_divide(F.col("m"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)).alias("density"), (2 * F.col("u") / F.col("n")).alias("avg_degree"), (F.col("m") / F.col("n")).alias("avg_indegree"))


def triangles(edge: DataFrame) -> DataFrame:
    """Triangles of the undirected graph, loops left out."""
    u = edge.where("src <> dst").select("uid", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    t = u.join(u.select("uid", F.col("a").alias("b"), F.col("b").alias("c")), ["uid", "b"]).join(u.select("uid", "a", F.col("b").alias("c")), ["uid", "a", "c"])
    return t.groupBy("uid").agg(F.count("*").alias("triangles"))


def brandes(out: dict, nodes: list) -> tuple[dict, dict, dict]:
    """Unweighted betweenness of nodes and edges, and eccentricities along the edges, of a directed graph."""
    node, edge, far = dict.fromkeys(nodes, 0.0), {}, {}
    for s in nodes:
        order, paths, dist, before = [], dict.fromkeys(nodes, 0.0), {s: 0}, {v: [] for v in nodes}
        paths[s] = 1.0
        todo = deque([s])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in out.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        far[s] = max(dist.values())
        owed = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                c = paths[v] / paths[w] * (1 + owed[w])
                edge[v, w] = edge.get((v, w), 0.0) + c
                owed[v] += c
            if w != s:
                node[w] += owed[w]
    return node, edge, far


def directed_clustering(pairs: list[tuple], nodes: list) -> float:
    """Mean over nodes of directed triangles by those possible, reciprocal edges counted out; loops are left out."""
    place = {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for s, t in pairs:
        if s != t:
            a[place[s], place[t]] = 1
    both = a + a.T
    closed = ((both @ both) * both.T).sum(1)
    deg = both.sum(1)
    room = 2 * (deg * (deg - 1) - 2 * (a * a.T).sum(1))
    return float(np.mean(np.divide(closed, room, out=np.zeros(len(nodes)), where=closed > 0)))


#: What graph search tells of a graph: numbers, and the betweenness of nodes and of edges.
MEASURES = "uid long, n long, diameter long, eccentricity double, assortativity double, max_betweenness double, clustering double, node_b array<struct<lid:long,b:double>>, edge_b array<struct<src:long,dst:long,b:double>>"


def graph_measures(edge: DataFrame) -> DataFrame:
    """Per user: diameter and mean eccentricity of the largest undirected component, assortativity, directed clustering, and betweenness of all nodes and edges as shares of the ordered pairs."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))
        nodes = sorted({x for p in pairs for x in p})
        near: dict = {v: set() for v in nodes}
        onward: dict = {v: [] for v in nodes}
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
            if a != b:
                onward[a].append(b)
        seen, best = set(), []
        for s in nodes:
            if s not in seen:
                part, todo = {s}, [s]
                while todo:
                    for w in near[todo.pop()] - part:
                        part.add(w)
                        todo.append(w)
                seen |= part
                best = max(best, sorted(part), key=len)
        _, _, far = brandes({v: near[v] - {v} for v in best}, best)
        node, way, _ = brandes(onward, nodes)
        n = len(nodes)
        scale, way_scale = 1 / max((n - 1) * (n - 2), 1), 1 / max(n * (n - 1), 1)
        deg = {v: len(near[v]) + (v in near[v]) for v in nodes}
        x = np.array([(deg[a], deg[b]) for a in best for b in near[a]], float)
        same = len(x) == 0 or x[:, 0].std() == 0
        row = {"uid": pdf["uid"].iloc[0], "n": n, "diameter": max(far.values()), "eccentricity": float(np.mean(list(far.values()))), "assortativity": None if same else float(np.corrcoef(x.T)[0, 1]), "max_betweenness": max(node.values()) * scale, "clustering": directed_clustering(pairs, nodes)}
        row["node_b"] = [{"lid": v, "b": node[v] * scale} for v in nodes]
        row["edge_b"] = [{"src": a, "dst": b, "b": way.get((a, b), 0.0) * way_scale} for a, b in sorted(set(pairs))]
        return pd.DataFrame([row])

    return edge.groupBy("uid").applyInPandas(one, MEASURES)


def graph_metrics(edge: DataFrame) -> DataFrame:
    """The numbers of ``graph_measures``."""
    return graph_measures(edge).drop("node_b", "edge_b")


def edge_betweenness(edge: DataFrame) -> DataFrame:
    """(uid, src, dst, betweenness) of all edges."""
    return graph_measures(edge).select("uid", F.explode("edge_b").alias("e")).select("uid", "e.src", "e.dst", F.col("e.b").alias("betweenness"))
