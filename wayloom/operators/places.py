"""Places of users: detection by clustering, regular places, and clustering of whole tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans as SparkKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.sphere import pairwise
from . import network
from .clustering import Tosca


def steady_seed(*key) -> int:
    """The same number for the same key in every process."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=6).digest(), "big")


def locate(x: np.ndarray, k_min: int, k_max: int, seed: int, min_dist: float = 50.0, runs: int = 5) -> np.ndarray:
    """Medoids of the run that finds the fewest places; of equals the last."""
    best = None
    for r in range(runs):
        found = Tosca(k_min, k_max, min_dist=min_dist, seed=seed + r).fit(x).medoids
        if best is None or len(found) <= len(best):
            best = found
    return best


def detect_places(ends: DataFrame, keys: list[str], min_dist: float = 50.0, runs: int = 5) -> DataFrame:
    """Rows (keys, tid, end, lid, clon, clat): each trip end with the nearest place of its group.

    The bounds on the number of places are the group's distinct coarse and fine geohash cells.
    A group is one user's trip ends in one window; its size is that of a person's movement.
    """
    e = ends.select(*keys, "tid", "end", "t", "lon", "lat", geo.geohash_cell("lon", "lat", 5).alias("coarse"), geo.geohash_cell("lon", "lat", 7).alias("fine"))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema.fields if f.name in keys) + ", tid long, end int, lid long, clon double, clat double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "tid", "end"])
        x = pdf[["lon", "lat"]].to_numpy(float)
        heads = locate(x, pdf["coarse"].nunique(), pdf["fine"].nunique(), steady_seed(*(pdf[k].iloc[0] for k in keys)), min_dist, runs)
        own = pairwise(x, heads, "spherical").argmin(1)
        return pdf[[*keys, "tid", "end"]].assign(end=pdf["end"].astype("int32"), lid=own.astype("int64"), clon=heads[own, 0], clat=heads[own, 1])

    return e.groupBy(*keys).applyInPandas(one, out)


def prune(regular: list, onward: dict) -> list:
    """Drops places without a move to another regular place, one at a time in order, until none or two are left."""
    kept = list(regular)
    while len(kept) > 2:
        dead = next((p for p in kept if not any(q != p and q in kept for q in onward.get(p, ()))), None)
        if dead is None:
            break
        kept.remove(dead)
    return kept


def regular_places(ends: DataFrame, edge: DataFrame) -> DataFrame:
    """(uid, lid, support) of places at or above the knee of support that survive pruning; order is by first visit."""
    n = ends.groupBy("uid", "lid").agg(F.count("*").alias("support"), F.min(F.struct("t", "tid", "end")).alias("since"))
    k = network.knee(n.select("uid", "lid", "support"))
    onward = edge.groupBy("uid", F.col("src").alias("lid")).agg(F.collect_set("dst").alias("onward"))
    often = n.join(k, "uid").where("support >= min_support").join(onward, ["uid", "lid"], "left")
    rows = often.select("uid", "lid", "support", "since.t", "since.tid", "since.end", "onward")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "tid", "end"])
        goes = {p: set(o) if o is not None else set() for p, o in zip(pdf["lid"], pdf["onward"], strict=True)}
        return pdf[pdf["lid"].isin(prune(pdf["lid"].tolist(), goes))][["uid", "lid", "support"]]

    return rows.groupBy("uid").applyInPandas(one, "uid long, lid long, support long")


def global_kmeans(df: DataFrame, features: str, k: int, seed: int = 7, max_iter: int = 20) -> DataFrame:
    """Clusters a whole table by its array column; rows keep their columns and get ``cluster``. Null arrays stay out."""
    x = df.where(F.col(features).isNotNull()).withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    model = SparkKMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__v", predictionCol="cluster").fit(x)
    return model.transform(x).drop("__v")
