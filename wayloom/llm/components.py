"""Connected components of an edge table, by contraction: hook to the least neighbour, jump to roots, keep the edges between roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _roots(up: DataFrame) -> DataFrame:
    """(v, p) with p <= v -> (v, p): the root that each vertex's parents lead to."""
    while True:
        jump = up.select(F.col("v").alias("p"), F.col("p").alias("root"))
        nxt = materialize(up.join(jump, "p").select("v", F.col("root").alias("p"), (F.col("root") != F.col("p")).alias("moved")))
        up = nxt.select("v", "p")
        if nxt.where("moved").isEmpty():
            return up


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (v, c): every vertex of an edge with the least vertex reachable from it.

    Roots are vertices without a lesser neighbour; at most half of those that still have edges stay, so that
    the rounds add up to about one reading of the edges and the table of vertices.
    """
    rest = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = rest.select(F.col("b").alias("v"), F.col("a").alias("p")).union(rest.select(F.col("a").alias("v"), F.col("a").alias("p")))
        up = _roots(materialize(both.groupBy("v").agg(F.min("p").alias("p"))))
        if labels is None:
            labels = up.select("v", F.col("p").alias("c"))
        else:
            labels = labels.join(up.select(F.col("v").alias("c"), "p"), "c", "left").select("v", F.coalesce("p", "c").alias("c"))
        labels = materialize(labels)
        # The least of a component never changes its name, so a root left without edges is that least vertex.
        left = rest.join(up.select(F.col("v").alias("a"), F.col("p").alias("x")), "a").join(up.select(F.col("v").alias("b"), F.col("p").alias("y")), "b")
        rest = materialize(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if rest.isEmpty():
            return labels
