"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is its share of all words by weight, at most ``max_repeat`` times
what it has; what is above goes to the others by weight, in closed form (a water
level). A source takes all its documents as often as they fit whole. For the budget
that remains, documents are counted by exact length; every length gets its
proportional number, the longest lengths then fill most of what is left, and a
bounded-knapsack table closes the rest, which is at most two longest documents.
Which documents of a length are taken follows a seeded hash.

Only (source, length, count) rows reach one task; they grow with the longest
document, not with the number of documents. Documents of one length are dealt to
hash buckets before they are ranked, so a very frequent length is no single group.

Defined results: a null text has size 0; a null source is a source, last in order;
documents of size 0 are taken zero words; rows equal in doc_id and text are documents
of their own, of which any may be taken; an empty table gives an empty table; further
columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, materialize

WEIGHTS = (5.0, 2.0, 1.0)
SEED = 17
#: Documents that a hash bucket of one source and length is to hold.
BUCKET = 1000


def n_words(text: Column) -> Column:
    """Words are counted by their first characters: no array is built."""
    firsts = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), f"[{BLANK}]+([^{BLANK}])?[^{BLANK}]*", "$1")
    return F.length(firsts).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """(source, source_size) -> adds ``target`` (double); one row per source."""
    # Sources in code point order with nulls last; UTF-8 bytes sort as code points do.
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    cap = F.col("source_size") * F.lit(float(max_repeat))
    s = sizes.withColumns({"w": w, "cap": cap}).withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - before) / rest)
    # The water level is that of the first source, in order of ratio, which it does not reach the cap of.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return s.withColumn("target", F.least(F.col("cap"), F.col("w") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "target")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their sizes sum to the budget, or as near below as can be."""
    order = np.argsort(lengths)
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * have).sum())
    if budget >= total:
        taken = have.copy()
    else:
        taken = np.array([h * budget // total for h in have.tolist()], dtype=np.int64)
    left = budget - int((size * taken).sum())
    spare = int(size[-1]) if len(size) else 0  # what the knapsack below is left with at least, for its choice
    for i in range(len(size) - 1, -1, -1):
        extra = max(0, min(int(have[i] - taken[i]), (left - spare) // int(size[i])))
        taken[i] += extra
        left -= extra * int(size[i])
    if left > 0:
        # Bounded knapsack over what is left: bit b of a set says that b words can be made; larger sets only grow.
        sets, used = [1], []
        for i in range(len(size)):
            free, s = int(have[i] - taken[i]), int(size[i])
            if free <= 0 or s > left:
                continue
            reach, k = sets[-1], 1
            free = min(free, left // s)
            while free > 0:  # copies in powers of two
                k = min(k, free)
                reach |= (reach << (k * s)) & ((1 << (left + 1)) - 1)
                used.append((i, k))
                sets.append(reach)
                free -= k
                k *= 2
            if sets[-1] >> left & 1:
                break
        goal = sets[-1].bit_length() - 1
        for (i, k), reach in zip(reversed(used), reversed(sets[:-1]), strict=True):
            if not reach >> goal & 1:
                taken[i] += k
                goal -= k * int(size[i])
    out = np.zeros(len(lengths), np.int64)
    out[order] = taken
    return out


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    have, size = int(pdf["source_size"].iloc[0]), pdf["size"].to_numpy()
    whole = int(pdf["target"].iloc[0] // have) if have else 0
    # The nearest whole budget; the cap is a whole number, so rounding keeps below it.
    budget = round(float(pdf["target"].iloc[0])) - whole * have
    fit = np.zeros(len(size), np.int64)
    if budget > 0:
        fit[size > 0] = fit_counts(size[size > 0], pdf["n"].to_numpy()[size > 0], budget)
    return pdf.assign(whole=whole, fit=fit)[["source", "size", "n", "source_size", "target", "whole", "fit"]]


def cut(rows: DataFrame, bucket: str, order: str) -> DataFrame:
    """(s, z, need, bucket, order) -> (s, z, last, rest): the value of ``order`` that holds the need-th row of (s, z), and the how manieth of its equals that is.

    Buckets follow the order; only counts of them, and of the values of one of them, are sorted.
    """
    run = Window.partitionBy("s", "z").orderBy(bucket)
    filled = rows.groupBy("s", "z", "need", bucket).agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(run) - F.col("m"))
    edge = filled.where("before < need and before + m >= need").select("s", "z", bucket, (F.col("need") - F.col("before")).alias("left"))
    values = rows.drop("need").join(edge, ["s", "z", bucket]).groupBy("s", "z", "left", order).agg(F.count("*").alias("m"))
    each = values.withColumn("before", F.sum("m").over(Window.partitionBy("s", "z").orderBy(order)) - F.col("m"))
    return each.where("before < left and before + m >= left").select("s", "z", F.col(order).alias("last"), (F.col("left") - F.col("before")).alias("rest"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = 3, seed: int = SEED) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``taken`` added (see the module)."""
    mark = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 1)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    # Written once: texts are read and their words counted a single time, and a row keeps its number.
    d = materialize(docs.drop("source_size", "target").withColumns({"size": n_words(F.col("text")), "__mark": mark, "__tie": F.monotonically_increasing_id(), "__s": key}))
    hist = d.groupBy("source", "size").agg(F.count("*").alias("n"))
    sources = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    h, g = hist.alias("h"), targets(sources, weights, max_repeat).alias("g")
    keyed = h.join(g, F.col("h.source").eqNullSafe(F.col("g.source"))).select("h.source", "h.size", "h.n", "g.source_size", "g.target")
    plan = keyed.groupBy("source").applyInPandas(_plan, "source string, size long, n long, source_size long, target double, whole long, fit long")
    plan = materialize(plan).select(key.alias("s"), F.col("size").alias("z"), "n", "source_size", "target", "whole", "fit")
    # Lengths taken in part: seeded hashes are cut where they hold the last document, and rows of equal ones by their numbers.
    some = plan.where("fit > 0 and fit < n").select("s", "z", "n", F.col("fit").alias("need"))
    parts = F.ceil(F.col("n") / BUCKET).cast("long")
    part = F.floor(F.shiftright("__mark", 32) * parts / F.lit(float(1 << 31))).cast("long")
    dealt = d.select(F.col("__s").alias("s"), F.col("size").alias("z"), "__mark", "__tie").join(some, ["s", "z"]).withColumn("part", part)
    last = materialize(cut(dealt.select("s", "z", "need", "part", "__mark"), "part", "__mark"))
    equal = dealt.drop("need").join(last, ["s", "z"]).where("__mark = last")
    rows = equal.select("s", "z", F.col("rest").alias("need"), F.shiftright("__tie", 33).alias("task"), "__tie")
    final = cut(rows, "task", "__tie").select("s", "z", F.col("last").alias("tie"))
    plan = plan.join(last.join(final, ["s", "z"]).select("s", "z", "last", "tie"), ["s", "z"], "left")
    names = {"s": "__s", "z": "__z", "n": "__n", "whole": "__whole", "fit": "__fit", "last": "__last", "tie": "__last_tie"}
    out = d.join(plan.withColumnsRenamed(names).withColumnRenamed("__s", "__k"), (F.col("__s") == F.col("__k")) & (F.col("size") == F.col("__z")))
    first = (F.col("__mark") < F.col("__last")) | ((F.col("__mark") == F.col("__last")) & (F.col("__tie") <= F.col("__last_tie")))
    picked = (F.col("__fit") > 0) & ((F.col("__fit") >= F.col("__n")) | F.coalesce(first, F.lit(False)))
    return out.withColumn("taken", F.col("size") * (F.col("__whole") + picked.cast("long"))).drop("__mark", "__tie", "__k", *names.values())
