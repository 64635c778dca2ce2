"""Exact Jaccard self-join of documents over word shingles, as a metric-space join.

1 - Jaccard is a metric, so a link (distance <= r) bounds what both ends see of any
third point. Documents with equal shingle sets are one point. The join descends:

1. *Outer regions.* The outer pivots are the single shingles, in one order. A point
   belongs to the region of its first pivot; the window of points that can be linked
   to one of that region reaches as far as its q-th pivot (two sets within r of each
   other, each cut after its first q pivots, still share at least l of them). Points
   with fewer than l shared pivots are linked with nothing. The l - 1 most frequent
   of the shared pivots of a point are dropped: one shared pivot remains.
2. *Families.* Points that such regions connect form a family; no link leaves one.
3. *Inner pivots.* A family is split by pivots from among its points: each point has
   its home in the Voronoi cell of its nearest pivot, and is copied to every cell whose
   pivot is at most 2 r farther, which is as far as a link can reach. Cells are joined
   the same way, down to cells that are compared outright by counting common shingles
   over inverted lists. A cell that is hardly smaller than its parent is compared so too.
4. Large families are first taken apart by their rarest shingles: linked sets of n share
   one of the p rarest of each, p as in ``reach``, rare counted in the family. What texts
   merely have in common (passages, tables) no longer holds them together. Families that
   stay large are split by pivots between tasks; where cells don't get smaller, into
   pairs of blocks. The others are joined in memory, one by one.

Only the links of a spanning forest leave a family, at most one a point.

Defined results: null and empty texts are the empty set, linked with nothing; texts
shorter than a shingle are one shingle; rows with equal sets, repeated rows too, are
one point; null doc_ids count as the least id; texts under one doc_id are points of
their own; an empty table gives an empty table; other columns are dropped. Texts, sets
and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, materialize
from .components import components
from .shingles import shingle_sets

NO_ID = -(2**63)
#: Points that one task joins in memory, points a pivot of a larger family stands for, and points compared outright.
BIG, CELL, LEAF = 4000, 1000, 256
#: Bytes of sets that one task joins in memory, and pivots that a family is split by at a time.
BYTES, PIVOTS = 64_000_000, 16


def reach(n: int, pct: int) -> tuple[int, int]:
    """(q, l): how many pivots of a set of n shingles are looked at, and how many of them a linked set shares."""
    p = n - -(-pct * n // 100) + 1
    q = min(n, p + (p + 1) // 2)
    return q, q - p + 1


def _sketch(shingle: int, pct: int):
    schema = pa.schema([("doc", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("need", pa.int64()), ("pivots", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = batch.column(0), batch.column(1), batch.column(2)
            for lo in range(0, len(ids), 500):
                n, a, need, pivots = [], [], [], []
                for s in shingle_sets(texts[lo : lo + 500], shingle):
                    n.append(len(s))
                    a.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                    need.append(reach(-(-pct * len(s) // 100), pct)[1] if len(s) else 0)
                    pivots.append(s[: reach(len(s), pct)[0]].view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in pivots])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pivots) if pivots else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 500], marks[lo : lo + 500], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(need, pa.int64()), lists], schema=schema)

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sets = [s.tobytes() for s in shingle_sets(part.column(1), shingle)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["a", "s"])

    return run


class Forest:
    """Union-find that keeps the links which joined something."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def compare_all(own: list[int], sets: list[np.ndarray], pct: int, forest: Forest) -> None:
    """Links among the points, by counting common shingles over inverted lists; points that links join already need none among them."""
    roots = [forest.root(x) for x in own]
    most = Counter(roots).most_common(1)[0][0]
    own = [x for x, r in zip(own, roots, strict=True) if r == most] + [x for x, r in zip(own, roots, strict=True) if r != most]
    size = np.array([len(sets[x]) for x in own])
    _, codes = np.unique(np.concatenate([sets[x] for x in own]), return_inverse=True)
    points = np.repeat(np.arange(len(own)), size)
    order = np.argsort(codes, kind="stable")
    lists, ends = points[order], np.searchsorted(codes[order], np.arange(codes.max() + 2))
    start = np.concatenate([[0], np.cumsum(size)])
    for i in range(roots.count(most), len(own)):
        c = codes[start[i] : start[i + 1]]
        lo, n = ends[c], ends[c + 1] - ends[c]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(lists[at], minlength=len(own))[:i]
        for k in np.flatnonzero(100 * both >= pct * (size[:i] + size[i] - both)).tolist():
            forest.join(own[k], own[i])


def distances(s: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    both = np.array([int((p[np.minimum(np.searchsorted(p, s), len(p) - 1)] == s).sum()) for p in pivots])
    return 1 - both / (np.array([len(p) for p in pivots]) + len(s) - both)


def cells(d: np.ndarray, pct: int) -> np.ndarray:
    """(points, pivots) distances -> which points each pivot's cell takes: its own and those a link can reach from it."""
    return d <= d.min(1, keepdims=True) + 2 * (1 - pct / 100) + 1e-9


def join_points(own: list[int], sets: list[np.ndarray], pct: int, forest: Forest, depth: int = 0) -> None:
    if len(own) > LEAF:
        heads = [own[k * len(own) // 8] for k in range(8)]
        far = np.array([distances(sets[x], [sets[h] for h in heads]) for x in own])
        taken = cells(far, pct)
        # A point is compared with all of a cell, so smaller cells pay off only while their squares sum to less.
        if (taken.sum(0).astype(float) ** 2).sum() < 0.8 * len(own) ** 2:
            for k in range(8):
                join_points([x for x, t in zip(own, taken[:, k], strict=True) if t], sets, pct, forest, depth + 1)
            return
        for i, k in np.argwhere(far <= 1 - pct / 100 - 1e-9).tolist():  # those at the very bound are compared
            forest.join(own[i], heads[k])
    if len(own) > 1:
        compare_all(own, sets, pct, forest)


def _families(pct: int):
    """Points sorted by family -> links of a spanning forest of each."""

    def flush(a: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        forest = Forest(len(a))
        join_points(sorted(range(len(a)), key=lambda x: (len(sets[x]), a[x])), sets, pct, forest)
        return pa.RecordBatch.from_arrays([pa.array([a[x] for x, _ in forest.links], pa.int64()), pa.array([a[y] for _, y in forest.links], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a, sets = None, [], []
        for batch in batches:
            for f, x, s in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if f != last:
                    if len(a) > 1:
                        yield flush(a, sets)
                    last, a, sets = f, [], []
                a.append(x)
                sets.append(np.frombuffer(s, np.uint64))
        if len(a) > 1:
            yield flush(a, sets)

    return run


def _split(pct: int):
    """Blocks of a family's points, its pivots first -> the points with the cells (pivots) that take them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, pivots = None, [], []
        for batch in batches:
            out: list[tuple] = []
            for f, block, point, a, s in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (f, block) != last:
                    last, names, pivots = (f, block), [], []
                if not point:
                    names.append(a)
                    pivots.append(np.frombuffer(s, np.uint64))
                elif pivots:
                    d = distances(np.frombuffer(s, np.uint64), pivots)[None]
                    out += [(f, names[k], a) for k in np.flatnonzero(cells(d, pct)[0])]
                else:
                    out.append((f, 0, a))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["f", "p", "a"])

    return run


def _spread(pct: int):
    """Points -> their size, how many of their rarest shingles are looked at, and all shingles."""
    schema = pa.schema([("f", pa.int64()), ("a", pa.int64()), ("n", pa.int64()), ("p", pa.int64()), ("h", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                sets = [np.frombuffer(s, np.int64) for s in part.column(2).to_pylist()]
                n = [len(s) for s in sets]
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                p = [m - -(-pct * m // 100) + 1 for m in n]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(p, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], schema=schema)

    return run


def refined(points: DataFrame, pct: int) -> DataFrame:
    """(f, a, s), each point in one family -> the same with smaller families, by the rarest shingles; points linked with nothing go."""
    flat = points.select("f", "a", "s").mapInArrow(_spread(pct), "f long, a long, n long, p long, h array<long>").select("f", "a", "n", "p", F.explode("h").alias("h"))
    often = flat.groupBy("f", "h").agg(F.count("*").alias("m")).where("m > 1")
    own = Window.partitionBy("a")
    # Shingles that a point shares with none of its family are its rarest.
    held = flat.join(often, ["f", "h"]).withColumns({"all": F.count("*").over(own), "k": F.row_number().over(own.orderBy("m", "h"))})
    held = materialize(held.where("n - all + k <= p").select("f", "h", "a"))
    near = held.join(held.groupBy("f", "h").agg(F.min("a").alias("b")), ["f", "h"]).where("a != b").select("a", "b").distinct()
    return components(near).select(F.col("c").alias("f"), F.col("v").alias("a")).join(points.select("a", "s"), "a").select("f", "a", "s")


def _sized(points: DataFrame) -> DataFrame:
    return points.join(points.groupBy("f").agg(F.count("*").alias("m"), F.sum(F.length("s")).alias("w")), "f")


def family_links(points: DataFrame, pct: int) -> DataFrame:
    """(f, a, s): families of points with their sets, each point in one -> links that span each component."""
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small, todo, turn = [], points, 0
    while True:
        todo = materialize(_sized(todo))
        fits = f"m <= {BIG} and w <= {BYTES}"
        small.append(todo.where(fits).select("f", "a", "s"))
        large = todo.where(f"not ({fits})")
        if large.isEmpty():
            break
        turn += 1
        if turn == 1:
            todo = refined(large, pct)
            continue
        blocks = F.ceil(F.greatest(F.col("m") / CELL, F.col("w") * 4 / BYTES)).cast("long")
        heads = F.least(blocks, F.lit(PIVOTS))
        pivot = F.pmod(F.xxhash64("a", F.lit(turn)), F.col("m")) < heads
        pivots = large.where(pivot).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).select("f", "block", F.lit(0).alias("point"), "a", "s")
        own = large.select("f", F.pmod(F.xxhash64("a", F.lit(-turn)), blocks).alias("block"), F.lit(1).alias("point"), "a", "s")
        dealt = pivots.union(own).repartition(parts, "f", "block").sortWithinPartitions("f", "block", "point", "a")
        cut = materialize(dealt.mapInArrow(_split(pct), "f long, p long, a long"))
        size = cut.groupBy("f", "p").agg(F.count("*").alias("n")).join(large.groupBy("f").agg(F.first("m").alias("m")), "f")
        # Families whose cells stay large are cut into pairs of blocks instead; this ends.
        slow = materialize(size.groupBy("f").agg(F.sum(F.col("n") * F.col("n")).alias("q"), F.first("m").alias("m")).where("q >= 0.8 * m * m").select("f"))
        halves = F.ceil(F.greatest(F.col("m") * 2 / BIG, F.col("w") * 2 / BYTES)).cast("int")
        b = F.pmod(F.xxhash64("a", F.lit(0)), halves).cast("int")
        other = F.explode(F.sequence(F.lit(0), halves - 1)).alias("o")
        pairs = large.join(slow, "f", "left_semi").select("f", "a", "s", b.alias("b"), other)
        pairs = pairs.select(F.xxhash64("f", F.least("b", "o"), F.greatest("b", "o"), F.lit("blocks")).alias("f"), "a", "s")
        small.append(pairs)
        todo = cut.join(slow, "f", "left_anti").join(large.select("f", "a", "s"), ["f", "a"]).select(F.xxhash64("f", "p").alias("f"), "a", "s")
    every = small[0]
    for x in small[1:]:
        every = every.union(x)
    dealt = every.repartition(parts, "f").sortWithinPartitions("f", "a")
    return materialize(dealt.mapInArrow(_families(pct), "a long, b long"))


def _regions(sketch: DataFrame) -> DataFrame:
    """(h, a): the points of each outer region that has several."""
    flat = sketch.where("n > 0").select("a", "need", F.explode("pivots").alias("h"))
    shared = flat.groupBy("h").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("h", "m")
    held = materialize(flat.join(shared, "h").groupBy("h", "a").agg(F.first("need").alias("need"), F.first("m").alias("m")))
    own = Window.partitionBy("a")
    cut = held.withColumns({"all": F.count("*").over(own), "k": F.row_number().over(own.orderBy("m", "h"))})
    cut = cut.where("all >= need and k <= all - need + 1").select("h", "a")
    return materialize(cut.join(cut.groupBy("h").count().where("count > 1"), "h", "left_semi"))


def text_mark() -> Column:
    """What tells the texts under one doc_id apart."""
    return F.xxhash64("text")


def _labelled(docs: DataFrame, shingle: int, pct: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, t, n, a), and points (a, doc, t, c): the row that stands for a set, and its component."""
    d = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_mark().alias("t"), "text")
    sketch = materialize(d.mapInArrow(_sketch(shingle, pct), "doc long, t long, n long, a long, need long, pivots array<long>"))
    points = sketch.where("n > 0").groupBy("a").agg(F.min(F.struct("doc", "t")).alias("row")).select("a", "row.doc", "row.t")
    regions = _regions(sketch)
    active = regions.select("a").distinct().join(points, "a")
    texts = d.join(active, ["doc", "t"]).select("a", "text")
    sets = materialize(texts.dropDuplicates(["a"]).mapInArrow(_sets(shingle), "a long, s binary"))
    near = regions.join(regions.groupBy("h").agg(F.min("a").alias("b")), "h").groupBy("a", "b").count().where("a != b")
    families = components(near.select("a", "b"))
    links = family_links(families.select(F.col("c").alias("f"), F.col("v").alias("a")).join(sets, "a").select("f", "a", "s"), pct)
    labels = components(links)
    named = points.join(labels.withColumnRenamed("v", "a"), "a", "left").select("a", "doc", "t", F.coalesce("c", "a").alias("c"))
    return sketch, named


def join(docs: DataFrame, shingle: int = 5, pct: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach, itself included)."""
    sketch, named = _labelled(docs, shingle, pct)
    least = named.groupBy("c").agg(F.min("doc").alias("component"))
    parts = named.join(least, "c").select("a", "component")
    out = sketch.select("doc", "n", "a").join(parts, "a", "left")
    real = lambda c: F.when(c != NO_ID, c)
    return out.select(real(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.coalesce("component", "doc")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 5, pct: int = 80) -> DataFrame:
    """One document of each component, that of the least doc_id (then text hash), and all without a word.

    Of rows with that doc_id and that text, one stays.
    """
    d = docs.withColumns({"__doc": F.coalesce("doc_id", F.lit(NO_ID)), "__t": text_mark()})
    worded = F.coalesce("text", F.lit("")).rlike(f"[^{BLANK}]")
    named = _labelled(docs, shingle, pct)[1]
    stay = named.groupBy("c").agg(F.min(F.struct("doc", "t")).alias("row")).select(F.col("row.doc").alias("__doc"), F.col("row.t").alias("__t"))
    kept = d.where(worded).join(stay, ["__doc", "__t"], "left_semi").dropDuplicates(["__doc", "__t"])
    return kept.select(*docs.columns).union(docs.where(~worded))
