"""Removal of repeated runs of lines, by winnowing over line hashes.

Lines are the ``\\n``-split parts that hold a word; lines without words are never
compared nor removed. A run of at least ``min_words`` words that also starts at an
earlier place (by doc_id, then text hash, then line) goes, whichever place that is.

1. *Fingerprints.* The window of a line is the shortest run from it on that holds
   ``min_words`` words; the least line hash of every window is selected, so two equal
   runs of that many words always share one.
2. *Positions.* Positions of equal fingerprints are brought together. Documents all of
   whose fingerprints stand at a single position hold no repeated run and are left alone.
3. *Extension.* In the others, windows are extended from a fingerprint found twice to
   both sides and compared as a whole: from their first line to the right, and to the
   left from their last. Equal ones meet, and all but the first go. Every line of a
   repeated run lies in the window from the run's first line, or else more than a
   window of the run ends with it, so that no pairs of occurrences are needed: a
   passage in a third of all documents costs one row a line.

Defined results: null texts hold no lines and stay null; rows equal in doc_id and
text are one document and share its result; null doc_ids sort first; an empty table
gives an empty table; further columns pass through; hashes are 128 bits wide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, materialize, words_of

MIN_WORDS = 50


def _hash(x: Column) -> Column:
    """128 bits: two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b"))


def _worded(line: Column) -> Column:
    return line.rlike(f"[^{BLANK}]")


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per line: its hash, its words from c0 to c1, and its window's fingerprint (null if the text ends before)."""
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("line"), i.alias("at")))
    flat = docs.select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("t"), F.posexplode(F.filter(parts, lambda x: _worded(x["line"]))).alias("pos", "x")
    ).select("d", "t", "pos", F.col("x.at").alias("at"), _hash(F.col("x.line")).alias("h"), F.size(words_of(F.col("x.line"))).cast("long").alias("w"))
    # One exchange serves the removal of repeated rows and the windows.
    flat = flat.repartition("d", "t").dropDuplicates(["d", "t", "pos"])
    flat = flat.withColumn("c1", F.sum("w").over(Window.partitionBy("d", "t").orderBy("pos")))
    span = Window.partitionBy("d", "t").orderBy("c0").rangeBetween(0, min_words - 1)
    return flat.withColumn("c0", F.col("c1") - F.col("w")).select(
        "d", "t", "pos", "at", "h", "c0", "c1", F.when(F.sum("w").over(span) >= min_words, F.min(F.struct(F.col("h").alias("h"), F.col("pos").alias("at"))).over(span)).alias("fp")
    )


def _later(windows: DataFrame, key: str) -> DataFrame:
    """Of the windows that are equal to others, all but the first."""
    here = F.struct("d", "t", "pos")
    first = windows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(first, key).where(F.col("first") != here)


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(d, t, gone): the indices of the ``\\n``-split parts removed from each document that loses any."""
    every = materialize(lines(docs, min_words))
    full = every.where("fp is not null").select("d", "t", F.col("fp.h").alias("fh"), F.col("fp.at").alias("at"))
    twice = full.distinct().groupBy("fh").count().where("count > 1").select("fh")
    active = full.join(twice, "fh", "left_semi").select("d", "t").distinct()
    doc = Window.partitionBy("d", "t")
    right, left = doc.orderBy("c0").rangeBetween(0, min_words - 1), doc.orderBy("c1").rangeBetween(-(min_words - 1), 0)
    whole = lambda span: F.when(F.max("c1").over(span) - F.min("c0").over(span) >= min_words, _hash(F.collect_list("h").over(span)))
    held = materialize(every.join(active, ["d", "t"], "left_semi").select("d", "t", "pos", "at", F.max("pos").over(right).alias("end"), whole(right).alias("r"), whole(left).alias("l")))
    marks = _later(held.select("d", "t", "pos", "end", "r"), "r").select("d", "t", "pos", "end")
    marks = marks.union(_later(held.select("d", "t", "pos", "l"), "l").select("d", "t", "pos", F.col("pos").alias("end")))
    # Marks come before the line they start at; a line is covered if a mark so far ends at it or later.
    both = held.select("d", "t", "pos", "at", F.lit(-1).alias("end")).union(marks.select("d", "t", "pos", F.lit(None).cast("int"), "end"))
    reach = F.max("end").over(doc.orderBy("pos", F.col("at").asc_nulls_first()))
    return both.withColumn("reach", reach).where("at is not null and reach >= pos").groupBy("d", "t").agg(F.collect_list("at").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with ``text`` shortened, and ``n_lines``, ``n_removed`` (long) added."""
    gone = removed_lines(docs, min_words).select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("gone").alias("__gone"))
    keyed = docs.withColumns({"__d": F.coalesce("doc_id", F.lit(-(2**63))), "__t": F.xxhash64("text")})
    out = keyed.join(gone, ["__d", "__t"], "left")
    parts = F.split("text", "\n")
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "__gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    return out.withColumns({
        "n_lines": F.coalesce(F.size(F.filter(parts, _worded)), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        "text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept),
    }).drop("__d", "__t", "__gone")
