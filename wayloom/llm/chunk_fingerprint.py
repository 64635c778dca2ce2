"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes of the UTF-8 text sets chunk boundaries,
normalised as in FastCDC: a strict mask below the normal size, a loose one above,
between a least and a largest size. A fingerprint is the sorted set of chunk digests
(12 hex digits) with the chunk's length (3 hex digits). Likeness of one fingerprint
to another is the weighted containment: bytes of its chunks that the other also has
over all bytes of its chunks.

``fingerprint_edits`` pairs each document with the next in descending doc_id order.
The ids are cut into ranges; each range also gets the first document of the range
after it, so texts move once and no range depends on another.

Defined results: null texts are empty; an empty text has the empty fingerprint, 1.0
like another empty one and 0.0 like any other; equal ids order by text, descending;
null ids come last; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, NORMAL, LARGEST = 16, 64, 256
STRICT, LOOSE = np.uint32(0xFF << 24), np.uint32(0xF << 28)
GEAR = np.random.RandomState(20).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of a text."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # doubles the bytes that each hash covers, up to 32
        h[step:] += h[:-step] << np.uint32(step)
    loose_at = np.flatnonzero((h & LOOSE) == 0)
    strict = (loose_at[(h[loose_at] & STRICT) == 0] + 1).tolist()
    loose = (loose_at + 1).tolist()
    ends, start = [], 0
    while n - start > LEAST:
        end = min(n, start + LARGEST)
        i = bisect_left(strict, start + LEAST)
        if i < len(strict) and strict[i] < min(end, start + NORMAL):
            end = strict[i]
        else:
            i = bisect_left(loose, start + NORMAL)
            if i < len(loose) and loose[i] < end:
                end = loose[i]
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(text: str) -> dict[str, int]:
    """Digest and length of each distinct chunk."""
    data, out, start = text.encode("utf-8", "surrogatepass"), {}, 0
    for end in cuts(data):
        out[f"{hashlib.blake2b(data[start:end], digest_size=6).hexdigest()}{end - start:03x}"] = end - start
        start = end
    return out


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    return sum(w for k, w in a.items() if k in b) / sum(a.values())


def show(c: dict[str, int]) -> str:
    return "".join(sorted(c))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chunks long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_chunks", pa.int64())])


def _row(doc: tuple, nxt: tuple) -> tuple:
    doc_id, text, own = doc
    half = len(text) // 2
    edited = text[: len(text) - half] + nxt[1][:half]
    of_edited = chunks(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, show(own), show(of_edited), likeness(own, of_edited), likeness(own, nxt[2]), len(own)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (range, head, place): each document meets the one after it; a head closes its range."""
    last, at, closed, out = None, None, False, []
    for batch in batches:
        for r, head, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if r != at:
                last, at, closed = None, r, False
            if closed:
                continue
            doc = (doc_id, text, chunks(text))
            if last is not None:
                out.append(_row(last, doc))
            last, closed = doc, bool(head)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pydict(dict(zip(_ARROW.names, zip(*out, strict=True), strict=True)), schema=_ARROW)
                out = []
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(_ARROW.names, zip(*out, strict=True), strict=True)), schema=_ARROW)


def fingerprint_edits(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    spark = docs.sparkSession
    n = n_ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("__o"), F.coalesce("text", F.lit("")).alias("text"))
    ids = d.select("__o")
    # One bound per range comes to the driver, then one id per range.
    bounds = sorted(set(ids.select(F.percentile_approx("__o", [i / n for i in range(1, n)] or [0.5], 10 * n)).first()[0] or []))
    d = d.withColumn("__r", F.size(F.filter(F.lit(bounds), lambda b: b > F.col("__o"))) if bounds else F.lit(0))
    firsts = sorted(tuple(x) for x in d.groupBy("__r").agg(F.max("__o")).collect())
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # the first head closes the last range
    as_head = F.when(F.col("__o").isin(list(before)), F.array(F.struct(F.col("__r").alias("r"), F.lit(0).alias("h")), F.struct(F.get(F.array(*[F.lit(x) for x in before.values()]), F.array_position(F.lit(list(before)), F.col("__o")).cast("int") - 1).alias("r"), F.lit(1).alias("h"))))
    both = F.coalesce(as_head, F.array(F.struct(F.col("__r").alias("r"), F.lit(0).alias("h"))))
    dealt = d.select("doc_id", "__o", "text", F.explode(both).alias("x")).select(F.col("x.r").alias("r"), F.col("x.h").alias("h"), "doc_id", "text", "__o")
    dealt = dealt.repartition(n, "r").sortWithinPartitions("r", "h", F.desc("__o"), F.desc("text"))
    return dealt.select("r", "h", "doc_id", "text").mapInArrow(_walk, SCHEMA)
