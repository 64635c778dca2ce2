"""Exact removal of repeated byte strings, with suffix arrays over anchored text.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes.

1. *Anchors.* Of the k-byte grams of each such string the least by hash is selected,
   so equal strings select equal grams at equal places. An anchor whose gram is found
   once in all documents cannot lie in a repeated string.
2. An anchor speaks for the strings around it, its stretch. Stretches that are equal
   as a whole are repeated from end to end.
3. *Suffix arrays.* Of the other stretches of a repeated gram, one of each kind is cut
   into cells aligned to the anchor. The suffix array of the cells' numbers brings
   strings that share all their whole cells side by side; these are then compared
   byte by byte at each of the places they can start at.
4. Repeated stretches are joined to their documents and united there.

Documents that share a whole text of ``LENGTH`` bytes or more lose all of it.

Defined results: null texts are empty; shorter texts lose nothing; repeated rows are
copies of each other; null doc_ids are kept as they are; an empty table gives an empty
table; other columns are dropped. Grams, stretches and texts are told apart by 64-bit
hashes (texts also by length); strings in step 3 by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .shingles import mixed, powers
from .suffix_array import suffix_array

LENGTH, GRAM, CELL = 200, 80, 16
WIDTH = LENGTH - GRAM + 1
#: Bits for the place in a number that orders grams by hash, then by place.
PLACE = 24
#: Cells that one suffix array is built of, unless a single gram has more.
CELLS = 60_000


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, gram hashes and stretch hashes of a text's anchors; texts under LENGTH have none."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    chosen = []
    step = (1 << PLACE) - WIDTH
    for lo in range(0, len(grams) - WIDTH + 1, step):  # one turn, but for texts of over 16 MB
        g = grams[lo : lo + step + WIDTH - 1]
        v = (g >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(g), dtype=np.uint64)
        span = 1
        while 2 * span <= WIDTH:
            v = np.minimum(v[:-span], v[span:])
            span *= 2
        if span < WIDTH:
            v = np.minimum(v[: len(v) - (WIDTH - span)], v[WIDTH - span :])
        chosen.append((v & np.uint64((1 << PLACE) - 1)).astype(np.int64) + lo)
    at = np.unique(np.concatenate(chosen))
    lo, hi = np.maximum(at - WIDTH + 1, 0), np.minimum(at + LENGTH, n)
    whole = mixed((sums[hi] - sums[lo]) * down[lo] + mixed(((at - lo) * 1024 + (hi - at)).astype(np.uint64)))
    return at, grams[at], whole


_BASE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("c", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("at", pa.list_(pa.int32())), ("g", pa.list_(pa.int64())), ("w", pa.list_(pa.int64()))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 400):
            part = batch.slice(lo, 400)
            n, sha, lists = [], [], []
            for t in part.column(2):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                n.append(len(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
                lists.append(anchors(np.frombuffer(raw, np.uint8)))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in lists])]).astype(np.int32))
            flat = [pa.array(np.concatenate([x[k] for x in lists]).view(np.int64)) for k in range(3)]
            flat[0] = flat[0].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sha), *[pa.ListArray.from_arrays(ends, x) for x in flat]], schema=_BASE_SCHEMA)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the anchors that stand for a kind of stretch -> the stretches' bytes."""
    for batch in batches:
        g, w, n, left, raw = [], [], [], [], []
        for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for x in own:
                lo = max(x["at"] - WIDTH + 1, 0)
                g.append(x["g"])
                w.append(x["w"])
                n.append(x["n"])
                left.append(x["at"] - lo)
                raw.append(data[lo : x["at"] + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(w, pa.int64()), pa.array(n, pa.int64()), pa.array(left, pa.int32()), pa.array(raw, pa.binary())], names=["g", "w", "n", "left", "raw"])


def repeated_starts(stretches: list[tuple[int, bytes]]) -> list[set[int]]:
    """(bytes before the anchor, bytes) of distinct stretches -> for each, starts relative to the anchor of strings that another also has."""
    numbers: dict[tuple[int, bytes], int] = {}
    text: list[int] = []
    where: list[tuple[int, int]] = []
    for k, (left, raw) in enumerate(stretches):
        for j in range(-(left // CELL), (len(raw) - left) // CELL):
            at = left + j * CELL
            text.append(numbers.setdefault((j, raw[at : at + CELL]), len(numbers) + 1))
            where.append((k, j))
        text.append(0)
        where.append((k, 1))
    out: list[set[int]] = [set() for _ in stretches]
    need = (LENGTH - CELL + 1) // CELL
    order = suffix_array(text)
    i = 0
    while i < len(order):
        a = order[i]
        head = text[a : a + need]
        m = i + 1
        # A separator would be among the cells if the stretch ended before.
        if where[a][1] <= 0 and 0 not in head and len(head) == need:
            while m < len(order) and text[order[m] : order[m] + need] == head:
                m += 1
            if m - i > 1:
                for r in range(CELL):
                    seen: dict[bytes, int] = {}
                    for x in order[i:m]:
                        k, j = where[x]
                        left, raw = stretches[k]
                        at = left + j * CELL - r
                        if at < 0 or at + LENGTH > len(raw):
                            continue
                        s = raw[at : at + LENGTH]
                        other = seen.setdefault(s, k)
                        if other != k:
                            out[other].add(j * CELL - r)
                            out[k].add(j * CELL - r)
        i = m
    return out


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by gram -> repeated intervals, relative to the anchor, of those found once."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        starts = repeated_starts([(r[3], r[4]) for r in rows])
        out = []
        for r, own in zip(rows, starts, strict=True):
            if own and r[2] == 1:
                runs: list[list[int]] = []
                for x in sorted(own):
                    if runs and x <= runs[-1][1]:
                        runs[-1][1] = x + LENGTH
                    else:
                        runs.append([x, x + LENGTH])
                out += [(r[0], r[1], a, b) for a, b in runs]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["g", "w", "a", "b"])

    rows: list[tuple] = []
    cells = 0
    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if cells > CELLS and rows[-1][0] != r[0]:
                yield flush(rows)
                rows, cells = [], 0
            rows.append(r)
            cells += len(r[4]) // CELL + 1
    if rows:
        yield flush(rows)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their repeated spans (flat starts and ends) -> counts and the rest's digest."""
    for batch in batches:
        out: list[tuple] = []
        for c, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for lo, hi in sorted((s["lo"], min(s["hi"], len(data))) for s in spans):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(hi, runs[-1][1])
                else:
                    runs.append([lo, hi])
            at, rest = 0, hashlib.sha256()
            for lo, hi in runs:
                rest.update(data[at:lo])
                at = hi
            rest.update(data[at:])
            out.append((c, len(data), sum(hi - lo for lo, hi in runs), len(runs), rest.hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols[:4]], pa.array(cols[4], pa.string())], names=["c", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long), kept_sha256."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("c"), "text")
    base = materialize(d.mapInArrow(_read, "doc_id long, c long, n_bytes long, sha string, at array<int>, g array<long>, w array<long>"))
    texts = base.groupBy("c").agg(F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("rep"))
    flat = base.select("c", F.explode(F.arrays_zip("at", "g", "w")).alias("x")).select("c", "x.at", "x.g", "x.w")
    twice = flat.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select("g")
    held = materialize(flat.join(twice, "g", "left_semi"))
    kinds = held.groupBy("g", "w").agg(F.count("*").alias("n"), F.min(F.struct("c", "at")).alias("one"))
    kinds = materialize(kinds)
    many = kinds.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g")
    mixed_kinds = kinds.join(many, "g", "left_semi")
    # The texts of documents that hold repeated grams, one of each.
    active = held.select("c").distinct().join(texts, "c")
    own = d.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("rep"), F.col("c").alias("c2"), "text")
    kept = materialize(active.join(own, "rep").where("c = c2").dropDuplicates(["c"]).select("c", "copies", "text"))
    by_text = mixed_kinds.groupBy(F.col("one.c").alias("c")).agg(F.collect_list(F.struct(F.col("one.at").alias("at"), "g", "w", "n")).alias("own"))
    cut = kept.join(by_text, "c").select("text", "own").mapInArrow(_cut, "g long, w long, n long, left int, raw binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = cut.repartition(parts, "g").sortWithinPartitions("g", "w").mapInArrow(_decide, "g long, w long, a int, b int")
    single = kept.where("copies = 1").select("c")
    loose = held.join(single, "c", "left_semi")
    lo, hi = F.greatest(F.col("at") - (WIDTH - 1), F.lit(0)), F.col("at") + LENGTH  # past the end is the end
    whole = loose.join(kinds.where("n > 1").select("g", "w"), ["g", "w"], "left_semi").select("c", lo.alias("lo"), hi.alias("hi"))
    part = loose.join(some, ["g", "w"]).select("c", (F.col("at") + F.col("a")).alias("lo"), (F.col("at") + F.col("b")).alias("hi"))
    marked = whole.union(part).groupBy("c").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    cleaned = kept.where("copies = 1").join(marked, "c").select("c", "text", "spans").mapInArrow(_remove, "c long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    cleaned = cleaned.select("c", F.col("n_removed").alias("gone"), F.col("n_spans").alias("runs"), F.col("kept_sha256").alias("rest"))
    gone_all = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    out = base.select("doc_id", "c", "n_bytes", "sha").join(texts.select("c", "copies"), "c").join(cleaned, "c", "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone_all, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone_all, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone_all, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
    )
