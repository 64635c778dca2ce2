"""Personal data found by patterns and by a character-level BiLSTM-CRF.

The tagger is trained in numpy, on at most ``SAMPLE`` windows of the documents, the least
by a hash. Its labelled spans are the pattern spans and secrets (values given to a name
such as token or key), together with rewritten forms of the same spans that the patterns
miss (no plus, dots or slashes between the groups of digits, spaces around the @, other
letters in secrets), and windows with digits that are none of these. A fifth of them is
held out: how sure a span must be is the least level at which ``RIGHT`` of the spans found
there are right.

Texts are tagged in overlapping windows around every digit or @; a text without any
holds no span of these kinds. Emissions are averaged where windows overlap and decoded
once along the whole stretch they cover, so that the windows agree. Spans of the tagger
are added where they touch no pattern span, are surely tagged and complete in form.

Defined results: null texts are empty and have no spans; repeated rows are tagged
alike; without a pattern span in the documents there is nothing to learn from and the
pattern spans are all; an empty table gives an empty table; further columns pass
through ``find`` but for those it adds.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .pii_patterns import KINDS as BASE
from .pii_patterns import SECRET, TRIGGER, digits_of, show, spans

#: What the tagger knows: the kinds of the patterns, and secrets.
KINDS = (*BASE, "secret")
WINDOW, STRIDE = 96, 48
SAMPLE, STEPS, BATCH, RATE = 600, 450, 32, 0.015
HIDDEN, EMBED = 16, 12
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
#: Share of the sample that is held out, and how many of the spans found there must be right for a threshold.
HELD, RIGHT, LEVELS = 5, 0.98, (0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995)
NEVER = -1e4
#: Characters: ASCII ones each, other letters, other, padding.
OTHER_LETTER, OTHER, PAD, N_CHARS = 128, 129, 130, 131


def codes(text: str, width: int) -> np.ndarray:
    out = np.full(width, PAD, np.int64)
    out[: len(text)] = [ord(c) if c < "\x80" else OTHER_LETTER if c.isalpha() else OTHER for c in text]
    return out


def tags_of(length: int, found: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, a, b in found:
        if not y[a:b].any():
            k = 1 + 2 * KINDS.index(kind)
            y[a], y[a + 1 : b] = k, k + 1
    return y


def allowed() -> np.ndarray:
    """0 where a tag may follow another, NEVER elsewhere: an inside follows its begin or inside."""
    t = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        t[:, 2 + 2 * k] = NEVER
        t[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return t


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _softmax_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, seed: int = 3):
        r = np.random.RandomState(seed)
        self.sure = LEVELS[-1]
        self.p = {"E": r.randn(N_CHARS, EMBED) * 0.3, "O": r.randn(2 * HIDDEN, TAGS) * 0.2, "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p |= {f"W{d}": r.randn(EMBED, 4 * HIDDEN) * 0.3, f"U{d}": r.randn(HIDDEN, 4 * HIDDEN) * 0.2, f"a{d}": np.zeros(4 * HIDDEN)}

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """(time, windows, EMBED) -> (time, windows, HIDDEN) and what the gradient needs."""
        n, m = x.shape[:2]
        h, c, out, keep = np.zeros((m, HIDDEN), x.dtype), np.zeros((m, HIDDEN), x.dtype), np.empty((n, m, HIDDEN), x.dtype), []
        pre = x @ self.p[f"W{d}"] + self.p[f"a{d}"]
        for t in range(n):
            z = pre[t] + h @ self.p[f"U{d}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            e = np.tanh(c)
            h = o * e
            out[t] = h
            keep.append((i, f, o, g, e, *before))
        return out, keep

    def _lstm_back(self, x: np.ndarray, keep: list, dh_all: np.ndarray, d: str, grad: dict) -> np.ndarray:
        n, m = x.shape[:2]
        dh, dc, dz_all = np.zeros((m, HIDDEN)), np.zeros((m, HIDDEN)), np.empty((n, m, 4 * HIDDEN))
        for t in range(n - 1, -1, -1):
            i, f, o, g, e, h0, c0 = keep[t]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - e * e)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * e * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz_all[t] = dz
            grad[f"U{d}"] += h0.T @ dz
            dh, dc = dz @ self.p[f"U{d}"].T, dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad[f"W{d}"] += x.reshape(-1, EMBED).T @ flat
        grad[f"a{d}"] += flat.sum(0)
        return dz_all @ self.p[f"W{d}"].T

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(windows, width) character codes -> (windows, width, TAGS) scores."""
        e = self.p["E"][x.T]
        f, _ = self._lstm(e, "f")
        b, _ = self._lstm(e[::-1], "b")
        return (np.concatenate([f, b[::-1]], 2) @ self.p["O"] + self.p["c"]).transpose(1, 0, 2)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of tags under the CRF, and its gradient."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        e = self.p["E"][x.T]
        f, kf = self._lstm(e, "f")
        b, kb = self._lstm(e[::-1], "b")
        h = np.concatenate([f, b[::-1]], 2)
        s = h @ self.p["O"] + self.p["c"]  # (time, windows, TAGS)
        n, m = s.shape[:2]
        trans = self.p["T"] + allowed()
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[0] = s[0]
        for t in range(1, n):
            alpha[t] = s[t] + _softmax_sum(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(n - 2, -1, -1):
            beta[t] = _softmax_sum(trans + (s[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _softmax_sum(alpha[-1], 1)
        ds = np.exp(alpha + beta - z[None, :, None])
        yt = y.T
        gold = np.take_along_axis(s, yt[:, :, None], 2).sum() + trans[yt[:-1], yt[1:]].sum()
        for t in range(1, n):
            grad["T"] += np.exp(alpha[t - 1][:, :, None] + trans + (s[t] + beta[t])[:, None, :] - z[:, None, None]).sum(0)
        np.subtract.at(grad["T"], (yt[:-1], yt[1:]), 1)
        tt, mm = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
        ds[tt, mm, yt] -= 1
        grad["O"] = h.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, TAGS)
        grad["c"] = ds.sum((0, 1))
        dh = ds @ self.p["O"].T
        de = self._lstm_back(e, kf, dh[:, :, :HIDDEN], "f", grad) + self._lstm_back(e[::-1], kb, dh[::-1, :, HIDDEN:], "b", grad)[::-1]
        np.add.at(grad["E"], x.T, de)
        return float(z.sum() - gold) / m, {k: g / m for k, g in grad.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 5) -> "Tagger":
        r, order = np.random.RandomState(seed), np.zeros(0, np.int64)
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            while len(order) < BATCH:
                order = np.concatenate([order, r.permutation(len(x))])
            own, order = order[:BATCH], order[BATCH:]
            _, grad = self.loss(x[own], y[own])
            size = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g * g
                self.p[k] -= RATE * (1 - 0.95 * step / steps) * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of one stretch -> its best tags, and each one's marginal probability."""
        n, trans = len(s), self.p["T"] + allowed()
        start = np.where(np.arange(TAGS) % 2 + (np.arange(TAGS) == 0) > 0, 0, NEVER)
        best, back = s[0] + start, np.zeros((n, TAGS), np.int64)
        alpha, beta = np.empty((n, TAGS)), np.zeros((n, TAGS))
        alpha[0] = best
        for t in range(1, n):
            paths = best[:, None] + trans
            back[t] = paths.argmax(0)
            best = paths.max(0) + s[t]
            alpha[t] = s[t] + _softmax_sum(alpha[t - 1][:, None] + trans, 0)
        for t in range(n - 2, -1, -1):
            beta[t] = _softmax_sum(trans + s[t + 1] + beta[t + 1], 1)
        path = np.empty(n, np.int64)
        path[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        marginal = np.exp(alpha + beta - _softmax_sum(alpha[-1], 0))
        return path, marginal[np.arange(n), path]


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text around its digits and @, half a window on either side."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - STRIDE), min(len(text), m.end() + STRIDE)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def starts(length: int) -> list[int]:
    """Windows over a stretch; the last one ends with it."""
    return [0] if length <= WINDOW else [*range(0, length - WINDOW, STRIDE), length - WINDOW]


def _complete(kind: str, s: str) -> bool:
    n = len(digits_of(s))
    if kind == "secret":
        return len(s) >= 16 and 0 < n < len(s) and not any(c.isspace() for c in s)
    return {"email": s.count("@") == 1 and "." in s.split("@")[-1], "ip": s.count(".") == 3 and 4 <= n <= 12, "card": 12 <= n <= 19, "phone": 9 <= n <= 15}[kind]


def runs_of(path: np.ndarray) -> list[tuple[str, int, int]]:
    """The spans that tags say."""
    out, begin = [], np.flatnonzero(path % 2 == 1)
    for x in begin.tolist():
        y = x + 1
        while y < len(path) and path[y] == path[x] + 1:
            y += 1
        out.append((KINDS[path[x] // 2], x, y))
    return out


def added(tagger: Tagger, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The tagger's further spans in each text."""
    todo = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for at in range(0, len(todo), 200):
        part = todo[at : at + 200]
        cut = [(k, a + o, min(b, a + o + WINDOW)) for k, (_, a, b) in enumerate(part) for o in starts(b - a)]
        for lo in range(0, len(cut), 2000):  # a stretch may have any number of windows
            own = cut[lo : lo + 2000]
            e = tagger.emissions(np.stack([codes(texts[part[k][0]][a:b], WINDOW) for k, a, b in own]))
            if lo == 0:
                total = [np.zeros((b - a, TAGS)) for _, a, b in part]
                seen = [np.zeros((b - a, 1)) for _, a, b in part]
            for (k, a, b), s in zip(own, e, strict=True):
                x = a - part[k][1]
                total[k][x : x + b - a] += s[: b - a]
                seen[k][x : x + b - a] += 1
        for k, (i, a, _) in enumerate(part):
            path, sure = tagger.decode(total[k] / seen[k])
            ends = np.array([q for _, _, q in base[i]], np.int64)
            for kind, x, y in runs_of(path):
                lo, hi = a + x, a + y
                # Pattern spans are in order of their starts; those of one kind don't overlap.
                near = base[i][max(0, int(np.searchsorted(np.maximum.accumulate(ends), lo, side="right"))) :] if len(ends) else []
                free = all(q <= lo for _, p, q in itertools.takewhile(lambda b, hi=hi: b[1] < hi, near))
                if free and sure[x:y].min() >= tagger.sure and _complete(kind, texts[i][lo:hi]):
                    out[i].append((kind, lo, hi))
    return out


def rewritten(kind: str, s: str, turn: int) -> str:
    """A form of the same data that no pattern takes."""
    if kind == "email":
        return s.replace("@", " @ ") if turn % 2 else s.replace("@", " @")
    if kind == "card":
        d = digits_of(s)
        return ("." if turn % 2 else "/").join(d[i : i + 4] for i in range(0, len(d), 4))
    if kind == "phone":
        return s[1:] if turn % 2 else s[1:].replace(" ", ".")
    if kind == "secret":
        return "".join(chr(ord(c) + 7 + turn % 9) if "a" <= c <= "f" else c for c in s) if turn % 2 else s.upper()
    return s


def labelled(text: str) -> list[tuple[str, int, int]]:
    """The spans that the tagger learns from: the patterns', and secrets given to a name that says so."""
    secrets = [("secret", *m.span(1)) for m in SECRET.finditer(text)]
    base = [b for b in spans(text) if all(b[2] <= p or q <= b[1] for _, p, q in secrets)]
    return sorted(base + secrets, key=lambda s: s[1])


def _examples(sample: int):
    """Texts -> windows with their spans: around each labelled span, and where digits are none; of a task's the least by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bool, set[tuple]] = {True: set(), False: set()}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text or not TRIGGER.search(text):
                    continue
                base = labelled(text)
                for a, b in stretches(text):
                    for o in starts(b - a):
                        lo, hi = a + o, min(b, a + o + WINDOW)
                        inner = [(k, p - lo, q - lo) for k, p, q in base if lo <= p and q <= hi]
                        if all(q <= lo or hi <= p or (lo <= p and q <= hi) for _, p, q in base):
                            window = text[lo:hi]
                            best[bool(inner)].add((hashlib.md5(window.encode("utf-8", "surrogatepass")).hexdigest(), window, json.dumps(inner)))
                    for has in best:
                        if len(best[has]) > 10 * sample:
                            best[has] = set(heapq.nsmallest(sample, best[has]))
        for has, rows in best.items():
            own = heapq.nsmallest(sample, rows)
            cols = list(zip(*own, strict=True)) if own else [[]] * 3
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols], pa.array([has] * len(own), pa.bool_())], names=["h", "window", "inner", "has"])

    return run


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """A tagger fitted on a bounded sample of distinct windows; None if the documents hold no span to learn from."""
    rows = materialize(docs.select("text").mapInArrow(_examples(sample), "h string, window string, inner string, has boolean"))
    best = [r for has, n in ((True, sample * 3 // 4), (False, sample // 4)) for r in rows.where(F.col("has") == has).dropDuplicates(["h", "window", "inner"]).orderBy("h", "window", "inner").limit(n).collect()]
    if not any(r.has for r in best):
        return None
    sets: dict[bool, list] = {True: [], False: []}  # by whether they are held out
    for i, r in enumerate(best):
        own = sets[i % HELD == 1]
        inner = [tuple(x) for x in json.loads(r.inner)]
        own.append((r.window, inner))
        text, found, at = "", [], 0
        for k, a, b in inner:
            if a < at:
                continue
            text += r.window[at:a]
            new = rewritten(k, r.window[a:b], i)
            found.append((k, len(text), len(text) + len(new)))
            text, at = text + new, b
        text += r.window[at:]
        if inner and len(text) <= WINDOW:
            own.append((text, found))
    x = np.stack([codes(w, WINDOW) for w, _ in sets[False]])
    y = np.stack([np.pad(tags_of(len(w), found), (0, WINDOW - len(w))) for w, found in sets[False]])
    tagger = Tagger().fit(x, y)
    tagger.sure, tagger.measured = threshold(tagger, sets[True])
    return tagger


def threshold(tagger: Tagger, held: list[tuple[str, list]]) -> tuple[float, list[tuple[float, float, float]]]:
    """The least certainty at which held-out spans are right often enough (else the greatest), and (certainty, precision, recall) for all."""
    found, want = [], 0
    for window, inner in held:
        s = tagger.emissions(codes(window, WINDOW)[None])[0][: len(window)]
        path, sure = tagger.decode(s)
        found += [(float(sure[a:b].min()), (k, a, b) in inner) for k, a, b in runs_of(path) if _complete(k, window[a:b])]
        want += len(inner)
    rows = []
    for level in LEVELS:
        own = [right for sure, right in found if sure >= level]
        rows.append((level, sum(own) / len(own) if own else 0.0, sum(own) / want if want else 0.0))
    return next((level for level, precision, _ in rows if precision >= RIGHT), LEVELS[-1]), rows


def find(docs: DataFrame) -> DataFrame:
    """The documents with ``base`` and ``spans`` (kind:start:end, comma-joined) and the number of base spans of each kind."""
    names = ("base", "spans", *(f"n_{k}" for k in BASE))
    docs = docs.drop(*names)
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    schema = T.StructType([*docs.schema.fields, T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), *[T.StructField(n, T.LongType()) for n in names[2:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                base = [spans(t) for t in texts]
                more = added(tagger, texts, base) if tagger else [[] for _ in texts]
                every = [sorted(b + m, key=lambda s: (s[1], KINDS.index(s[0]))) for b, m in zip(base, more, strict=True)]
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE]
                new = [pa.array([show(b) for b in base]), pa.array([show(e) for e in every]), *counts]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts, digest of the base spans, all spans, how many the tagger added, and how many there are."""
    found = find(docs.select("doc_id", "text"))
    size = lambda c: F.size(F.filter(F.split(c, ","), lambda x: x != "")).cast("long")
    every = size(F.col("spans"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans", (every - size(F.col("base"))).alias("n_added"), every.alias("n_spans"))
