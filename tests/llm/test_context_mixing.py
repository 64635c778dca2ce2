"""The context mixer against a scalar model with exact counts, and as a probability distribution."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from wayloom.llm import context_mixing as cm

WORDS = ["nation", "national", "nationally", "of", "the", "thereabouts", "a", "été", "internationalisation"]


def texts():
    random.seed(3)
    return [" ".join(random.choice(WORDS) for _ in range(25)) + random.choice(["", "\n", "."]) for _ in range(12)] + ["", None]


@pytest.fixture(scope="module")
def scored(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(2)
    kept = {}
    train = cm.train

    def spy(*args):
        kept["model"] = train(*args)
        return kept["model"]

    cm.train = spy
    try:
        out = {r.doc_id: r for r in cm.score(rows).collect()}
    finally:
        cm.train = train
    return out, kept["model"]


class Scalar:
    """One bit after the other, with counts in a dictionary."""

    def __init__(self, own, heads, tails):
        self.n, self.words, self.heads, self.tails = Counter(), Counter(), heads, tails
        for t in own:
            for k, ctx, node, bit, late in self.bits(t):
                (self.words if late else self.n)[k, ctx, node, bit] += 1
                if late and k < 6:
                    self.n[k, ctx, node, bit] += 1
                if late and k == 6:
                    self.n[k, ctx[-5:], node, bit] += 1

    @staticmethod
    def word(before):
        out = b""
        for b in reversed(before):
            if b in (0, 32, 9, 10, 11, 12, 13):
                break
            out = bytes([b]) + out
        return out

    def bits(self, t):
        raw = bytes(5) + t + b"\xff"
        for i in range(5, len(raw)):
            w = self.word(raw[:i])
            late = len(w) >= 5
            for j in range(8):
                node, bit = (raw[i] | 256) >> (8 - j), raw[i] >> (7 - j) & 1
                for k in range(7):
                    yield k, raw[i - k : i] if k < 6 else w, node, bit, late

    def score(self, t):
        total, seven = 0.0, list(self.bits(t))
        for at in range(0, len(seven), 7):
            x, top, late = [], 0, seven[at][4]
            j = at // 7 % 8
            for k, ctx, node, bit, _ in seven[at : at + 7]:
                c = self.words if late and k == 6 else self.n
                n0, n1 = c[k, ctx, node, 0], c[k, ctx, node, 1]
                x.append(math.log(n1 + cm.PRIOR) - math.log(n0 + cm.PRIOR))
                seen = n0 + n1
                if k < 6 and seen:
                    top = k
            level = int((cm.LEVELS <= seen).sum())
            mixer = self.tails if late else self.heads
            gate = (5 + level if late and seen else top) if late else len(seven[at + 6][1]) * cm.OFTEN + level
            m = max(-11, min(11, sum(a * b for a, b in zip(x, mixer.weights[gate * 8 + j], strict=True))))
            p = 1 / (1 + math.exp(-m))
            u = (m + 12) * 1.5
            e, f = node * cm.STEPS + int(u), u - int(u)
            p = 0.5 * p + 0.5 * ((1 - f) * mixer.map[e] + f * mixer.map[e + 1])
            p = min(max(p, 1e-5), 1 - 1e-5)
            total += math.log10(p if bit else 1 - p)
        return total


def test_scores_are_those_of_the_scalar_model(scored):
    got, (_, heads, tails) = scored
    raw = {i: (t or "").encode() for i, t in enumerate(texts())}
    held = {i for i in raw if got[i].held_out}
    assert held and len(held) < len(raw)
    model = Scalar([t for i, t in raw.items() if i not in held], heads, tails)
    for i, t in raw.items():
        # Some hashed slots are shared.
        assert got[i].score == pytest.approx(model.score(t), rel=1e-2)


def test_bytes_have_probabilities_that_sum_to_one(scored):
    fixed, heads, tails = scored[1]
    t = cm.Tables(cm.unpacked(fixed))
    ctx = int.from_bytes(b"\x00 nat"[:5], "big")
    w = np.array([ctx << 8 | b for b in range(256)], np.uint64)
    assert np.exp(t.log_p(heads, w)).sum() == pytest.approx(1, abs=1e-6)
    data = b"".join(b"nation" + bytes([b]) for b in range(256))
    words = cm.Words(data, np.full(256, 7), np.ones(256, np.int64))
    pick = np.flatnonzero(words.w >> np.uint64(8) & np.uint64(255) == ord("n"))
    p = np.exp(tails.log_p(*words.inputs(t, pick, False)))
    assert len(pick) == 256 and p.sum() == pytest.approx(1, abs=1e-6)


def test_exact_columns_where_words_begin_alike(spark):
    """Longer words, also with control characters, lie between a word before a blank and the same word at an end."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    run = " ".join(f"natio{i:03}{'x' * 900}" for i in range(1000))  # more than a chunk holds
    mine = ["the natio", "NATION national nationally", "nation", "national", "abcde\x01 abcde\tabcde\x0e abcde\x1f\nabcde abcdef", run, "abcdé\r", None]
    other = ["natio x", "nationally\nnatio national", "abcde\x01\x0babcde\x0cABCDE", ""]
    rows = [*zip((i for i in range(100) if not held(i)), mine), *zip((i for i in range(100) if held(i)), other)]
    tokens = {i: [*(t or "").encode().lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)).split(b" "), None] for i, t in rows}
    tokens = {i: [x for x in t if x != b""] for i, t in tokens.items()}
    count = Counter(x for i, t in tokens.items() if not held(i) for x in t)
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in cm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got.keys() == tokens.keys()
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(t), sum(x in count for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), rel=1e-12)
