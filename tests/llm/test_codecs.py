"""Suffix array, SentencePiece, patterns, budget fitting and chunking against brute force."""

import random

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from wayloom.llm import chunk_fingerprint, pii_patterns, source_mix, suffix_dedup
from wayloom.llm.pii_tagger import Tagger
from wayloom.llm.sentencepiece_codec import MODEL, Codec
from wayloom.llm.suffix_array import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abe rtion▁ \n\té日😀", max_size=60), max_size=5))
def test_sentencepiece(texts):
    with open(MODEL, "rb") as f:
        codec = Codec(f.read())
    texts = [t.replace("▁", "x") for t in texts] + ["", "  a  b", "a" * 300]
    ids = codec.encode(texts)
    assert ids == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts)
    assert [codec.decode(x) for x in ids] == texts


def test_unigram_is_viterbi():
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def piece(text, score, kind):
        body = b"\x0a" + varint(len(text.encode())) + text.encode() + b"\x15" + np.float32(score).tobytes() + b"\x18" + bytes([kind])
        return b"\x0a" + varint(len(body)) + body

    vocab = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.5, "▁a": -4.0, "ba": -2.2, "aba": -6.0}
    model = piece("<unk>", 0, 2) + b"".join(piece(p, s, 1) for p, s in vocab.items()) + b"\x12\x02\x18\x01" + b"\x1a\x04\x18\x01\x20\x00"
    codec = Codec(model)
    best = {}

    def search(s):
        if s not in best:
            best[s] = max([search(s[len(p) :]) + v for p, v in vocab.items() if s.startswith(p)], default=-1e9) if s else 0.0
        return best[s]

    random.seed(1)
    for _ in range(50):
        t = "".join(random.choice("ab") for _ in range(random.randint(1, 9)))
        assert abs(sum(codec.scores[i] for i in codec.encode([t])[0]) - search("▁" + t)) < 1e-5


def test_repeated_strings_against_brute_force():
    random.seed(3)
    base = bytes(random.randrange(97, 101) for _ in range(700))
    out = [(120, base[100:420]), (120, base[100:300] + b"x" * 120), (60, base[160:420]), (120, b"y" * 60 + base[160:420])]
    got = suffix_dedup.repeated_starts(out)
    for k, (left, raw) in enumerate(out):
        own = {i - left for i in range(len(raw) - 199) for j, (l2, r2) in enumerate(out) if j != k and 0 <= i - left + l2 <= len(r2) - 200 and r2[i - left + l2 : i - left + l2 + 200] == raw[i : i + 200] and -120 <= i - left <= 0}
        assert got[k] == own


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=6), st.integers(0, 200))
def test_fit_is_near(hist, budget):
    sizes, have = np.array(list(hist)), np.array(list(hist.values()))
    taken = source_mix.fit_counts(sizes, have, min(budget, int((sizes * have).sum())))
    assert (taken >= 0).all() and (taken <= have).all()
    assert 0 <= min(budget, int((sizes * have).sum())) - int((sizes * taken).sum()) < sizes.max()


def test_patterns():
    text = "a.b@x.y.com, 1.2.3.4 and 1.2.3.456; 4111 1111 1111 1111; +1 (415) 555-2671. x@y @z.com"
    assert [(k, text[a:b]) for k, a, b in pii_patterns.spans(text)] == [("email", "a.b@x.y.com"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (415) 555-2671")]
    assert pii_patterns.spans("1" * 100_000) == [] and pii_patterns.spans("") == []


def test_tagger_gradient():
    t, r = Tagger(), np.random.RandomState(0)
    x, y = r.randint(32, 60, (3, 7)), np.array([[0, 1, 2, 0, 3, 4, 0], [0] * 7, [5, 6, 6, 0, 7, 8, 8]])
    _, grad = t.loss(x, y)
    for k, i in (("O", (3, 2)), ("T", (0, 1)), ("Wf", (1, 5)), ("Ub", (2, 7)), ("c", (1,))):
        old, e = t.p[k][i], 1e-5
        t.p[k][i] = old + e
        up, _ = t.loss(x, y)
        t.p[k][i] = old - e
        down, _ = t.loss(x, y)
        t.p[k][i] = old
        assert abs((up - down) / (2 * e) - grad[k][i]) < 1e-6


def test_chunks_resist_shifts():
    random.seed(2)
    text = "".join(random.choice("abcdefgh ") for _ in range(5000))
    a, b = chunk_fingerprint.chunks(text), chunk_fingerprint.chunks("some more words " + text)
    assert chunk_fingerprint.likeness(a, b) > 0.9 and chunk_fingerprint.likeness({}, {}) == 1.0 and chunk_fingerprint.likeness(a, {}) == 0.0
