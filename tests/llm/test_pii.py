"""Pattern spans against the contract's own expressions, and the tagger's further spans on held-out forms."""

import random
import re

from wayloom.llm import pii_patterns, pii_tagger

CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    double = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(digits[::-1])]
    return sum(v - 9 if v > 9 else v for v in double) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(CONTRACT.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_patterns_are_the_contracts():
    random.seed(4)
    parts = ["1", "0", "25", ".", ".", "@", "@", "+", "-", " ", "(", ")", "a", "Z", "é", "\n", "４", "4111111111111111", "10.0.0.1", "a@b.c", "+1 (555) 010-9999", "%", "_"]
    for _ in range(20_000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 25)))
        assert pii_patterns.spans(text) == plain(text), text


def rows():
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8)))
    some = lambda n: " ".join(word() for _ in range(n))
    data = [lambda: f"{word()}.{word()}@{word()}.com", lambda: f"{random.randint(1, 255)}.1.2.{random.randint(1, 255)}", lambda: f"+1 (555) 010-{random.randint(1000, 9999)}", lambda: f'token = "{random.getrandbits(160):040x}"', lambda: f"version {random.randint(1, 9)}.0"]
    return [f"{some(12)} {random.choice(data)()} {some(12)}" for _ in range(250)] + [None, "", "no digits", "7" * 3000, f'{some(5)} token = "{"1a" * 20}" {some(5)}']


def test_tagger_adds_secrets_and_keeps_base_spans(spark):
    texts = rows()
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in pii_tagger.find(frame).collect()}
    assert len(got) == len(texts)
    caught = 0
    for i, t in enumerate(texts):
        base, every = got[i].base, got[i].spans
        assert base == pii_patterns.show(plain(t or ""))
        assert set(filter(None, base.split(","))) <= set(filter(None, every.split(",")))
        extra = [x for x in every.split(",") if x and x not in base.split(",")]
        if t and "token" in t:
            caught += any(x.startswith("secret:") for x in extra)
        if t and "version" in t:
            assert not extra
    assert caught >= 0.9 * sum("token" in t for t in texts if t)
