"""The pattern spans of personal data; positions are code points, ends exclusive."""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")

# The patterns that define the base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Labels for the tagger, no base span: a value given to a name that tells a secret.
SECRET = re.compile(r"(?i)\b(?:api[_-]?key|key|passw(?:or)?d|secret|token)\b[\"']?[\x20]{0,4}[:=][\x20]{0,4}[\"']?([A-Za-z0-9+/_-]{16,64})(?![A-Za-z0-9+/_-])")

#: What every span of any kind holds.
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @, leftwards as far as the last match, so that no run is read twice."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in LOCAL:
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        floor = m.end() if m else at + 1
        if m:
            out.append((lo, m.end()))
        at = text.find("@", floor)
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans, leftmost and not overlapping within a kind, by start and then kind."""
    if not TRIGGER.search(text):
        return []
    found = [("email", *s) for s in emails(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def show(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)
