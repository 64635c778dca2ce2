"""Word shingles as sorted arrays of 64-bit hashes, computed over blocks of UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; longer texts are cut at white space, so only a longer word makes a longer piece.
BLOCK = 1 << 16
_MULT = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) < n:
        m = max(n, BLOCK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def blank_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[32, *range(9, 14)]] = True
    return out


BLANKS = blank_bytes()
#: A number for each byte; A-Z have those of a-z.
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT[1]))
_VALUES[65:91] = _VALUES[97:123]


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the bytes, none across a cut, and where each starts."""
    real = ~BLANKS[data]
    first, last = real.copy(), real.copy()
    first[1:] &= ~real[:-1]
    last[:-1] &= ~real[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = real[inner]
    last[inner - 1] = real[inner - 1]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:-1], out=sums[1:])
    return mixed((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64)), lo


def _joined(w: np.ndarray, k: int) -> np.ndarray:
    total = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        total += w[i : len(w) - k + 1 + i] * np.uint64(_MULT[i])
        total = mixed(total)
    return total


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _long(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text, in pieces that end at white space."""
    out, lo = [], 0
    while lo < len(data):
        hi, size = len(data), BLOCK
        while lo + size < len(data):
            at = np.flatnonzero(BLANKS[data[lo : lo + size]])
            if len(at):
                hi = lo + int(at[-1]) + 1
                break
            size *= 2
        out.append(word_hashes(data[lo:hi], np.zeros(0, np.int64))[0])
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the distinct hashes of its n-word shingles, ascending.

    A-Z is lower-cased; words are what ASCII white space separates. Fewer than n
    words make one shingle of the whole sequence; no words and null texts make none.
    """
    col = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    ends = np.frombuffer(col.buffers()[1], wide)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2] if len(col) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, side="right")) - 1)
        block = data[ends[i] : ends[j]]
        if len(block) > BLOCK:  # one text
            w, at = _long(block), [0]
            at.append(len(w))
        else:
            w, lo = word_hashes(block, ends[i : j + 1] - ends[i])
            at = np.searchsorted(lo, ends[i : j + 1] - ends[i]).tolist()
        every = _joined(w, n) if len(w) >= n else w[:0]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield _distinct(every[a : b - n + 1]) if b - a >= n else _joined(w[a:b], b - a) if b > a else w[:0]
        i = j


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), n))
