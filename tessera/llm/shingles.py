"""Sets of hashed word shingles of texts, in numpy."""

from __future__ import annotations

import numpy as np

RANDOM = np.random.default_rng(17)
BYTE_CODES = RANDOM.integers(0, 1 << 63, size=256, dtype=np.uint64)
BYTE_CODES[ord("A") : ord("Z") + 1] = BYTE_CODES[ord("a") : ord("z") + 1]
#: Base of the polynomial word hash (3 modulo 8) and its inverse modulo 2**64.
BASE = (int(RANDOM.integers(1 << 62, 1 << 63)) & ~7) | 3
INVERSE = pow(BASE, -1, 1 << 64)
ODD = [np.uint64(x | 1) for x in RANDOM.integers(1 << 62, 1 << 63, size=16, dtype=np.uint64).tolist()]

# The bytes that end words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are hashed at a time.
PIECE = 1 << 18


def mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[k]
    x ^= x >> np.uint64(29)
    x *= ODD[k + 1]
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS, INVERSES = powers(BASE, PIECE + 1), powers(INVERSE, PIECE + 1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word, a run of other bytes than blanks; A-Z count as a-z."""
    blank = BLANK[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        lo, hi = starts[a], ends[b - 1]
        own, inverse = (POWERS, INVERSES) if hi - lo <= PIECE else (powers(BASE, hi - lo + 1), powers(INVERSE, hi - lo + 1))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE_CODES[data[lo:hi]] * own[: hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * ODD[8])
        a = b
    return out, starts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one, one without words none."""
    # Texts lie one after another, so a word never crosses a text only if texts are kept apart.
    sizes = np.diff(offsets)
    apart = np.full(len(data) + len(sizes), 0x20, np.uint8)
    apart[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
    hashes, first = word_hashes(apart)
    bounds = np.searchsorted(first, offsets + np.arange(len(offsets)))
    joined = hashes * ODD[9]
    for k in range(1, words):
        joined = mix(joined[: len(hashes) - k] + hashes[k:] * ODD[10], 2)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                whole = mix(whole * ODD[11] + h, 4)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    one, two = mix(shingles, 5), mix(shingles, 6)
    return int(one.sum(dtype=np.uint64).astype(np.int64)), int((two * two.max(initial=np.uint64(1))).sum(dtype=np.uint64).astype(np.int64))


def minwise(shingles: np.ndarray, count: int) -> np.ndarray:
    """The smallest hash of the set under each of `count` functions, 32 bits of it."""
    out = np.full(count, (1 << 64) - 1, np.uint64)
    factors = MINWISE[:count]
    for a in range(0, len(shingles), 4096):
        x = shingles[a : a + 4096, None] * factors
        x ^= x >> np.uint64(32)
        x *= ODD[12]
        np.minimum(out, x.min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


MINWISE = RANDOM.integers(1 << 62, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
