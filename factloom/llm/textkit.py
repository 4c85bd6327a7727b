"""Vectorised byte and word hashing over blocks of texts (numpy, no per-word Python).

Hashes are polynomials modulo the prime 2**61 - 1. (Modulo 2**64 every base has the same
collisions: the Thue-Morse word of 1024 letters and its complement, for one.) The base has an
inverse, so the hash of any byte span comes from two prefix sums and one product, and whole
blocks of texts are hashed at once. Every hash depends on the span's bytes only, never on
where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
PRIME = (1 << 61) - 1
POINT = BASE % PRIME
INVERSE = pow(POINT, -1, PRIME)
CHUNK = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def reduce(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for any 64-bit x."""
    x = (x & U(PRIME)) + (x >> U(61))
    return x - U(PRIME) * (x >= U(PRIME))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for a, b under it."""
    a1, a0, b1, b0 = a >> U(31), a & U((1 << 31) - 1), b >> U(31), b & U((1 << 31) - 1)
    mid = a1 * b0 + a0 * b1
    return reduce(a1 * b1 * U(2) + (mid >> U(30)) + ((mid & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def running(x: np.ndarray) -> np.ndarray:
    """Prefix sums modulo the prime, from the empty one on."""
    out, carry = np.zeros(len(x) + 1, U), U(0)
    for lo in range(0, len(x), CHUNK):
        high, low = np.cumsum(x[lo : lo + CHUNK] >> U(32)), np.cumsum(x[lo : lo + CHUNK] & U(0xFFFFFFFF))
        # 2**61 is 1, so 32 bits up are 29 down for what leaves at the top.
        total = reduce(((high & U((1 << 29) - 1)) << U(32)) + (high >> U(29))) + reduce(low)
        out[lo + 1 : lo + 1 + len(total)] = total = reduce(reduce(total) + carry)
        carry = total[-1]
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_up, _down = np.ones(1, U), np.ones(1, U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """POINT**i and POINT**-i for i < n, modulo the prime; kept between calls."""
    global _up, _down
    if len(_up) < n:
        n, tables = max(n, 1 << 18), []
        for base in (POINT, INVERSE):
            out = np.ones(n, U)
            done = 1
            while done < n:
                more = min(done, n - done)
                out[done : done + more] = times(out[:more], np.full(more, pow(base, done, PRIME), U))
                done += more
            tables.append(out)
        _up, _down = tables
    return _up, _down


def _by_chunks(fn, n: int) -> np.ndarray:
    """fn(lo, hi) for neighbouring ranges, as one array: temporaries stay in the cache."""
    out = np.empty(n, U)
    for lo in range(0, n, CHUNK):
        out[lo : lo + CHUNK] = fn(lo, min(n, lo + CHUNK))
    return out


def prefix(data: np.ndarray) -> np.ndarray:
    """Hash of every prefix of ``data`` (a byte counts one more than its value)."""
    up = powers(len(data) + 1)[0]
    out, carry = np.zeros(len(data) + 1, U), U(0)
    for lo in range(0, len(data), CHUNK):
        value, p = data[lo : lo + CHUNK].astype(U) + U(1), up[lo : min(lo + CHUNK, len(data))]
        high, low = np.cumsum((p >> U(30)) * value), np.cumsum((p & U((1 << 30) - 1)) * value)  # under 2**54
        total = reduce((high >> U(31)) + ((high & U((1 << 31) - 1)) << U(30)) + low + carry)
        out[lo + 1 : lo + 1 + len(total)] = total
        carry = total[-1]
    return out


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a - b + U(PRIME) * (a < b)


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end)."""
    return mix(times(_less(pre[end], pre[start]), powers(len(pre))[1][start]))


def windows(pre: np.ndarray, width: int) -> np.ndarray:
    """Hash of every span of ``width`` bytes, by start."""
    down = powers(len(pre))[1]
    return _by_chunks(lambda lo, hi: mix(times(_less(pre[lo + width : hi + width], pre[lo:hi]), down[lo:hi])), max(0, len(pre) - width))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, in time independent of ``width``."""
    n = len(x) - width + 1
    pad = -len(x) % width
    rows = np.concatenate([x, np.full(pad, MASK, U)]).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty; nothing is decoded."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(sizes: list[int], limit: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of about ``limit`` bytes together (one row at least)."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


class Words:
    """Words of a block of texts: runs of bytes outside ``gap``, after A-Z (with ``accents``
    also the letters of Latin-1) are lowered.

    doc: index of each word's text; start, end: byte span in ``data``; hash: of the word.
    first: for text i its words are first[i]:first[i + 1].
    """

    def __init__(self, texts: list[bytes], gap: np.ndarray = SPACE, accents: bool = False):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = LOWER[raw]
        if accents:  # U+00C0 to U+00DE, but for the multiplication sign
            self.data[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)] += 0x20
        inside = ~gap[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, int)
        self.offsets = np.concatenate([[0], ends]).astype(np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.prefix = prefix(self.data)
        self.hash = spans(self.prefix, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbouring word hashes, by first word."""
    if len(h) < n:
        return np.zeros(0, U)
    out = np.zeros(len(h) - n + 1, U)
    for i in range(n):
        out = (out * U(BASE)) + h[i : len(h) - n + 1 + i]
    return mix(out)
