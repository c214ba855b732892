"""Hashes of all words of many texts at once.

A word's hash is a polynomial in its bytes, modulo 2**64, over a table of random numbers: with running sums over the whole
buffer it takes a few array operations for thousands of words, and no table of words is kept.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes that one running sum covers; only a single word can be longer, and then it is hashed by itself.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C17  # 3 modulo 4: texts that differ by an exchange differ in their sums

_tables: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None


def _prepared() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White space by byte, a random odd number for each byte, and the powers of the base and of its inverse."""
    global _tables
    if _tables is None:
        space = np.zeros(256, dtype=bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        powers, inverses = np.full(CHUNK, _BASE, dtype=np.uint64), np.full(CHUNK, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        powers[0] = inverses[0] = 1
        _tables = space, values, np.multiply.accumulate(powers), np.multiply.accumulate(inverses)
    return _tables


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h ^ np.uint64(salt) ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (what stands between ASCII white space) of all texts end to end, and words of each text."""
    space, values, powers, inverses = _prepared()
    data = b"\n".join([b"", *texts, b""])
    a = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(space[a])) + 1
    starts, ends = edges[::2], edges[1::2]  # the buffer begins and ends with white space
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + CHUNK, side="right"))
        if j <= i:
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
            i += 1
            continue
        sums = values[a[base : ends[j - 1]]]
        sums *= powers[: len(sums)]
        np.cumsum(sums, out=sums)
        lo, hi = starts[i:j] - base, ends[i:j] - base
        before = sums[lo - 1]
        before[0] = 0
        out[i:j] = (sums[hi - 1] - before) * inverses[lo]
        i = j
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends_of = np.cumsum(sizes + 1)  # each text begins after its line feed
    n = np.diff(np.searchsorted(starts, ends_of, side="right"), prepend=0) if len(texts) else np.zeros(0, dtype=np.int64)
    return mix(out), n.astype(np.int64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, wherever they begin."""
    size = max(0, len(words) - n + 1)
    out = np.full(size, n, dtype=np.uint64)
    for k in range(n):
        out += mix(words[k : k + size], k + 1) * np.uint64((0xC2B2AE3D27D4EB4F * (2 * k + 1)) % (1 << 64))
    return mix(out)


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""
