"""Vectorised scans over the UTF-8 bytes of many documents at once.

``data`` is the documents' bytes end to end, ``offsets`` their n + 1 bounds.
Hashes are sums of byte times odd power modulo 2**64, finished by a mixer.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: The bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 1 << 12)
        grown = np.full(size, BASE, np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds in each document."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that cross no document bound: starts, ends, and each document's bounds among them."""
    first, last = inside.copy(), inside.copy()
    if len(inside):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def piece_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece data[start:end]; equal pieces have equal hashes. Pieces don't overlap and ascend."""
    lens = ends - starts
    out = np.zeros(len(starts), np.uint64)
    filled = np.flatnonzero(lens > 0)
    if len(filled):
        s, n = starts[filled], lens[filled]
        begin = np.concatenate(([0], np.cumsum(n)[:-1]))
        within = np.arange(int(n.sum())) - np.repeat(begin, n)
        at = within + np.repeat(s, n)
        value = (data[at].astype(np.uint64) + np.uint64(1)) * powers(int(n.max()))[within]
        out[filled] = np.add.reduceat(value, begin)
    return mix(out + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """Words (runs of non-space bytes): starts, ends, bounds by document, hashes."""
    starts, ends, bounds = runs(~SPACE[data], offsets)
    return starts, ends, bounds, piece_hash(data, starts, ends)


def ngram_hashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive pieces within a document, and the index of the first piece of each."""
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(total - n + 1, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            out += hashes[j : total - n + 1 + j] * factor
            factor = factor * BASE
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(doc[: total - n + 1] == doc[n - 1 :])
    return mix(out[at]), at


def doc_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def salted(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents, so that one sort serves a whole slice."""
    return hashes ^ mix(docs.astype(np.uint64) + np.uint64(0x51ED270B))


def distinct_per_doc(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> np.ndarray:
    """Number of distinct hashes in each document."""
    _, first = np.unique(salted(hashes, docs), return_index=True)
    return np.bincount(docs[first], minlength=n_docs)


def repeated(hashes: np.ndarray) -> np.ndarray:
    """True where a hash occurs twice or more."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out
