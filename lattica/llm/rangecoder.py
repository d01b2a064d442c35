"""Adaptive context-mixing range coder for token ids, many blocks in lockstep.

The symbols of a file are ids and phrases, runs of ids that the file holds several times
(a word of several ids). A symbol is predicted by three orders. Order 2 and order 1 name
one candidate each, the symbol that followed the last two or the last one, kept in hashed
tables with a confidence that grows with each hit and halves with each miss. Order 0 gives
every symbol of the file a probability: symbols are ranked by their counts, ranks fall in
classes (eight single ranks, then classes about half as wide as their first rank), the
file's list has the share of each class, and ranks within it are alike. The three predictions are
mixed linearly; a block learns the weights, apart for each pair of confidences, by how
well each order predicted (the posterior share of each in the mixture).

The mixture drives a range coder: the interval of a symbol is the order-2 candidate's
share, or the order-1 candidate's, or a part of the rest by class and place. Every block
starts from nothing and is checked by a CRC of its symbols and bytes, so any block can be
read alone (with the file's list of symbols). Weights are float32 and divisions float64 of
whole numbers below 2**52, single elementwise operations that IEEE 754 fixes, so encoder
and decoder agree on any machine.

A step codes one symbol of LANES blocks at once.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Symbols of a block, at most, and of a file's blocks if there are too few to fill FEW lanes.
BLOCK, SHORT = 2048, 256
LANES, FEW = 2048, 1024
#: Slots of a block's table of an order, and levels of confidence.
SLOT_BITS = 9
_SURE = 8
_HASH_SHIFT = np.uint32(32 - SLOT_BITS)
#: Bits of the mixture and of the classes' shares; the least share of each order.
_MIX, _CLASS, _LEAST = 16, 13, 64
_SPAN = np.float32((1 << _MIX) - 3 * _LEAST)
_WIDEST = 4096
_LOW_BITS = 36
_FLOOR, _MASK = 1 << _LOW_BITS, (1 << _LOW_BITS) - 1
_LEARN = np.float32(0.02)
_KEEP = np.float32(0.98)
_TINY = np.float32(1e-20)
#: Steps whose classes the encoder looks up at once.
_AHEAD = 64
#: Runs that are copied at once.
_STRETCH = 1 << 14


def classes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First rank and width of each class of n ranks; widths are powers of two, but for the last."""
    first, at = [], 0
    while at < n:
        first.append(at)
        at += 1 if at < 8 else min(1 << ((at // 2).bit_length() - 1), _WIDEST)
    first = np.array(first or [0], np.int64)
    return first, np.diff(np.append(first, max(n, 1)))


def _shares(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares of 2**_CLASS of the classes of ranks with these counts; each has one at least."""
    mass = np.add.reduceat(counts, first) if len(counts) else np.ones(1, np.int64)
    shares = mass * ((1 << _CLASS) - len(first)) // max(int(mass.sum()), 1) + 1
    shares[np.argmax(shares)] += (1 << _CLASS) - int(shares.sum())
    return shares


class _Order0:
    """Classes of the ranks 0 ... size - 1 with their shares."""

    def __init__(self, size: int, shares: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.size = max(size, 1)
        self.first, width = classes(size)
        if 2 * len(self.first) > 1 << _CLASS:
            raise ValueError(f"{size} different symbols in one file are too many")
        self.share = _shares(counts, self.first) if shares is None else shares.astype(np.int64)
        if len(self.share) != len(self.first) or int(self.share.sum()) != 1 << _CLASS:
            raise ValueError("the data are damaged")
        self.shift = np.ceil(np.log2(width)).astype(np.int64)
        self.start = np.cumsum(self.share) - self.share
        self.of_rank = np.repeat(np.arange(len(width), dtype=np.int16), width)
        self.of_spot = np.repeat(np.arange(len(width)), self.share)
        self.likely = (self.share / (1 << _CLASS << self.shift)).astype(np.float32)


class _Model:
    """Orders 1 and 2 (rows 0 and 1) of n blocks, and the weights of all three."""

    def __init__(self, n: int):
        lane = np.arange(n)
        self.base = np.stack((lane << SLOT_BITS, (lane + n) << SLOT_BITS))
        self.wbase = np.stack((lane, lane + n)) * (_SURE * _SURE)
        self.table = np.zeros(2 * n << SLOT_BITS, np.uint32)
        self.weight = np.full(2 * n * _SURE * _SURE, 0.25, np.float32)
        self.one, self.two = np.zeros(n, np.uint32), np.zeros(n, np.uint32)

    def predict(self, k: int):
        """The candidates' shares of 2**_MIX in the first k blocks."""
        h = np.empty((2, k), np.uint32)
        np.multiply(self.one[:k], np.uint32(0x9E3779B1), out=h[0])
        np.bitwise_xor(h[0], self.two[:k] * np.uint32(0x85EBCA6B), out=h[1])
        h[1] *= np.uint32(0xC2B2AE35)
        h >>= _HASH_SHIFT
        self.slot = self.base[:, :k] + h
        self.entry = self.table[self.slot]
        self.sure = self.entry & np.uint32(_SURE - 1)
        self.candidate = self.entry >> np.uint32(3)
        pair = self.sure[1] * np.uint32(_SURE)
        pair += self.sure[0]
        self.at = self.wbase[:, :k] + pair
        self.v = self.weight[self.at]
        share = (self.v * _SPAN).astype(np.int64)
        share += _LEAST
        return share

    def learn(self, k: int, rank: np.ndarray, hit: np.ndarray, likely: np.ndarray) -> None:
        """rank: what came, as uint32; hit: whether the candidates are it; likely: its probability by order 0."""
        v = self.v
        q0 = np.float32(1) - v[0]
        q0 -= v[1]
        q0 *= likely
        q = v * hit
        q0 += q[0]
        q0 += q[1]
        q0 += _TINY
        q *= _LEARN / q0
        v *= _KEEP
        q += v
        self.weight[self.at] = q
        fresh = rank << np.uint32(3)
        fresh |= np.uint32(1)
        sure = self.sure
        more = self.entry + (sure < _SURE - 1)
        less = sure + np.uint32(1)
        less >>= np.uint32(1)
        np.subtract(self.entry, less, out=less)
        less = np.where(sure < 2, fresh, less)
        self.table[self.slot] = np.where(hit, more, less)
        self.two[:k] = self.one[:k]
        self.one[:k] = rank


def _lanes(lengths: np.ndarray):
    """For each step the number of blocks that go on; lengths must not ascend."""
    at = np.arange(lengths[0])
    return np.searchsorted(-lengths, -at, side="left").tolist()


def _coded(share, hit):
    """Begin and width of the share that is coded: order 2's, order 1's or the rest. hit: by order 1 (if not by order 2), by order 2."""
    both = share[0] + share[1]
    begin = np.where(hit[0], share[1], both)
    begin *= ~hit[1]
    np.subtract(1 << _MIX, both, out=both)
    return begin, np.where(hit[1], share[1], np.where(hit[0], share[0], both))


def _encode(ranks: np.ndarray, lengths: np.ndarray, order0: _Order0) -> list[bytes]:
    """ranks: blocks as columns (padded), lengths not ascending."""
    longest, n = ranks.shape
    model = _Model(n)
    low, span = np.zeros(n, np.int64), np.full(n, 1 << 52, np.int64)
    # words of all blocks lie by place, so that blocks write side by side
    words = np.zeros((longest * 4 + 8) * n, np.uint32)
    pos = np.arange(n)
    for t, k in enumerate(_lanes(lengths)):
        if t % _AHEAD == 0:
            rows = ranks[t : t + _AHEAD]
            cls = order0.of_rank[rows]
            start, share, shift, likely = order0.start[cls], order0.share[cls], order0.shift[cls], order0.likely[cls]
            place = rows - order0.first[cls]
        row, rank = t % _AHEAD, ranks[t, :k]
        ends = model.predict(k)
        hit = model.candidate == rank
        lo, width = _coded(ends, hit)
        r = span[:k] >> _MIX
        lo *= r
        lo += low[:k]
        r *= width
        rest = r >> _CLASS
        part = rest * share[row, :k]
        part >>= shift[row, :k]
        rest *= start[row, :k]
        rest += part * place[row, :k]
        miss = ~(hit[0] | hit[1])
        rest *= miss
        lo += rest
        r = np.where(miss, part, r)
        need = r < _FLOOR
        words[pos[:k]] = lo >> _LOW_BITS
        pos[:k] += need * n
        low[:k] = np.where(need, (lo & _MASK) << 16, lo)
        r <<= need * 16
        span[:k] = r
        more = np.flatnonzero(r < _FLOOR)
        while len(more):
            own = low[more]
            words[pos[more]] = own >> _LOW_BITS
            pos[more] += n
            low[more] = (own & _MASK) << 16
            span[more] <<= 16
            more = more[span[more] < _FLOOR]
        model.learn(k, rank, hit, likely[row, :k])
    for _ in range(4):
        words[pos] = low >> _LOW_BITS
        low = (low & _MASK) << 16
        pos += n
    sizes = pos // n
    words = words.reshape(-1, n)[: int(sizes.max())]
    for c in range(len(words) - 1, 0, -1):  # carries
        words[c - 1] += words[c] >> 16
    flat = np.ascontiguousarray(words.T.astype(">u2"))
    return [flat[i, : sizes[i]].tobytes() for i in range(n)]


def _decode(blobs: list[bytes], lengths: np.ndarray, order0: _Order0) -> np.ndarray:
    """Ranks, blocks as columns."""
    n, longest = len(blobs), int(lengths[0])
    model = _Model(n)
    most = max(map(len, blobs)) // 2 + 8
    words = np.zeros((n, most), np.uint16)
    for i, raw in enumerate(blobs):
        words[i, : len(raw) // 2] = np.frombuffer(raw, ">u2", len(raw) // 2)
    # the code holds 52 bits: three words and 4 bits; the words that follow are moved by these 4 bits
    head = words[:, :4].astype(np.int64)
    code = (head[:, 0] << 36) | (head[:, 1] << 20) | (head[:, 2] << 4) | (head[:, 3] >> 12)
    words[:, :-1] = (words[:, :-1] << 4) | (words[:, 1:] >> 12)
    words = words.T.ravel()
    span, pos = np.full(n, 1 << 52, np.int64), np.arange(n) + 3 * n
    ranks = np.zeros((longest, n), np.uint32)
    for t, k in enumerate(_lanes(lengths)):
        ends = model.predict(k)
        r = span[:k] >> _MIX
        own = code[:k]
        second = r * ends[1]
        hit = np.stack((own < second + r * ends[0], own < second))
        miss = ~hit[0]
        lo, width = _coded(ends, hit)
        lo *= r
        own = own - lo
        r *= width
        rest = r >> _CLASS
        spot = (own / rest).astype(np.int64)
        cls = order0.of_spot.take(spot, mode="clip")
        left = own - order0.start[cls] * rest
        rest *= order0.share[cls]
        rest >>= order0.shift[cls]
        place = (left / rest).astype(np.int64)
        left -= place * rest
        place += order0.first[cls]
        rank = np.where(hit[1], model.candidate[1], model.candidate[0])
        rank = np.where(miss, np.minimum(place, order0.size - 1).astype(np.uint32), rank)
        own = np.where(miss, left, own)
        r = np.where(miss, rest, r)
        need = r < _FLOOR
        code[:k] = np.where(need, (own << 16) | words.take(pos[:k], mode="clip"), own)
        pos[:k] += need * n
        r <<= need * 16
        span[:k] = r
        more = np.flatnonzero(r < _FLOOR)
        while len(more):
            code[more] = (code[more] << 16) | words.take(pos[more], mode="clip")
            pos[more] += n
            span[more] <<= 16
            if (span[more] <= 0).any():
                raise ValueError("the data are damaged")
            more = more[span[more] < _FLOOR]
        ranks[t, :k] = rank
        model.learn(k, rank, model.candidate == rank, order0.likely[order0.of_rank[rank]])
    return ranks


# -- the file format -----------------------------------------------------------------------
# magic, symbols of a block, documents, ids, blocks, different symbols, bytes of their list, symbols;
# doc_id and null flag and number of ids of each document; bytes and CRC of each block; shares of the
# classes; the list (deflated): the number of ids of each symbol, most frequent symbol first, and
# these ids; CRC of all this; the blocks.

MAGIC = b"IDRC\x03"
_HEAD = struct.Struct("<5sIIQIIIQ")
#: Where the number of ids stands in a file.
TOTAL_AT = 13


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int | None = None) -> bytes:
    """A file of whole documents: ``ids`` of all of them end to end, each a symbol."""
    seen, which = _compact(ids)
    return _file(doc_ids, lengths, len(ids), which, np.ones(len(seen), np.int64), seen, block)


def pack_words(doc_ids: list[int | None], lengths: np.ndarray, words: np.ndarray, sizes: np.ndarray, flat: np.ndarray, block: int | None = None) -> bytes:
    """A file of whole documents, all of whose ids are ``words`` end to end: numbers of words with so many ids, which ``flat`` holds.

    A word of several ids that comes twice or more is a phrase; others are spelled by their ids.
    """
    first = np.cumsum(sizes) - sizes
    phrase = (np.bincount(words, minlength=len(sizes)) > 1) & (sizes > 1)
    letters, spelled = _compact(flat)
    spell = spread(spelled, first, np.where(phrase, 0, sizes), np.arange(len(sizes)))
    # phrases are symbols behind the ids
    count = np.where(phrase, 1, sizes)
    at = np.cumsum(count) - count
    units = np.empty(int(count.sum()), np.int64)
    is_phrase = np.zeros(len(units), bool)
    is_phrase[at[phrase]] = True
    units[~is_phrase] = spell
    units[is_phrase] = len(letters) + np.arange(int(phrase.sum()))
    symbols = spread(units, at, count, words)
    own = np.flatnonzero(phrase)
    return _file(doc_ids, lengths, int(sizes[words].sum()), symbols, np.concatenate((np.ones(len(letters), np.int64), sizes[own])), np.concatenate((letters, spread(flat, first, sizes, own))), block)


def spread(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[first[w] : first[w] + sizes[w]] of every w of ``which``, end to end."""
    out = [flat[:0]]
    for i in range(0, len(which), _STRETCH):
        own = which[i : i + _STRETCH]
        count = sizes[own]
        ends = np.cumsum(count)
        at = np.repeat(first[own] - ends + count, count)
        at += np.arange(len(at))
        out.append(flat[at])
    return np.concatenate(out)


def _compact(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, ascending, and the place of each id among them."""
    if not len(ids) or int(ids.max()) > 1 << 22:
        return np.unique(ids, return_inverse=True)
    there = np.zeros(int(ids.max()) + 1, bool)
    there[ids] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[ids]


def _file(doc_ids, lengths, total: int, symbols: np.ndarray, sizes: np.ndarray, flat: np.ndarray, block: int | None) -> bytes:
    """symbols: numbers of symbols with so many ids, which ``flat`` holds."""
    block = block or int(np.clip(-(-len(symbols) // FEW), SHORT, BLOCK))
    n = -(-len(symbols) // block)
    long = np.full(n, block, np.int64)
    if n:
        long[-1] = len(symbols) - (n - 1) * block
    counts = np.bincount(symbols, minlength=len(sizes))
    order = np.argsort(-counts, kind="stable")
    order = order[: int((counts > 0).sum())]
    rank_of = np.zeros(len(sizes), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    order0 = _Order0(len(order), counts=counts[order])
    ranks = rank_of[symbols]
    blobs = []
    for i in range(0, n, LANES):
        own = long[i : i + LANES]
        part = ranks[i * block : (i + LANES) * block]
        rows = np.zeros((len(own), int(own[0])), np.uint32)
        rows.ravel()[: len(part)] = part
        blobs += _encode(np.ascontiguousarray(rows.T), own, order0)
    crcs = [zlib.crc32(blob, zlib.crc32(ranks[i * block : (i + 1) * block].astype("<u4").tobytes())) for i, blob in enumerate(blobs)]
    listed = zlib.compress(sizes[order].astype("<u4").tobytes() + spread(flat, np.cumsum(sizes) - sizes, sizes, order).astype("<u4").tobytes(), 1)
    head = _HEAD.pack(MAGIC, block, len(doc_ids), total, n, len(order), len(listed), len(symbols))
    head += np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array(lengths, "<u8").tobytes()
    head += np.array([len(x) for x in blobs], "<u4").tobytes() + np.array(crcs, "<u4").tobytes() + order0.share.astype("<u2").tobytes() + listed
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blobs)


def unpack(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file; a wrong checksum raises."""
    magic, block, docs, total, n, distinct, listed, length = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a file of this format")
    if distinct > length:
        raise ValueError("the data are damaged")
    at = _HEAD.size
    cols = []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", n), ("<u4", n), ("<u2", len(classes(distinct)[0])), ("u1", listed)):
        if at + count * np.dtype(kind).itemsize > len(raw):
            raise ValueError("the data are damaged")
        cols.append(np.frombuffer(raw, kind, count, at))
        at += cols[-1].nbytes
    if struct.unpack_from("<I", raw, at)[0] != zlib.crc32(raw[:at]):
        raise ValueError("the header's checksum is wrong")
    at += 4
    doc_ids, nulls, lengths, bytes_, crcs, shares, names = cols
    names = np.frombuffer(zlib.decompress(names.tobytes()), "<u4")
    sizes, flat = names[:distinct].astype(np.int64), names[distinct:]
    order0 = _Order0(distinct, shares)
    ranks = np.zeros(length, np.uint32)
    ends = at + np.concatenate(([0], np.cumsum(bytes_, dtype=np.int64)))
    for i in range(0, n, LANES):
        m = min(LANES, n - i)
        own = np.minimum(block, length - block * np.arange(i, i + m)).astype(np.int64)
        blobs = [raw[ends[j] : ends[j + 1]] for j in range(i, i + m)]
        rows = np.ascontiguousarray(_decode(blobs, own, order0).T)
        for j in range(m):
            piece = rows[j, : own[j]]
            if zlib.crc32(blobs[j], zlib.crc32(piece.astype("<u4").tobytes())) != crcs[i + j]:
                raise ValueError(f"the checksum of block {i + j} is wrong")
            ranks[(i + j) * block : (i + j) * block + own[j]] = piece
    ids = spread(flat, np.cumsum(sizes) - sizes, sizes, ranks).astype(np.uint32)
    if len(ids) != total:
        raise ValueError("the data are damaged")
    return [None if x else int(d) for d, x in zip(doc_ids, nulls, strict=True)], lengths.astype(np.int64), ids
