"""Exact removal of repeated byte strings by a distributed, prefix-aware merge sort.

A byte goes if a string of ``length`` bytes that covers it starts at another place
too, in any document. Sorting all suffixes would move each byte ``length`` times, so
the sort is sparse: every window of ``length`` bytes is represented by its smallest
16-gram hash (rightmost of equal ones), its anchor. Equal windows have equal anchors
at equal offsets, so only suffixes at anchors need to be brought together. The
windows of one anchor in one document are a segment.

1. One scan lists the segments: anchor hash, content hash, place. Segments whose anchor
   occurs once are done. Of each content among the others two places, the smallest
   and the largest, go through the sort (a single place, if there is but one).
2. Each task sorts its rotated segments (from the anchor to the end, then what is before
   the anchor), front-codes the run (common prefix with the one before, and the rest)
   and sends it, cut by ranges of the order; each range merges its runs with a loser
   tree that keeps the common prefix of each run's head with the last winner, and
   compares bytes only beyond it.
3. The prefixes decide. Equal records make a content repeated as a whole. Neighbours that
   share the anchor's 16 bytes form a group; its second order, by the bytes before the
   anchor, read backwards, gives the common lengths on the other side. A window that
   begins ``a`` bytes before the anchor is repeated if another record lies both in its
   run of common prefixes of ``length - a`` bytes and in its run of ``a`` common bytes
   before the anchor. No pair is looked at.
4. An anchor with more than CROWD contents would make a group without a bound. Its
   windows are matched by counts over the cluster instead, in blocks of windows:
   blocks whose bytes occur twice are repeated as a whole, blocks whose common bytes
   occur in one content only are not, and the others go on in smaller blocks.

Hashes bring candidates together (128 bits stand for a content, so that its other copies
share what the two that were sorted have shown); only for crowded anchors do hashes of
anchor and bytes decide. Rows are known by doc_id and 128 bits of their text, so that rows without an
id, or with the same one, stay apart unless they are equal.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` keep
all; a document whose bytes all go keeps the empty string; equal rows are repeats of
each other, also without a doc_id; a very long text is one document like others (a task
holds it and some 100 bytes for each of its bytes); an empty table gives an empty result;
extra columns are carried and otherwise ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as b
from .common import discard, groups, materialize, release, steps, table

LENGTH = 200
GRAM = 16
#: Contents of one anchor, at most, that are matched in one group.
CROWD = 1000
#: Windows of a block, at most, for anchors in more contents; then blocks of 8, then single windows.
LARGEST_BLOCK = 32
#: Anchors of one range of the order, about.
RANGE_ANCHORS = 4000
#: Records of one run, and of groups that are matched in one go.
RUN_RECORDS, MATCH_RECORDS = 20_000, 20_000


def _doubled(data: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Hashes of all strings of GRAM and of ``most`` bytes (powers of two), by start (beyond the end: zeros)."""
    h = b.mix(data.astype(np.uint64) + np.uint64(1))
    out, n, factor = {}, 1, int(b.BASE)
    while n < most:
        beyond = np.zeros_like(h)
        beyond[: max(len(h) - n, 0)] = h[n:]
        h = h * np.uint64(factor)
        h += beyond
        factor = factor * factor % (1 << 64)
        n *= 2
        if n in (GRAM, most):
            out[n] = h
    return out


def _level(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Segments of a slice: document, first and last window start, anchor, anchor hash, content hash."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    level = _level(length)
    doubled = _doubled(data, level)
    gram = b.mix(doubled[GRAM])
    low = np.uint64(0xFFFFFFFF)
    least = (gram & ~low) | (low - np.arange(n, dtype=np.uint64))
    width, k = length - GRAM + 1, 1
    while 2 * k <= width:
        least[: n - k] = np.minimum(least[: n - k], least[k:])
        k *= 2
    rest = width - k
    if rest:
        least[: n - rest] = np.minimum(least[: n - rest], least[rest:])
    room = np.diff(offsets) - length + 1
    docs = np.flatnonzero(room > 0)
    counts = room[docs]
    total = int(counts.sum())
    if not total:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    starts = np.arange(total) + np.repeat(offsets[:-1][docs] - begin, counts)
    anchor = (low - (least[starts] & low)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[begin] = True
    at = np.flatnonzero(new)
    first, last = starts[at], starts[np.append(at[1:], total) - 1]
    doc = np.repeat(docs, counts)[at]
    p = anchor[at]
    h, end = doubled[level], last + length
    middle = np.minimum(first + level, end - level)
    content = b.mix(b.mix(h[first] + b.mix(h[middle])) + b.mix(h[end - level] ^ np.uint64(0xABCDEF)) + ((end - first) * 1024 + (p - first)).astype(np.uint64))
    # smallest hashes crowd near zero: mixed again, they spread over ranges and filters
    return doc, first, last, p, b.mix(gram[p] + np.uint64(1)), content


_KEY = ["id", "k1", "k2"]


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)


def _scan(length: int):
    """Segments: row, anchor hash, content hash, place (first window start << 16 | windows - 1 << 8 | anchor offset)."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in steps(batch):
                doc, first, last, p, g, h = segments(data, offsets, length)
                place = (first - offsets[doc]) << 16 | (last - first) << 8 | (p - first)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in _KEY), _int(g), _int(h), pa.array(place)], names=[*_KEY, "g", "h", "place"])

    return run


def _picked(batches, fields: tuple[str, ...]):
    """From texts with their picked segments: all bytes, and by pick where its text begins, its place and the fields."""
    for batch in batches:
        for part, data, offsets in steps(batch):
            lists = part.column("picks")
            flat = lists.flatten()
            own = np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy()))
            yield data, own, *(flat.field(c).to_numpy() for c in ("place", *fields))


# -- runs: records of an order, front-coded -----------------------------------------------


def encode_run(keys: list[bytes], marks: list[tuple[int, int, int]]) -> bytes:
    """Front-codes ascending keys: common prefix, rest (all rests compressed), and each record's content hash, count and anchor offset."""
    n = len(keys)
    common, rest = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
    tails = []
    before = b""
    for i, key in enumerate(keys):
        k = _common(before, key, 0)
        common[i], rest[i] = k, len(key) - k
        tails.append(key[k:])
        before = key
    h, count, left = (np.array([m[j] for m in marks], t) for j, t in ((0, np.int64), (1, np.uint8), (2, np.uint16)))
    return np.array([n], np.uint32).tobytes() + common.tobytes() + rest.tobytes() + h.tobytes() + count.tobytes() + left.tobytes() + zstandard.ZstdCompressor(level=3).compress(b"".join(tails))


def decode_run(raw: bytes):
    """Yields (common prefix with the record before, key, content hash, count, anchor offset)."""
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at, cols = 4, []
    for t in (np.uint16, np.uint16, np.int64, np.uint8, np.uint16):
        cols.append(np.frombuffer(raw, t, n, at).tolist())
        at += n * np.dtype(t).itemsize
    tails, at, key = zstandard.ZstdDecompressor().decompress(raw[at:]), 0, b""
    for common, rest, h, count, left in zip(*cols, strict=True):
        key = key[:common] + tails[at : at + rest]
        at += rest
        yield common, key, h, count, left


def _common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of x and y, whose first ``known`` bytes are equal."""
    n = min(len(x), len(y))
    if x[known:n] == y[known:n]:
        return n
    low, high = known, n
    while high - low > 8:  # the first difference lies in [low, high)
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    while x[low] == y[low]:
        low += 1
    return low


def merge_runs(runs):
    """Merges ascending runs of (common, key, ...) with a loser tree; yields (common prefix with the record before, key, ...).

    Each waiting head remembers its common prefix with the last winner that passed its
    node. Of two heads the one with the longer prefix is smaller, unread; with equal
    prefixes bytes are compared from there on, and the loser keeps what was found.
    """
    heads = []
    iterators = [iter(r) for r in runs]
    for it in iterators:
        first = next(it, None)
        heads.append(None if first is None else [0, *first[1:]])
    n = len(heads)
    if not n:
        return
    size = 1 << max(n - 1, 0).bit_length()
    heads += [None] * (size - n)
    iterators += [iter(())] * (size - n)

    def beats(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two heads with prefixes known against the same record."""
        x, y = heads[i], heads[j]
        if x is None:
            return j, i
        if y is None:
            return i, j
        if x[0] != y[0]:
            return (i, j) if x[0] > y[0] else (j, i)
        k = _common(x[1], y[1], x[0])
        a, c = x[1], y[1]
        smaller = len(a) <= len(c) if k == min(len(a), len(c)) else a[k] < c[k]
        if smaller:
            y[0] = k
            return i, j
        x[0] = k
        return j, i

    tree = [0] * size  # losers; tree[0] is the winner

    def build(node: int) -> int:
        if node >= size:
            return node - size
        won, lost = beats(build(2 * node), build(2 * node + 1))
        tree[node] = lost
        return won

    winner = build(1) if size > 1 else 0
    while heads[winner] is not None:
        yield heads[winner]
        follow = next(iterators[winner], None)
        heads[winner] = None if follow is None else list(follow)
        node = (winner + size) // 2
        while node:
            winner, tree[node] = beats(winner, tree[node])
            node //= 2


def _runs(length: int, range_bits: int, crowd_bits: int):
    """Front-coded runs, by range of the order, of the picked segments; those of crowded anchors by content (cut < 0)."""

    def run(batches):
        held: list[tuple[bytes, int, int, int]] = []

        def flush():
            held.sort()
            keys, marks, cuts = [], [], []
            for key, left, h, n in held:
                if keys and key == keys[-1] and left == marks[-1][2]:
                    marks[-1][1] = 2
                else:
                    keys.append(key)
                    marks.append([h, min(max(n, 1), 2), left])
                    cuts.append(-1 - ((h >> 16) & ((1 << crowd_bits) - 1)) if n else int.from_bytes(key[:8], "big") >> (64 - range_bits))
            held.clear()
            cuts = np.array(cuts, np.int64)
            order = np.argsort(cuts, kind="stable")
            bounds = [0, *(np.flatnonzero(np.diff(cuts[order])) + 1).tolist(), len(cuts)]
            coded = [encode_run([keys[k] for k in order[i:j]], [marks[k] for k in order[i:j]]) for i, j in zip(bounds, bounds[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(cuts[order][bounds[:-1]]), pa.array(coded, pa.binary())], names=["cut", "run"])

        for data, own, place, g, h, n in _picked(batches, ("g", "h", "n")):
            raw = data.tobytes()
            first = own + (place >> 16)
            p, end = first + (place & 255), first + (place >> 8 & 255) + length
            head = g.astype(">i8").tobytes()
            for i, (f, q, e, c, k) in enumerate(zip(first.tolist(), p.tolist(), end.tolist(), h.tolist(), n.tolist(), strict=True)):
                held.append((head[8 * i : 8 * i + 8] + raw[q:e] + raw[f:q], q - f, c, k))
            if len(held) > RUN_RECORDS:
                yield flush()
        if held:
            yield flush()

    return run


def _levels(length: int) -> tuple[int, ...]:
    """Block sizes, each a multiple of the next, whose strings are between one and two hashed levels long."""
    level = _level(length)
    top = min(LARGEST_BLOCK, 2 * level - length + 1, length - level + 1) // 8 * 8
    return tuple(sorted({top, 8, 1}, reverse=True)) if top >= 8 else (1,)


def _hash_of(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, level: int) -> np.ndarray:
    """Hashes of strings of sizes between level and 2 * level at ``starts``; h: hashes of ``level`` bytes."""
    return b.mix(h[starts] + b.mix(h[starts + sizes - level] ^ np.uint64(0x9E3779B97F4A7C15)) + sizes.astype(np.uint64))


_BLOCK = "struct<core:bigint,whole:bigint,lo:bigint,hi:bigint>"


def _crowd_blocks(key: bytes, left: int, length: int) -> list[list[dict]]:
    """Blocks, by level, of a record of a crowded anchor.

    A block holds the windows at offsets k * size ... (k + 1) * size - 1 from the anchor, as far as
    the segment has them (lo to hi, counted from its first). ``core`` stands for k and the bytes that all
    windows at those offsets have in common, ``whole`` for the bytes of all windows of the block.
    """
    level = _level(length)
    text = np.frombuffer(key[len(key) - left :] + key[8 : len(key) - left], np.uint8)
    h, last = _doubled(text, level)[level], len(text) - length
    out = []
    for size in _levels(length):
        k = np.arange((left - last) // size, left // size + 1)
        high, low = np.minimum(k * size + size - 1, left), np.maximum(k * size, left - last)
        core = b.mix(_hash_of(h, left - k * size, np.full(len(k), length - size + 1), level) + k.astype(np.uint64))
        whole = b.mix(_hash_of(h, left - high, length + high - low, level) + (low * 1024 + high).astype(np.uint64)) if size > 1 else core
        out.append([{"core": c, "whole": w, "lo": x, "hi": y} for c, w, x, y in zip(core.view(np.int64).tolist(), whole.view(np.int64).tolist(), (left - high).tolist(), (left - low).tolist(), strict=True)])
    return out


def _crowd_matches(each: DataFrame, length: int) -> DataFrame:
    """g, h, a, z of the repeated windows of contents that occur once at crowded anchors. each: g, h, n and blocks by level."""
    sizes = _levels(length)
    items = each.select("g", "h", "n", F.explode(f"b{sizes[0]}").alias("b")).select("g", "h", "n", "b.*")
    hits = []
    for k in range(len(sizes)):
        items = materialize(items, "blocks")
        wholes = materialize(items.groupBy("g", "core", "whole").agg(F.sum("n").alias("all"), F.min("h").alias("one")), "wholes")
        twice = wholes.where("`all` > 1").select("g", "core", "whole")
        hits.append(items.where("n = 1").join(twice, ["g", "core", "whole"]).select("g", "h", "lo", "hi"))
        if k + 1 < len(sizes):
            mixed = materialize(wholes.groupBy("g", "core").agg(F.count("*").alias("v")).where("v > 1").select("g", "core"), "cores")
            # one content stands for all that share a block's bytes; it's no longer asked for, only compared with
            asked = wholes.join(mixed, ["g", "core"], "left_semi").select("g", "core", "whole", F.col("one").alias("h"), F.least("all", F.lit(2)).alias("times"))
            where = items.select("g", "core", "whole", "h", "lo", "hi").join(asked, ["g", "core", "whole", "h"]).select("g", "h", F.col("lo").alias("from"), F.col("hi").alias("to"), "times")
            inner = F.filter(f"b{sizes[k + 1]}", lambda x: (x["lo"] >= F.col("from")) & (x["hi"] <= F.col("to")))
            items = where.join(each.select("g", "h", f"b{sizes[k + 1]}"), ["g", "h"]).select("g", "h", F.col("times").alias("n"), F.explode(inner).alias("b")).select("g", "h", "n", "b.*")
    every = hits[0]
    for x in hits[1:]:
        every = every.unionByName(x)
    spans = every.groupBy("g", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))
    return spans.select("g", "h", F.transform("s", lambda x: x["lo"]).alias("a"), F.transform("s", lambda x: x["hi"]).alias("z"))


def _repeated_windows(keys: list[bytes], common: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """records x windows (counted from the segment's first): True where another record has the window's bytes.

    Records in their order, with the common prefix with the one before; a group begins
    where that is shorter than the anchor's key.
    """
    n = len(keys)
    right = np.array([len(k) for k in keys]) - 8 - left
    ahead = common - 8
    group = np.cumsum(common < 8 + GRAM)
    # the second order: the bytes before the anchor, backwards
    back = [k[len(k) - x :][::-1] if x else b"" for k, x in zip(keys, left.tolist(), strict=True)]
    order = sorted(range(n), key=lambda i: (group[i], back[i]))
    behind = np.full(n, -1)
    for x, (i, j) in enumerate(zip(order, order[1:], strict=False)):
        if group[i] == group[j]:
            behind[x + 1] = _common(back[i], back[j], 0)
    order = np.array(order)
    hit = np.zeros((n, length - GRAM + 2), bool)
    place = np.empty(n, np.int64)
    for a in range(length - GRAM + 1):
        some = np.flatnonzero((left >= a) & (right >= length - a))
        if len(some) > 1:
            place[order] = np.cumsum(behind < a)
            both = np.cumsum(ahead < length - a)[some] * (n + 1) + place[some]
            again = some[b.repeated(both)]
            hit[again, left[again] - a] = True
    return hit


def _matched(length: int) -> str:
    """What the merge gives: of a content its repeated windows (null: all), or if n isn't null its number and blocks."""
    return "g long, h long, a array<long>, z array<long>, n long, " + ", ".join(f"b{x} array<{_BLOCK}>" for x in _levels(length))


def _match(length: int):
    """Merges the runs of each range: contents that are repeated as a whole (a, z null), repeated windows of others, blocks of crowded ones."""
    block = pa.list_(pa.struct([(c, pa.int64()) for c in ("core", "whole", "lo", "hi")]))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), *(block for _ in _levels(length))]
    names = [x.split()[0] for x in _matched(length).split(", ")]

    def batch(g, h, **more):
        columns = {"g": pa.array(g, pa.int64()), "h": pa.array(h, pa.int64()), **more}
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(len(columns["g"]), t)) for c, t in zip(names, kinds, strict=True)], names=names)

    def crowd(records: list):
        blocks = [_crowd_blocks(r[1], r[4], length) for r in records]
        more = {f"b{x}": pa.array([r[k] for r in blocks], block) for k, x in enumerate(_levels(length))}
        return batch([int.from_bytes(r[1][:8], "big", signed=True) for r in records], [r[2] for r in records], n=pa.array([r[3] for r in records], pa.int64()), **more)

    def verdicts(records: list):
        """records: [common, key, content, count, left] of whole groups."""
        common, content, count, left = (np.array([r[k] for r in records], np.int64) for k in (0, 2, 3, 4))
        keys = [r[1] for r in records]
        first = common < 8 + GRAM
        alone = first & np.append(first[1:], True)
        own = np.flatnonzero(~alone)
        starts = np.zeros(0, np.int64)
        if len(own):
            hit = _repeated_windows([keys[i] for i in own], common[own], left[own], length)
            hit[count[own] > 1] = False
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.ravel().view(np.int8)))))
            width = hit.shape[1]
            row, starts, ends = own[edge[::2] // width], edge[::2] % width, edge[1::2] % width - 1
        g = np.frombuffer(b"".join(k[:8] for k in keys), ">i8").astype(np.int64)
        whole = np.flatnonzero(count > 1)
        yield batch(g[whole], content[whole])
        if len(starts):
            at = np.flatnonzero(np.diff(row, prepend=-1))
            bounds = np.append(at, len(row)).astype(np.int32)
            yield batch(g[row[at]], content[row[at]], **{c: pa.ListArray.from_arrays(bounds, pa.array(x)) for c, x in (("a", starts), ("z", ends))})

    def run(batches):
        for (cut,), rows in groups(batches, ["cut"]):
            now: list = []
            for common, key, content, count, left in merge_runs([decode_run(r) for r in rows.column("run").to_pylist()]):
                if now and common == len(key) == len(now[-1][1]) and left == now[-1][4]:
                    now[-1][3] += count
                    continue
                if cut < 0 and len(now) >= 2000:
                    yield crowd(now)
                    now = []
                elif common < 8 + GRAM and len(now) > MATCH_RECORDS:
                    yield from verdicts(now)
                    now = []
                now.append([common, key, content, count, left])
            if now and cut < 0:
                yield crowd(now)
            elif now:
                yield from verdicts(now)

    return run


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, k1, k2 (the row), place (of the segment), a, z: windows of the segment, from a to z, that are repeated; null: all.

    docs: id, k1, k2, text.
    """
    if length < 2 * GRAM or length - GRAM > 255 or 2 * length - GRAM > 3 * _level(length):
        raise ValueError(f"strings of {length} bytes aren't supported (100 and 200 are)")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = "id long, k1 long, k2 long, g long, h long, place long"
    segments = materialize(docs.mapInArrow(_scan(length), kinds), "segments")
    # tables of their own on the narrow sides: a join of two exchanges is dealt anew where a key is hot
    twice = materialize(segments.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "twice")
    found = materialize(segments.join(twice, "g", "left_semi"), "places")
    discard(segments, twice)
    at = F.struct("k1", "k2", "id", "place")
    contents = materialize(found.groupBy("g", "h").agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high")), "contents")
    variants = materialize(contents.groupBy("g").agg(F.count("*").alias("variants")), "variants")
    release(spark)
    asked = contents.join(variants, "g").withColumn("crowded", F.col("variants") > CROWD)
    sizes = variants.agg(F.count("*"), F.sum(F.when(F.col("variants") > CROWD, F.col("variants")))).first()
    bits = [max(6, (x // RANGE_ANCHORS).bit_length()) for x in (sizes[0], sizes[1] or 0)]
    # of a crowded anchor's contents one place each, with the number of all; of others two
    one = F.when(F.col("crowded") | (F.col("low") == F.col("high")), F.array("low")).otherwise(F.array("low", "high"))
    number = F.when(F.col("crowded"), F.col("n")).otherwise(0).alias("n")
    picks = asked.select("g", "h", number, F.explode(one).alias("at")).groupBy("at.k1", "at.k2", "at.id").agg(F.collect_list(F.struct("at.place", "g", "h", "n")).alias("picks"))
    texts = docs.join(picks, _KEY).select("text", "picks")
    sent = texts.mapInArrow(_runs(length, *bits), "cut long, run binary")
    matched = materialize(sent.repartition(parts, "cut").sortWithinPartitions("cut").mapInArrow(_match(length), _matched(length)), "matches")
    release(spark)
    verdicts = matched.where("n is null").select("g", "h", "a", "z")
    if sizes[1]:
        none = F.lit(None).cast("array<long>")
        crowd = matched.where("n is not null").drop("a", "z")
        verdicts = verdicts.unionByName(crowd.where("n > 1").select("g", "h", none.alias("a"), none.alias("z"))).unionByName(_crowd_matches(crowd, length))
    verdicts = materialize(verdicts, "verdicts")
    out = materialize(found.join(verdicts, ["g", "h"]).select(*_KEY, "place", "a", "z"), "repeats")
    discard(found, contents, variants, matched, verdicts)
    return out


def _spans(places: list, length: int):
    """Byte spans (half open) that the repeated windows of a document cover, ascending and apart."""
    own = []
    for p in places or ():
        first, more = p["place"] >> 16, p["place"] >> 8 & 255
        if p["a"] is None:
            own.append((first, first + more + length))
        else:
            own += [(first + a, first + z + length) for a, z in zip(p["a"], p["z"], strict=True)]
    out: list[list[int]] = []
    for start, end in sorted(own):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _cut(length: int):
    """Texts without their repeated spans: n_bytes, n_removed, n_spans, digest and the rest as text."""

    def run(batches):
        names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for part, data, offsets in steps(batch):
                raw, out = data.tobytes(), []
                for i, places in enumerate(part.column("places").to_pylist()):
                    text = raw[offsets[i] : offsets[i + 1]]
                    spans = _spans(places, length)
                    at, kept = 0, []
                    for start, end in spans:
                        kept.append(text[at:start])
                        at = end
                    kept.append(text[at:])
                    rest = b"".join(kept)
                    out.append((len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of ``docs`` but text and those named here, and n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining text)."""
    others = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]
    text = F.coalesce("text", F.lit(""))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), "text")
    found = repeats(named.select(*_KEY, "text"), length)
    places = found.groupBy(*_KEY).agg(F.collect_set(F.struct("place", "a", "z")).alias("places"))
    kind = dict(named.dtypes)["row"]
    cut = named.join(places, _KEY, "left").select("row", "text", "places").mapInArrow(_cut(length), f"row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return cut.select("row.*", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).drop("kept")
