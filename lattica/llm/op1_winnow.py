"""Document fingerprints by winnowing, in DataFrame expressions only.

Every K-byte gram of a text's UTF-8 bytes is hashed at every position; of each
window of W consecutive grams the smallest hash is kept, the rightmost of equal
ones, with its position. So any two texts that share W + K - 1 bytes share a kept
hash, and nothing shorter than K bytes is matched. Hash and position travel in one
long (hash high, reversed position low), so the rightmost smallest is a plain
minimum, and minima of 2, 4, ... W grams come from doubling. Long texts are cut in
chunks that overlap by the windows, so no array is longer than a chunk.

Defined results: a null text is empty; an empty text has no picks; a text of fewer
than W grams is one window, and one shorter than K bytes is one gram; two empty
fingerprints are alike (1), one empty one is like nothing (0). Documents without a
doc_id come first in the order; rows that share a doc_id follow each other by text.
With a single row, the next document is itself. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

K, W, CHUNK = 12, 16, 8192
POSITION_BITS = 14
_LAST = (1 << POSITION_BITS) - 1
_HASH = (1 << (63 - POSITION_BITS)) - 1
#: Documents of one bucket of the order, about, and buckets at most.
BUCKET_DOCS, MOST_BUCKETS = 128, 16_384


def _let(value: Column, use) -> Column:
    """use(value), evaluating value once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _minima(grams: Column) -> Column:
    """For each position the minimum of the (up to) W packed grams from it on."""

    def widen(a: Column, by: int) -> Column:
        wider = _let(a, lambda x: F.zip_with(x, F.slice(x, by + 1, F.size(x)), lambda p, q: F.least(p, q)))
        return wider if 2 * by >= W else widen(wider, 2 * by)

    return widen(grams, 1)


def _chunk_picks(chunk: Column, base: Column, own_from: Column, own_to: Column) -> Column:
    """Picks (pos, hash) of the windows of ``chunk`` whose position from ``base`` lies in [own_from, own_to)."""
    n = F.greatest(F.octet_length(chunk) - (K - 1), F.lit(1))
    grams = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.shiftleft(F.xxhash64(F.substring(chunk, i + 1, F.lit(K))).bitwiseAND(F.lit(_HASH)), POSITION_BITS).bitwiseOR((F.lit(_LAST) - i).cast("long")),
    )
    kept = F.array_distinct(F.slice(_minima(grams), 1, F.greatest(n - (W - 1), F.lit(1))))
    picks = F.transform(kept, lambda v: F.struct((F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST)) + base).alias("pos"), F.shiftright(v, POSITION_BITS).alias("hash")))
    return F.filter(picks, lambda p: (p["pos"] >= own_from) & (p["pos"] < own_to))


def winnow(data: Column) -> Column:
    """array<struct<pos, hash>> of a binary column: the kept grams, by position."""
    grams = F.greatest(F.octet_length(data) - (K - 1), F.lit(1))
    chunks = F.sequence(F.lit(0), F.floor((grams - 1) / CHUNK).cast("int"))

    def one(j: Column) -> Column:
        start = F.greatest(j * CHUNK - (W - 1), F.lit(0))
        size = (j + 1) * CHUNK + (W - 1) + (K - 1) - start
        return _let(F.substring(data, start + 1, size), lambda c: _chunk_picks(c, start.cast("long"), j * CHUNK, (j + 1) * CHUNK))

    empty = F.array().cast("array<struct<pos:bigint,hash:bigint>>")
    return F.when(F.octet_length(data) > 0, F.flatten(F.transform(chunks, one))).otherwise(empty)


def spliced(data: Column, picks: Column, kept_bytes: Column) -> Column:
    """Picks of ``data``, of which the first ``kept_bytes`` also begin a text whose picks are known.

    Only windows that reach beyond those bytes are looked at again.
    """
    edge = kept_bytes - (W + K - 1)  # the last window start within the kept bytes
    start = F.greatest(edge - (W - 2), F.lit(0))
    owned = F.when(start > 0, edge + 1).otherwise(F.lit(0))
    rest = F.transform(winnow(F.substring(data, start + 1, F.octet_length(data))), lambda p: F.struct((p["pos"] + start).alias("pos"), p["hash"].alias("hash")))
    return F.concat(F.filter(picks, lambda p: p["pos"] < owned), F.filter(rest, lambda p: p["pos"] >= owned))


def hashes(picks: Column) -> Column:
    return F.array_distinct(F.transform(picks, lambda p: p["hash"]))


def fingerprint(picks: Column) -> Column:
    """A digest of all picks, positions included: equal texts have equal ones."""
    return F.md5(F.array_join(F.transform(picks, lambda p: F.concat_ws(":", p["pos"].cast("string"), p["hash"].cast("string"))), " ").cast("binary"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two distinct-hash arrays."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame) -> tuple[DataFrame, object]:
    """docs (doc_id, text) dealt by ranges of doc_id, and the window in which lead() sees the next document.

    The first document of each range also stands, as a ghost, at the end of the range
    before (that of the first range at the end of the last), so one shuffle serves.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stats = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).first()
    ways = max(1, min(MOST_BUCKETS, math.ceil(stats.n / BUCKET_DOCS)))
    bounds = [0 if stats.low is None else stats.low]
    if ways > 1 and stats.low is not None:
        cuts = docs.agg(F.percentile_approx("doc_id", [i / ways for i in range(1, ways)], max(10_000, 4 * ways)).alias("c")).first().c
        bounds = sorted({stats.low, *cuts})
    step = math.ceil(math.sqrt(len(bounds)))
    below = lambda array, x: F.size(F.filter(array, lambda y: y <= x)) - 1
    id_ = F.coalesce(F.col("doc_id"), F.lit(bounds[0]))
    coarse = F.greatest(below(_numbers(bounds[::step]), id_), F.lit(0))
    placed = docs.withColumn("_c", coarse * step).withColumn("_b", F.col("_c") + F.greatest(below(F.slice(_numbers(bounds), F.col("_c") + 1, F.lit(step)), id_), F.lit(0)))
    first = F.element_at(_numbers(bounds), F.col("_b") + 1) == id_
    places = F.array(F.struct(F.col("_b").alias("bucket"), F.lit(0).alias("ghost")))
    ghost = F.array(F.struct(F.pmod(F.col("_b") - 1, F.lit(len(bounds))).alias("bucket"), F.lit(1).alias("ghost")))
    dealt = placed.withColumn("_p", F.explode(F.when(first, F.concat(places, ghost)).otherwise(places))).select("doc_id", "text", "_p.bucket", "_p.ghost").repartition(parts, "bucket")
    return dealt, Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts (the last half replaced by the next text's beginning).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_picks.
    """
    rows, order = with_next(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text"))
    rows = rows.withColumn("head", F.left("text", F.col("n_chars") - half)).withColumn("edited", F.concat("head", F.left(F.coalesce("next", F.lit("")), half)))
    rows = rows.select(
        "doc_id", "bucket", "ghost", "text", "n_chars", F.octet_length("head").alias("kept_bytes"), F.col("edited").cast("binary").alias("edited"),
        winnow(F.col("text").cast("binary")).alias("picks"),
    )
    rows = rows.select("*", hashes(F.col("picks")).alias("own"), spliced(F.col("edited"), F.col("picks"), F.col("kept_bytes")).alias("edited_picks"))
    rows = rows.select(
        "doc_id", "bucket", "ghost", "text", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("picks")).alias("fingerprint"), fingerprint(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes(F.col("edited_picks"))).alias("near_edited"), F.size("picks").alias("n_picks"), "own",
    )
    rows = rows.withColumn("near_next", likeness(F.col("own"), F.lead("own").over(order)))
    return rows.where("ghost = 0").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_picks")


def op1_winnow(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
