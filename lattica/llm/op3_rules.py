"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Two multinomials over hashed word
uni- and bigrams are counted over whole tables: one over the trusted documents,
one over the raw corpus. A document's ratio is the mean over its n-grams of
log p_trusted - log p_raw, and every document that passes the base rules is kept
if and only if the ratio reaches ``threshold``.

Defined results: a null or empty text has no words and fails the base rules (its
ratio is 0); repeated rows are counted and judged like any others; an empty table
gives an empty result; with no trusted document both multinomials are the raw one
and all ratios are 0; very long texts are counted and judged whole; a ratio equal to the
threshold keeps the document; rows without a doc_id are judged and never trusted; extra
columns of the input are ignored.

The threshold lies between the classes as measured at sf0.1, over documents that pass the base
rules: of those labelled good 99.9 % have a ratio above -0.046, of those labelled bad 95 %
one below -0.243.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as b
from .common import attach, steps, table
from .docstats import base_counts

#: The models have this many hashed n-grams, whatever the size of the corpus.
BUCKETS = 1 << 16
#: Pseudo-counts that the trusted multinomial draws from the raw one, per bucket on average.
SMOOTHING = 0.5
THRESHOLD = -0.15

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ratio double, kept boolean"


def _grams(hashes, bounds):
    """Buckets of all uni- and bigrams, and the documents they're in."""
    docs = b.doc_of(bounds)
    two, at = b.ngram_hashes(hashes, bounds, 2)
    ids = np.concatenate((hashes, two ^ np.uint64(0xA5A5A5A5)))
    return (b.mix(ids) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate((docs, docs[at]))


def _count(batches):
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part, data, offsets in steps(batch):
            _, _, bounds, hashes = b.word_hashes(data, offsets)
            ids, docs = _grams(hashes, bounds)
            raw += np.bincount(ids, minlength=BUCKETS)
            good = part.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            trusted += np.bincount(ids[good[docs]], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(trusted[seen])], names=["bucket", "raw", "trusted"])


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log p_trusted - log p_raw by bucket. ``trusted``: the doc_ids of the trusted documents."""
    marked = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    rows = attach(docs.select("doc_id", "text"), marked, how="left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counted = rows.mapInArrow(_count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counted.bucket], good[counted.bucket] = counted.raw, counted.trusted
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    p_good = (good + SMOOTHING * BUCKETS * p_raw) / (good.sum() + SMOOTHING * BUCKETS)
    return (np.log(p_good) - np.log(p_raw)).astype(np.float32)


def judge(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """One row of SCHEMA for each document."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for part, data, offsets in steps(batch):
                c = base_counts(data, offsets)
                ids, docs_of = _grams(c["_hashes"], c["_bounds"])
                n = len(offsets) - 1
                total = np.bincount(docs_of, weights=model.value[ids], minlength=n)
                ratio = total / np.maximum(np.bincount(docs_of, minlength=n), 1)
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                columns = [part.column("doc_id")] + [pa.array(c[k].astype(np.int64)) for k in names[1:6]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(ratio), pa.array(~failed & (ratio >= threshold))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return judge(docs, fit(docs, trusted), threshold)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Trusted: the documents that labels marks with quality 1."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))
