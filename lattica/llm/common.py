"""Shared plumbing of the corpus operators: scratch tables, label joins, Arrow slicing.

Everything here keeps three promises: nothing is written outside the folder the
cluster shares, nothing is broadcast without a size check, and a Python worker
never holds more than a few megabytes of text at a time (one document, if a
single document is longer than that).
"""

from __future__ import annotations

import gc
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a lookup side, at most, that is broadcast.
BROADCAST_BYTES = 16 << 20
#: Bytes of text one vectorised step works on (its 8-byte columns then stay near the CPU).
STEP_BYTES = 1 << 18
#: Documents one vectorised step works on.
STEP_DOCS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only a local master may fall back to /tmp."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints"
    return where.rstrip("/")


_area: ContextVar[str] = ContextVar("lattica_area", default="scratch")


@contextmanager
def scratch_area(spark: SparkSession, name: str):
    """Tables that materialize() writes meanwhile lie in an area of their own; it yields the function that deletes the area."""
    own = f"{name}-{uuid.uuid4().hex}"
    held = _area.set(own)
    try:
        yield lambda: _delete(spark, f"{_scratch_root(spark)}/{own}")
    finally:
        _area.reset(held)


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lattica-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = f"{_scratch_root(spark)}/{_area.get()}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more, and the shuffle files behind them."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let the driver forget frames that nobody holds any more, so that executors delete their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(docs: DataFrame, side: DataFrame, key: str | list[str] = "doc_id", how: str = "inner") -> DataFrame:
    """Join a narrow ``side`` to wide ``docs``: broadcast up to BROADCAST_BYTES, else by shuffle."""
    # a hashed row: 16 bytes, and its columns with 8 for numbers and 32 for strings
    width = 16 + sum(32 if kind in ("string", "binary") else 8 for _, kind in side.dtypes)
    if side.count() * width <= BROADCAST_BYTES:
        side = F.broadcast(side)
    return docs.join(side, key, how)


def fold(doc_id, n: int):
    """crc32(doc_id as text) mod n; a null id falls in no fold that is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def steps(batch: pa.RecordBatch, column: str = "text", max_bytes: int = STEP_BYTES, max_docs: int = STEP_DOCS):
    """Cut a batch in slices of bounded text; yields (slice, bytes, offsets). Null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar("", texts.type))
    data, offsets = _bytes_of(texts)
    at, n = 0, len(texts)
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
        end = min(max(end, at + 1), at + max_docs, n)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if off is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(batches, keys: list[str]):
    """Runs of rows with equal keys, as lists of (key, rows as dicts of lists), from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        change = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[i] for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)
