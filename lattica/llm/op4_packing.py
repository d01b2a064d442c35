"""Conflict-constrained best-fit packing of documents into bins of ``capacity`` tokens.

A bin never holds two pieces of one source, nor two of one duplicate cluster. In a
shard (about SHARD documents, dealt by hash, so a hot source or cluster is spread
evenly) pieces are placed longest first. Open bins are kept in the order of their
residual room, each with a bitmap of its sources and one of its clusters; the search
starts at the first bin with room enough and goes on to its successors until one
has no conflict: the tightest compatible bin. Without one a new bin is opened.

Then bins meet across shards: those less full than FULL are dealt anew, and in each new
shard whole bins are placed like pieces, by the same search over the bitmaps of all their
sources and clusters. Such rounds go on until one unites fewer than one in 64 of its bins, so no
shard's bounds decide how full bins get; ``fill`` reports it.

Documents longer than a bin are cut into full bins and a last piece, which is packed.

Defined results: a document without tokens (null or empty text) is one piece of no
tokens; a very long one fills bins of its own but for its last piece; a null source
or cluster conflicts with nothing; equal lengths are placed in the order of doc_id (null
first), then cluster; repeated rows are packed each for itself, and dealt by their place in
the table, so that equal ones don't meet in one shard; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, materialize, table
from .op10_mixing import tokens

CAPACITY = 2048
#: Documents of a shard, on average.
SHARD = 2048
#: A bin with this share of its room in use is left alone by the later rounds.
FULL = 0.95

SCHEMA = "doc_id long, piece long, start long, n_tokens long, bin_id long, offset long, source string, cluster string"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item (size, source bit, cluster bit; bit 0: none), placed in the given order."""
    order: list[tuple[int, int]] = []  # (residual, bin) of the open bins
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in items:
        i = bisect_left(order, (size, -1))
        while i < len(order) and (sources[order[i][1]] & source or clusters[order[i][1]] & cluster):
            i += 1
        if i < len(order):
            residual, at = order.pop(i)
            sources[at] |= source
            clusters[at] |= cluster
        else:
            residual, at = capacity, len(sources)
            sources.append(source)
            clusters.append(cluster)
        out.append((at, capacity - residual))
        insort(order, (residual - size, at))
    return out


def _bits(names: list) -> list[int]:
    known: dict = {}
    return [0 if x is None else 1 << known.setdefault(x, len(known)) for x in names]


#: What rounds pass on besides: tokens in the piece's bin, and whether the piece stands for the bin.
_STATE = SCHEMA + ", filled long, lead boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[f.split()[0] for f in _STATE.split(", ")])


def _stated(rows: list[tuple]) -> list[tuple]:
    """Rows of SCHEMA with filled and lead."""
    filled: dict[int, int] = {}
    for r in rows:
        filled[r[4]] = filled.get(r[4], 0) + r[3]
    seen: set[int] = set()
    out = []
    for r in rows:
        out.append((*r, filled[r[4]], r[4] not in seen))
        seen.add(r[4])
    return out


def _place(capacity: int):
    """Pieces of a shard's documents to bins; bin_id is shard * 2**32 + bin."""

    def run(batches):
        for (shard,), rows in groups(batches, ["shard"]):
            d = rows.to_pydict()
            docs = sorted(zip(d["doc_id"], d["n_tokens"], d["source"], d["cluster"], strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[3] or "", r[2] or "", r[1]))
            source, cluster = _bits([r[2] for r in docs]), _bits([r[3] for r in docs])
            whole, last = [], []
            for k, (_, n, _, _) in enumerate(docs):
                full = max(n - 1, 0) // capacity
                whole += [(k, j, j * capacity, capacity) for j in range(full)]
                last.append((k, full, full * capacity, n - full * capacity))
            last.sort(key=lambda x: -x[3])
            placed = best_fit([(x[3], source[x[0]], cluster[x[0]]) for x in last], capacity)
            used = max((at for at, _ in placed), default=-1) + 1
            placed += [(used + i, 0) for i in range(len(whole))]
            yield _batch(_stated([(docs[k][0], piece, start, n, (int(shard) << 32) + at, offset, docs[k][2], docs[k][3]) for (k, piece, start, n), (at, offset) in zip(last + whole, placed, strict=True)]))

    return run


def _unite(capacity: int, round_: int):
    """Bins of a shard to bins; bin_id is round * 2**58 + shard * 2**32 + bin."""

    def run(batches):
        for (shard,), rows in groups(batches, ["shard"]):
            d = rows.to_pydict()
            pieces = list(zip(*(d[f.split()[0]] for f in SCHEMA.split(", ")), strict=True))
            bins: dict[int, list[int]] = {}
            for i, p in enumerate(pieces):
                bins.setdefault(p[4], []).append(i)
            source, cluster = _bits([p[6] for p in pieces]), _bits([p[7] for p in pieces])
            items = []
            for own in bins.values():
                s = c = 0
                for i in own:
                    s |= source[i]
                    c |= cluster[i]
                items.append((sum(pieces[i][3] for i in own), s, c))
            order = sorted(range(len(items)), key=lambda k: -items[k][0])
            placed = best_fit([items[k] for k in order], capacity)
            owners = list(bins.values())
            out = [(*pieces[i][:4], (round_ << 58) + (int(shard) << 32) + at, offset + pieces[i][5], *pieces[i][6:]) for k, (at, offset) in zip(order, placed, strict=True) for i in owners[k]]
            yield _batch(_stated(out))

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of SCHEMA, one for each piece. items: doc_id, n_tokens, source, cluster."""
    items = materialize(items.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long"), F.col("source").cast("string"), F.col("cluster").cast("string"), F.monotonically_increasing_id().alias("own")), "items")
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, n: int, *by) -> DataFrame:
        shards = max(1, -(-n // SHARD))
        return rows.select(F.pmod(F.xxhash64(*by), F.lit(shards)).alias("shard"), "*").repartition(parts, "shard")

    first = dealt(items, items.count(), "doc_id", "cluster", "n_tokens", "own").sortWithinPartitions("shard").mapInArrow(_place(capacity), _STATE)
    state = materialize(first, "bins")
    closed, round_ = [], 0
    while True:
        open_ = state.where(F.col("filled") < FULL * capacity)
        n = open_.agg(F.count("*").alias("pieces"), F.count_if("lead").alias("bins")).first()
        if n.pieces == 0 or n.pieces <= SHARD and round_:
            break
        round_ += 1
        united = materialize(dealt(open_, n.pieces, "bin_id", F.lit(round_)).sortWithinPartitions("shard", "bin_id", "offset").mapInArrow(_unite(capacity, round_), _STATE), "bins")
        closed.append(state.where(F.col("filled") >= FULL * capacity))
        state = united
        if (n.bins - united.where("lead").count()) * 64 < n.bins or round_ == 31:
            break
    out = state
    for x in closed:
        out = out.unionByName(x)
    return out.drop("filled", "lead")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """bins, tokens, fill (share of the bins' room in use)."""
    sums = packed.agg(F.count_distinct("bin_id").alias("bins"), F.sum("n_tokens").alias("tokens"))
    return sums.withColumn("fill", F.col("tokens") / (F.col("bins") * capacity))


def items_of(docs: DataFrame) -> DataFrame:
    """Sizes in words; a cluster is all texts that are equal but for case and white space."""
    plain = F.md5(F.lower(F.regexp_replace("text", r"\s+", " ")).cast("binary"))
    return docs.select("doc_id", tokens(F.col("text")).alias("n_tokens"), "source", plain.alias("cluster"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(items_of(table(spark, sf_dir, "documents")))
