"""Near-duplicate documents by an LSH forest of MinHash signatures, confirmed on full sets.

1. One scan gives each document's distinct word-shingle hashes, their number, a
   128-bit digest of the set and 64 MinHash values. Documents of equal digest are
   one class, whose smallest doc_id stands for it.
2. The forest: 32 signature orders. In order t a class has the label of MinHash
   values number order_t[0], order_t[1], ... (16 of them); all labels are sorted by range, and
   classes whose longest common prefix reaches the depth of their region are neighbours.
   A region starts at DEPTH values and goes one deeper while more than REGION classes
   share the prefix, down to the whole label (there each class has the REGION next ones as
   neighbours, and the one beside it is a candidate in any case).
   A task reads its range in chunks and carries the last REGION labels over; the REGION
   labels on either side of each bound between ranges meet in a task of their own.
   Neighbours are candidates unless four bits of each of their 64 values agree five
   standard deviations less often than those of sets as alike as asked. Sorting ties by
   node splits even a label that a third of all classes share.
3. Connected candidates form pools. In blocks of at most BLOCK classes, pools are
   closed exactly on full sets: any two classes of a block that no chain of links
   joins yet are compared. Pools of several blocks go on in rounds: classes outside
   the pool's largest component become pivots, and every pivot is compared with all
   blocks of its pool, until each class outside has been a pivot; so no link within
   a pool is lost, and no pair is compared that cannot change a component.

Two classes are linked if 100 * |A and B| >= ``percent`` * |A or B|.

Defined results: a null or empty text (no words) has the empty set and is linked
with nothing; a text of fewer words than a shingle is one shingle; rows that share
a doc_id are one document to the links; a row without a doc_id takes no part (null
component, kept); a very long text is one set, which a task holds whole; pairs at exactly
``percent`` are linked; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as b
from .common import attach, groups, materialize, steps, table
from .components import components, repoint

VALUES, ORDERS, DEPTH, DEEPEST, REGION = 64, 32, 3, 16, 64
#: Values of a label that are kept whole; of the further ones two bytes.
WHOLE = 3
BLOCK = 64
#: Labels that a task looks at in one go, and labels of a range at least, about.
CHUNK, RANGE_LABELS = 20_000, 4_096
#: Pivots of a pool in the first round; four times as many in each further one.
PIVOTS = 64

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_ORDER = np.array([_rng.permutation(VALUES)[:DEEPEST] for _ in range(ORDERS)])


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, and their documents (ascending)."""
    _, _, bounds, hashes = b.word_hashes(b.LOWER[data], offsets)
    n = np.diff(bounds)
    grams, at = b.ngram_hashes(hashes, bounds, words)
    docs = b.doc_of(bounds)[at]
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        whole = np.zeros(len(few), np.uint64)
        for j in range(words - 1):
            has = n[few] > j
            whole[has] = whole[has] * b.BASE + hashes[bounds[few[has]] + j]
        grams = np.concatenate((grams, b.mix(whole + n[few].astype(np.uint64))))
        docs = np.concatenate((docs, few))
        order = np.argsort(docs, kind="stable")
        grams, docs = grams[order], docs[order]
    first = np.sort(np.unique(b.salted(grams, docs), return_index=True)[1])
    return grams[first], docs[first]


def scan(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (d1, d2) and MinHash values of every row."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in steps(batch):
                grams, of = shingles(data, offsets, words)
                n = len(offsets) - 1
                size = np.bincount(of, minlength=n)
                some = size > 0
                at = np.searchsorted(of, np.flatnonzero(some))
                digest, values = np.zeros((2, n), np.uint64), np.zeros((n, VALUES), ">u4")
                if len(at):
                    for k in (0, 1):
                        digest[k][some] = np.add.reduceat(b.mix(grams ^ np.uint64(0x1234567 + k)), at)
                    low = np.zeros((some.sum(), VALUES), np.uint32)
                    for k in range(VALUES):
                        low[:, k] = np.minimum.reduceat((grams * _A[k] + _B[k]) >> np.uint64(32), at)
                    values[some] = low
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * VALUES), n, [None, pa.py_buffer(values.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digest), flat], names=["doc_id", "n_shingles", "d1", "d2", "vals"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, vals binary")


#: A label's bytes: the order, then its values; where each value ends.
_ENDS = 1 + np.array([4 * min(k, WHOLE) + 2 * max(k - WHOLE, 0) for k in range(DEEPEST + 1)])
_WIDTH = int(_ENDS[-1])
_ALIKE = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)


def _labels(batches):
    """One row for each class and order: the order and its first DEEPEST values as sortable bytes; four bits of each value."""
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            n = part.num_rows
            values = np.frombuffer(b"".join(part.column("vals").to_pylist()), np.uint8).reshape(n, VALUES, 4)
            sketch = pa.array([x.tobytes() for x in (values[:, ::2, 3] & 15) << 4 | (values[:, 1::2, 3] & 15)], pa.binary())
            for t in range(ORDERS):
                label = np.empty((n, _WIDTH), np.uint8)
                label[:, 0] = t
                own = values[:, _ORDER[t]]
                label[:, 1 : _ENDS[WHOLE]] = own[:, :WHOLE].reshape(n, -1)
                label[:, _ENDS[WHOLE] :] = own[:, WHOLE:, 2:].reshape(n, -1)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_WIDTH), n, [None, pa.py_buffer(label.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([flat, part.column("node"), sketch], names=["label", "node", "sketch"])


def _depths(labels: np.ndarray) -> np.ndarray:
    """Values that each label has in common with the one before it (another order: -1)."""
    differ = labels[1:] != labels[:-1]
    same = np.where(differ.any(1), differ.argmax(1), labels.shape[1])
    return np.searchsorted(_ENDS, same, side="right") - 1


def _closed(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component under the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(labels: np.ndarray, sketch: np.ndarray, node: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidates among sorted labels, as few pairs as connect them."""
    depth = np.concatenate(([-1], _depths(labels)))
    need = np.full(len(node), DEPTH)
    for d in range(DEPTH, DEEPEST):
        at = np.cumsum(depth < d)  # number of the run of labels with d values in common
        crowded = np.bincount(at, minlength=at[-1] + 1)[at] > REGION
        deeper = crowded & (need == d)
        if not deeper.any():
            break
        need[deeper] = d + 1
    region = np.cumsum(depth < need)
    size = np.bincount(region, minlength=region[-1] + 1)[region]
    beside = np.flatnonzero((size > REGION) & (depth >= need))
    pairs = [(beside - 1, beside)]
    for k in range(1, REGION):
        i = np.flatnonzero(region[:-k] == region[k:])
        if not len(i):
            break
        i = i[_ALIKE[sketch[i] ^ sketch[i + k]].sum(1, dtype=np.int64) >= least]
        pairs.append((i, i + k))
    i, j = (np.concatenate([x[m] for x in pairs]) for m in (0, 1))
    low = _closed(len(node), i, j)
    pair = np.flatnonzero(low != np.arange(len(node)))
    return node[pair], node[low[pair]]


def _arrays(rows: pa.Table | pa.RecordBatch):
    """Labels and sketches as byte matrices, and nodes."""
    flat = [np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(rows.num_rows, -1) for c in ("label", "sketch")]
    return *flat, rows.column("node").to_numpy()


_FOREST = "node long, other long, label binary, sketch binary, part int, last boolean, n long"


def _neighbours(least: float):
    """Candidates within a range; also its first and its last labels (other null, with the number of all)."""

    def run(batches):
        part, total, held, waiting, first, last = TaskContext.get().partitionId(), 0, [], 0, None, None
        names = [x.split()[0] for x in _FOREST.split(", ")]

        def flush():
            nonlocal held, waiting, first, last
            new = pa.Table.from_batches(held).select(["label", "sketch", "node"])
            held, waiting = [], 0
            both = new if last is None else pa.concat_tables([last, new])
            first = both.slice(0, REGION) if last is None else first
            u, v = _pairs(*_arrays(both), least)
            last = both.slice(max(both.num_rows - REGION, 0)).combine_chunks()
            none = [pa.nulls(len(u), t) for t in (pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *none], names=names)

        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            total += batch.num_rows
            if waiting >= CHUNK:
                yield flush()
        if waiting:
            yield flush()
        if total:
            for rows, end in ((first, False), (last, True)):
                n = rows.num_rows
                label, sketch, node = (rows.column(c).combine_chunks() for c in ("label", "sketch", "node"))
                same = [pa.array([x] * n, t) for x, t in ((part, pa.int32()), (end, pa.bool_()), (total, pa.int64()))]
                yield pa.RecordBatch.from_arrays([node, pa.nulls(n, pa.int64()), label, sketch, *same], names=names)

    return run


def _across(least: float):
    """Candidates among the labels on either side of a bound."""

    def run(batches):
        for _, rows in groups(batches, ["seam"]):
            u, v = _pairs(*_arrays(rows), least)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that connect the forest's candidates. ``classes``: node, vals."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(parts, classes.count() * ORDERS // RANGE_LABELS))
    agree = percent / 100 + (1 - percent / 100) / 16
    least = VALUES * agree - 5 * (VALUES * agree * (1 - agree)) ** 0.5
    labels = classes.mapInArrow(_labels, "label binary, node long, sketch binary")
    found = materialize(labels.repartitionByRange(ranges, "label", "node").sortWithinPartitions("label", "node").mapInArrow(_neighbours(least), _FOREST), "forest")
    inner = found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))
    ends = found.where("other is null")
    # one row a range comes to the driver; a range of fewer labels than a neighbourhood joins the bounds on its either side
    sizes = sorted((r.part, r.n) for r in ends.groupBy("part").agg(F.first("n").alias("n")).collect())
    seam, places = 0, []
    for k, (part, n) in enumerate(sizes):
        if k:
            places.append((part, False, seam))
        if n >= REGION:
            seam += 1
        places.append((part, True, seam))
    where = spark.createDataFrame(places, "part int, last boolean, seam int")
    met = ends.join(F.broadcast(where), ["part", "last"]).select("seam", "label", "node", "sketch").distinct()
    outer = met.repartition(ranges, "seam").sortWithinPartitions("seam", "label", "node").mapInArrow(_across(least), "u long, v long")
    return inner.unionByName(outer)


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of the others."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    hit = one[at] == flat
    bounds = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat(hit.astype(np.int64), bounds)


def _linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    both = _common(one, others)
    union = np.array([len(o) for o in others]) + len(one) - both
    return 100 * both >= percent * union


def _may(n: int, m: np.ndarray, percent: int) -> np.ndarray:
    """Sets of these sizes can be alike enough."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _sets(column) -> list[np.ndarray]:
    chunk = column.combine_chunks()
    flat = chunk.flatten().to_numpy(zero_copy_only=False)
    at = chunk.offsets.to_numpy() - chunk.offsets[0].as_py()
    return [np.sort(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


def _close(sets: list[np.ndarray], nodes: np.ndarray, percent: int) -> np.ndarray:
    """Label (smallest node) of each set's component by links within the block."""
    size = np.array([len(s) for s in sets])
    label = nodes.copy()
    for i in range(len(sets) - 1):
        later = np.flatnonzero((label != label[i]) & _may(size[i], size, percent))
        later = later[later > i]
        if len(later):
            for j in later[_linked(sets[i], [sets[k] for k in later], percent)]:
                lo, hi = sorted((label[i], label[j]))
                label[label == hi] = lo
    return label


def confirm(docs: DataFrame, pools: DataFrame, words: int, percent: int) -> DataFrame:
    """node, label of the exact components within each pool. ``pools``: node, label (the pool)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = pools.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = materialize(attach(pools, materialize(blocks, "blocks"), "label").select(F.col("node").alias("doc_id"), F.col("label").alias("pool"), F.pmod(F.xxhash64("node"), "blocks").alias("block"), (F.col("blocks") > 1).cast("long").alias("many")), "pools")

    def sets_of(batches):
        for batch in batches:
            for part, data, offsets in steps(batch):
                grams, of = shingles(data, offsets, words)
                bounds = np.searchsorted(of, np.arange(len(offsets))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "pool", "block", "many")), pa.ListArray.from_arrays(bounds, pa.array(grams.view(np.int64)))], names=["node", "pool", "block", "many", "grams"])

    texts = attach(docs.select(F.col("doc_id").cast("long"), "text"), placed)
    schema = "node long, pool long, block long, many long, grams array<long>"
    sets = materialize(texts.mapInArrow(sets_of, schema), "sets")

    def close(batches):
        for _, rows in groups(batches, ["pool", "block"]):
            nodes = rows.column("node").to_numpy()
            label = _close(_sets(rows.column("grams")), nodes, percent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label), *(rows.column(c).combine_chunks() for c in ("pool", "block", "many"))], names=["node", "label", "pool", "block", "many"])

    state_schema = "node long, label long, pool long, block long, many long"
    state = materialize(sets.repartition(parts, "pool", "block").sortWithinPartitions("pool", "block", "node").mapInArrow(close, state_schema), "state")
    done = state.where("many = 0").select("node", "label")
    if not state.where("many = 1").count():
        return done

    many = materialize(sets.where("many = 1").select("node", "pool", "block", "grams"), "many")
    state = state.where("many = 1").select("node", "label", "pool", F.lit(False).alias("tried"))
    quota = PIVOTS

    def compare(batches):
        for _, rows in groups(batches, ["pool", "block"]):
            nodes, labels, pivot = (rows.column(c).to_numpy() for c in ("node", "label", "pivot"))
            own = _sets(rows.column("grams"))
            size = np.array([len(s) for s in own])
            linked = set()
            docs_at = np.flatnonzero(pivot == 0)
            for i in np.flatnonzero(pivot == 1):
                rest = docs_at[(labels[docs_at] != labels[i]) & _may(size[i], size[docs_at], percent)]
                if len(rest):
                    hit = rest[_linked(own[i], [own[k] for k in rest], percent)]
                    linked |= {(int(labels[i]), int(x)) for x in labels[hit]}
            pairs = sorted(linked)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    while True:
        sizes = state.groupBy("pool", "label").agg(F.count("*").alias("n"))
        largest = materialize(sizes.groupBy("pool").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("m")).select("pool", (-F.col("m.l")).alias("main")), "largest")
        outside = attach(state.where(~F.col("tried")), largest, "pool").where("label != main")
        counted = materialize(outside.groupBy("pool").agg(F.count("*").alias("n"), F.min("node").alias("first")), "outside")
        if not counted.count():
            return done.unionByName(state.select("node", "label"))
        drawn = F.pmod(F.xxhash64("node", F.lit(quota)), F.lit(1 << 20)) * F.col("n") < F.lit(quota << 20)
        pivots = materialize(attach(outside, counted, "pool").where(drawn | (F.col("node") == F.col("first"))).select("node", "pool"), "pivots")
        labelled = many.join(state.select("node", "label"), "node")
        its_blocks = materialize(many.select("pool", "block").distinct(), "blocks")
        asked = labelled.drop("block").join(pivots.select("node"), "node", "left_semi").join(its_blocks, "pool").withColumn("pivot", F.lit(1).cast("long"))
        both = labelled.withColumn("pivot", F.lit(0).cast("long")).unionByName(asked)
        links = both.select("node", "label", "pool", "block", "pivot", "grams").repartition(parts, "pool", "block").sortWithinPartitions("pool", "block", "pivot", "node").mapInArrow(compare, "u long, v long")
        moved = repoint(state, "label", components(links))
        state = materialize(moved.join(pivots.select(F.col("node").alias("_p")), moved["node"] == F.col("_p"), "left").withColumn("tried", F.col("tried") | F.col("_p").isNotNull()).drop("_p"), "state")
        quota *= 4


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; kept is the row of the component's smallest doc_id."""
    rows = materialize(scan(docs, words), "scan")
    classes = materialize(rows.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node")), "classes")
    signed = attach(rows.select("doc_id", "vals"), classes.select(F.col("node").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "node")
    pools = components(candidates(signed, percent))
    labels = materialize(confirm(docs, pools, words, percent), "labels")
    named = materialize(repoint(classes.withColumn("component_id", F.col("node")), "component_id", labels).select("d1", "d2", "component_id"), "named")
    out = rows.drop("vals").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest doc_id of each component.

    Of rows that have words and are equal in doc_id (or have none) and text, one stays: that of the
    smallest other columns. Rows without a doc_id are linked with nothing else.
    """
    gone = materialize(near_duplicates(docs, words, percent).where("not kept").select("doc_id").distinct(), "gone")
    hashed = [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_k2")]
    filled = F.coalesce(F.octet_length("text"), F.lit(0)) > 0
    twice = materialize(docs.where(filled).select(*hashed).groupBy("_k1", "_k2").agg(F.count("*").alias("n")).where("n > 1").select("_k1", "_k2"), "twice")
    kept = attach(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return kept
    flagged = attach(kept.select("*", *hashed), twice.withColumn("_twice", F.lit(True)), ["_k1", "_k2"], "left")
    again = F.coalesce(F.col("_twice") & filled, F.lit(False))
    one = flagged.where(again).groupBy("_k1", "_k2").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return flagged.where(~again).select(*docs.columns).unionByName(one)


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    """Links on 4-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
