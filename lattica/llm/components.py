"""Connected components of an edge table, with the smallest node of each as its label.

Large graphs are contracted on the cluster: every node points to its smallest
neighbour, pointers are doubled until they end at roots, and edges are rewritten
between roots; each round at least halves the nodes that still have edges. What
is left, once under ``ONE_TASK`` edges, is closed by a union-find in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Edges, at most, that one task closes by itself (16 bytes each).
ONE_TASK = 500_000


def _union_find(batches):
    parent: dict[int, int] = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    roots = np.fromiter((find(x) for x in nodes.tolist()), np.int64, len(nodes))
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(roots[i : i + (1 << 16)])], names=["node", "label"])


def repoint(table: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """Replace ``column`` by what it points to, where it does."""
    p = pointers.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return table.join(p, table[column] == p["_n"], "left").withColumn(column, F.coalesce("_l", column)).drop("_n", "_l")


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node, label for every node of ``edges`` (two long columns u, v; any direction, repeats and loops allowed)."""

    def clean(e: DataFrame) -> DataFrame:
        return materialize(e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    every = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null")
    left = clean(every)
    nodes = None
    while (n := left.count()) > one_task:
        if nodes is None:
            nodes = materialize(left.select(F.explode(F.array("u", "v")).alias("node")).distinct().select("node", F.col("node").alias("label")), "nodes")
        pointers = materialize(left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")), "pointers")
        while True:
            jumped = materialize(repoint(pointers.withColumn("was", F.col("label")), "label", pointers), "pointers")
            moved = jumped.where("label != was").limit(1).count()
            pointers = jumped.drop("was")
            if not moved:
                break
        nodes = materialize(repoint(nodes, "label", pointers), "nodes")
        left = clean(repoint(repoint(left, "u", pointers), "v", pointers))
    schema = "node long, label long"
    rest = materialize(left.repartition(1).mapInArrow(_union_find, schema), "labels") if n else edges.sparkSession.createDataFrame([], schema)
    return rest if nodes is None else materialize(repoint(nodes, "label", rest) if n else nodes, "nodes")
