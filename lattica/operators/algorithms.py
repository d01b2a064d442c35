"""The four algorithms as vertex programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..loop import Run, run
from ..program import VertexProgram, smaller
from ..storage import materialize
from .build import Graph


def bfs_program(root: int) -> VertexProgram:
    """Levels from ``root`` along out-edges."""
    return VertexProgram(
        name="bfs",
        init=lambda v, deg: (F.when(v == root, F.lit(0).cast("long")), v == root),
        message=lambda val, w: val + 1,
        combine="up",
        apply=lambda old, msg, deg, k, last: F.coalesce(old, msg),
        activate=lambda old, new: old.isNull() & new.isNotNull(),
    )


def sssp_program(root: int, kind: str = "long") -> VertexProgram:
    """Shortest distances from ``root``; weights must not be negative."""
    return VertexProgram(
        name="sssp",
        init=lambda v, deg: (F.when(v == root, F.lit(0).cast(kind)), v == root),
        message=lambda val, w: val + w,
        combine="min",
        apply=lambda old, msg, deg, k, last: F.least(old, msg),
        activate=smaller,
    )


def cc_program() -> VertexProgram:
    """Smallest id among the vertices that reach each vertex; on symmetrized edges its component's label."""
    return VertexProgram(
        name="cc",
        init=lambda v, deg: (v, F.lit(True)),
        message=lambda val, w: val,
        combine="min",
        apply=lambda old, msg, deg, k, last: F.least(old, msg),
        activate=smaller,
    )


def pagerank_program(iterations: int) -> VertexProgram:
    """Ranks start at 1; between rounds a vertex holds rank / out_degree, after the last the rank; dangling mass is dropped."""
    if iterations < 0:
        raise ValueError("iterations must not be negative")
    spread = lambda rank, deg: F.when(deg > 0, rank / deg).otherwise(rank)

    def apply(old, msg, deg, k, last):
        rank = F.lit(0.15) + F.lit(0.85) * F.coalesce(msg, F.lit(0.0))
        return rank if last else spread(rank, deg)

    return VertexProgram(
        name="pagerank",
        init=lambda v, deg: (spread(F.lit(1.0), deg), F.lit(True)),
        message=lambda val, w: val,
        combine="sum",
        apply=apply,
        activate=lambda old, new: F.lit(True),
        rounds=iterations,
        everywhere=True,
    )


def bfs(graph: Graph, root: int, **options) -> Run:
    return run(graph, bfs_program(root), **options)


def sssp(graph: Graph, root: int, **options) -> Run:
    if not graph.weighted:
        raise ValueError("the graph has no weights")
    low = graph.edges.agg(F.min("w")).first()[0]
    if low is not None and low < 0:
        raise ValueError("negative weight")
    return run(graph, sssp_program(root, "double" if dict(graph.edges.dtypes)["w"] == "double" else "long"), **options)


def pagerank(graph: Graph, iterations: int = 20, **options) -> Run:
    return run(graph, pagerank_program(iterations), **options)


def cc(graph: Graph, method: str = "rounds", **options) -> Run:
    """method "rounds": labels travel an edge a round; "contract": for graphs of many rounds, undirected input only."""
    if method == "rounds":
        return run(graph, cc_program(), **options)
    if method != "contract":
        raise ValueError(f"unknown method {method!r}")
    labels = contract(graph.edges)
    state = graph.vertices.select("v").join(labels, "v", "left").select("v", F.coalesce("label", "v").alias("val"), F.lit(False).alias("active"))
    return Run(state)


def contract(edges: DataFrame) -> DataFrame:
    """v, label of every vertex with an edge to another one, by rounds of contraction.

    Each vertex points to its smallest neighbour, if smaller; pointers are doubled until
    they end at roots; edges are rewritten between roots. A round at least halves the
    vertices that still have edges, so rounds grow with the logarithm of the graph.
    """

    def clean(e: DataFrame) -> DataFrame:
        return materialize(e.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "contract")

    def follow(t: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
        p = pointers.select(F.col("at").alias("_at"), F.col("to").alias("_to"))
        return t.join(p, t[column] == p["_at"], "left").withColumn(column, F.coalesce("_to", column)).drop("_at", "_to")

    left = clean(edges)
    labels = materialize(left.select(F.explode(F.array("u", "v")).alias("v")).distinct().withColumn("label", F.col("v")), "labels")
    while left.limit(1).count():
        pointers = materialize(left.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("to")), "pointers")
        while True:
            jumped = materialize(follow(pointers.withColumn("was", F.col("to")), "to", pointers), "pointers")
            pointers = jumped.drop("was")
            if not jumped.where("to != was").limit(1).count():
                break
        labels = materialize(follow(labels, "label", pointers), "labels")
        left = clean(follow(follow(left, "u", pointers), "v", pointers).select(F.col("u").alias("src"), F.col("v").alias("dst")))
    return labels
