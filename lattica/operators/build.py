"""From edges to a property graph: compact ids, both directions, weights, degrees, blocks, adjacency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, partitions


@dataclass
class Graph:
    """edges: src, dst[, w]; vertices: v, orig_id, in_degree, out_degree."""

    edges: DataFrame
    vertices: DataFrame

    @property
    def weighted(self) -> bool:
        return "w" in self.edges.columns


def symmetrize(edges: DataFrame) -> DataFrame:
    """Each edge also reversed, with its weight (a loop is stored twice)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct vertex ids (v) that occur in an edge; duplicates go before the exchange."""
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def rank_ids(ids: DataFrame) -> DataFrame:
    """orig_id, v: the dense 0-based rank of each distinct id (column v).

    Ids are dealt by range and sorted; an id's rank is its place in its partition
    plus the sizes of the partitions before, of which only the sizes come to the driver.
    """
    n = partitions(ids.sparkSession)
    low = (1 << 33) - 1
    placed = materialize(ids.select(F.col("v").alias("orig_id")).repartitionByRange(n, "orig_id").sortWithinPartitions("orig_id").withColumn("at", F.monotonically_increasing_id()), "ranks")
    sizes = placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    before, total = {}, 0
    for r in sizes:
        before[r.p] = total
        total += r.n
    if not before:
        return placed.select("orig_id", F.col("at").alias("v"))
    offsets = ids.sparkSession.createDataFrame(list(before.items()), "p long, before long")
    return placed.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(offsets), "p").select("orig_id", (F.col("before") + F.col("at").bitwiseAND(F.lit(low))).alias("v"))


def compact_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges in dense ids, which keep the order of the original ones, and the mapping (orig_id, v)."""
    mapping = materialize(rank_ids(endpoints(edges)), "mapping")
    out = edges
    for end in ("src", "dst"):
        named = mapping.select(F.col("orig_id").alias(end), F.col("v").alias("_v"))
        out = out.join(named, end).drop(end).withColumnRenamed("_v", end)
    return out.select("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")]), mapping


def synthetic_weight(src: Column, dst: Column) -> Column:
    return F.pmod(src + dst, F.lit(100))


def with_synthetic_weights(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", synthetic_weight(F.col("src"), F.col("dst")))


def degrees(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """v, in_degree, out_degree with multiplicity, in one exchange; ids adds vertices without edges (column v)."""
    end = lambda c, i, o: F.struct(F.col(c).alias("v"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select(F.explode(F.array(end("src", 0, 1), end("dst", 1, 0))).alias("e")).select("e.*")
    if ids is not None:
        ends = ends.unionByName(ids.select("v", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("v").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def build_graph(edges: DataFrame, compact: bool = False, undirected: bool = False, weight: str = "none", num_vertices: int | None = None) -> Graph:
    """Edges to a graph. weight: "none", "synthetic" ((src + dst) % 100 on the graph's ids) or "column" (edges.w).

    ``num_vertices``: ids 0 ... num_vertices - 1 exist, with or without edges.
    """
    if weight != "column":
        edges = edges.drop("w")
    elif "w" not in edges.columns:
        raise ValueError("edges have no column w")
    mapping = None
    if compact:
        edges, mapping = compact_ids(edges)
    if undirected:
        edges = symmetrize(edges)
    if weight == "synthetic":
        edges = with_synthetic_weights(edges)
    spark = edges.sparkSession
    more = spark.range(num_vertices).withColumnRenamed("id", "v") if num_vertices else None
    vertices = degrees(edges, more)
    if mapping is not None:
        vertices = vertices.join(mapping, "v", "left").select("v", "orig_id", "in_degree", "out_degree")
    else:
        vertices = vertices.select("v", F.col("v").alias("orig_id"), "in_degree", "out_degree")
    return Graph(edges, vertices)


def check(graph: Graph) -> dict[str, int]:
    """Sums of degrees and the number of edges; raises if they differ."""
    s = graph.vertices.agg(F.coalesce(F.sum("in_degree"), F.lit(0)).alias("i"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("o")).first()
    e = graph.edges.count()
    if not s.i == s.o == e:
        raise ValueError(f"degrees don't add up: in {s.i}, out {s.o}, edges {e}")
    return {"in_degree": s.i, "out_degree": s.o, "edges": e}


def adjacency(edges: DataFrame, direction: str = "out") -> DataFrame:
    """v, nbrs: array of (id, w) sorted by id. Arrays are as long as a degree: for interop and inspection, not for rounds."""
    own, other = ("src", "dst") if direction == "out" else ("dst", "src")
    w = F.col("w") if "w" in edges.columns else F.lit(None).cast("long")
    return edges.groupBy(F.col(own).alias("v")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("id"), w.alias("w")))).alias("nbrs"))


def neighbours(edges: DataFrame, v: int, direction: str = "out") -> DataFrame:
    """id[, w] of one vertex's edges; the filter reaches the scan."""
    own, other = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.where(F.col(own) == v).select(F.col(other).alias("id"), *[c for c in edges.columns if c == "w"])


def block(edges: DataFrame, sources: tuple[int, int], dests: tuple[int, int]) -> DataFrame:
    """Edges of a rectangle (half-open ranges)."""
    return edges.where((F.col("src") >= sources[0]) & (F.col("src") < sources[1]) & (F.col("dst") >= dests[0]) & (F.col("dst") < dests[1]))


def hash_order(v: Column, n: int, parts: int) -> Column:
    """New id of v among 0 ... n - 1 when vertices are ordered by (v % parts, v), in closed form."""
    bucket = F.pmod(v, F.lit(parts))
    whole, extra = divmod(n, parts)
    before = bucket * whole + F.least(bucket, F.lit(extra))
    return before + F.floor(v / parts)


def part_order(assignment: DataFrame, align: int = 64) -> DataFrame:
    """v, part, new_id: vertices grouped by part, each part starting at a multiple of ``align``. assignment: v, part.

    Ranks within a part come from the order (part, v) by ranges, as in rank_ids.
    """
    spark = assignment.sparkSession
    sizes = {r.part: r.n for r in assignment.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, ranks, at, seen = {}, {}, 0, 0
    for part in sorted(sizes):
        starts[part], ranks[part] = at, seen
        at += -(-sizes[part] // align) * align
        seen += sizes[part]
    n = partitions(spark)
    low = (1 << 33) - 1
    placed = materialize(assignment.select("v", "part").repartitionByRange(n, "part", "v").sortWithinPartitions("part", "v").withColumn("at", F.monotonically_increasing_id()), "parts")
    counts = placed.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    before, total = [], 0
    for r in counts:
        before.append((r.p, total))
        total += r.n
    shift = spark.createDataFrame([(p, starts[p] - ranks[p]) for p in starts], "part long, shift long") if starts else spark.createDataFrame([], "part long, shift long")
    offsets = spark.createDataFrame(before, "p long, before long")
    out = placed.withColumn("p", F.shiftright("at", 33)).join(F.broadcast(offsets), "p").join(F.broadcast(shift), "part")
    return out.select("v", "part", (F.col("before") + F.col("at").bitwiseAND(F.lit(low)) + F.col("shift")).alias("new_id"))
