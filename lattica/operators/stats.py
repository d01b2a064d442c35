"""Balance, workload and communication of a partitioning; cost of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .partition import VERTEX_WEIGHT, vertex_sets, with_owner


def balance(blocks: DataFrame) -> DataFrame:
    """unbalance (largest over mean edges of a block), non_empty."""
    return blocks.agg((F.max("edges") / F.avg("edges")).alias("unbalance"), F.count_if(F.col("edges") > 0).alias("non_empty"))


def workload(blocks: DataFrame) -> DataFrame:
    """owner, workload: edges plus ten for each vertex of the blocks' ranges."""
    load = F.col("edges") + VERTEX_WEIGHT * (F.col("to_source") - F.col("from_source") + F.col("to_dest") - F.col("from_dest"))
    return blocks.groupBy("owner").agg(F.sum(load).alias("workload"))


def _spread(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.sum(c).alias("total"), F.avg(c).alias("mean"), F.max(c).alias("max"), F.min(c).alias("min"), (F.max(c) / F.avg(c)).alias("max_ratio"), (F.min(c) / F.avg(c)).alias("min_ratio"))


def work_report(blocks: DataFrame) -> DataFrame:
    return _spread(workload(blocks), "workload")


def managed(blocks: DataFrame) -> DataFrame:
    """owner, a, z: vertex ranges that are both source and destination range of one of the owner's blocks."""
    a, z = F.greatest("from_source", "from_dest"), F.least("to_source", "to_dest")
    return blocks.select("owner", a.alias("a"), z.alias("z")).where("a < z")


def communication(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """owner, communication: received vertices that the owner doesn't manage, plus sent ones."""
    own = F.broadcast(managed(blocks).groupBy("owner").agg(F.collect_list(F.struct("a", "z")).alias("ranges")))
    sets = vertex_sets(edges, blocks).join(own, "owner", "left")
    outside = sets.where(~F.coalesce(F.exists("ranges", lambda r: (r["a"] <= F.col("v")) & (F.col("v") < r["z"])), F.lit(False)))
    counts = outside.groupBy("owner").agg(F.count("*").alias("n"))
    owners = blocks.select("owner").distinct()
    return owners.join(counts, "owner", "left").select("owner", F.coalesce("n", F.lit(0)).cast("long").alias("communication"))


def communication_report(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    return _spread(communication(edges, blocks), "communication")


def pair_gain(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """a, b, gain: vertices that two owners both receive plus those both send (pairs with some).

    Owners of a vertex are gathered as one short array (a grid's row or column), and pairs
    come from that, so no join by vertex multiplies hot ones beyond the number of owners.
    """
    sets = vertex_sets(edges, blocks).groupBy("kind", "v").agg(F.array_sort(F.collect_set("owner")).alias("o")).groupBy("o").agg(F.count("*").alias("n"))
    pairs = sets.select("n", F.col("o"), F.explode("o").alias("a")).select("n", "a", F.explode("o").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("gain"))


def edge_workload_ratio(blocks: DataFrame) -> DataFrame:
    """ratio: most edges of an owner over the mean."""
    return blocks.groupBy("owner").agg(F.sum("edges").alias("e")).agg((F.max("e") / F.avg("e")).alias("ratio"))


def block_edges(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """owner, edges: counted from the edges themselves."""
    return with_owner(edges, blocks).groupBy("owner").agg(F.count("*").alias("edges"))
