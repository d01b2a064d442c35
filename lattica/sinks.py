"""Writers: results as text, graphs, partitioned graphs with their metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.build import Graph
from .operators.partition import with_owner
from .storage import partitions


def write_results(values: DataFrame, path: str | None, by_range: bool = True) -> None:
    """Lines "vertex value" in files of contiguous vertex ranges; a path of None writes nothing. Any path that Spark can write."""
    if path is None:
        return
    out = values.select("v", "val")
    if by_range:
        out = out.repartitionByRange(partitions(values.sparkSession), "v").sortWithinPartitions("v")
    out.write.mode("overwrite").csv(path, sep=" ")


def write_graph(graph: Graph, path: str) -> None:
    """edges sorted by source within files dealt by source, and vertices, as Parquet."""
    n = partitions(graph.edges.sparkSession)
    graph.edges.repartition(n, "src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")


def write_partitioned(edges: DataFrame, blocks: DataFrame, path: str, total_v: int) -> None:
    """Edges in one folder an owner, the blocks as a table, and a metadata JSON document an owner."""
    spark = edges.sparkSession
    with_owner(edges, blocks).write.mode("overwrite").partitionBy("owner").parquet(f"{path}/edges")
    blocks.coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks")
    rows = blocks.orderBy("owner", "from_source", "from_dest").collect()
    total_e = sum(r.edges for r in rows)
    docs = []
    for owner in sorted({r.owner for r in rows}):
        own = [{k: r[k] for k in ("from_source", "to_source", "from_dest", "to_dest", "edges")} for r in rows if r.owner == owner]
        docs.append((owner, json.dumps({"total_v": total_v, "total_e": total_e, "graphs": own})))
    spark.createDataFrame(docs, "owner int, value string").write.mode("overwrite").partitionBy("owner").text(f"{path}/metadata")


def ranges(values: DataFrame) -> DataFrame:
    """first, last, rows of each partition of a result that is dealt by range."""
    return values.groupBy(F.spark_partition_id().alias("p")).agg(F.min("v").alias("first"), F.max("v").alias("last"), F.count("*").alias("rows"))
