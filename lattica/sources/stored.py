"""What the sinks have written: graphs, block metadata, results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.build import Graph

_RANGE = T.StructType([T.StructField(c, T.LongType()) for c in ("from_source", "to_source", "from_dest", "to_dest", "edges")])
METADATA = T.StructType([T.StructField("total_v", T.LongType()), T.StructField("total_e", T.LongType()), T.StructField("graphs", T.ArrayType(_RANGE))])


def read_graph(spark: SparkSession, path: str, degrees: bool = True) -> Graph:
    """A graph that sinks.write_graph stored; without ``degrees`` only ids are read of the vertices."""
    vertices = spark.read.parquet(f"{path}/vertices")
    return Graph(spark.read.parquet(f"{path}/edges"), vertices if degrees else vertices.select("v", "orig_id"))


def read_partitioned(spark: SparkSession, path: str, owners: list[int] | None = None) -> DataFrame:
    """owner and edges that sinks.write_partitioned stored; of some owners only their folders are read."""
    edges = spark.read.parquet(f"{path}/edges")
    return edges if owners is None else edges.where(F.col("owner").isin(owners))


def read_block_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each block of a metadata JSON document (or a folder of them); owner from a folder name like owner=3, else null."""
    docs = spark.read.schema(METADATA).json(path, multiLine=True, recursiveFileLookup=True)
    owner = F.regexp_extract(F.input_file_name(), "owner=([0-9]+)/", 1).try_cast("int")
    return docs.select(owner.alias("owner"), "total_v", "total_e", F.explode("graphs").alias("g")).select("owner", "total_v", "total_e", "g.*")


def read_raw_results(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """v, val of files of little-endian 4-byte values (kind "long": unsigned, "double": floats) named by their first vertex, result_<start>_<end>[.ext]."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    first = F.regexp_extract("path", "result_([0-9]+)_([0-9]+)[^/]*$", 1).try_cast("long")
    item, out = ("<u4", np.int64) if kind == "long" else ("<f4", np.float64)

    def run(batches):
        for batch in batches:
            for start, content in zip(batch.column("first").to_pylist(), batch.column("content"), strict=True):
                values = np.frombuffer(content.as_buffer(), item)
                for i in range(0, len(values), 1 << 20):
                    part = values[i : i + (1 << 20)].astype(out)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start + i, start + i + len(part))), pa.array(part)], names=["v", "val"])

    return files.select(first.alias("first"), "content").where("first is not null").mapInArrow(run, f"v long, val {kind}")


def read_results(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """Lines "vertex value"; a malformed line is an error."""
    return spark.read.csv(path, sep=" ", schema=f"v long, val {kind}", mode="FAILFAST")


def range_of_result(path):
    """First vertex of a result file, from a name like result_<start>_<end>.txt."""
    return F.regexp_extract(path, r"result_([0-9]+)_([0-9]+)\.txt$", 1).try_cast("long")
