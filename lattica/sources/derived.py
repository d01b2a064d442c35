"""Graphs that lie in order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns)


def _next_part(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = lines.select(F.col("l_partkey").cast("long").alias("src"), F.lead("l_partkey").over(order).cast("long").alias("dst"))
    return pairs.where("dst is not null")


def copart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed multigraph of parts: each order line's part to the next line's."""
    return _next_part(_lines(spark, sf_dir, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def copart_q40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As copart, over lines of quantity 40 or more: sparse, with dangling and unreached vertices."""
    return _next_part(_lines(spark, sf_dir, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").where("l_quantity >= 40"))


def retq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected graph of orders (even ids) and parts (odd ids) of large returned lines; both directions."""
    lines = _lines(spark, sf_dir, "l_orderkey", "l_partkey", "l_returnflag", "l_quantity").where("l_returnflag = 'R' and l_quantity >= 48")
    one = lines.select((F.col("l_orderkey").cast("long") * 2).alias("src"), (F.col("l_partkey").cast("long") * 2 + 1).alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
