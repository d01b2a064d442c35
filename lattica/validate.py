"""Comparison of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """v, a, b where two results (v, val) differ, a vertex that only one has included."""
    x, y = a.select("v", F.col("val").alias("a"), F.lit(1).alias("_x")), b.select("v", F.col("val").alias("b"), F.lit(1).alias("_y"))
    both = x.join(y, "v", "full")
    return both.where(F.col("_x").isNull() | F.col("_y").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).select("v", "a", "b")


def beyond(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """v, a, b where |a - b| / a exceeds the tolerance, or only one result has the vertex."""
    both = a.select("v", F.col("val").alias("a")).join(b.select("v", F.col("val").alias("b")), "v", "full")
    off = F.abs(F.col("a") - F.col("b")) > tolerance * F.abs(F.col("a"))
    return both.where(F.col("a").isNull() | F.col("b").isNull() | off)


def stale(files: DataFrame, minutes: int = 30) -> DataFrame:
    """Files (path, modificationTime, as the binaryFile source has them) older than ``minutes``."""
    return files.where(F.col("modificationTime") < F.current_timestamp() - F.make_dt_interval(mins=F.lit(minutes)))
