"""Synthetic graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, probabilities=(0.57, 0.19, 0.19, 0.05), seed: int = 1) -> DataFrame:
    """R-MAT edges: 2**scale ids, edge_factor * 2**scale lines; each bit of both ends falls in a quadrant by a hash of (line, bit)."""
    a, b, c, _ = probabilities
    unit = lambda k: (F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53))
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(scale):
        u = unit(k)
        src = src * 2 + (u >= a + b).cast("long")
        dst = dst * 2 + (((u >= a) & (u < a + b)) | (u >= a + b + c)).cast("long")
    return spark.range(edge_factor << scale).select(src.alias("src"), dst.alias("dst"))
