"""Algebra on vertex sets (DataFrames with a column v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").unionByName(b.select("v")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("v").distinct().join(b.select("v"), "v", "left_semi")


def complement(a: DataFrame, every: DataFrame) -> DataFrame:
    return every.select("v").distinct().join(a.select("v"), "v", "left_anti")


def cardinality(a: DataFrame) -> DataFrame:
    return a.agg(F.count_distinct("v").alias("n"))


def bitmap(a: DataFrame) -> DataFrame:
    """bucket, bits: the set as bitmaps of 32,768 ids."""
    return a.groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))


def bitmap_cardinality(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def ordered(a: DataFrame) -> DataFrame:
    return a.select("v").distinct().orderBy("v")
