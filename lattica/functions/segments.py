"""Cost model of sending a vertex range's values: which format, how many bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest counts that go as pairs and as a bitmap with packed values (fixed values of the cost model).
PAIR_BOUND, SPARSE_BOUND = 100_000, 1_000_000


def segment_format(active: Column, pair_bound: int = PAIR_BOUND, sparse_bound: int = SPARSE_BOUND) -> Column:
    return F.when(active == 0, F.lit("MAGIC")).when(active <= pair_bound, F.lit("PAIR")).when(active <= sparse_bound, F.lit("SPARSE")).otherwise(F.lit("DENSE"))


def segment_bytes(active: Column, length: Column, pair_bound: int = PAIR_BOUND, sparse_bound: int = SPARSE_BOUND) -> Column:
    """Bytes of a segment with ``active`` of ``length`` vertices: header of 5 words, then words by format."""
    bitmap = F.shiftright(length, 5) + 2
    words = F.when(active == 0, F.lit(5)).when(active <= pair_bound, 5 + 2 * active).when(active <= sparse_bound, 5 + bitmap + active).otherwise(5 + bitmap + length)
    return (words * 4).cast("long")


def direction(active_edges: Column, edges: Column) -> Column:
    """push while the active vertices have fewer out-edges than a twentieth of all edges."""
    return F.when(active_edges < F.floor(edges / 20), F.lit("push")).otherwise(F.lit("pull"))
