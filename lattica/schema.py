"""Column names and schemas that the engine's tables share."""

from __future__ import annotations

from pyspark.sql import types as T

#: What results show for a vertex that was never reached (inside the engine it's null).
UNREACHED = 4294967295

BLOCKS = T.StructType([T.StructField("owner", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("from_source", "to_source", "from_dest", "to_dest", "edges"))])
ROUNDS = T.StructType(
    [
        T.StructField("round", T.IntegerType()),
        T.StructField("active_in", T.LongType()),
        T.StructField("active_edges", T.LongType()),
        T.StructField("activated", T.LongType()),
        T.StructField("mode", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("messages", T.LongType()),
        T.StructField("vertices", T.LongType()),
    ]
)
