"""Edge lists from text lines and from any table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to three unsigned decimals, blanks between them; what follows is ignored.
LINE = r"^[ \t\r\n]*([0-9]+)[ \t\r\n]+([0-9]+)(?:[ \t\r\n]+([0-9]+))?"


def parse_edge_lines(lines: DataFrame, weighted: bool = False, column: str = "value") -> DataFrame:
    """src, dst (and w: null where a line has none). Lines that start with # or hold fewer than two numbers are dropped."""
    value = F.col(column)
    fields = [F.regexp_extract(value, LINE, k) for k in (1, 2, 3)]
    kept = lines.where(~value.startswith("#")).select(*[f.try_cast("long").alias(c) for f, c in zip(fields, ("src", "dst", "w"), strict=True)])
    kept = kept.where("src is not null and dst is not null")
    return kept if weighted else kept.drop("w")


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False, missing_weight: str = "error") -> DataFrame:
    """Text edge list. ``missing_weight``: "error", or a number to put in a line without a third field."""
    edges = parse_edge_lines(spark.read.text(path), weighted)
    if not weighted:
        return edges
    if missing_weight == "error":
        checked = F.when(F.col("w").isNull(), F.raise_error(F.concat(F.lit("edge without a weight: "), F.concat_ws(" ", "src", "dst")))).otherwise(F.col("w"))
        return edges.withColumn("w", checked.cast("long"))
    return edges.withColumn("w", F.coalesce("w", F.lit(int(missing_weight))))


def from_table(df: DataFrame, src: str, dst: str, w: str | None = None) -> DataFrame:
    """Edges from two columns of any table or query (a third for weights); rows without both ends are dropped."""
    columns = [F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")]
    if w is not None:
        kind = "double" if dict(df.dtypes)[w] in ("float", "double") or dict(df.dtypes)[w].startswith("decimal") else "long"
        columns.append(F.col(w).cast(kind).alias("w"))
    return df.select(*columns).where("src is not null and dst is not null")
