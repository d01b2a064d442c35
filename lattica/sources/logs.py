"""Request traces and worker logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metric name -> (label in the log, unit).
METRICS = {
    "duration_ms": ("Duration", "ms"),
    "billed_ms": ("Billed Duration", "ms"),
    "memory_mb": ("Max Memory Used", "MB"),
    "message_mb": ("total_msg_size", "MB"),
    "overall_s": ("overall_time", "s"),
    "idle_s": ("overall_idle_time", "s"),
}


def parse_trace(lines: DataFrame, skip: int = 88, divisor: float = 100.0, position: str = "position") -> DataFrame:
    """Requests per minute: the last field of each line over ``divisor``, from line number ``skip`` on. lines: position, value."""
    last = F.element_at(F.split(F.trim("value"), r"\s+"), -1).try_cast("double")
    return lines.where(F.col(position) >= skip).select((F.col(position) - skip).alias("minute"), (last / divisor).alias("requests"))


def parse_worker_lines(lines: DataFrame) -> DataFrame:
    """One column for each metric, null where a line doesn't have it."""
    found = {name: F.regexp_extract("value", rf"(?<![A-Za-z_])(?<!Billed ){label}: *([0-9]+(?:\.[0-9]+)?) *{unit}\b", 1).try_cast("double") for name, (label, unit) in METRICS.items()}
    return lines.select("*", *[c.alias(n) for n, c in found.items()])


def read_worker_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each log file: the largest value of each metric in it."""
    lines = parse_worker_lines(spark.read.text(path).withColumn("worker", F.input_file_name()))
    return lines.groupBy("worker").agg(*[F.max(n).alias(n) for n in METRICS])


def run_metrics(workers: DataFrame) -> DataFrame:
    """Latency is the slowest worker's; the others are sums."""
    sums = [F.sum(n).alias(n) for n in ("billed_ms", "memory_mb", "message_mb", "overall_s", "idle_s")]
    return workers.agg(F.max("duration_ms").alias("latency_ms"), *sums)
