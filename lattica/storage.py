"""Tables in the folder that the whole cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may fall back to /tmp."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/checkpoints"
    return where.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters on which it isn't installed. The driver serves the archive until it ends."""
    package, folder = Path(__file__).resolve().parent, tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lattica-{spark.sparkContext.applicationId}/graph/{tag}-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet at ``path`` and read it back with the same schema."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return save(df, new_path(df.sparkSession, tag))


def save_dealt(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write Parquet at ``path``, bucketed by ``key`` in as many buckets as a shuffle has partitions, and read it back.

    Joins and aggregates by the key then need no exchange of this side. The catalog knows
    the table only while the result is made; its files are all that is needed.
    """
    spark = df.sparkSession
    name = f"lattica_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(partitions(spark), key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    out = spark.table(name).select("*")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
