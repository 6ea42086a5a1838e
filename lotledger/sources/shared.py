"""Tables written once where driver and executors can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet in the folder of spark.checkpoint.dir, read back: several readers compute it once, and a
    lost executor costs only the tasks that it was running. Only local mode may leave the folder unset."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a written table, if it has at most so many rows; else the join is left to Spark."""
    return F.broadcast(df) if df.count() <= most else df


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, path: str) -> bool:
    system, path = _path(spark, path)
    return system.exists(path)


def delete(spark: SparkSession, path: str) -> None:
    system, path = _path(spark, path)
    system.delete(path, True)


def mark(spark: SparkSession, path: str) -> None:
    """Make an empty file."""
    system, path = _path(spark, path)
    system.create(path, True).close()
