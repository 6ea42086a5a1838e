"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule, as a Java and a Python regular expression.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only in local mode, where driver and executors are one machine, may spark.checkpoint.dir be unset; a
    temporary folder is made then.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and a lost
    executor costs only the tasks that it was running."""
    return _written(df, tag)[0]


#: Spark's setting that shuffle files go when the write that made them is done, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Materialized tables that are deleted as soon as their last reader is done. tidy: what was shuffled to make one
    is deleted as soon as it is written."""

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.paths, self.tidy = spark, {}, tidy

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        if not self.tidy:
            return self._kept(*_written(df, tag))
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            return self._kept(*_written(df, tag))
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)

    def _kept(self, table: DataFrame, path: str) -> DataFrame:
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        self.drop(*(table for table, _ in self.paths.values()))


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by materialize() that no later step reads."""
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rpartition("/")[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a table that is on disk already, if counting shows at most max_rows rows; else the
    join is left to Spark, which shuffles both sides and splits skewed keys at run time."""
    return F.broadcast(df) if df.count() <= max_rows else df


def running_sum(df: DataFrame, keys: list[str], block: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Add name, the running sum of value within keys in the order of (block, *order): by block totals."""
    at = [*keys, block]
    totals = df.groupBy(*at).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(c).alias(f"_{c}") for c in at), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*at).orderBy(*order)  # rows alike in all of order get the sum that includes them all
    same = F.lit(True)
    for c in at:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.withColumn("_in", F.sum(value).over(inside)).join(offsets, same).withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before", *(f"_{c}" for c in at))


def place_of(key: Column) -> Column:
    """A hexadecimal digest as a number from 0 (included) to 1, by its first 8 digits."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: Rows that one row is expanded to in one step.
AT_ONCE = 10_000


def each(counted: DataFrame, count: str, ordinal: str, at_once: int | None = None) -> DataFrame:
    """A row for each of count, numbered by ordinal from 0. What one row is expanded to comes from many tasks if it
    is much."""
    most = at_once or AT_ONCE
    n = F.col(count)
    few = counted.filter(n <= most).withColumn(ordinal, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    many = counted.filter(n > most).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {most}"))))
    start = F.col("_from") * most
    many = many.repartition("_from").withColumn(ordinal, F.explode(F.sequence(start, F.least(start + most, n) - 1)))
    return few.unionByName(many.drop("_from"))


def number_alike(rows: DataFrame, key: str, repeated: DataFrame, most: int) -> DataFrame:
    """rows with copy, which numbers those of one key from 0, a file split at a time. repeated: key, those of more
    than one row, on disk; up to most of them are broadcast."""
    if repeated.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    marked = rows.join(broadcast_if_small(repeated.select(F.col(key).alias("_shared")), most), F.col(key) == F.col("_shared"), "left")
    again = marked.filter("_shared IS NOT NULL").drop("_shared").withColumns({"_at": F.monotonically_increasing_id(), "_one": F.lit(1).cast("long")})
    again = materialize(again.withColumn("_split", F.expr("_at >> 33")), "again")
    again = running_sum(again, [key], "_split", [F.col("_at")], "_one", "_number").withColumn("copy", F.col("_number") - 1)
    once = marked.filter("_shared IS NULL").drop("_shared").withColumn("copy", F.lit(0).cast("long"))
    return once.unionByName(again.drop("_at", "_one", "_split", "_number"))
