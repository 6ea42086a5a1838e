"""Deed documents as a stream: polling, late rows, upserts by batch, running latest sale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.deeds import coverage
from ..operators.sales import sales_from_documents
from ..operators.upserts import insert_ignore, merge_partitions, upsert
from ..sources.shared import delete, exists, mark, written

REREAD_DAYS, MAX_REREAD_DAYS = 45, 90


def read_documents(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Normalized documents as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def needs_run(source: DataFrame, covered: DataFrame) -> DataFrame:
    """source, latest, covered_to, run: whether a source has dates beyond those covered. source: (source,
    recorded_date); covered: (source, date_to)."""
    latest = source.groupBy("source").agg(F.max("recorded_date").alias("latest"))
    known = covered.groupBy("source").agg(F.max("date_to").alias("covered_to"))
    return latest.join(known, "source", "left").withColumn("run", F.coalesce(F.col("latest") > F.col("covered_to"), F.lit(True)))


def stream_documents(stream: DataFrame, days: int = REREAD_DAYS) -> DataFrame:
    """Documents once for each (document, parcel): rows that come again within the re-read window are
    dropped, and the watermark forgets keys after it, so state is bounded by the window."""
    late = f"{min(days, MAX_REREAD_DAYS)} days"
    return stream.withColumn("recorded_ts", F.col("recorded_date").cast("timestamp")).withWatermark("recorded_ts", late).dropDuplicatesWithinWatermark(["document_id", "bbl"]).drop("recorded_ts")


def stream_latest_sale(stream: DataFrame) -> DataFrame:
    """The latest deed with an amount of each parcel, kept up to date (update or complete mode). State is
    one row a parcel by design."""
    sold = sales_from_documents(stream)
    last = F.max(F.struct("sale_date", "sale_price", "source", "document_id")).alias("s")
    return sold.groupBy("bbl").agg(last).select("bbl", "s.*")


# How the tables are partitioned: documents and sales by borough and month, what is covered by borough.
DOCUMENT_PARTS = {"part_borough": "left(bbl, 1)", "part_month": "date_format(recorded_date, 'yyyy-MM')"}
SALE_PARTS = {"part_borough": "left(bbl, 1)", "part_month": "date_format(sale_date, 'yyyy-MM')"}
DOCUMENT_KEYS, SALE_KEYS = ["document_id", "bbl"], ["bbl", "sale_date", "source"]


def stored_table(spark: SparkSession, folder: str, name: str, schema: StructType | str) -> DataFrame:
    """A table below folder as the batches have left it."""
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def batch_upsert(spark: SparkSession, folder: str, as_of: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that puts documents and their sales into tables below folder, and what is covered.

    A batch writes the partitions that it changes and no others; what is covered is counted anew in the
    boroughs that it touches. A ledger names the batches that are done: those are not run again. A batch that broke
    off is run again from what it had staged, or from the start; both upserts give the same rows the second time.
    """

    def run(batch: DataFrame, number: int) -> None:
        done = f"{folder}/ledger/batch={number}"
        if exists(spark, done):
            return
        staging = f"{folder}/staging/batch={number}"
        batch = written(batch.dropDuplicates(DOCUMENT_KEYS), "batch")
        if not batch.isEmpty():
            put = lambda stored, new: upsert(stored, new, DOCUMENT_KEYS, ["recorded_date", "amount"])
            merge_partitions(f"{folder}/documents", batch, DOCUMENT_KEYS, DOCUMENT_PARTS, put, f"{staging}/documents")
            sold = sales_from_documents(batch)
            if not sold.isEmpty():
                merge_partitions(f"{folder}/sales", sold, [], SALE_PARTS, lambda stored, new: insert_ignore(stored, new, SALE_KEYS), f"{staging}/sales")
            boroughs = [r[0] for r in batch.select(F.coalesce(F.expr(DOCUMENT_PARTS["part_borough"]), F.lit("none"))).distinct().collect()]  # six at most
            parts = StructType([*batch.schema.fields, *(StructField(n, StringType()) for n in DOCUMENT_PARTS)])
            docs = stored_table(spark, folder, "documents", parts).filter(F.col("part_borough").isin(boroughs))
            covered = coverage(docs, as_of).withColumn("part_borough", F.coalesce(F.substring("borough", 1, 1), F.lit("none")))
            covered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_borough").parquet(f"{folder}/coverage")
        mark(spark, done)
        delete(spark, staging)

    return run


def ingest(stream: DataFrame, folder: str, as_of: str, days: int = REREAD_DAYS) -> StreamingQuery:
    """Take in all that has arrived, then stop; the next call goes on from there."""
    run = batch_upsert(stream.sparkSession, folder, as_of)
    return stream_documents(stream, days).writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def coverage_gap(covered: DataFrame, bulk: str, as_of: str) -> DataFrame:
    """borough, gap_from, gap_days: what the bulk source lacks until as_of, for the live source to fill."""
    ends = covered.filter(F.col("source") == bulk).groupBy("borough").agg(F.max("date_to").alias("end"))
    return ends.select("borough", F.date_add("end", 1).alias("gap_from"), F.greatest(F.datediff(F.lit(as_of).cast("date"), "end"), F.lit(0)).alias("gap_days"))
