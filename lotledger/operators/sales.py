"""Sales: unions of sources, the latest of each parcel, and refreshing what is stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import DEED_TYPES, MANUAL_DEED_TYPES


def union_sales(*sources: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def sales_from_documents(docs: DataFrame, types: list[str] = DEED_TYPES, source: str = "acris_realtime", date: Column | None = None) -> DataFrame:
    """Sale rows of the deeds among documents that have an amount and a key."""
    day = F.col("recorded_date") if date is None else date
    return docs.filter(F.col("doc_type").isin(types) & (F.col("amount") > 0) & (F.col("bbl") != "")).select(
        "bbl", day.alias("sale_date"), F.col("amount").alias("sale_price"), "doc_type", F.lit(source).alias("source"), "document_id"
    )


def sales_from_entry(docs: DataFrame) -> DataFrame:
    """Sale rows of documents typed in by hand: other deed types, dated by the document, else its recording."""
    return sales_from_documents(docs, MANUAL_DEED_TYPES, "manual_entry", F.coalesce("doc_date", "recorded_date"))


def latest_sales(sales: DataFrame, keys: DataFrame | None = None, borough: str | None = None) -> DataFrame:
    """The latest sale of each parcel: by date, then price, then source and document (each the greater one).

    The greatest struct is found by partial aggregation, so sales are neither sorted nor gathered by parcel
    before the shuffle. keys: only parcels in its column bbl; borough: only keys that begin with it.
    """
    if "document_id" not in sales.columns:
        sales = sales.withColumn("document_id", F.lit(None).cast("string"))
    if keys is not None:
        sales = sales.join(keys.select("bbl").distinct(), "bbl", "left_semi")
    if borough is not None:
        sales = sales.filter(F.col("bbl").startswith(borough))
    order = F.struct("sale_date", "sale_price", "source", "document_id")
    return sales.groupBy("bbl").agg(F.max(order).alias("s")).select("bbl", "s.*")


def latest_deed_sales(docs: DataFrame, borough: str | None = None) -> DataFrame:
    """The latest deed with an amount of each parcel."""
    return latest_sales(sales_from_documents(docs), borough=borough)


def backfill_last_sale(parcels: DataFrame, latest: DataFrame) -> DataFrame:
    """Scored parcels with the sale columns of latest where it has the parcel; nothing else is changed."""
    new = latest.select(F.col("bbl").alias("_bbl"), *(F.col(c).alias(f"_{c}") for c in ("sale_date", "sale_price", "source")))
    joined = parcels.join(new, F.col("bbl") == F.col("_bbl"), "left")
    there = F.col("_bbl").isNotNull()
    names = {"last_sale_date": "_sale_date", "last_sale_price": "_sale_price", "last_sale_source": "_source"}
    return joined.select(*(F.when(there, F.col(names[c])).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in parcels.columns))


def apply_newer_sales(parcels: DataFrame, sales: DataFrame) -> DataFrame:
    """Scored parcels with the latest sale of a batch where it is newer than the stored one, and ppbsf after it."""
    new = latest_sales(sales).select(F.col("bbl").alias("_bbl"), *(F.col(c).alias(f"_{c}") for c in ("sale_date", "sale_price", "source")))
    joined = parcels.join(new, F.col("bbl") == F.col("_bbl"), "left")
    newer = F.coalesce(F.col("_sale_date") > F.col("last_sale_date"), F.col("_sale_date").isNotNull())
    per_foot = F.floor(F.col("_sale_price") / F.col("slack_sf") * 100.0 + 0.5) / 100.0
    values = {
        "last_sale_date": F.col("_sale_date"),
        "last_sale_price": F.col("_sale_price"),
        "last_sale_source": F.col("_source"),
        "ppbsf": F.when((F.col("_sale_price") > 0) & (F.col("slack_sf") > 0), per_foot),
    }
    return joined.select(*(F.when(newer, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in parcels.columns))


def resolve_sale(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """bbl, sale_date, sale_price, source and the other source's sale (corroborating_*). The later date wins;
    at one date a sale with an amount wins over one without; else the primary source."""
    p = latest_sales(primary).select("bbl", F.struct("sale_date", "sale_price", "source").alias("p"))
    s = latest_sales(secondary).select("bbl", F.struct("sale_date", "sale_price", "source").alias("s"))
    both = p.join(s, "bbl", "full_outer")
    later = F.col("s.sale_date") > F.col("p.sale_date")
    priced = (F.col("s.sale_date") == F.col("p.sale_date")) & (F.coalesce("p.sale_price", F.lit(0.0)) == 0) & (F.col("s.sale_price") > 0)
    second = F.col("p").isNull() | F.coalesce(later, F.lit(False)) | F.coalesce(priced, F.lit(False))
    win, other = F.when(second, F.col("s")).otherwise(F.col("p")), F.when(second, F.col("p")).otherwise(F.col("s"))
    return both.select("bbl", win.alias("w"), other.alias("o")).select("bbl", "w.*", F.col("o.sale_date").alias("corroborating_date"), F.col("o.sale_price").alias("corroborating_price"), F.col("o.source").alias("corroborating_source"))
