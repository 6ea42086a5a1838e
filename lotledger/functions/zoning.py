"""Zoning districts: normal form, residential equivalents, parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .keys import literal_map

# Residential equivalents of commercial districts.
EQUIVALENTS = {
    "C1-6": "R7", "C1-6A": "R7A", "C1-7": "R8", "C1-7A": "R8A", "C1-8": "R9", "C1-8A": "R9A", "C1-8X": "R9X", "C1-9": "R10", "C1-9A": "R10A",
    "C2-6": "R7", "C2-6A": "R7A", "C2-7": "R9", "C2-7A": "R9A", "C2-7X": "R9X", "C2-8": "R10", "C2-8A": "R10A",
    "C3": "R3-2", "C3A": "R3A",
    "C4-1": "R5", "C4-2": "R6", "C4-2A": "R6A", "C4-3": "R6", "C4-3A": "R6A", "C4-4": "R7", "C4-4A": "R7A", "C4-4D": "R8A", "C4-4L": "R7A",
    "C4-5": "R7", "C4-5A": "R7A", "C4-5D": "R7D", "C4-5X": "R7X", "C4-6": "R10", "C4-6A": "R10A", "C4-7": "R10", "C4-7A": "R10A",
    "C5-1": "R10", "C5-1A": "R10A", "C5-2": "R10", "C5-2A": "R10A", "C5-3": "R10", "C5-4": "R10", "C5-5": "R10",
    "C6-1": "R7", "C6-1A": "R6", "C6-2": "R8", "C6-2A": "R8A", "C6-3": "R9", "C6-3A": "R9A", "C6-3D": "R9D", "C6-3X": "R9X",
    "C6-4": "R10", "C6-4A": "R10A", "C6-4X": "R10X", "C6-5": "R10", "C6-6": "R10", "C6-7": "R10", "C6-8": "R10", "C6-9": "R10",
}
# Floor area ratios (standard, with qualifying affordable housing) and units' size by district.
FAR = {
    "R6": (2.20, 3.90), "R6A": (3.00, 3.90), "R6-1": (3.00, 3.90), "R6B": (2.00, 2.40), "R6D": (2.50, 3.00), "R6-2": (2.50, 3.00),
    "R7A": (4.00, 5.01), "R7-1": (3.44, 5.01), "R7-2": (3.44, 5.01), "R7D": (4.66, 5.60), "R7X": (5.00, 6.00), "R7-3": (5.00, 6.00),
    "R8": (6.02, 7.20), "R8A": (6.02, 7.20), "R8X": (6.02, 7.20), "R8B": (4.00, 4.80),
    "R9": (7.52, 9.02), "R9A": (7.52, 9.02), "R9D": (9.00, 10.80), "R9X": (9.00, 10.80), "R9-1": (9.00, 10.80),
    "R10": (10.00, 12.00), "R10A": (10.00, 12.00), "R10X": (10.00, 12.00), "R11": (12.00, 15.00), "R12": (15.00, 18.00),
}
DU_FACTOR, DEFAULT_DU_FACTOR = 680, 700
UAP_PREFIXES = ["R6", "R7", "R8", "R9", "R10", "R11", "R12"]
RESIDENTIAL_PREFIXES = ["R", "C1", "C2", "C3", "C4", "C5", "C6", "MX"]


def norm_zone(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"\s+", "")


def res_equiv(c: Column) -> Column:
    """The residential district that a district counts as; null if there is none."""
    zone = norm_zone(c)
    return F.when(zone.startswith("R"), zone).when(zone.startswith("C") | zone.startswith("M"), literal_map(EQUIVALENTS)[zone])


def zone_key(c: Column) -> Column:
    """The district under which parameters are looked up."""
    zone = F.trim(F.upper(F.coalesce(c, F.lit(""))))
    behind = F.regexp_extract(zone, r"^[^/]*/([^/]*)", 1)
    return (
        F.when(zone.startswith("R"), F.regexp_extract(zone, r"^([A-Z0-9-]*)", 1))
        .when(behind.rlike(r"^R\d"), F.regexp_extract(behind, r"^([A-Z0-9-]*)", 1))
        .otherwise(F.coalesce(res_equiv(zone), zone))
    )


def zone_allows_res(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit(""))).rlike(r"^(R|C[1-6]|MX)|/R")


def uap_zone(c: Column) -> Column:
    """Whether a district is of those in which the affordability bonus applies."""
    return F.coalesce(res_equiv(c), norm_zone(c)).rlike("^R([6-9]|1[0-2])")


def zone_table(spark: SparkSession) -> DataFrame:
    rows = [(z, standard, bonus, DU_FACTOR) for z, (standard, bonus) in FAR.items()]
    return spark.createDataFrame(rows, "zone string, standard_far double, bonus_far double, du_factor int")


def zone_params(df: DataFrame, zone: str = "zone_dist") -> DataFrame:
    """df with standard_far, bonus_far, du_factor of its district, else of the district without suffix, else null.
    The table has as many rows as there are districts, so it is broadcast."""
    table = F.broadcast(zone_table(df.sparkSession))
    values = ["standard_far", "bonus_far", "du_factor"]
    exact, base = (table.select(F.col("zone").alias(f"_{p}zone"), *(F.col(v).alias(f"_{p}{v}") for v in values)) for p in "eb")
    keyed = df.withColumn("_key", zone_key(F.col(zone))).withColumn("_base", F.regexp_extract("_key", r"^(R\d+)", 1))
    joined = keyed.join(exact, F.col("_key") == F.col("_ezone"), "left").join(base, F.col("_base") == F.col("_bzone"), "left")
    return joined.select(*df.columns, *(F.coalesce(f"_e{v}", f"_b{v}").alias(v) for v in values))
