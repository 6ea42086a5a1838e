"""Screening of parcels for development potential, with their latest sale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.coerce import js_float, js_int, js_round, round34
from ..functions.keys import sanitize_bbl
from ..functions.zoning import DEFAULT_DU_FACTOR, uap_zone, zone_allows_res, zone_params
from ..sources.shared import written
from .sales import latest_sales

# Condominium classes, columns that results can be sorted by.
CONDO_CLASSES = ["R1", "R2", "R3", "R4", "R5", "R6", "R9", "RR"]
SORT_COLUMNS = ["score", "slack_sf", "underbuilt_ratio", "lot_area", "resid_far", "last_sale_date", "last_sale_price", "data_completeness", "ppbsf"]
NET_TO_GROSS, MIN_LOT_AREA, MIN_485X_UNITS = 0.80, 2000, 6
YEAR = 365.25


def eligible_parcels(parcels: DataFrame, borough: str | None = None) -> DataFrame:
    """Parcels with a key, a residential ratio and a lot over the least area; of one borough if it is given."""
    kept = parcels.filter(F.col("bbl").isNotNull() & (js_float(F.col("residfar")) > 0) & (js_float(F.col("lotarea")) > MIN_LOT_AREA))
    return kept if borough is None else kept.filter(F.col("borocode") == borough)


def parcel_metrics(parcels: DataFrame) -> DataFrame:
    """Typed parcels with buildable area, slack and underbuilt percentage."""
    typed = parcels.select(
        sanitize_bbl(F.col("bbl")).alias("bbl"),
        F.coalesce("address", F.lit("")).alias("address"),
        F.col("borocode").alias("borough"),
        F.coalesce("zonedist1", F.lit("")).alias("zone_dist"),
        *(js_float(F.col(c)).alias(n) for c, n in (("lotarea", "lot_area"), ("bldgarea", "bldg_area"), ("residfar", "resid_far"), ("builtfar", "built_far"))),
        F.coalesce("landuse", F.lit("")).alias("land_use"),
        F.coalesce("bldgclass", F.lit("")).alias("bldg_class"),
        js_int(F.col("yearbuilt")).alias("year_built"),
        js_int(F.col("unitsres")).alias("units_res"),
        F.coalesce("ownername", F.lit("")).alias("owner_name"),
    )
    buildable = F.col("resid_far") * F.col("lot_area")
    ratio = F.when(F.col("resid_far") > 0, F.col("built_far") / F.col("resid_far")).otherwise(1.0)
    return typed.withColumns(
        {
            "max_buildable_sf": js_round(buildable),
            "slack_sf": js_round(F.greatest(buildable - F.col("bldg_area"), F.lit(0.0))),
            "underbuilt_ratio": js_round(F.greatest(1 - ratio, F.lit(0.0)) * 1000) / 10,
        }
    )


def attach_latest_sale(parcels: DataFrame, sales: DataFrame) -> DataFrame:
    """parcels with last_sale_date, last_sale_price, last_sale_source and ppbsf (price for each square foot of slack)."""
    last = latest_sales(sales).select(
        F.col("bbl").alias("_bbl"), F.col("sale_date").alias("last_sale_date"), F.nullif("sale_price", F.lit(0.0)).alias("last_sale_price"), F.col("source").alias("last_sale_source")
    )
    joined = parcels.join(last, F.col("bbl") == F.col("_bbl"), "left").drop("_bbl")
    return joined.withColumn("ppbsf", F.when((F.col("last_sale_price") > 0) & (F.col("slack_sf") > 0), js_round(F.col("last_sale_price") / F.col("slack_sf"), 2)))


def potential_units(parcels: DataFrame) -> DataFrame:
    """With the district's parameters and the units that the slack makes room for."""
    df = zone_params(parcels)
    units = round34(F.col("slack_sf") * NET_TO_GROSS / F.coalesce("du_factor", F.lit(DEFAULT_DU_FACTOR)))
    return df.withColumn("potential_units", F.when(F.col("slack_sf") <= 0, 0).otherwise(units))


def program_flags(parcels: DataFrame) -> DataFrame:
    """With program_flags, an array of (program, eligible, note)."""
    allows, bonus = zone_allows_res(F.col("zone_dist")), F.coalesce(F.col("bonus_far") > F.col("standard_far"), F.lit(False))
    units = F.col("potential_units")
    tax = allows & (F.col("slack_sf") > 0) & (units >= MIN_485X_UNITS)
    size = F.when(units >= 150, "Option A (Very Large)").when(units >= 100, "Option A (Large)").otherwise("Option B")
    flag = lambda program, eligible, note: F.struct(F.lit(program).alias("program"), eligible.alias("eligible"), note.cast("string").alias("note"))
    none = F.lit(None)
    flags = F.array(
        flag("MIH", allows & bonus, F.when(allows & bonus, "Verify MIH overlay")),
        flag("UAP", allows & bonus & uap_zone(F.col("zone_dist")) & (F.col("lot_area") >= 5000), none),
        flag("485-x", tax, F.when(tax, size)),
        flag("421-a", F.lit(False), F.lit("Expired - grandfathered only")),
        flag("467-m", allows & (F.col("resid_far") >= 6.0), none),
    )
    return parcels.withColumn("program_flags", flags)


def _eligible(*programs: str) -> Column:
    """How many of the programs a parcel is eligible for."""
    return F.size(F.filter("program_flags", lambda f: f["eligible"] & f["program"].isin(*programs)))


def steps(value: Column, *at: tuple[float, int]) -> Column:
    """The points of the first step that a value reaches, 0 below all."""
    out = F.lit(0)
    for least, points in reversed(at):
        out = F.when(value >= least, points).otherwise(out)
    return out


def screening_score(parcels: DataFrame, as_of: str) -> DataFrame:
    """With score: building potential (30), sale (25) and property (45), at most 100, and up to 30 for renting."""
    area, lot, most = F.col("bldg_area"), F.col("lot_area"), F.col("max_buildable_sf")
    ratio = F.when(area > 0, most / area).when(most > 0, 999.0).otherwise(0.0)
    underbuilt = steps(ratio, (3, 30), (2, 25), (1.5, 20), (1.2, 15), (1, 10))
    years = F.datediff(F.lit(as_of).cast("date"), F.col("last_sale_date")) / YEAR
    ppsf = F.when(area > 0, F.col("last_sale_price") / area).otherwise(0.0)
    sale = 5 + F.when(years <= 2, 10).when(years <= 5, 5).otherwise(0) + F.when((ppsf > 0) & (ppsf < 100), 10).when((ppsf > 0) & (ppsf < 250), 5).otherwise(0)
    sale = F.when(F.col("last_sale_date").isNotNull() & (F.col("last_sale_price") > 0), F.least(sale, F.lit(25))).otherwise(0)
    built = F.when(lot > 0, area / lot).otherwise(0.0)
    possible = F.when(lot > 0, most / lot).otherwise(0.0)
    prop = (
        F.when(F.col("land_use") == "11", 20).when(F.col("land_use") == "10", 15).otherwise(0)
        + F.when((built < 1) & (possible > 2), 5).otherwise(0)
        + 5 * _eligible("MIH", "UAP", "485-x", "467-m")
        + F.when(F.col("resid_far") >= 3.0, 5).otherwise(0)
    )
    renting = F.when(F.upper("zone_dist").rlike("^(R|C|M1)"), 10).otherwise(0) + 10 * _eligible("485-x") + 5 * _eligible("UAP")
    total = F.least(underbuilt + sale + F.least(prop, F.lit(45)), F.lit(100)) + F.least(renting, F.lit(30))
    return parcels.withColumn("score", total.cast("int"))


def data_completeness(parcels: DataFrame) -> DataFrame:
    """With data_completeness, 0 to 100."""
    there = lambda cond, points: F.when(cond, points).otherwise(0)
    text = lambda c: F.length(c) > 0
    total = (
        there(text("address"), 10) + there(text("owner_name"), 20) + there(text("bldg_class"), 10) + there(F.col("year_built") > 0, 10)
        + there(F.col("last_sale_date").isNotNull(), 15) + there(F.col("last_sale_price") > 0, 15) + there(F.col("units_res") > 0, 10) + there(text("land_use"), 10)
    )
    return parcels.withColumn("data_completeness", total)


def score_parcels(parcels: DataFrame, sales: DataFrame, as_of: str, borough: str | None = None) -> DataFrame:
    """The whole screening: eligible parcels with metrics, latest sale, units, programmes, score and completeness."""
    scored = attach_latest_sale(parcel_metrics(eligible_parcels(parcels, borough)), sales)
    return data_completeness(screening_score(program_flags(potential_units(scored)), as_of))


def search_parcels(
    scored: DataFrame,
    ranges: dict[str, tuple[float | None, float | None]] | None = None,
    exclude_condos: bool = False,
    zones: list[str] | None = None,
    classes: list[str] | None = None,
    sold_within_years: float | None = None,
    as_of: str | None = None,
    programs: list[str] | None = None,
) -> DataFrame:
    """Parcels that pass all filters that are given. ranges: least and greatest value by column. zones are
    compared whole, without regard to case; classes are beginnings of the building class, any of which will do."""
    out = scored
    for c, (low, high) in (ranges or {}).items():
        if low is not None:
            out = out.filter(F.col(c) >= low)
        if high is not None:
            out = out.filter(F.col(c) <= high)
    if exclude_condos:
        out = out.filter(~F.col("bldg_class").isin(CONDO_CLASSES))
    if zones:
        out = out.filter(F.lower("zone_dist").isin([z.lower() for z in zones]))
    if classes:
        starts = F.lit(False)
        for c in classes:
            starts |= F.col("bldg_class").startswith(c)
        out = out.filter(starts)
    if sold_within_years is not None:
        out = out.filter(F.datediff(F.lit(as_of).cast("date"), F.col("last_sale_date")) <= sold_within_years * YEAR)
    if programs:
        out = out.filter(F.exists("program_flags", lambda f: f["eligible"] & f["program"].isin(programs)))
    return out


def page_of(df: DataFrame, sort: str = "score", descending: bool = True, page: int = 0, size: int = 50) -> DataFrame:
    """A page of parcels by a permitted column, then score, then key. Nulls stand first when descending."""
    if sort not in SORT_COLUMNS:
        raise ValueError(f"can't sort by {sort}")
    first = F.col(sort).desc_nulls_first() if descending else F.col(sort).asc_nulls_last()
    return df.orderBy(first, F.col("score").desc_nulls_first(), "bbl").offset(page * size).limit(size)


def page_with_total(df: DataFrame, sort: str = "score", descending: bool = True, page: int = 0, size: int = 50) -> DataFrame:
    """The same with total, the number of all rows, which are counted as they pass on their way to the page: one scan."""
    seen = Observation("rows")
    rows = written(page_of(df.observe(seen, F.count(F.lit(1)).alias("total")), sort, descending, page, size), "page")
    return rows.withColumn("total", F.lit(seen.get["total"]))


def latest_sale_date(sales: DataFrame, borough: str) -> DataFrame:
    return sales.filter(F.col("bbl").startswith(borough)).agg(F.max("sale_date").alias("latest_sale_date"))
