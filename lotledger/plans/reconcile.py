"""Fields of plans from two extractors, and of several sections of one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import js_round

# Fields in which the extractors may differ by a share of the first's value, and that share.
TOLERANCE = {
    "zoningFloorArea": 0.05, "maxFar": 0.05, "buildingArea": 0.05, "floors": 0.01, "studio": 0.01, "br1": 0.01, "br2": 0.01, "br3": 0.01, "br4plus": 0.01, "affordableUnits": 0.01, "marketUnits": 0.01,
}
MIX = {"STUDIO": "studio", "1BR": "br1", "2BR": "br2", "3BR": "br3", "4BR_PLUS": "br4plus"}
UNITS_APART, SHARE_APART, MOST_SURE = 2, 0.05, 0.6


def _rule(value: Column, rules: dict[str, Column], other: Column) -> Column:
    """The rule of a field by its name."""
    for name, rule in rules.items():
        other = F.when(value == name, rule).otherwise(other)
    return other


def reconcile_fields(first: DataFrame, second: DataFrame, parcels: DataFrame) -> DataFrame:
    """doc_id, field, first_value, second_value, agreement, final_value, confidence: a row for each field of second.

    first: doc_id, field, value string, confidence (of rules); second: doc_id, field, value string (of another extractor);
    parcels: doc_id, field (far, lotArea), value double. Each has one row for a document and field. The first's value holds,
    but for a far or lotArea on which they disagree and the parcel is nearer to the second. Without a first value the
    second's holds, save totalUnits and far, which give no row; as do empty values, and zeros where only the second has one.
    """
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    a = first.select("doc_id", "field", text(F.col("value")).alias("first_value"), "confidence")
    b = second.select("doc_id", "field", text(F.col("value")).alias("second_value")).filter("second_value IS NOT NULL")
    rows = b.join(a, ["doc_id", "field"], "left").join(parcels.select("doc_id", "field", F.col("value").alias("parcel")), ["doc_id", "field"], "left")
    rows = rows.withColumns({"x": F.col("first_value").try_cast("double"), "y": F.col("second_value").try_cast("double")})
    field, x, y, parcel = F.col("field"), F.col("x"), F.col("y"), F.col("parcel")
    mix = field.isin(list(MIX.values()))
    rows = rows.withColumns({"x": F.when(~mix | (x > 0), x), "first_value": F.when(~mix | (x > 0), F.col("first_value"))})
    apart = F.abs(x - y)
    tolerance = _rule(field, {k: F.lit(v) for k, v in TOLERANCE.items()}, F.lit(SHARE_APART))
    special = {
        "totalUnits": apart <= UNITS_APART, "far": apart / F.greatest(x, F.lit(0.1)) <= SHARE_APART, "lotArea": apart / F.greatest(x, F.lit(1.0)) <= SHARE_APART,
        "zone": F.upper("first_value") == F.upper("second_value"),
    }
    rows = rows.withColumn("agreement", F.when(F.col("first_value").isNotNull(), _rule(field, special, apart / F.greatest(F.abs(x), F.lit(0.1)) <= tolerance)))
    agree, sure = F.col("agreement"), F.coalesce("confidence", F.lit(0.5))
    alone = F.col("first_value").isNull()
    by_parcel = field.isin("far", "lotArea") & ~agree & F.coalesce(parcel > 0, F.lit(False)) & (F.abs(x - parcel) > F.abs(y - parcel))
    level = {
        "totalUnits": F.when(agree, F.least(F.lit(1.0), sure + 0.1)).otherwise(F.greatest(F.lit(0.3), sure - 0.1)), "far": F.when(agree, F.least(F.lit(1.0), sure + 0.05)).otherwise(sure),
        "lotArea": F.when(agree, 0.9).otherwise(0.7), "zone": F.when(agree, 0.9).otherwise(0.6),
    }
    none = (alone & field.isin("totalUnits", "far")) | ((field == "lotArea") & ~F.coalesce(y > 0, F.lit(False))) | (alone & (field != "zone") & (F.coalesce(y, F.lit(0.0)) == 0)) | ((field != "zone") & y.isNull())
    return rows.filter(~none).select(
        "doc_id", "field", "first_value", "second_value", "agreement", F.when(alone | by_parcel, F.col("second_value")).otherwise(F.col("first_value")).alias("final_value"),
        F.when(alone, 0.7).otherwise(_rule(field, level, F.when(agree, 0.9).otherwise(0.65))).alias("confidence"),
    )


def merge_sections(sections: DataFrame) -> DataFrame:
    """doc_id, lot_area, zoning_floor_area, far, total_units, studio to br4plus, average_sf map<string,double>, confidence.

    sections: doc_id, section (COVER_SHEET, ZONING_SCHEDULE, FLOOR_PLAN_LABEL or GENERIC), seq, lot_area, zoning_floor_area, far,
    total_units, unit_mix map<string,long>, unit_sizes map<string,array<double>>, confidence. The first number that isn't
    0 holds; mixes of zoning schedules add up, and a generic one counts where it comes first; a type that is only stated as 0 has 0; sizes are pooled. Sections alike in
    seq are in the order of their names.
    """
    turn = F.struct("seq", "section")
    told = {"lot_area": ["COVER_SHEET", "ZONING_SCHEDULE"], "zoning_floor_area": ["ZONING_SCHEDULE"], "far": ["COVER_SHEET", "ZONING_SCHEDULE"], "total_units": ["COVER_SHEET", "ZONING_SCHEDULE", "GENERIC"]}
    first = [F.min(F.when(F.col("section").isin(by) & (F.col(c) != 0), F.struct(turn.alias("turn"), F.col(c).alias("v"))))["v"].alias(c) for c, by in told.items()]
    heads = sections.groupBy("doc_id").agg(*first, F.least(F.lit(MOST_SURE), F.greatest(F.lit(0.0), F.max("confidence"))).alias("confidence"))
    mixed = sections.filter(F.col("section").isin("ZONING_SCHEDULE", "GENERIC")).select("doc_id", turn.alias("turn"), F.explode("unit_mix").alias("type", "n")).filter("n IS NOT NULL")
    lead = F.min(F.when(F.col("n") != 0, F.struct("turn", "n")))
    zoned = F.coalesce(F.sum(F.when(F.col("turn.section") == "ZONING_SCHEDULE", F.col("n"))), F.lit(0))
    counts = mixed.groupBy("doc_id", "type").agg((zoned + F.when(lead["turn"]["section"] == "GENERIC", lead["n"]).otherwise(0)).alias("n"))
    mix = counts.groupBy("doc_id").agg(F.sum("n").alias("_all"), *(F.max(F.when(F.col("type") == k, F.col("n"))).alias(v) for k, v in MIX.items()))
    sizes = sections.filter("section = 'FLOOR_PLAN_LABEL'").select("doc_id", F.explode("unit_sizes").alias("type", "sizes")).select("doc_id", "type", F.explode("sizes").alias("sf"))
    averages = sizes.groupBy("doc_id", "type").agg(js_round(F.avg("sf")).alias("sf")).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "sf")))).alias("average_sf"))
    rows = heads.join(mix, "doc_id", "left").join(averages, "doc_id", "left")
    total = F.coalesce("total_units", F.when(F.col("_all") > 0, F.col("_all")))
    return rows.select("doc_id", "lot_area", "zoning_floor_area", "far", total.alias("total_units"), *MIX.values(), "average_sf", "confidence")
