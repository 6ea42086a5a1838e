"""Plan extraction: classes of tables, unit records, resolved unit counts, gates against the parcel, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import js_round

# Words in the headers of tables by class, words of affordability, and rooms.
LIGHT = ["NATURAL LIGHT", "VENTILATION", "ROOM ID", "REQ'D", "PROVIDED", "WINDOW", "AIR SHAFT", "LIGHT & VENT", "LIGHT AND VENT", "REQUIRED AREA", "PROVIDED AREA", "OPENING"]
UNIT = [
    "UNIT", "APT", "BEDROOM", "TYPE", "STUDIO", "1BR", "2BR", "NO. OF UNITS", "UNIT NO", "UNIT TYPE", "NO OF UNITS", "APARTMENT", "APT. NO", "DWELLING UNIT", "DU TYPE", "UNIT SIZE", "UNIT NO.",
    "INCOME BAND", "AMI", "AFFORDABLE", "MARKET RATE", "MIH", "RENT STABILIZED", "NET SF", "GROSS SF",
]
ZONING = ["FAR", "LOT AREA", "ZONING", "USE GROUP", "FLOOR AREA RATIO", "ZFA", "ZONING FLOOR AREA", "PERMITTED", "PROPOSED FAR"]
OCCUPANCY = ["OCCUPANT LOAD", "OCCUPANCY", "CAPACITY", "PERSONS", "OCCUPANCY GROUP", "EGRESS"]
AFFORDABILITY = ["AFFORDABLE", "AMI", "MIH", "MARKET RATE", "INCOME BAND", "RENT STABILIZED"]
ROOMS = ["BEDROOM", "LIVING ROOM", "KITCHEN", "BATHROOM", "DINING", "CLOSET", "FOYER", "HALL", "ALCOVE", "LIVING/DINING", "BATH", "W.I.C", "WIC", "LIVING", "DINING ROOM"]
SAMPLE_ROWS = 5
# Weights of the sources of a unit count, in the order in which ties are settled.
WEIGHTS = {"cover_sheet": 0.9, "zoning": 0.85, "table": 0.8}
# Fixed values of the gates: usable share of floor area, area of a unit at most and at least, shares of the implied numbers.
USABLE, LARGE_UNIT, SMALL_UNIT, MOST, LEAST, FAR_TOLERANCE = 0.80, 800, 680 * 1.5, 1.5, 0.25, 0.2


def classify_tables(tables: DataFrame) -> DataFrame:
    """tables (headers array<string>, rows array<array<string>>, ...) with table_type and type_confidence."""
    text = F.upper(F.array_join("headers", " "))
    hits = lambda words: reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in words))
    scored = tables.withColumn("_s", F.struct(hits(LIGHT).alias("light"), (hits(UNIT) + hits(AFFORDABILITY)).alias("unit"), hits(ZONING).alias("zoning"), hits(OCCUPANCY).alias("occupancy")))
    rooms = F.filter(F.slice("rows", 1, SAMPLE_ROWS), lambda row: F.exists(row, lambda cell: F.upper(F.trim(cell)).isin(ROOMS)))
    light, best = F.col("_s.light"), F.greatest("_s.unit", "_s.zoning", "_s.occupancy")
    sure = lambda n: F.least(F.lit(0.9), 0.5 + n * 0.15)
    kind = F.when(F.col("_s.unit") == best, "unit_schedule").when(F.col("_s.zoning") == best, "zoning_table").otherwise("occupancy_load")
    is_room, is_light = F.size(rooms) >= 2, light >= 2
    return scored.select(
        *tables.columns,
        F.when(is_room | is_light, "light_ventilation_schedule").when(best >= 1, kind).otherwise("unknown").alias("table_type"),
        F.when(is_room, 0.95).when(is_light, sure(light)).when(best >= 2, sure(best)).when(best == 1, 0.4).otherwise(0.2).alias("type_confidence"),
    )


def dedupe_units(units: DataFrame) -> DataFrame:
    """One record for each (doc_id, unit_id), the one with most fields, of several the first by seq, then by its fields; records without an id
    all stay. units: doc_id, unit_id, seq, bedroom_type, bedroom_count, allocation, ami_band, ..."""
    named = F.coalesce(F.col("unit_id") != "", F.lit(False))
    known = lambda c: F.coalesce(F.col(c) != "UNKNOWN", F.lit(True)).cast("int")
    fields = known("bedroom_type") + known("allocation") + F.col("bedroom_count").isNotNull().cast("int") + F.col("ami_band").isNotNull().cast("int")
    best = units.filter(named).groupBy("doc_id", "unit_id").agg(F.min_by(F.struct(*units.columns), F.struct(-fields, "seq", "bedroom_type", "bedroom_count", "allocation", "ami_band")).alias("u")).select("u.*")
    return best.unionByName(units.filter(~named))


def resolve_units(candidates: DataFrame, redundancy: DataFrame | None = None) -> DataFrame:
    """doc_id, units, confidence, source, n_sources, conflict: the unit count of a document from up to three sources.

    candidates: doc_id, source, value, confidence. Values within 2 of each other support one another; where the largest is
    over twice the least and that is under 30, the largest loses. redundancy: doc_id, redundancy.
    """
    names = list(WEIGHTS)
    value, weight = lambda i: F.col(f"v{i}"), lambda i: F.col(f"c{i}")
    columns = []
    for i, name in enumerate(names):
        one = F.when((F.col("source") == name) & (F.col("value") > 0), F.struct("value", "confidence"))
        columns += [F.max(one)["value"].cast("double").alias(f"v{i}"), (F.max(one)["confidence"] * WEIGHTS[name]).alias(f"c{i}")]
    rows = candidates.groupBy("doc_id").agg(*columns)
    n = sum((value(i).isNotNull().cast("int") for i in range(1, 3)), value(0).isNotNull().cast("int"))
    rows = rows.withColumns({"n_sources": n, "most": F.greatest("v0", "v1", "v2"), "least": F.least("v0", "v1", "v2")}).filter("n_sources > 0")
    for i, j in ((0, 1), (0, 2), (1, 2)):
        near = F.coalesce(F.abs(value(i) - value(j)) <= 2, F.lit(False))
        rows = rows.withColumns({f"c{k}": F.when(near, F.least(F.lit(1.0), weight(k) + 0.1)).otherwise(weight(k)) for k in (i, j)})
    rows = rows.withColumn("conflict", (F.col("n_sources") > 1) & (F.col("most") > 2 * F.col("least")) & (F.col("least") < 30))
    first = F.when(value(0) == F.col("most"), 0).when(value(1) == F.col("most"), 1).otherwise(2)
    rows = rows.withColumn("_first", first)
    rows = rows.withColumns({f"c{i}": F.when(F.col("conflict") & (F.col("_first") == i), F.greatest(F.lit(0.0), weight(i) - 0.4)).otherwise(weight(i)) for i in range(3)})
    entry = lambda i: F.when(value(i).isNotNull(), F.struct(weight(i).alias("confidence"), F.lit(-i).alias("turn"), value(i).alias("value"), F.lit(names[i]).alias("source")))
    rows = rows.withColumn("b", F.greatest(*(entry(i) for i in range(3))))
    if redundancy is not None:
        rows = rows.join(redundancy.select("doc_id", "redundancy"), "doc_id", "left")
    often = F.coalesce(F.col("redundancy") >= 0.95, F.lit(False)) if redundancy is not None else F.lit(False)
    sure = F.col("b.confidence")
    sure = F.when(F.col("n_sources") == 1, F.least(sure, F.lit(0.6))).when((F.col("n_sources") >= 3) & often, F.least(F.lit(1.0), sure + 0.05)).otherwise(sure)
    return rows.select("doc_id", F.col("b.value").alias("units"), sure.alias("confidence"), F.col("b.source").alias("source"), "n_sources", "conflict")


def validation_gates(plans: DataFrame) -> DataFrame:
    """doc_id, field, extracted, low, high, status, needs_manual: a row for each gate that applies.

    plans: doc_id, units, far, lot_area (extracted), parcel_lot, parcel_far, legal_far (null: one and a half times the
    parcel's), mentions (array of declared unit counts).
    """
    units, far, lot, p_lot, p_far = (F.col(c).cast("double") for c in ("units", "far", "lot_area", "parcel_lot", "parcel_far"))
    usable = p_lot * p_far * USABLE
    implied_most, implied_least = F.ceil(usable / LARGE_UNIT), F.greatest(F.lit(1), F.floor(usable / SMALL_UNIT))
    high, low = F.ceil(implied_most * MOST).cast("double"), F.greatest(F.lit(1), F.floor(implied_least * LEAST)).cast("double")
    state = lambda *cases: reduce(lambda acc, c: acc.when(c[0], c[1]), cases[1:], F.when(*cases[0])).otherwise("PASS")
    gate = lambda applies, field, value, low, high, status: F.when(applies, F.struct(F.lit(field).alias("field"), value.alias("extracted"), low.alias("low"), high.alias("high"), status.alias("status")))
    by_units = state((units > high, "NEEDS_OVERRIDE"), (units < low, "NEEDS_OVERRIDE"), ((units > implied_most * 1.2) | (units < implied_least * 0.5), "WARN"))
    legal = F.coalesce(F.col("legal_far").cast("double"), p_far * 1.5)
    off = F.abs(far - p_far) / p_far > FAR_TOLERANCE
    by_far = state((off & (far <= legal), "WARN"), (off, "NEEDS_OVERRIDE"))
    lot_off = F.abs(lot - p_lot) / p_lot
    by_lot = state((lot_off > 0.15, "NEEDS_OVERRIDE"), (lot_off > 0.08, "WARN"))
    mentions, resolved = F.transform(F.coalesce("mentions", F.array().cast("array<double>")), lambda m: m.cast("double")), F.coalesce(units, F.lit(0.0))
    against = F.filter(mentions, lambda m: F.abs(m - resolved) > 2)
    agree = F.size(mentions) - F.size(against)
    variance = F.when(resolved > 0, F.abs(F.array_max(against) - resolved) / resolved).otherwise(1.0)
    by_mentions = F.when((variance > 0.3) & (agree < 2), "CONFLICTING").otherwise("WARN")
    differ = (F.size(F.array_distinct(mentions)) > 1) & (F.size(against) > 0)
    gates = F.array(
        gate((p_lot > 0) & (p_far > 0) & units.isNotNull(), "totalUnits", units, low, high, by_units),
        gate(far.isNotNull() & (p_far > 0), "far", far, p_far * (1 - FAR_TOLERANCE), legal, by_far),
        gate(differ, "unitCountRedundancy", resolved, F.array_min(mentions), F.array_max(mentions), by_mentions),
        gate(lot.isNotNull() & (p_lot > 0), "lotArea", lot, p_lot * 0.85, p_lot * 1.15, by_lot),
    )
    return plans.select("doc_id", F.explode(F.array_compact(gates)).alias("g")).select("doc_id", "g.*", F.col("g.status").isin("NEEDS_OVERRIDE", "CONFLICTING").alias("needs_manual"))


def page_confidence(pages: DataFrame) -> DataFrame:
    """pages (mapped_columns, total_found, total_consistent, unit_rows, ocr_used, ocr_confidence, totals_conflict) with score."""
    points: list[Column] = [
        F.when(F.col("mapped_columns") >= 3, 0.30).when(F.col("mapped_columns") >= 2, 0.15).otherwise(0.0),
        F.when(F.col("total_found") & F.col("total_consistent"), 0.25).when(F.col("total_found"), 0.10).otherwise(0.0),
        F.when(F.col("unit_rows") >= 10, 0.20).when(F.col("unit_rows") >= 5, 0.10).when(F.col("unit_rows") >= 1, 0.05).otherwise(0.0),
        F.when(F.col("ocr_used"), 0.15 * (F.col("ocr_confidence") / 100)).otherwise(0.0),
        F.when(F.col("totals_conflict"), -0.30).otherwise(0.0),
    ]
    return pages.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(0.99), reduce(lambda a, b: a + b, points))))


def plan_confidence(pages: DataFrame) -> DataFrame:
    """doc_id, confidence: the pages' scores by weight. pages: doc_id, score, weight."""
    sums = pages.groupBy("doc_id").agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    return sums.select("doc_id", F.when(F.col("w") > 0, F.least(F.lit(0.99), js_round(F.col("s") / F.col("w"), 2))).otherwise(0.0).alias("confidence"))


def plan_warnings(units: DataFrame) -> DataFrame:
    """doc_id, n, unknown_bedrooms and unknown_allocations (null where their share is no cause for a warning)."""
    sums = units.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("bedroom_type") == "UNKNOWN").alias("b"), F.count_if(F.col("allocation") == "UNKNOWN").alias("a"))
    return sums.select("doc_id", "n", F.when(F.col("b") > 0.3 * F.col("n"), F.col("b")).alias("unknown_bedrooms"), F.when(F.col("a") > 0.5 * F.col("n"), F.col("a")).alias("unknown_allocations"))
