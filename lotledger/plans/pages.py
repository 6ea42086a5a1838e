"""Facts of plan documents from their pages: relevance, declared units and areas, checks against parcels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import js_round
from ..operators.upserts import top_k

# Weights of phrases on a page and the category that they speak for; patterns of declared facts,
# in the order in which they are tried.
RULES = [
    (r"(APARTMENT|DWELLING|RESIDENTIAL)\s+(UNIT|APT)\s+(SCHEDULE|MIX)", 5, "UNIT_SCHEDULE"),
    (r"(UNIT\s+MIX|UNIT\s+COUNT|UNIT\s+SCHEDULE|SCHEDULE\s+OF\s+UNITS)", 4, "UNIT_SCHEDULE"),
    (r"OCCUPANT\s+LOAD", 4, "UNIT_SCHEDULE"), (r"BC\s*1004", 3, "UNIT_SCHEDULE"), (r"AREA\s+PER\s+OCCUPANT", 3, "UNIT_SCHEDULE"),
    (r"(NO\.?\s+OF\s+UNITS|NUMBER\s+OF\s+UNITS|TOTAL\s+UNITS)", 3, "UNIT_SCHEDULE"),
    (r"(FAR|ZFA|ZONING\s+FLOOR\s+AREA|LOT\s+AREA)", 3, "ZONING_ANALYSIS"), (r"FLOOR\s+AREA\s+RATIO", 3, "ZONING_ANALYSIS"),
    (r"ZONING\s+(ANALYSIS|COMPLIANCE|SUMMARY|DIAGRAM)", 4, "ZONING_ANALYSIS"), (r"USE\s+GROUP", 2, "ZONING_ANALYSIS"), (r"(PERMITTED|PROPOSED)\s+(FAR|FLOOR\s+AREA)", 3, "ZONING_ANALYSIS"),
    (r"(COVER\s+SHEET|PROJECT\s+INFORMATION|TITLE\s+SHEET)", 5, "COVER_SHEET"), (r"(PROJECT\s+SUMMARY|PROJECT\s+DATA)", 4, "COVER_SHEET"), (r"SCOPE\s+OF\s+WORK", 3, "COVER_SHEET"),
    (r"PROPOSED\s+\d+\s*[-]?\s*(?:UNIT|DWELLING|STORY)", 3, "COVER_SHEET"),
    (r"(AFFORDABLE|MIH|INCLUSIONARY|UAP|RESTRICTED)", 3, "AFFORDABLE_HOUSING"), (r"AMI\s*(?:BAND|LEVEL|%)", 3, "AFFORDABLE_HOUSING"), (r"INCOME\s+(?:BAND|LEVEL|RESTRICT)", 3, "AFFORDABLE_HOUSING"), (r"RENT\s+STABIL", 2, "AFFORDABLE_HOUSING"),
    (r"(NET|GROSS)\s*(SF|SQ\.?\s*FT|AREA)", 2, "UNIT_SCHEDULE"), (r"FLOOR\s+PLAN", 2, "FLOOR_PLAN"), (r"TYPICAL\s+FLOOR", 2, "FLOOR_PLAN"),
]
UNITS = [
    r"PROPOSED\s+(\d{1,4})\s+(?:NEW\s+)?(?:RESIDENTIAL\s+)?(?:DWELLING\s+)?UNITS?\b", r"(\d{1,4})\s+PROPOSED\s+(?:DWELLING\s+)?UNITS?\b",
    r"(\d{1,4})\s*[-]?\s*UNIT\s+(?:APARTMENT|RESIDENTIAL|DWELLING)\s+(?:BUILDING|PROJECT)", r"TOTAL\s+(?:NUMBER\s+OF\s+)?(?:RESIDENTIAL\s+)?(?:DWELLING\s+)?UNITS[:\s]*(\d{1,4})",
    r"(\d{1,4})\s+(?:NEW\s+)?RESIDENTIAL\s+UNITS", r"NUMBER\s+OF\s+UNITS[:\s]*(\d{1,4})",
]
LOT_AREA = [r"(?:LOT|SITE|LAND)\s+(?:AREA|SIZE)[:\s]*([\d,]+)\s*(?:SF|SQ\.?\s*(?:FT)?|SQUARE\s+FEET)", r"LOT\s+AREA[:\s]*([\d,]+)"]
FAR = [r"(?:PROPOSED\s+)?(?:RESIDENTIAL\s+)?(?:FAR|FLOOR\s+AREA\s+RATIO)[:\s]*([\d.]+)", r"FAR\s*=\s*([\d.]+)"]
MIN_SCORE, MAX_PAGES, MAX_UNITS = 3, 8, 500


def score_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) with score, the sum of the weights of all phrases on them, category, the one
    with the greatest weight, and relevant."""
    upper = F.upper("text")
    hits = [(F.when(upper.rlike(p), w).otherwise(0), c) for p, w, c in RULES]
    names = list(dict.fromkeys(c for *_, c in RULES))
    sums = {c: sum((h for h, of in hits if of == c), F.lit(0)) for c in names}
    df = pages.withColumns({f"_{c}": s for c, s in sums.items()})
    score = sum((F.col(f"_{c}") for c in names[1:]), F.col(f"_{names[0]}"))
    best = F.greatest(*(F.col(f"_{c}") for c in names))
    category = F.lit("IRRELEVANT")
    for c in reversed(names):
        category = F.when((F.col(f"_{c}") == best) & (best > 0), c).otherwise(category)
    return df.withColumns({"score": score, "category": category, "relevant": score >= MIN_SCORE}).drop(*(f"_{c}" for c in names))


def select_pages(scored: DataFrame, k: int = MAX_PAGES) -> DataFrame:
    """The best pages of each document, and its best cover, zoning and schedule page if they aren't among them."""
    order = [F.desc("score"), F.col("page")]
    relevant = scored.filter("relevant")
    first = top_k(relevant.filter(F.col("category").isin("COVER_SHEET", "ZONING_ANALYSIS", "UNIT_SCHEDULE")), ["doc_id", "category"], order, 1)
    return top_k(relevant, ["doc_id"], order, k).unionByName(first).dropDuplicates(["doc_id", "page"])


def _number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def unit_mentions(pages: DataFrame) -> DataFrame:
    """doc_id, page, value: every number of units that a page declares, 1 to 500, once a page."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.upper("text"), F.lit(p), 1) for p in UNITS)))
    values = pages.select("doc_id", "page", F.explode(found).alias("v")).select("doc_id", "page", F.col("v").try_cast("int").alias("value"))
    return values.filter(F.col("value").between(1, MAX_UNITS)).distinct()


def _between(matches: Column, low: float, high: float) -> Column:
    return F.filter(matches, lambda m: m["v"].between(low, high))


def extract_signals(pages: DataFrame) -> DataFrame:
    """doc_id with units, lot_area and far: of the first pattern that a page matches, on its first page."""
    held = []
    for name, patterns, low, high in (("units", UNITS, 1, MAX_UNITS), ("lot_area", LOT_AREA, 100, 1_000_000), ("far", FAR, 0.1, 30)):
        matches = F.array(*(F.struct(F.lit(i).alias("i"), _number(F.regexp_extract(F.upper("text"), p, 1)).alias("v")) for i, p in enumerate(patterns)))
        held.append(F.array_min(_between(matches, low, high)).alias(name))
    rows = pages.select("doc_id", "page", *held)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(c)["i"].alias("i"), "page", F.col(c)["v"].alias("v"))))["v"].alias(c)
    return rows.groupBy("doc_id").agg(first("units"), first("lot_area"), first("far"))


def redundancy(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """doc_id, redundancy of every resolved document: by how many pages of sources (source, page) declare its number of
    units, give or take 2; 0 if nothing declares any."""
    told = mentions.select(F.col("doc_id").alias("_doc"), "source", "page", "value")
    joined = resolved.select("doc_id", "units").join(told, F.col("doc_id") == F.col("_doc"), "left")
    near = F.abs(F.col("value") - F.col("units")) <= 2
    n = joined.groupBy("doc_id").agg(F.countDistinct(F.when(near, F.struct("source", "page"))).alias("n"), F.count("_doc").alias("told"))
    return n.select("doc_id", F.when(F.col("told") == 0, 0.0).when(F.col("n") >= 3, 0.95).when(F.col("n") == 2, 0.85).when(F.col("n") == 1, 0.6).otherwise(0.3).alias("redundancy"))


def cross_check(plans: DataFrame, parcels: DataFrame) -> DataFrame:
    """plans (doc_id, bbl, units, lot_area, far, confidence) with the warnings that the parcel table gives rise to."""
    p = parcels.select("bbl", F.col("lot_area").alias("p_lot"), F.col("resid_far").alias("p_far"))
    joined = plans.join(p, "bbl", "left").withColumn("implied", js_round(F.col("p_lot") * F.col("p_far") * 0.80 / 800))
    off = lambda a, b: F.abs(a - b) / b
    warn = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    checks = F.array(
        warn((F.col("units") > 0) & (F.col("implied") > 0) & (off(F.col("units"), F.col("implied")) > 0.4) & (F.col("confidence") < 0.8), "units"),
        warn((F.col("p_lot") > 0) & (off(F.col("lot_area"), F.col("p_lot")) > 0.1), "lot_area"),
        warn((F.col("p_far") > 0) & (F.col("far") > F.col("p_far") * 1.05), "far"),
    )
    return joined.withColumn("warnings", F.array_compact(checks)).drop("p_lot", "p_far")


def cap_units(units: DataFrame, declared: DataFrame) -> DataFrame:
    """Unit records (doc_id, floor, unit_id): where there are over 1.5 times as many as declared, the declared
    number by floor and id."""
    joined = units.join(declared.select("doc_id", "units"), "doc_id", "left")
    whole, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("floor", "unit_id")
    ranked = joined.withColumns({"_n": F.count("*").over(whole), "_i": F.row_number().over(order)})
    return ranked.filter(F.col("units").isNull() | (F.col("_n") <= 1.5 * F.col("units")) | (F.col("_i") <= F.col("units"))).drop("_n", "_i", "units")
