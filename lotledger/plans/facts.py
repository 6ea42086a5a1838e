"""Key facts and conversion areas that the text of a plan states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the facts (numbers; floor area ratios; codes), and the ratios that are believed.
NUMBER, FEET = r"([0-9,]+(?:\.\d+)?)", r"\s*(?:sf|sq\.?\s*ft)"
NUMBERS = {
    "lotArea": rf"lot\s*area[:\s]*(?:approx\.?\s*)?{NUMBER}\s*(?:sf|sq\.?\s*ft|square\s*feet)?",
    "zoningFloorArea": rf"(?:zoning|max(?:imum)?|allowable)\s*(?:floor\s*area|zfa|gfa)[:\s]*{NUMBER}{FEET}?",
    "proposedFloorArea": rf"proposed\s*(?:floor\s*area|gfa|gsf|total\s*area)[:\s]*{NUMBER}{FEET}?",
    "totalUnits": r"(?:#\s*(?:of\s+)?units|number\s*of\s*(?:dwelling\s*)?units|(?:dwelling\s*)?units|#\s*of\s*(?:dwelling\s*)?units)[:\s]*(\d{1,4})\b",
    "buildingArea": rf"(?:bldg|building)\s*area[:\s]*{NUMBER}{FEET}?",
    "floors": r"(?:#\s*(?:of\s+)?floors|number\s*of\s*(?:floors|stories)|stories)[:\s]*(\d{1,3})\b",
}
RATIOS = {
    "far": rf"(?:max(?:imum)?\s+)?\b(?:f\.?a\.?r\.?(?![a-z])|floor\s*area\s*ratio)[:\s]*{NUMBER}",
    "residFar": rf"resid(?:ential)?\s*\b(?:f\.?a\.?r\.?(?![a-z])|floor\s*area\s*ratio)[:\s]*{NUMBER}",
}
CODES = {"zoneDistrict": r"\bzone[:\s]*((?:R|C|M)\d{1,2}-\d[A-Z]?)\b", "bin": r"\bbin[:\s]*(\d{7})\b"}
LEAST_RATIO, MOST_RATIO = 0.1, 15.0
# Patterns of the areas of a conversion, words that make an area another's, and the levels of confidence.
AREAS = {
    "pre_existing": rf"(?:pre[- ]?existing|existing)\s*(?:floor\s*area|area|building)[:\s]*{NUMBER}{FEET}?",
    "new": rf"new\s+(?:construction\s+|building\s+)?(?:floor\s*area|gross\s*area|net\s*area|construction\s*area|area)[:\s]*{NUMBER}{FEET}",
    "total": rf"(?:total|overall)\s+(?:(?:residential|project|building)\s+)?(?:floor\s*area|area|project\s*area)[:\s]*{NUMBER}{FEET}",
}
OTHER_USE = r"(?i)(?:commercial|retail|landscaping|amenity|parking|mechanical)\s+"
SURE_NUMBER, SURE_CODE, SURE_AREA, TOLERANCE = 0.8, 0.85, 0.75, 0.05


def _number(c: Column) -> Column:
    return F.regexp_replace(c, ",", "").try_cast("double")


def plan_facts(texts: DataFrame) -> DataFrame:
    """doc_id, field, number, code, confidence: what texts (doc_id, text) state, the first place of each fact.

    Floor area ratios are the first from .1 to 15. Facts that a text doesn't state, and null texts, have no row.
    """
    text = F.col("text")
    fact = lambda name, number, code, sure: F.struct(F.lit(name).alias("field"), number.alias("number"), code.alias("code"), F.lit(sure).alias("confidence"))
    no_number, no_code = F.lit(None).cast("double"), F.lit(None).cast("string")
    facts = [fact(n, _number(F.regexp_extract(text, f"(?i){p}", 1)), no_code, SURE_NUMBER) for n, p in NUMBERS.items()]
    for name, pattern in RATIOS.items():
        every = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), 1), _number)
        facts.append(fact(name, F.get(F.filter(every, lambda v: v.between(LEAST_RATIO, MOST_RATIO)), F.lit(0)), no_code, SURE_NUMBER))
    facts += [fact(n, no_number, F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")), SURE_CODE) for n, p in CODES.items()]
    return texts.select("doc_id", F.explode(F.array(*facts)).alias("f")).select("doc_id", "f.*").filter("number IS NOT NULL OR code IS NOT NULL")


def conversion_areas(texts: DataFrame) -> DataFrame:
    """doc_id, pre_existing, new, total, their confidences (sure_...), and reconciled (null without all three).

    The first place of each area counts, unless it names another use. Where the first two come within 5 % of the total all
    gain .1; where they don't, the first loses .15. Texts without any area have no row.
    """
    text = F.col("text")
    place = {n: F.regexp_extract(text, f"(?i){p}", 0) for n, p in AREAS.items()}
    rows = texts.select("doc_id", *(F.when(~place[n].rlike(OTHER_USE), _number(F.regexp_extract(text, f"(?i){p}", 1))).alias(n) for n, p in AREAS.items()))
    fits = F.abs(F.col("pre_existing") + F.col("new") - F.col("total")) <= F.col("total") * TOLERANCE
    rows = rows.filter(F.coalesce(*AREAS).isNotNull()).withColumn("reconciled", fits)
    sure = F.when(F.col("reconciled"), SURE_AREA + 0.1)
    first = sure.when(~F.col("reconciled"), SURE_AREA - 0.15).otherwise(SURE_AREA)
    level = {n: first if n == "pre_existing" else sure.otherwise(SURE_AREA) for n in AREAS}
    return rows.select("doc_id", *AREAS, *(F.when(F.col(n).isNotNull(), level[n]).alias(f"sure_{n}") for n in AREAS), "reconciled")
