"""What cover sheets and zoning analyses of plans declare, with the place where they say it.

Matches, their places and their snippets come from Spark's own regular expressions; a page is read where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import js_float

# Words of cover pages and of zoning pages (two of them), and how sure their signals are.
COVER = ["COVER SHEET", "PROJECT INFORMATION", "TITLE SHEET", "PROJECT SUMMARY", "PROJECT DATA"]
ZONING = ["FAR", "LOT AREA", "ZONING", "FLOOR AREA RATIO", "ZFA", "USE GROUP", "ZONING FLOOR AREA", "PERMITTED", "PROPOSED"]
LEAST_WORDS, ON_COVER, ELSEWHERE, ON_ZONING = 2, 0.9, 0.7, 0.85
# The patterns of each signal of a cover sheet, in the order in which they are tried.
COVER_PATTERNS = {
    "units": [
        r"PROPOSED\s+(\d{1,4})\s+(?:NEW\s+)?(?:RESIDENTIAL\s+)?(?:DWELLING\s+)?UNITS?\b",
        r"(\d{1,4})\s+PROPOSED\s+(?:DWELLING\s+)?UNITS?\b",
        r"(\d{1,4})\s*[-]?\s*UNIT\s+(?:APARTMENT|RESIDENTIAL|DWELLING)\s+(?:BUILDING|PROJECT)",
        r"TOTAL\s+(?:NUMBER\s+OF\s+)?(?:RESIDENTIAL\s+)?(?:DWELLING\s+)?UNITS[:\s]*(\d{1,4})",
        r"(\d{1,4})\s+(?:NEW\s+)?(?:RESIDENTIAL\s+)?DWELLING\s+UNITS",
        r"(\d{1,4})\s+(?:NEW\s+)?RESIDENTIAL\s+UNITS",
        r"#?\s*(?:OF\s+)?UNITS[:\s]+(\d{1,4})",
        r"NUMBER\s+OF\s+UNITS[:\s]*(\d{1,4})",
        r"(?:CONTAINS|CONSISTING\s+OF|COMPRISING)\s+(\d{1,4})\s+(?:DWELLING\s+)?UNITS",
        r"DU[:\s]+(\d{1,4})",
        r"(\d{1,4})\s+DUs?\b",
    ],
    "floors": [r"(\d{1,3})\s*(?:STORIES|STORY|FLOORS?)\s+(?:ABOVE|PLUS)", r"(?:STORIES|FLOORS?)[:\s]*(\d{1,3})", r"(\d{1,3})\s*[-]?\s*STORY"],
    "zone": [r"ZONING\s*(?:DISTRICT)?[:\s]*((?:R|C|M)\d[\w-]*)", r"ZONE[:\s]*((?:R|C|M)\d[\w-]*)"],
    "lot_area": [r"(?:LOT|SITE|LAND)\s+(?:AREA|SIZE)[:\s]*([\d,]+)\s*(?:SF|SQ\.?\s*(?:FT)?|SQUARE\s+FEET)", r"(?:TAX\s+)?LOT\s+(?:AREA|SIZE)\s*(?:\(SF\))?[:\s]*([\d,]+)", r"LOT\s+AREA[:\s]*([\d,]+)"],
    "building_area": [r"(?:BUILDING|BLDG)\s+AREA[:\s]*([\d,]+)\s*(?:SF|SQ|SQFT)", r"GROSS\s+(?:FLOOR|BUILDING)\s+AREA[:\s]*([\d,]+)"],
    "far": [
        r"(?:PROPOSED\s+)?(?:RESIDENTIAL\s+)?(?:FAR|FLOOR\s+AREA\s+RATIO)[:\s]*([\d.]+)", r"(?:MAX|MAXIMUM)\s+(?:ALLOWABLE\s+)?FAR[:\s]*([\d.]+)",
        r"FAR\s*=\s*([\d.]+)", r"BULK\s+(?:FAR|FLOOR\s+AREA\s+RATIO)[:\s]*([\d.]+)",
    ],
}
# The same of a zoning analysis.
ZONING_PATTERNS = {
    "units": [
        r"TOTAL\s+DWELLING\s+UNITS[:\s]*(\d{1,4})", r"DU[:\s]+(\d{1,4})", r"DWELLING\s+UNITS[:\s]*(\d{1,4})", r"(?:TOTAL\s+)?(?:NO\.?\s+OF\s+)?UNITS[:\s]*(\d{1,4})", r"RESIDENTIAL\s+UNITS[:\s]*(\d{1,4})",
        r"(\d{1,4})\s+DUs?\b", r"(?:TOTAL|MAX(?:IMUM)?)\s+(?:ALLOWABLE\s+)?UNITS[:\s]*(\d{1,4})", r"PROPOSED\s+(\d{1,4})\s+(?:DWELLING\s+)?UNITS",
    ],
    "lot_area": [r"(?:LOT|SITE|LAND)\s+(?:AREA|SIZE)[:\s]*([\d,]+)\s*(?:SF|SQ\.?\s*(?:FT)?|SQUARE\s+FEET)?", r"(?:TAX\s+)?LOT\s+(?:AREA|SIZE)\s*(?:\(SF\))?[:\s]*([\d,]+)", r"SITE\s+AREA[:\s]*([\d,]+)"],
    "far": [
        r"(?:PROPOSED\s+)?(?:RESIDENTIAL\s+)?(?:FAR|FLOOR\s+AREA\s+RATIO)[:\s]*([\d.]+)", r"(?:RESID(?:ENTIAL)?\.?\s+)?FAR[:\s]*([\d.]+)", r"(?:MAX|MAXIMUM)\s+(?:ALLOWABLE\s+)?FAR[:\s]*([\d.]+)",
        r"FAR\s*=\s*([\d.]+)", r"BULK\s+(?:FAR|FLOOR\s+AREA\s+RATIO)[:\s]*([\d.]+)",
    ],
    "zoning_floor_area": [r"(?:ZONING\s+)?FLOOR\s+AREA[:\s]*([\d,]+)\s*(?:SF|SQ|SQFT)?", r"ZFA[:\s]*([\d,]+)", r"TOTAL\s+(?:ZONING\s+)?FLOOR\s+AREA[:\s]*([\d,]+)"],
    "zone": [r"ZONING\s*(?:DISTRICT)?[:\s]*((?:R|C|M)\d[\w/-]*)", r"(?:^|\s)ZONE[:\s]*((?:R|C|M)\d[\w/-]*)"],
}
# What a signal may be, else it is none, and the characters around a match that are shown.
RANGES, AROUND = {"units": (1, 500), "far": (0.1, 15)}, 30


def _cased(pattern: str) -> str:
    return f"(?i){pattern}"


def snippet(text: Column, at: Column, match: Column) -> Column:
    """The match (at a place from 1) with the characters around it, on one line."""
    start = F.greatest(at - AROUND, F.lit(1))
    return F.trim(F.translate(F.substr(text, start, at + F.length(match) + AROUND - start), "\n", " "))


def match_places(text: Column, pattern: str) -> Column:
    """array of (at, match, value) of every match in order, found one by one in what is left of the text."""
    n = F.size(F.regexp_extract_all(text, F.lit(pattern), 0))
    turns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,match:string,value:string>>").alias("found"))

    def step(acc: Column, _: Column) -> Column:
        rest = F.substr(text, acc["end"] + 1)
        at, match = F.regexp_instr(rest, F.lit(pattern)), F.regexp_extract(rest, pattern, 0)
        one = F.struct((acc["end"] + at).alias("at"), match.alias("match"), F.regexp_extract(rest, pattern, 1).alias("value"))
        return F.when(at > 0, F.struct((acc["end"] + at + F.length(match) - 1).alias("end"), F.concat(acc["found"], F.array(one)).alias("found"))).otherwise(acc)

    return F.aggregate(turns, start, step, lambda acc: acc["found"])


def _firsts(pages: DataFrame, table: dict[str, list[str]]) -> DataFrame:
    """pages (doc_id, page, text, _cover) with, for each signal, (i, page, value, snippet) of the first pattern that the page matches
    with a value, in place of the text. Every pattern is looked for once; one that counts is looked for again, for its place."""
    text = F.col("text")
    values = {f"_{n}": F.array(*(F.trim(F.regexp_extract(text, _cased(p), 1)) for p in patterns)) for n, patterns in table.items()}
    number = lambda v: F.coalesce(js_float(F.regexp_replace(v, ",", ""), None) > 0, F.lit(False))
    some = lambda v: v != ""
    at = {f"_{n}_at": F.array_position(F.transform(f"_{n}", some if n == "zone" else number), True).cast("int") - 1 for n in table}

    def shown(n: str) -> Column:
        hit = F.lit(None)
        for i, p in enumerate(map(_cased, table[n])):
            place = snippet(text, F.regexp_instr(text, F.lit(p)), F.regexp_extract(text, p, 0))
            hit = F.when(F.col(f"_{n}_at") == i, place) if i == 0 else hit.when(F.col(f"_{n}_at") == i, place)
        return F.when(F.col(f"_{n}_at") >= 0, F.struct(F.col(f"_{n}_at").alias("i"), "page", F.get(f"_{n}", F.col(f"_{n}_at")).alias("value"), hit.alias("snippet")))

    return pages.withColumns(values).withColumns(at).select("doc_id", "page", "_cover", *(shown(n).alias(n) for n in table))


def _is_cover() -> Column:
    upper = F.upper("text")
    return F.coalesce(F.exists(F.array(*map(F.lit, COVER)), lambda w: upper.contains(w)), F.lit(False))


def _is_zoning() -> Column:
    upper = F.upper("text")
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, ZONING)), lambda w: upper.contains(w))) >= LEAST_WORDS, F.lit(False))


def _long(found: DataFrame, source: str, names: list[str], sure: Column) -> DataFrame:
    rows = found.select("doc_id", sure.alias("confidence"), F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("s")) for n in names))).alias("x")).filter("x.s IS NOT NULL")
    number = F.when(F.col("x.signal") != "zone", js_float(F.regexp_replace("x.s.value", ",", ""), None))
    rows = rows.select("doc_id", F.lit(source).alias("source"), "x.signal", "x.s.value", number.alias("number"), "x.s.page", "x.s.snippet", "confidence")
    keep = F.lit(True)
    for n, (low, high) in RANGES.items():
        keep &= (F.col("signal") != n) | F.col("number").between(low, high)
    return rows.filter(keep)


def cover_signals(pages: DataFrame) -> DataFrame:
    """doc_id, source, signal, value, number, page, snippet, confidence: what pages (doc_id, page, text) declare.

    The first pattern counts, and for it the first page; only cover pages are read where a document has any. A
    first value out of its range is none. Null texts say nothing.
    """
    pages = _firsts(pages.filter("text IS NOT NULL").select("doc_id", "page", "text", _is_cover().alias("_cover")), COVER_PATTERNS)
    ends = [F.min(F.when(test, F.col(n))).alias(f"{n}_{k}") for n in COVER_PATTERNS for k, test in (("c", F.col("_cover")), ("a", F.lit(True)))]
    found = pages.groupBy("doc_id").agg(F.max("_cover").alias("_cover"), *ends)
    found = found.select("doc_id", "_cover", *(F.when(F.col("_cover"), F.col(f"{n}_c")).otherwise(F.col(f"{n}_a")).alias(n) for n in COVER_PATTERNS))
    return _long(found, "cover_sheet", list(COVER_PATTERNS), F.when(F.col("_cover"), ON_COVER).otherwise(ELSEWHERE))


def zoning_signals(pages: DataFrame) -> DataFrame:
    """The same of the pages with two words of a zoning analysis."""
    pages = _firsts(pages.filter("text IS NOT NULL").filter(_is_zoning()).select("doc_id", "page", "text", F.lit(False).alias("_cover")), ZONING_PATTERNS)
    found = pages.groupBy("doc_id").agg(*(F.min(n).alias(n) for n in ZONING_PATTERNS))
    return _long(found, "zoning_text", list(ZONING_PATTERNS), F.lit(ON_ZONING))


def _mentions(pages: DataFrame, source: str, patterns: list[str], sure: Column) -> DataFrame:
    numbered = lambda i: lambda m: F.struct(F.lit(i).alias("i"), m["at"].alias("at"), m["match"].alias("match"), m["value"].alias("value"))
    places = F.flatten(F.array(*(F.transform(match_places(F.col("text"), _cased(p)), numbered(i)) for i, p in enumerate(patterns))))
    rows = pages.select("doc_id", "page", "text", sure.alias("confidence"), F.explode(places).alias("m")).withColumn("value", F.col("m.value").try_cast("int")).filter(F.col("value").between(*RANGES["units"]))
    rows = rows.select("doc_id", "page", "value", "confidence", F.struct("m.i", "m.at", snippet(F.col("text"), F.col("m.at"), F.col("m.match")).alias("snippet")).alias("m"))
    first = rows.groupBy("doc_id", "page", "value").agg(F.min("m").alias("m"), F.max("confidence").alias("confidence"))
    return first.select("doc_id", F.lit(source).alias("source"), "page", "value", F.col("m.snippet").alias("snippet"), "confidence")


def unit_mentions(pages: DataFrame) -> DataFrame:
    """doc_id, source, page, value, snippet, confidence: every number of units that cover pages (all pages, without any) and
    zoning pages declare, 1 to 500, once for each page and source."""
    pages = pages.filter("text IS NOT NULL").withColumns({"_cover": _is_cover(), "_zoning": _is_zoning()})
    covered = pages.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("_cover").alias("_any"))
    searched = pages.join(covered, F.col("doc_id").eqNullSafe(F.col("_doc"))).filter("_cover OR NOT _any")
    cover = _mentions(searched, "cover_sheet", COVER_PATTERNS["units"], F.when(F.col("_any"), ON_COVER).otherwise(ELSEWHERE))
    return cover.unionByName(_mentions(pages.filter("_zoning"), "zoning_text", ZONING_PATTERNS["units"], F.lit(ON_ZONING)))
