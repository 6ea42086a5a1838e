"""Parcel keys, boroughs, document types, roles and row fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boroughs and their aliases, document types and their spellings, categories.
BOROUGH_NAMES = {"1": "Manhattan", "2": "Bronx", "3": "Brooklyn", "4": "Queens", "5": "Staten Island"}
BOROUGH_ALIASES = {
    "manhattan": "1", "mn": "1", "new york": "1",
    "bronx": "2", "bx": "2", "the bronx": "2",
    "brooklyn": "3", "bk": "3", "kings": "3",
    "queens": "4", "qn": "4",
    "staten island": "5", "si": "5", "richmond": "5",
}
DOC_TYPES = {
    "deed": "DEED", "warranty deed": "DEED",
    "mortgage": "MTGE", "mtge": "MTGE",
    "satisfaction of mortgage": "SAT", "satisfaction": "SAT", "sat": "SAT",
    "assignment": "ASST", "asst": "ASST",
    "ucc1": "UCC1", "ucc3": "UCC3",
    "lis pendens": "LP", "lp": "LP",
    "agreement": "AGMT", "agmt": "AGMT",
    "memorandum of contract": "MCON", "mcon": "MCON",
    "power of attorney": "RPTT", "rptt": "RPTT", "real property transfer": "RPTT",
    "aded": "ADED", "administrators deed": "ADED",
    "deedo": "DEEDO", "deed, other": "DEEDO",
    "cdec": "CDEC", "condo declaration": "CDEC",
    "al": "AL&R", "al&r": "AL&R",
    "cntr": "CNTR", "contract": "CNTR",
}
DEED_TYPES = ["DEED", "DEEDO", "ADED", "EXED", "RDED", "TORD"]
MORTGAGE_TYPES = ["MTGE", "AGMT", "ASPM", "SMTG"]
REGULATORY_TYPES = ["RCOV", "RSTD", "RPTT", "DECL"]
RECENT_DEED_TYPES = ["DEED", "DEEDO", "ADED"]
MANUAL_DEED_TYPES = ["DEED", "DEEDO", "ADED", "CDEC"]


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _padded(digits: Column, n: int) -> Column:
    """At least n digits; longer ones stay whole."""
    return F.when(F.length(digits) < n, F.lpad(digits, n, "0")).otherwise(digits)


def build_bbl(borough: Column, block: Column, lot: Column) -> Column:
    """Borough, block (5 digits) and lot (4 digits) as one key; '' unless the borough is 1 to 5 and both are numbers."""
    lead = lambda c: F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("long")
    b, k, n = lead(borough), lead(block), lead(lot)
    key = F.concat(b.cast("string"), _padded(k.cast("string"), 5), _padded(n.cast("string"), 4))
    return F.coalesce(F.when(b.between(1, 5), key), F.lit(""))


def sanitize_bbl(c: Column) -> Column:
    """Ten digits: what follows a point goes, other characters go, padded on the left, last ten kept."""
    digits = F.regexp_replace(F.regexp_replace(c, r"\..*$", ""), r"\D", "")
    return F.right(_padded(digits, 10), F.lit(10))


def parse_bbl(c: Column) -> Column:
    """borough, block and lot of a key; null if the borough isn't 1 to 5."""
    key = F.right(_padded(F.regexp_replace(c, r"\D", ""), 10), F.lit(10))
    parts = F.struct(F.substring(key, 1, 1).alias("borough"), F.substring(key, 2, 5).alias("block"), F.substring(key, 7, 4).alias("lot"))
    return F.when(F.substring(key, 1, 1).isin(*BOROUGH_NAMES), parts)


def format_bbl(c: Column) -> Column:
    return F.concat_ws("-", F.substring(c, 1, 1), F.substring(c, 2, 5), F.substring(c, 7, 4))


def borough_code(c: Column) -> Column:
    key = F.lower(F.trim(c))
    return F.when(key.isin(*BOROUGH_NAMES), key).otherwise(literal_map(BOROUGH_ALIASES)[key])


def borough_name(c: Column) -> Column:
    return literal_map(BOROUGH_NAMES)[c]


def bbl_label(c: Column) -> Column:
    """Borough, Block n, Lot m."""
    number = lambda at, n: F.substring(c, at, n).try_cast("int").cast("string")
    return F.concat(F.coalesce(borough_name(F.substring(c, 1, 1)), F.lit("Unknown")), F.lit(", Block "), number(2, 5), F.lit(", Lot "), number(7, 4))


def norm_doc_type(c: Column) -> Column:
    return F.coalesce(literal_map(DOC_TYPES)[F.lower(F.trim(c))], F.upper(F.trim(c)), F.lit(""))


def doc_category(c: Column) -> Column:
    return F.when(c.isin(DEED_TYPES), "deed").when(c.isin(MORTGAGE_TYPES), "mortgage").when(c.isin(REGULATORY_TYPES), "regulatory").otherwise("unknown")


def party_labels(doc_type: Column) -> Column:
    """Names of the two parties of a document."""
    category = doc_category(doc_type)
    first = F.when(category == "deed", "Seller").when(category == "mortgage", "Borrower").otherwise("Party 1")
    second = F.when(category == "deed", "Buyer").when(category == "mortgage", "Lender").otherwise("Party 2")
    return F.struct(first.alias("party1"), second.alias("party2"))


def map_role_party(c: Column) -> Column:
    return F.when(c == "2", "OWNER").when(c == "1", "SELLER").otherwise("OTHER")


def map_role_housing(c: Column) -> Column:
    key = F.regexp_replace(F.lower(c), r"\s+", "")
    return F.when(key.isin("agent", "sitemanager"), "MANAGING_AGENT").when(key.isin("corporateowner", "individualowner", "jointowner", "headofficer"), "OWNER").otherwise("OTHER")


def map_role_licence(c: Column) -> Column:
    key = F.trim(F.upper(c))
    return F.when(key == "PE", "ENGINEER").when(key == "RA", "ARCHITECT").when(key.isin("GC", "GENERAL CONTRACTOR"), "GC").otherwise("OTHER")


def map_role_filing(c: Column) -> Column:
    key = F.lower(c)
    return (
        F.when(key.rlike("permittee|contractor"), "GC").when(key.contains("owner"), "OWNER").when(key.contains("applicant"), "APPLICANT")
        .when(key.rlike("filing_rep|filing representative"), "FILING_REP").otherwise("OTHER")
    )


def dedupe_key(crfn: Column, document_id: Column, *fields: Column) -> Column:
    """By recording number, else by document id, else by a hash of the fields."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    hashed = F.concat(F.lit("hash_"), F.hex(F.xxhash64(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)))))
    return F.coalesce(F.concat(F.lit("crfn_"), some(crfn)), F.concat(F.lit("docid_"), some(document_id)), hashed)


def row_fingerprint(*fields: Column) -> Column:
    return F.xxhash64(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)))
