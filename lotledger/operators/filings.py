"""Filings of parcels: job types, programmes that texts mention, owners by precedence, the full parcel score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import trim_or_null
from ..functions.keys import literal_map
from ..functions.zoning import zone_key
from .screening import YEAR, steps

# Job types by their names; phrases that mention a programme; points by job type.
JOB_TYPES = {
    "new building": "NB", "demolition": "DM", "full demolition": "DM", "alteration": "A1", "alteration type 1": "A1",
    "alteration type 2": "A2", "alteration type 3": "A3", "foundation only": "FO",
}
PHRASES = {
    "485-x": ["485-X", "485X", "485(X)", "SECTION 485-X", "TAX EXEMPTION 485"], "UAP": ["UAP", "UNIFORM AFFORDABILITY", "UNIFIED AFFORDABILITY"],
    "MIH": ["MIH", "MANDATORY INCLUSIONARY", "INCLUSIONARY HOUSING"], "421-a": ["421-A", "421A", "AFFORDABLE NEW YORK"], "467-m": ["467-M", "467M"],
}
JOB_POINTS = {"NB": 15, "DM": 12, "A1": 8, "FO": 5}


def norm_job_type(c: Column) -> Column:
    """The code of a job type; unknown ones in capitals, '' for null."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(literal_map(JOB_TYPES)[F.lower(bare)], F.upper(bare))


def program_mentions(texts: DataFrame) -> DataFrame:
    """bbl, mentions (array of programmes) and evidence (program, text) from texts (bbl, text), each text once."""
    upper = F.upper("text")
    hits = []
    for program, phrases in PHRASES.items():
        found = F.lit(False)
        for phrase in phrases:
            found |= upper.contains(phrase)
        hits.append(F.when(found, program))
    rows = texts.filter("text IS NOT NULL").select("bbl", "text", F.explode(F.array_compact(F.array(*hits))).alias("program")).distinct()
    return rows.groupBy("bbl").agg(F.array_sort(F.collect_set("program")).alias("mentions"), F.array_sort(F.collect_list(F.struct("program", "text"))).alias("evidence"))


def _one(df: DataFrame, name: str, rank: Column | None = None) -> DataFrame:
    """A row for each job number: _<name>_job and its fields as the struct <name>."""
    fields = F.struct(*(c for c in df.columns if c != "job_number"))
    picked = F.min(fields) if rank is None else F.min_by(fields, rank)
    return df.filter("job_number <> ''").groupBy(F.col("job_number").alias(f"_{name}_job")).agg(picked.alias(name))


def enrich_filings(filings: DataFrame, manual: DataFrame, portal: DataFrame, permits: DataFrame) -> DataFrame:
    """Filings (job_number, owner_name, owner_email, owner_phone, ...) with owners filled in and owner_contact_source.

    manual (job_number, name, email, phone, source) comes first, on the job or its base number; then portal (name,
    email, phone) and permits (owner_name, approved_date; the latest) on the base number. Each side has one row a
    job before the joins, so filings are never multiplied. Only e-mails of manual rows replace one that is there.
    """
    rows = filings.withColumn("_base", F.substring_index("job_number", "-", 1))
    hand = _one(manual, "m")
    rows = rows.join(hand, F.col("job_number") == F.col("_m_job"), "left").drop("_m_job")
    rows = rows.join(hand.withColumnsRenamed({"_m_job": "_b_job", "m": "b"}), F.col("_base") == F.col("_b_job"), "left")
    named = permits.filter(trim_or_null(F.col("owner_name")).isNotNull()).withColumn("job_number", F.substring_index("job_number", "-", 1))
    latest = F.struct(F.datediff(F.lit("9999-12-31").cast("date"), "approved_date"), "owner_name")
    rows = rows.join(_one(portal, "p"), F.col("_base") == F.col("_p_job"), "left").join(_one(named, "a", latest), F.col("_base") == F.col("_a_job"), "left")
    rows = rows.withColumn("m", F.coalesce("m", "b"))
    by_hand, by_portal = F.col("m").isNotNull(), F.col("m").isNull() & F.col("p").isNotNull()
    by_permit = F.col("m").isNull() & F.col("p").isNull() & F.col("owner_name").isNull() & F.col("a").isNotNull()
    text = lambda c: trim_or_null(F.col(c))
    fill = lambda own, field: F.coalesce(F.col(own), F.when(by_hand, text(f"m.{field}")).when(by_portal, text(f"p.{field}")))
    found = {
        "owner_contact_source": F.when(by_hand, F.coalesce("m.source", F.lit("dobnow_manual_import"))).when(by_portal | by_permit, "dobnow_payload"),
        "owner_name": F.coalesce(fill("owner_name", "name"), F.when(by_permit, text("a.owner_name"))),
        "owner_email": F.coalesce(F.when(by_hand, text("m.email")), fill("owner_email", "email")),
        "owner_phone": fill("owner_phone", "phone"),
    }
    return rows.select(*(found.get(c, F.col(c)).alias(c) for c in filings.columns), found["owner_contact_source"].alias("owner_contact_source"))


def lot_score(df: DataFrame, as_of: str) -> DataFrame:
    """With breakdown, an array of (category, score, max_score), dev_score, rental_overlay, total_score, class.

    df: ratio (null without parcel data), ppsf, sale_amount, sale_date, other_amount, land_use, num_floors,
    lot_area, built_far_calc, max_far, zone_dist, resid_far; arrays (null: none) eligible, job_types and
    mentions; registered.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    held = lambda name, value: F.coalesce(F.array_contains(name, value), F.lit(False))
    own, other = F.col("sale_amount") > 0, F.col("other_amount") > 0
    years = F.datediff(F.lit(as_of).cast("date"), "sale_date") / YEAR
    low = F.when((F.col("ppsf") > 0) & (F.col("ppsf") < 100), 10).when((F.col("ppsf") > 0) & (F.col("ppsf") < 250), 5).otherwise(0)
    sale = 5 + F.when(years <= 2, 10).when(years <= 5, 5).otherwise(0) + low + F.when(own & other, 3).otherwise(0)
    site = F.when(F.col("land_use") == "11", 20).when(F.col("land_use") == "10", 15)
    site = site.when(F.col("land_use").isin("01", "02", "03") & (F.col("num_floors") <= 2) & (F.col("lot_area") > 5000), 10).otherwise(0)
    site += F.when((F.col("built_far_calc") < 1) & (F.col("max_far") > 2), 5).otherwise(0) + F.when(zone_key(F.col("zone_dist")).rlike("^R([6-9]|10)"), 5).otherwise(0)
    for program in ("UAP", "485-x", "467-m"):
        site += F.when(held("eligible", program), 5).otherwise(0)
    site += F.when(F.col("resid_far") >= 3, 5).otherwise(0)
    jobs = sum((F.when(held("job_types", t), p).otherwise(0) for t, p in JOB_POINTS.items()), F.lit(0))
    penalty = 3 * F.greatest(F.size(F.coalesce("mentions", F.array().cast("array<string>"))), F.lit(0))
    renting = F.when(F.upper("zone_dist").rlike("^(R|C|M1)"), 10).otherwise(0) + F.when(held("mentions", "485-x"), 10).otherwise(0)
    renting += F.when(F.col("registered"), 5).otherwise(0) + F.when(held("mentions", "UAP"), 5).otherwise(0)
    parts = {
        "Underbuilt Ratio": (zero(steps(F.col("ratio"), (3, 30), (2, 25), (1.5, 20), (1.2, 15), (1, 10))), 30),
        "Sale Indicators": (F.when(own | other, F.least(sale, F.lit(25))).otherwise(0), 25),
        "Property Characteristics": (F.when(F.col("ratio").isNotNull(), F.least(site, F.lit(45))).otherwise(0), 45),
        "Pipeline Activity": (F.least(jobs, F.lit(15)), 15),
        "Existing Benefits (Penalty)": (-penalty, 0),
        "Rental Overlay": (F.least(renting, F.lit(30)), 30),
    }
    entry = lambda c, s, m: F.struct(F.lit(c).alias("category"), s.cast("int").alias("score"), F.lit(m).alias("max_score"))
    out = df.withColumn("breakdown", F.array(*(entry(c, s, m) for c, (s, m) in parts.items())))
    points = lambda i: F.col("breakdown")[i]["score"]
    dev = F.least(F.greatest(points(0) + points(1) + points(2) + points(3) + points(4), F.lit(0)), F.lit(100))
    out = out.withColumns({"dev_score": dev, "rental_overlay": points(5)}).withColumn("total_score", F.col("dev_score") + F.col("rental_overlay"))
    total = F.col("total_score")
    return out.withColumn("class", F.when(total >= 76, "Very High").when(total >= 51, "High").when(total >= 26, "Moderate").otherwise("Low"))
