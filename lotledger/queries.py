"""Registered queries: every operator applied to tables derived from the test tables, with SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import coerce, keys, names, text, zoning
from .operators import activity, contacts, deeds, filings, finance, owners, portfolio, programs, records, sales, screening, spatial, stakeholders, upserts
from .plans import extraction, facts, layout, pages, reconcile, signals, units
from .sources import derived, extracts, pasted, result_pages
from .sources.shared import small, written
from .streaming import deeds as live

AS_OF = "2001-12-31"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _map(values: dict) -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in values.items()) + "}"


def _bbl(part: str) -> str:
    return f"({part} % 5 + 1)::VARCHAR || lpad(({part} // 7)::VARCHAR, 5, '0') || lpad(({part} % 7 + 1)::VARCHAR, 4, '0')"


# The derived tables in SQL.
PARCELS = f"""parcels AS (
  SELECT {_bbl('p_partkey')} AS bbl, p_partkey || ' ' || upper(p_brand) || ' STREET' AS address, (p_partkey % 5 + 1)::VARCHAR AS borough,
    {_list(derived.ZONES)}[p_size % 15 + 1] AS zone_dist, (1500 + (p_partkey % 90) * 200)::DOUBLE AS lot_area, ((p_size % 12) * 1500)::DOUBLE AS bldg_area,
    0.5::DOUBLE * (p_size % 20) AS resid_far, 0.25::DOUBLE * (p_partkey % 8) AS built_far, lpad((p_partkey % 11 + 1)::VARCHAR, 2, '0') AS land_use,
    {_list(derived.CLASSES)}[p_partkey % 7 + 1] AS bldg_class, (1900 + p_partkey % 100)::INTEGER AS year_built, (p_partkey % 13)::INTEGER AS units_res,
    upper(p_name) || {_list(derived.SUFFIXES)}[p_partkey % 6 + 1] AS owner_name
  FROM part)"""
SALES = f"""sales AS (
  SELECT {_bbl('l_partkey')} AS bbl, l_shipdate::DATE AS sale_date, l_extendedprice AS sale_price, 'rolling_sales' AS source, lpad(l_orderkey::VARCHAR, 16, '0') AS document_id FROM lineitem)"""
LATEST = "latest AS (SELECT * FROM sales QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY sale_date DESC NULLS LAST, sale_price DESC NULLS LAST, source DESC, document_id DESC) = 1)"
MASTER = f"""master AS (
  SELECT lpad(o_orderkey::VARCHAR, 16, '0') AS document_id, {_list(derived.DOC_TYPES)}[o_orderkey % 14 + 1] AS doc_type, o_orderdate::DATE AS document_date,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END AS recorded, o_totalprice AS amount, CASE WHEN o_orderkey % 3 <> 0 THEN 'C' || o_orderkey END AS crfn FROM orders)"""
LEGALS = f"legals AS (SELECT DISTINCT lpad(l_orderkey::VARCHAR, 16, '0') AS document_id, (l_partkey % 5 + 1)::VARCHAR AS borough, (l_partkey // 7)::VARCHAR AS block, (l_partkey % 7 + 1)::VARCHAR AS lot, {_bbl('l_partkey')} AS bbl FROM lineitem)"
PARTIES = f"""parties AS (
  SELECT lpad(o_orderkey::VARCHAR, 16, '0') AS document_id, '1' AS party_type, upper(c_name) || {_list(derived.SUFFIXES)}[c_custkey % 6 + 1] AS name, 0 AS seq FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT lpad(l_orderkey::VARCHAR, 16, '0'), '2', upper(s_name) || {_list(derived.SUFFIXES)}[s_suppkey % 6 + 1], l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
lists AS (
  SELECT document_id, string_agg(name, '; ' ORDER BY seq, name) FILTER (party_type = '1') AS party1, string_agg(name, '; ' ORDER BY seq, name) FILTER (party_type = '2') AS party2 FROM parties GROUP BY document_id)"""
DOCS = f"""{MASTER}, {LEGALS}, {PARTIES},
docs AS (
  SELECT m.document_id, doc_type, coalesce(recorded, document_date) AS recorded_date, document_date AS doc_date, amount, crfn, borough, block, lot, bbl, party1, party2, 'socrata_poll' AS source
  FROM master m JOIN legals USING (document_id) LEFT JOIN lists USING (document_id))"""
_R = lambda x: f"floor({x} + 0.5::DOUBLE)"
_RES = f"""CASE WHEN starts_with(zone_dist, 'R') THEN zone_dist WHEN starts_with(zone_dist, 'C') OR starts_with(zone_dist, 'M') THEN {_map(zoning.EQUIVALENTS)}[zone_dist] END"""
SCORED = f"""{PARCELS}, {SALES}, {LATEST},
zones AS (SELECT unnest({_list(list(zoning.FAR))}) AS zone, unnest([{', '.join(f'{a}::DOUBLE' for a, _ in zoning.FAR.values())}]) AS standard_far, unnest([{', '.join(f'{b}::DOUBLE' for _, b in zoning.FAR.values())}]) AS bonus_far),
k AS (
  SELECT *, CASE WHEN starts_with(zone_dist, 'R') THEN regexp_extract(zone_dist, '^([A-Z0-9-]*)', 1) WHEN regexp_matches(split_part(zone_dist, '/', 2), '^R[0-9]') THEN regexp_extract(split_part(zone_dist, '/', 2), '^([A-Z0-9-]*)', 1)
    ELSE coalesce({_RES}, zone_dist) END AS zk
  FROM parcels WHERE resid_far > 0 AND lot_area > 2000),
m AS (
  SELECT k.*, coalesce(e.standard_far, b.standard_far) AS standard_far, coalesce(e.bonus_far, b.bonus_far) AS bonus_far,
    {_R('resid_far * lot_area')} AS max_buildable_sf, {_R('greatest(resid_far * lot_area - bldg_area, 0::DOUBLE)')} AS slack_sf,
    {_R('greatest(1 - built_far / resid_far, 0::DOUBLE) * 1000')} / 10 AS underbuilt_ratio,
    sale_date AS last_sale_date, nullif(sale_price, 0) AS last_sale_price, l.source AS last_sale_source
  FROM k LEFT JOIN zones e ON e.zone = zk LEFT JOIN zones b ON b.zone = regexp_extract(zk, '^(R[0-9]+)', 1) LEFT JOIN latest l USING (bbl)),
u AS (
  SELECT *, CASE WHEN slack_sf <= 0 THEN 0 ELSE floor(q) + CASE WHEN q - floor(q) >= 0.75 THEN 1 ELSE 0 END END::INTEGER AS potential_units
  FROM (SELECT *, slack_sf * 0.8::DOUBLE / CASE WHEN standard_far IS NULL THEN 700 ELSE 680 END AS q FROM m)),
f AS (
  SELECT *, regexp_matches(zone_dist, '^(R|C[1-6]|MX)|/R') AS res, coalesce(bonus_far > standard_far, false) AS bonus FROM u),
g AS (
  SELECT *, res AND bonus AS mih, res AND bonus AND lot_area >= 5000 AND regexp_matches(coalesce({_RES}, zone_dist), '^R([6-9]|1[0-2])') AS uap,
    res AND slack_sf > 0 AND potential_units >= 6 AS p485, res AND resid_far >= 6 AS p467 FROM f),
s AS (
  SELECT *, CASE WHEN bldg_area > 0 THEN max_buildable_sf / bldg_area WHEN max_buildable_sf > 0 THEN 999 ELSE 0 END AS ubr,
    date_diff('day', last_sale_date, DATE '{AS_OF}') AS days, CASE WHEN bldg_area > 0 THEN last_sale_price / bldg_area ELSE 0 END AS ppsf FROM g),
scored AS (
  SELECT *, (least(
      CASE WHEN ubr >= 3 THEN 30 WHEN ubr >= 2 THEN 25 WHEN ubr >= 1.5 THEN 20 WHEN ubr >= 1.2 THEN 15 WHEN ubr >= 1 THEN 10 ELSE 0 END
      + CASE WHEN last_sale_date IS NOT NULL AND last_sale_price > 0 THEN least(25, 5 + CASE WHEN days <= 730.5 THEN 10 WHEN days <= 1826.25 THEN 5 ELSE 0 END
          + CASE WHEN ppsf > 0 AND ppsf < 100 THEN 10 WHEN ppsf > 0 AND ppsf < 250 THEN 5 ELSE 0 END) ELSE 0 END
      + least(45, CASE land_use WHEN '11' THEN 20 WHEN '10' THEN 15 ELSE 0 END + CASE WHEN bldg_area / lot_area < 1 AND max_buildable_sf / lot_area > 2 THEN 5 ELSE 0 END
          + 5 * (mih::INT + uap::INT + p485::INT + p467::INT) + CASE WHEN resid_far >= 3 THEN 5 ELSE 0 END), 100)
    + least(30, CASE WHEN regexp_matches(zone_dist, '^(R|C|M1)') THEN 10 ELSE 0 END + 10 * p485::INT + 5 * uap::INT))::INTEGER AS score,
    (10 + CASE WHEN owner_name <> '' THEN 20 ELSE 0 END + 10 + 10 + CASE WHEN last_sale_date IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN last_sale_price > 0 THEN 15 ELSE 0 END
      + CASE WHEN units_res > 0 THEN 10 ELSE 0 END + 10)::INTEGER AS data_completeness,
    CASE WHEN last_sale_price > 0 AND slack_sf > 0 THEN floor(last_sale_price / slack_sf * 100 + 0.5::DOUBLE) / 100 END AS ppbsf,
    array_to_string(list_filter([CASE WHEN mih THEN 'MIH' END, CASE WHEN uap THEN 'UAP' END, CASE WHEN p485 THEN '485-x' END, CASE WHEN p467 THEN '467-m' END], lambda x: x IS NOT NULL), ', ') AS programs
  FROM s)"""
SCORED_COLUMNS = "bbl, borough, zone_dist, max_buildable_sf, slack_sf, underbuilt_ratio, last_sale_date, last_sale_price, ppbsf, potential_units, score, data_completeness, programs"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.score_parcels(derived.parcels(spark, sf_dir), derived.rolling_sales(spark, sf_dir), AS_OF)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deeds.normalize_documents(derived.master(spark, sf_dir), derived.legals(spark, sf_dir), derived.parties(spark, sf_dir))


def _shown(scored: DataFrame) -> DataFrame:
    eligible = F.transform(F.filter("program_flags", lambda f: f["eligible"]), lambda f: f["program"])
    return scored.withColumn("programs", F.array_join(eligible, ", ")).select(*SCORED_COLUMNS.split(", "))


@query(f"WITH {SCORED} SELECT {SCORED_COLUMNS} FROM scored")
def screen_parcels(spark, sf_dir):
    return _shown(_scored(spark, sf_dir))


@query(f"""WITH {SCORED} SELECT {SCORED_COLUMNS} FROM scored WHERE borough = '1' AND lower(zone_dist) IN ('r7a', 'r8', 'm1-2/r7a', 'c4-4', 'r6') AND bldg_class NOT IN ('R1', 'R2', 'R3', 'R4', 'R5', 'R6', 'R9', 'RR')
  AND slack_sf >= 5000 AND (mih OR p485)""")  # fmt: skip
def search_screened(spark, sf_dir):
    found = screening.search_parcels(_scored(spark, sf_dir).filter("borough = '1'"), {"slack_sf": (5000, None)}, True, ["R7A", "r8", "M1-2/R7A", "C4-4", "R6"], programs=["MIH", "485-x"])
    return _shown(found)


@query(f"WITH {SCORED} SELECT {SCORED_COLUMNS} FROM scored WHERE starts_with(bldg_class, 'A') OR starts_with(bldg_class, 'D4') ORDER BY last_sale_price DESC NULLS FIRST, score DESC NULLS FIRST, bbl OFFSET 50 LIMIT 50")
def page_screened(spark, sf_dir):
    return _shown(screening.page_of(screening.search_parcels(_scored(spark, sf_dir), classes=["A", "D4"]), "last_sale_price", page=1, size=50))


@query(f"WITH {SALES}, {LATEST} SELECT bbl, sale_date, sale_price, source, document_id FROM latest")
def latest_sale_of_parcels(spark, sf_dir):
    return sales.latest_sales(derived.rolling_sales(spark, sf_dir))


@query(f"WITH {SALES} SELECT max(sale_date) AS latest_sale_date FROM sales WHERE starts_with(bbl, '3')")
def latest_sale_date_of_borough(spark, sf_dir):
    return screening.latest_sale_date(derived.rolling_sales(spark, sf_dir), "3")


@query(f"WITH {DOCS} SELECT * FROM docs")
def normalize_deed_documents(spark, sf_dir):
    return _docs(spark, sf_dir)


@query(f"WITH {MASTER} SELECT max(recorded) AS latest_date FROM master WHERE doc_type IN ('DEED', 'DEEDO', 'ADED', 'EXED', 'RDED', 'TORD')")
def latest_source_date(spark, sf_dir):
    return deeds.latest_date(derived.master(spark, sf_dir))


@query(f"""WITH {MASTER}, {LEGALS} SELECT bbl, recorded AS sale_date, amount AS sale_price, doc_type, m.document_id FROM master m JOIN legals USING (document_id)
  WHERE borough = '2' AND doc_type IN ('DEED', 'DEEDO', 'ADED') AND amount > 0 AND recorded >= DATE '{AS_OF}' - 1500""")  # fmt: skip
def recent_deeds_of_borough(spark, sf_dir):
    return deeds.recent_deeds(derived.master(spark, sf_dir), derived.legals(spark, sf_dir), "2", AS_OF, 1500)


@query(f"WITH {DOCS} SELECT source, borough, min(recorded_date) AS date_from, max(recorded_date) AS date_to, count(*) AS doc_count, greatest(date_diff('day', max(recorded_date), DATE '{AS_OF}'), 0) AS gap_days FROM docs GROUP BY source, borough")
def coverage_by_source(spark, sf_dir):
    return deeds.coverage(_docs(spark, sf_dir), AS_OF)


@query(f"""WITH {DOCS} SELECT bbl, recorded_date AS sale_date, amount AS sale_price, 'acris_realtime' AS source, document_id FROM docs WHERE doc_type IN ('DEED', 'DEEDO', 'ADED', 'EXED', 'RDED', 'TORD') AND amount > 0
  QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY recorded_date DESC, amount DESC, document_id DESC) = 1""")  # fmt: skip
def latest_deed_of_parcels(spark, sf_dir):
    return sales.latest_deed_sales(_docs(spark, sf_dir))


@query(f"""WITH {DOCS} SELECT document_id, doc_type, recorded_date, amount, bbl FROM docs WHERE recorded_date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' AND borough = '4' AND amount >= 50000
  AND doc_type IN ('DEED', 'MTGE') AND starts_with(bbl, '4000')""")  # fmt: skip
def search_deed_documents(spark, sf_dir):
    found = deeds.search_documents(_docs(spark, sf_dir), AS_OF, date_from="1996-01-01", date_to="1996-06-30", borough="4", amounts=(50000, None), types=["DEED", "MTGE"], key="4000")
    return found.select("document_id", "doc_type", "recorded_date", "amount", "bbl")


@query(f"""WITH {DOCS}, {SALES}, n AS (SELECT bbl, recorded_date AS sale_date, amount AS sale_price, 'acris_realtime' AS source, document_id FROM docs WHERE doc_type IN ('DEED', 'DEEDO', 'ADED', 'EXED', 'RDED', 'TORD') AND amount > 0),
  o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY bbl, sale_date, source ORDER BY document_id DESC) = 1),
  a AS (SELECT * FROM sales UNION ALL SELECT * FROM o)
  SELECT source, count(*) AS n, count(DISTINCT bbl) AS parcels, min(sale_date) AS first_sale, max(sale_date) AS last_sale FROM a GROUP BY source""")  # fmt: skip
def backfill_sales_from_documents(spark, sf_dir):
    both = deeds.backfill_sales(derived.rolling_sales(spark, sf_dir), sales.sales_from_documents(_docs(spark, sf_dir)).drop("doc_type"))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("bbl").alias("parcels"), F.min("sale_date").alias("first_sale"), F.max("sale_date").alias("last_sale"))


@query(f"""WITH {DOCS}, old AS (SELECT * FROM docs WHERE doc_type = 'DEED' AND recorded_date < DATE '1996-01-01'),
  new AS (SELECT * REPLACE (amount + 1 AS amount) FROM docs WHERE doc_type = 'DEED' AND recorded_date >= DATE '1995-06-01')
  SELECT document_id, bbl, amount FROM new UNION ALL SELECT document_id, bbl, amount FROM old WHERE recorded_date < DATE '1995-06-01'""")  # fmt: skip
def upsert_documents(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter("doc_type = 'DEED'").select("document_id", "bbl", "block", "lot", "recorded_date", "amount")
    new = docs.filter("recorded_date >= DATE '1995-06-01'").withColumn("amount", F.col("amount") + 1)
    return upserts.upsert(docs.filter("recorded_date < DATE '1996-01-01'"), new, ["document_id", "bbl", "block", "lot"], ["recorded_date", "amount"]).select("document_id", "bbl", "amount")


@query(f"""WITH {DOCS}, stored AS (SELECT document_id, bbl, crfn, amount FROM docs WHERE doc_type = 'MTGE'),
  t AS (SELECT 'X' || document_id AS document_id, bbl, crfn, amount + CASE WHEN right(document_id, 1) IN ('1', '2', '3') THEN 5 ELSE 0 END AS amount FROM stored WHERE crfn IS NOT NULL)
  SELECT substr(document_id, 2) AS document_id, bbl, crfn, amount FROM t WHERE right(document_id, 1) IN ('1', '2', '3')""")  # fmt: skip
def resolve_and_diff_documents(spark, sf_dir):
    stored = _docs(spark, sf_dir).filter("doc_type = 'MTGE'").select("document_id", "bbl", "crfn", "amount")
    changed = F.when(F.right("document_id", F.lit(1)).isin("1", "2", "3"), 5).otherwise(0)
    incoming = stored.filter("crfn IS NOT NULL").select(F.concat(F.lit("X"), "document_id").alias("document_id"), "bbl", "crfn", (F.col("amount") + changed).alias("amount"))
    return deeds.resolve_and_diff(incoming, stored, ["crfn", "amount"])


@query(f"""WITH {DOCS}, d AS (SELECT CASE WHEN doc_type = 'ASST' THEN 'FT_' || document_id ELSE document_id END AS document_id, crfn, bbl FROM docs WHERE doc_type IN ('ASST', 'SAT'))
  SELECT CASE WHEN starts_with(document_id, 'FT_') AND crfn IS NOT NULL THEN substr(document_id, 4) ELSE document_id END AS document_id, crfn, bbl FROM d""")  # fmt: skip
def enrich_recording_numbers(spark, sf_dir):
    docs = _docs(spark, sf_dir).filter("doc_type IN ('ASST', 'SAT')")
    docs = docs.select(F.when(F.col("doc_type") == "ASST", F.concat(F.lit("FT_"), "document_id")).otherwise(F.col("document_id")).alias("document_id"), "crfn", "bbl")
    return deeds.enrich_crfn(docs, derived.master(spark, sf_dir))


@query(f"""WITH {SCORED}, r AS (SELECT bbl, sale_date, sale_price, 'live' AS source FROM sales WHERE sale_date >= DATE '1998-01-01' QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY sale_date DESC, sale_price DESC, document_id DESC) = 1),
  old AS (SELECT bbl, slack_sf, CASE WHEN hash_bit = 0 THEN last_sale_date END AS last_sale_date, CASE WHEN hash_bit = 0 THEN last_sale_price END AS last_sale_price, last_sale_source, ppbsf FROM (SELECT *, year_built % 2 AS hash_bit FROM scored))
  SELECT bbl, CASE WHEN n THEN sale_date ELSE last_sale_date END AS last_sale_date, CASE WHEN n THEN sale_price ELSE last_sale_price END AS last_sale_price, CASE WHEN n THEN source ELSE last_sale_source END AS last_sale_source,
    CASE WHEN n THEN CASE WHEN slack_sf > 0 THEN floor(sale_price / slack_sf * 100 + 0.5::DOUBLE) / 100 END ELSE ppbsf END AS ppbsf
  FROM (SELECT *, coalesce(sale_date > last_sale_date, sale_date IS NOT NULL) AS n FROM old LEFT JOIN r USING (bbl))""")  # fmt: skip
def apply_newer_sales_to_parcels(spark, sf_dir):
    old = _scored(spark, sf_dir)
    half = F.col("year_built") % 2 == 0
    old = old.select("bbl", "slack_sf", F.when(half, F.col("last_sale_date")).alias("last_sale_date"), F.when(half, F.col("last_sale_price")).alias("last_sale_price"), "last_sale_source", "ppbsf")
    live = derived.rolling_sales(spark, sf_dir).filter("sale_date >= DATE '1998-01-01'").withColumn("source", F.lit("live"))
    return sales.apply_newer_sales(old, live).drop("slack_sf")


@query(f"""WITH {SALES}, {DOCS}, p AS (SELECT * FROM sales QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY sale_date DESC, sale_price DESC, document_id DESC) = 1),
  q AS (SELECT bbl, recorded_date AS sale_date, amount AS sale_price, 'acris_realtime' AS source FROM docs WHERE doc_type IN ('DEED', 'DEEDO', 'ADED', 'EXED', 'RDED', 'TORD') AND amount > 0
    QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY recorded_date DESC, amount DESC, document_id DESC) = 1),
  j AS (SELECT coalesce(p.bbl, q.bbl) AS bbl, p.sale_date AS pd, p.sale_price AS pp, p.source AS ps, q.sale_date AS qd, q.sale_price AS qp, q.source AS qs,
    p.bbl IS NULL OR coalesce(q.sale_date > p.sale_date, false) OR coalesce(q.sale_date = p.sale_date AND coalesce(p.sale_price, 0) = 0 AND q.sale_price > 0, false) AS second FROM p FULL JOIN q ON p.bbl = q.bbl)
  SELECT bbl, CASE WHEN second THEN qd ELSE pd END AS sale_date, CASE WHEN second THEN qp ELSE pp END AS sale_price, CASE WHEN second THEN qs ELSE ps END AS source,
    CASE WHEN second THEN pd ELSE qd END AS corroborating_date, CASE WHEN second THEN pp ELSE qp END AS corroborating_price, CASE WHEN second THEN ps ELSE qs END AS corroborating_source FROM j""")  # fmt: skip
def resolve_sale_of_parcels(spark, sf_dir):
    return sales.resolve_sale(derived.rolling_sales(spark, sf_dir), sales.sales_from_documents(_docs(spark, sf_dir)))


_SUFFIX = r"(\s*,?\s*\b(LLC|L\.?L\.?C\.?|LP|L\.?P\.?|INC\.?|CORP\.?|CORPORATION|CO\.?|LTD\.?|PLLC|P\.?L\.?L\.?C\.?|LLP|L\.?L\.?P\.?)\b\.?\s*,?\s*)+$"
_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(upper({c}), '[^A-Za-z0-9_\s,]', ' ', 'g'), '\s+', ' ', 'g'))"
_STRIP = lambda c: rf"trim(regexp_replace(regexp_replace({c}, '(?i){_SUFFIX}', ''), ',\s*$', ''))"
_KEY = lambda c: rf"trim(regexp_replace({_STRIP(_NORM(c))}, '(?i)^(THE|A|AN)\s+', ''))"
_ORG = r"\b(LLC|LP|INC|CORP|CORPORATION|LTD|PLLC|LLP|TRUST|ASSOCIATES|REALTY|HOLDINGS|ENTERPRISES|PROPERTIES|GROUP|PARTNERS|DEVELOPMENT|MGMT|MANAGEMENT)\b"
_KIND = lambda c: rf"""CASE WHEN regexp_matches(upper({c}), '{_ORG}') THEN 'org' WHEN regexp_matches({_STRIP(_NORM(c))}, '^[A-Z][A-Z]+( [A-Z][A-Z]+){{1,3}}$') THEN 'person' ELSE 'unknown' END"""
MENTIONS = f"""{DOCS}, {PARCELS},
sides AS (
  SELECT trim(unnest(string_split(party1, ';'))) AS name, -date_diff('day', DATE '1970-01-01', recorded_date) AS seq, bbl, doc_type, 1 AS side, recorded_date FROM docs WHERE party1 IS NOT NULL
  UNION ALL SELECT trim(unnest(string_split(party2, ';'))), -date_diff('day', DATE '1970-01-01', recorded_date), bbl, doc_type, 2, recorded_date FROM docs WHERE party2 IS NOT NULL),
raw AS (
  SELECT name, seq, bbl, CASE WHEN d THEN 'owner' WHEN side = 1 THEN 'borrower' ELSE 'lender' END AS relationship, CASE WHEN d THEN CASE WHEN side = 1 THEN 0.7 ELSE 0.85 END ELSE 0.6 END::DOUBLE AS confidence,
    CASE WHEN d THEN 'purchase' WHEN side = 1 THEN 'acris_doc' END AS event_type, recorded_date AS occurred_at, 'acris' AS source FROM (SELECT *, regexp_matches(lower(doc_type), 'deed|rptt') AS d FROM sides) WHERE length(name) > 2
  UNION ALL SELECT trim(owner_name), bbl::BIGINT, bbl, 'owner', 0.6, NULL, NULL, 'pluto' FROM parcels WHERE length(trim(owner_name)) > 2),
mentions AS (SELECT *, {_KEY('name')} AS key, {_KIND('name')} AS entity_type FROM raw WHERE length({_KEY('name')}) >= 3),
heads AS (SELECT key, arg_min(name, (seq, name)) AS canonical_name, arg_min(entity_type, (seq, name)) AS entity_type, count(DISTINCT name) - 1 AS n_aliases FROM mentions GROUP BY key),
lots AS (SELECT key, count(DISTINCT bbl) AS n_parcels FROM mentions GROUP BY key),
entities AS (SELECT sha256(upper(key) || '|' || entity_type) AS id, * FROM heads JOIN lots USING (key)),
links AS (SELECT id AS owner_entity_id, bbl, relationship AS relationship_type, arg_min(confidence, (seq, m.source, confidence)) AS confidence FROM mentions m JOIN entities USING (key) GROUP BY ALL)"""


def _mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first mention of each name in documents and parcels, and all mentions, by number and dealt by parcel."""
    lots = deeds.documents_of_lots(derived.master(spark, sf_dir), derived.legals(spark, sf_dir))
    parcels = derived.parcels(spark, sf_dir).select("bbl", F.col("ownername").alias("owner_name"))
    packed, names = owners.packed_mentions(lots, derived.parties(spark, sf_dir), parcels)
    return owners.named(packed, names), owners.unpacked(packed, names)


def _ids(mentions: DataFrame) -> DataFrame:
    return small(written(owners.entity_ids(mentions), "entities"))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links by the number of the entity, and the entities."""
    mentions, by_parcel = _mentions(spark, sf_dir)
    return owners.entity_links(by_parcel, None), _ids(mentions)


@query(f"WITH {MENTIONS} SELECT id, key, canonical_name, entity_type, n_aliases, n_parcels FROM entities")
def build_owner_entities(spark, sf_dir):
    return owners.build_entities(*_mentions(spark, sf_dir)).select("id", "key", "canonical_name", "entity_type", F.size("aliases").cast("long").alias("n_aliases"), "n_parcels")


@query(f"WITH {MENTIONS} SELECT owner_entity_id, bbl, array_to_string(list_sort(list_distinct(list(relationship_type))), ',') AS relationship_types, max(confidence) AS confidence, count(*) AS n_evidence FROM links GROUP BY owner_entity_id, bbl")
def owner_portfolios(spark, sf_dir):
    links, entities = _links(spark, sf_dir)
    found = owners.identified(portfolio.portfolio(links, [k[0] for k in owners.KINDS[:3]]), entities)
    return found.withColumn("relationship_types", F.array_join("relationship_types", ","))


@query(f"""WITH {MENTIONS}, l AS (SELECT DISTINCT owner_entity_id, bbl FROM links WHERE relationship_type = 'owner'),
  p AS (SELECT a.owner_entity_id, b.owner_entity_id AS other_id, count(*) AS shared_parcels FROM l a JOIN l b ON a.bbl = b.bbl AND a.owner_entity_id <> b.owner_entity_id GROUP BY ALL),
  t AS (SELECT owner_entity_id AS other_id, count(*) AS total_parcels FROM l GROUP BY ALL)
  SELECT owner_entity_id, other_id, shared_parcels, total_parcels, 'owner' AS relationship_types FROM p JOIN t USING (other_id) QUALIFY row_number() OVER (PARTITION BY owner_entity_id ORDER BY shared_parcels DESC, total_parcels DESC, other_id) <= 50""")  # fmt: skip
def co_owners(spark, sf_dir):
    links, entities = _links(spark, sf_dir)
    found = portfolio.associated_entities(owners.identified(links.filter("relationship_type = 'owner'"), entities))
    return found.withColumn("relationship_types", F.array_join("relationship_types", ","))


@query(f"""WITH {MENTIONS} SELECT id AS owner_entity_id, event_type, bbl, coalesce(occurred_at, DATE '1900-01-01') AS occurred_at, count(*) AS n FROM mentions JOIN entities USING (key) WHERE event_type IS NOT NULL GROUP BY ALL""")
def owner_events(spark, sf_dir):
    mentions, by_parcel = _mentions(spark, sf_dir)
    return owners.identified(owners.dedupe_events(by_parcel, None), _ids(mentions))


@query(f"""WITH {MENTIONS}, b AS (SELECT id AS owner_entity_id, bbl, max(occurred_at) AS occurred_at FROM mentions JOIN entities USING (key) WHERE event_type = 'purchase' GROUP BY ALL),
  few AS (SELECT e FROM (SELECT DISTINCT owner_entity_id AS e FROM links) LEFT JOIN (SELECT owner_entity_id AS e, count(*) AS n FROM b GROUP BY ALL) USING (e) WHERE coalesce(n, 0) < 3),
  a AS (SELECT bbl, max(occurred_at) AS occurred_at FROM b GROUP BY bbl),
  v AS (SELECT DISTINCT l.owner_entity_id, l.bbl, a.occurred_at, true AS via_bbl FROM links l JOIN few ON e = owner_entity_id JOIN a USING (bbl) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.owner_entity_id = l.owner_entity_id AND b.bbl = l.bbl)),
  u AS (SELECT *, false AS via_bbl FROM b UNION ALL SELECT * FROM v)
  SELECT owner_entity_id, bbl, occurred_at, via_bbl FROM u QUALIFY row_number() OVER (PARTITION BY owner_entity_id ORDER BY occurred_at DESC, bbl) <= 30""")  # fmt: skip
def recent_purchases_of_owners(spark, sf_dir):
    mentions, by_parcel = _mentions(spark, sf_dir)
    found = portfolio.recent_purchases(owners.dedupe_events(by_parcel, None), owners.entity_links(by_parcel, None))
    return owners.identified(found, _ids(mentions))


@query(f"""WITH {PARCELS}, n AS (SELECT upper(trim(owner_name)) AS u, CASE WHEN regexp_matches(upper(owner_name), '{_ORG}') THEN 'org' ELSE 'unknown' END AS entity_type, bbl FROM parcels WHERE length(trim(owner_name)) > 2)
  SELECT sha256(u || '|' || entity_type) AS owner_entity_id, count(DISTINCT bbl) AS n_parcels FROM n GROUP BY ALL""")  # fmt: skip
def sync_owners_of_parcels(spark, sf_dir):
    parcels = derived.parcels(spark, sf_dir).select("bbl", F.col("ownername").alias("owner_name"))
    entities = spark.createDataFrame([], "id string, canonical_name string, entity_type string")
    links = spark.createDataFrame([], "owner_entity_id string, bbl string, relationship_type string, confidence double")
    return owners.sync_parcel_owners(parcels, entities, links)[1].groupBy("owner_entity_id").agg(F.countDistinct("bbl").alias("n_parcels"))


@query(rf"""WITH {PARCELS} SELECT owner_name, {_NORM('owner_name')} AS normal, {_STRIP(_NORM('owner_name'))} AS stripped, {_KEY('owner_name')} AS key, {_KIND('owner_name')} AS kind, count(*) AS n FROM parcels GROUP BY owner_name""")
def owner_name_forms(spark, sf_dir):
    c = F.col("ownername")
    forms = derived.parcels(spark, sf_dir).groupBy(c.alias("owner_name")).agg(F.count("*").alias("n"))
    c = F.col("owner_name")
    return forms.select(c, names.norm_name(c).alias("normal"), names.strip_suffixes(names.norm_name(c)).alias("stripped"), names.owner_match_key(c).alias("key"), names.entity_type(c).alias("kind"), "n")


@query(f"WITH {DOCS} SELECT doc_type, CASE WHEN doc_type IN {tuple(keys.DEED_TYPES)} THEN 'deed' WHEN doc_type IN {tuple(keys.MORTGAGE_TYPES)} THEN 'mortgage' WHEN doc_type IN {tuple(keys.REGULATORY_TYPES)} THEN 'regulatory' ELSE 'unknown' END AS category, count(*) AS n, floor(sum(amount) / count(*) * 100 + 0.5::DOUBLE) / 100 AS mean_amount FROM docs GROUP BY doc_type")
def documents_by_category(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    sums = docs.groupBy("doc_type").agg(F.count("*").alias("n"), coerce.js_round(F.sum("amount") / F.count("*"), 2).alias("mean_amount"))
    return sums.withColumn("category", keys.doc_category(F.col("doc_type")))


TAXED = f"""{PARCELS},
zones AS (SELECT unnest({_list(list(zoning.FAR))}) AS zone, unnest([{', '.join(f'{a}::DOUBLE' for a, _ in zoning.FAR.values())}]) AS standard_far, unnest([{', '.join(f'{b}::DOUBLE' for _, b in zoning.FAR.values())}]) AS bonus_far),
zk AS (
  SELECT *, CASE WHEN starts_with(zone_dist, 'R') THEN regexp_extract(zone_dist, '^([A-Z0-9-]*)', 1) WHEN regexp_matches(split_part(zone_dist, '/', 2), '^R[0-9]') THEN regexp_extract(split_part(zone_dist, '/', 2), '^([A-Z0-9-]*)', 1)
    ELSE coalesce({_RES}, zone_dist) END AS zk, 2.0::DOUBLE AS comm_far, 1.0::DOUBLE AS facil_far FROM parcels),
cap AS (
  SELECT *, {_R('far * lot_area')} AS max_res_fa, {_R('greatest(far, comm_far, facil_far) * lot_area')} AS max_buildable_sf, {_R('greatest(greatest(far, comm_far, facil_far) * lot_area - bldg_area, 0::DOUBLE)')} AS buildable_slack_sf,
    {_R('greatest(far * lot_area - bldg_area, 0::DOUBLE)')} AS new_res_fa, bldg_area <= 0 OR land_use = '11' AS is_vacant, regexp_matches(zone_dist, '^(R|C[1-6]|MX)|/R') AS allows_res, {_R('bonus_far * lot_area')} AS qualifying_fa, CASE WHEN standard_far IS NULL THEN 700 ELSE 680 END AS du_factor
  FROM (SELECT zk.*, coalesce(e.standard_far, b.standard_far) AS standard_far, coalesce(e.bonus_far, b.bonus_far) AS bonus_far, greatest(resid_far, coalesce(e.standard_far, b.standard_far, 0)) AS far
    FROM zk LEFT JOIN zones e ON e.zone = zk.zk LEFT JOIN zones b ON b.zone = regexp_extract(zk.zk, '^(R[0-9]+)', 1))),
av AS (
  SELECT *, CASE tax_class WHEN 1 THEN 0.19963::DOUBLE WHEN 2 THEN 0.12439::DOUBLE WHEN 3 THEN 0.12094::DOUBLE ELSE 0.10592::DOUBLE END AS tax_rate,
    CASE WHEN est > 0 THEN est ELSE {_R('(bldg_area + new_res_fa) * 15')} END AS assessed_value
  FROM (SELECT *, CASE WHEN regexp_matches(bldg_class, '^[ABS]') THEN 1 WHEN regexp_matches(bldg_class, '^[UT]') THEN 3 WHEN units_res >= 4 OR regexp_matches(bldg_class, '^[CDR]') THEN 2 WHEN regexp_matches(bldg_class, '^[OKLEFGHIJ]') THEN 4 ELSE 2 END AS tax_class,
    CASE WHEN area > 0 THEN floor(floor(area * [400, 200, 300, 250, 200][borough::INT] + 0.5::DOUBLE) * 0.45::DOUBLE + 0.5::DOUBLE) ELSE 0 END AS est
    FROM (SELECT *, CASE WHEN new_res_fa > 0 THEN new_res_fa ELSE bldg_area END AS area FROM cap)))"""
_SCHEDULES = "[" + ", ".join(f"{{'program': '{p}', 'option': '{o}', 'free': {n}}}" for p, o, n in finance.SCHEDULES) + "]"
PROJECTED = f"""{TAXED},
sch AS (SELECT s.program AS program, s.option AS option, y AS year, CASE WHEN y <= s.free THEN 100 ELSE [80, 60, 40, 20, 10][(y - s.free - 1) // 2 + 1] END AS pct
  FROM (SELECT unnest({_SCHEDULES}) AS s), range(1, 41) t(y) WHERE y <= s.free + 10),
proj AS (
  SELECT bbl, program, option, year, exemption, floor(greatest(assessed_value - exemption, 0::DOUBLE) * tax_rate * 100 + 0.5::DOUBLE) / 100 AS net_tax, floor(assessed_value * tax_rate * 100 + 0.5::DOUBLE) / 100 AS flat_tax,
    floor(floor(assessed_value * pow(1.02::DOUBLE, year - 1) + 0.5::DOUBLE) * tax_rate * 100 + 0.5::DOUBLE) / 100 AS growth_tax
  FROM (SELECT *, floor(assessed_value * (pct::DOUBLE / 100) * 100 + 0.5::DOUBLE) / 100 AS exemption FROM av, sch WHERE program <> '421-a'))"""
UNITS = """units AS (
  SELECT l_orderkey % 50 AS scenario, ['Studio', '1BR', '2BR', '3BR', '2BR'][l_quantity::INT % 5 + 1] AS unit_type, CASE WHEN l_returnflag = 'A' THEN 0 ELSE [40, 60, 80, 75, 100, 130, 55][l_linenumber] END AS ami_band,
    300 + l_quantity * 20 AS area_sf, l_returnflag AS allocation, l_orderkey % 200 AS doc_id FROM lineitem),
alloc0 AS (SELECT scenario, unit_type, ami_band, count(*) AS count, sum(area_sf) AS total_sf FROM units GROUP BY ALL)"""
_RENTS = "[" + ", ".join(f"{{'t': '{t}', 'a': {a}, 'r': {float(r)}::DOUBLE}}" for a, rs in finance.RENTS.items() for t, r in zip(finance.UNIT_TYPES, rs, strict=True)) + "]"
ALLOC = f"""{UNITS}, rents AS (SELECT x.t AS t, x.a AS a, x.r AS r FROM (SELECT unnest({_RENTS}) AS x)),
alloc AS (SELECT scenario, unit_type, ami_band, count, total_sf, total_sf / count AS avg_sf,
  (SELECT r FROM rents WHERE t = unit_type ORDER BY abs(a - CASE WHEN ami_band > 0 THEN ami_band ELSE 165 END), a LIMIT 1) AS monthly_rent FROM alloc0)"""


def _capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = screening.parcel_metrics(derived.parcels(spark, sf_dir)).drop("max_buildable_sf", "slack_sf")
    return finance.capacity(typed.withColumns({"comm_far": F.lit(2.0), "facil_far": F.lit(1.0)}))


def _taxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finance.assessed_value(_capacity(spark, sf_dir)).withColumn("programs", F.array(F.lit("485-x"), F.lit("467-m")))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey % 50 as scenario", "array('Studio', '1BR', '2BR', '3BR', '2BR')[cast(l_quantity as int) % 5] as unit_type",
        "case when l_returnflag = 'A' then 0 else array(40, 60, 80, 75, 100, 130, 55)[l_linenumber - 1] end as ami_band", "300 + l_quantity * 20 as area_sf", "l_returnflag as allocation", "l_orderkey % 200 as doc_id",
    )


@query(f"WITH {TAXED} SELECT bbl, max_res_fa, max_buildable_sf, buildable_slack_sf, new_res_fa, is_vacant, allows_res, qualifying_fa, du_factor FROM cap")
def building_capacity(spark, sf_dir):
    return _capacity(spark, sf_dir).select("bbl", "max_res_fa", "max_buildable_sf", "buildable_slack_sf", "new_res_fa", "is_vacant", "allows_res", "qualifying_fa", "du_factor")


@query(f"WITH {TAXED} SELECT bbl, tax_class, tax_rate, assessed_value FROM av")
def assessed_values(spark, sf_dir):
    return _taxed(spark, sf_dir).select("bbl", "tax_class", "tax_rate", "assessed_value")


@query(f"WITH {PROJECTED} SELECT program, option, year, count(*) AS n, floor(sum(net_tax) * 100 + 0.5) / 100 AS net_tax, floor(sum(growth_tax) * 100 + 0.5) / 100 AS growth_tax FROM proj WHERE program <> '421-a' GROUP BY ALL")
def tax_projection(spark, sf_dir):
    rows = finance.project_tax(_taxed(spark, sf_dir))
    return rows.groupBy("program", "option", "year").agg(F.count("*").alias("n"), coerce.js_round(F.sum("net_tax"), 2).alias("net_tax"), coerce.js_round(F.sum("growth_tax"), 2).alias("growth_tax"))


@query(f"""WITH {PROJECTED}, t AS (SELECT bbl, program, option, sum(net_tax) AS n, sum(growth_tax) AS g FROM proj GROUP BY ALL)
  SELECT bbl, program, option, floor((g - n) * 100 + 0.5) / 100 AS real_savings FROM t QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY floor((g - n) * 100 + 0.5) DESC, program DESC, option DESC) = 1""")  # fmt: skip
def best_tax_scenario(spark, sf_dir):
    return finance.best_scenario(finance.tax_savings(finance.project_tax(_taxed(spark, sf_dir))))


@query(f"""WITH {TAXED} SELECT bbl, year, growth_tax, floor(sum(growth_tax) OVER (PARTITION BY bbl ORDER BY year) * 100 + 0.5) / 100 AS total_tax FROM (
  SELECT bbl, y::INT AS year, floor(floor(assessed_value * pow(1.02::DOUBLE, y - 1) + 0.5::DOUBLE) * tax_rate * 100 + 0.5::DOUBLE) / 100 AS growth_tax FROM av, range(1, 41) t(y))""")  # fmt: skip
def growing_tax(spark, sf_dir):
    return finance.tax_baseline(_taxed(spark, sf_dir)).withColumn("total_tax", coerce.js_round(F.col("total_tax"), 2))


_OPTIONS = "[" + ", ".join(f"{{'o': '{n}', 's': {s}::DOUBLE, 'lo': {lo}, 'hi': {hi or 'NULL'}, 'ami': {ami}, 'pct': {pct}}}" for n, s, a, y, lo, hi, bands in finance.OPTIONS_485X for ami, pct in bands) + "]"


@query(f"""WITH {TAXED}, o AS (SELECT unnest({_OPTIONS}) AS x), u AS (SELECT *, CASE WHEN max_res_fa <= 0 THEN 0 ELSE floor(max_res_fa / du_factor) + CASE WHEN max_res_fa / du_factor - floor(max_res_fa / du_factor) >= 0.75 THEN 1 ELSE 0 END END::INT AS total_units FROM cap),
  r AS (SELECT *, x.o AS option, x.ami AS max_ami, CASE WHEN total_units <= 0 THEN 0 ELSE ceil(total_units * x.s) END::INT AS affordable_units, {_R('x.s * max_res_fa')} AS affordable_fa FROM u, o)
  SELECT bbl, option, max_ami, total_units, affordable_units, affordable_fa, ceil(affordable_units * x.pct / 100)::INT AS band_units, {_R('x.pct::DOUBLE / 100 * affordable_fa')} AS band_fa, allows_res AND new_res_fa > 0 AND total_units >= 6 AS eligible,
    total_units >= x.lo AND coalesce(total_units <= x.hi, true) AS applicable FROM r""")  # fmt: skip
def program_options_485x(spark, sf_dir):
    return finance.program_options(_capacity(spark, sf_dir)).select("bbl", "option", "max_ami", "total_units", "affordable_units", "affordable_fa", "band_units", "band_fa", "eligible", "applicable")


@query(f"""WITH {PARCELS} SELECT bbl, least(CASE WHEN lux THEN 500 WHEN land_use IN ('05', '06') OR regexp_matches(bldg_class, '^[OKLEFGHIJ]') THEN 300 WHEN starts_with(zone_dist, 'C') OR (starts_with(zone_dist, 'M') AND contains(zone_dist, '/')) THEN 400
    WHEN regexp_matches(zone_dist, '^R[6-9]') OR land_use IN ('02', '03') OR regexp_matches(bldg_class, '^[CD]') THEN 350 WHEN regexp_matches(zone_dist, '^R[1-5]') OR land_use = '01' OR regexp_matches(bldg_class, '^[ABS]') THEN 325 ELSE 350 END
    + CASE WHEN f > 30 THEN 250 WHEN f > 15 THEN 150 WHEN f > 7 THEN 75 ELSE 0 END + CASE WHEN borough = '1' THEN 75 ELSE 0 END + CASE WHEN lux THEN 150 ELSE 0 END + CASE WHEN year_built > 0 AND year_built < 1940 THEN 75 ELSE 0 END
    + CASE WHEN lot_area > 0 AND lot_area < 2500 THEN 25 ELSE 0 END, CASE WHEN lux THEN 1500 ELSE 1000 END)::INT AS hard_cost FROM (SELECT *, starts_with(bldg_class, 'R') OR starts_with(zone_dist, 'R10') AS lux, year_built % 40 AS f FROM parcels)""")  # fmt: skip
def hard_costs(spark, sf_dir):
    typed = screening.parcel_metrics(derived.parcels(spark, sf_dir)).withColumn("num_floors", F.col("year_built") % 40)
    return finance.hard_cost(typed).select("bbl", F.col("hard_cost").cast("int").alias("hard_cost"))


@query(f"WITH {ALLOC} SELECT * FROM alloc")
def unit_allocations(spark, sf_dir):
    return finance.allocations(_units(spark, sf_dir))


@query(f"""WITH {ALLOC}, s AS (SELECT scenario, sum(count) AS total_units, sum(CASE WHEN ami_band > 0 THEN count ELSE 0 END) AS affordable_units, sum(total_sf) AS total_sf, sum(count * monthly_rent) * 12 AS annual_revenue,
    sum(CASE WHEN ami_band > 0 THEN count * monthly_rent ELSE 0 END) * 12 AS affordable_revenue, sum(ami_band * count) AS w FROM alloc GROUP BY scenario)
  SELECT scenario, total_units, affordable_units, total_sf, annual_revenue, affordable_revenue, total_sf * 350 * 1.25::DOUBLE + total_sf * 150 AS cost, floor(w / affordable_units + 0.5::DOUBLE) AS blended_ami, annual_revenue / (total_sf * 350 * 1.25::DOUBLE + total_sf * 150) AS roi FROM s""")  # fmt: skip
def scenario_evaluation(spark, sf_dir):
    return finance.evaluate_scenarios(finance.allocations(_units(spark, sf_dir)))


@query(f"""WITH {ALLOC}, g AS (SELECT unnest([-0.1, 0.0, 0.1])::DOUBLE AS s), t AS (SELECT scenario, sum(count * monthly_rent) * 12 AS rev, sum(total_sf) AS sf FROM alloc GROUP BY scenario)
  SELECT scenario, a.s AS rent_shock, b.s AS cost_shock, rev * (1 + a.s) / (sf * (350 * (1 + b.s)) * 1.25::DOUBLE + sf * 150) AS roi FROM t, g a, g b""")  # fmt: skip
def scenario_shocks(spark, sf_dir):
    return finance.shock_grid(finance.allocations(_units(spark, sf_dir)))


@query(f"""WITH {UNITS}, b AS (SELECT scenario, unit_type, sum(CASE WHEN ami_band > 0 THEN count ELSE 0 END) AS a, sum(CASE WHEN ami_band = 0 THEN count ELSE 0 END) AS m FROM alloc0 GROUP BY ALL),
  d AS (SELECT scenario, max(abs(a / ta - m / tm)) AS deviation FROM (SELECT *, sum(a) OVER (PARTITION BY scenario) AS ta, sum(m) OVER (PARTITION BY scenario) AS tm FROM b) GROUP BY scenario),
  s AS (SELECT scenario, sum(count) AS n, sum(CASE WHEN ami_band > 0 THEN count ELSE 0 END) AS aff, sum(CASE WHEN ami_band = 60 THEN count ELSE 0 END) AS b60, sum(CASE WHEN ami_band = 80 THEN count ELSE 0 END) AS b80 FROM alloc0 GROUP BY ALL),
  e AS (SELECT s.*, deviation, aff / n - 0.25::DOUBLE AS affordable_slack, least(CASE WHEN b60 >= greatest(1, floor(0.2::DOUBLE * aff)) THEN greatest(b60 / aff - 0.2::DOUBLE, 0) ELSE b60 / aff - 0.2::DOUBLE END,
    CASE WHEN b80 >= greatest(1, floor(0.1::DOUBLE * aff)) THEN greatest(b80 / aff - 0.1::DOUBLE, 0) ELSE b80 / aff - 0.1::DOUBLE END) AS band_slack FROM s JOIN d USING (scenario))
  SELECT scenario, aff / n AS affordable_share, affordable_slack, band_slack, deviation, affordable_slack >= -0.001 AND band_slack >= -0.001 AND 0.1::DOUBLE - deviation >= -0.001 AS feasible FROM e""")  # fmt: skip
def scenario_constraints(spark, sf_dir):
    return finance.check_constraints(finance.allocations(_units(spark, sf_dir)), 0.25, {60: 0.2, 80: 0.1})


@query("""WITH u AS (SELECT l_orderkey % 200 AS doc_id, ['Studio', '1BR', '2BR', '3BR', '2BR'][l_quantity::INT % 5 + 1] AS bedroom, l_returnflag AS allocation, CASE WHEN l_returnflag = 'A' THEN 0 ELSE [40, 60, 80, 75, 100, 130, 55][l_linenumber] END AS ami_band, 300 + l_quantity * 20 AS area_sf FROM lineitem)
  SELECT doc_id, bedroom, allocation, ami_band, count(*) AS n, sum(area_sf) AS area_sf FROM u GROUP BY GROUPING SETS ((doc_id), (doc_id, bedroom), (doc_id, allocation), (doc_id, allocation, bedroom), (doc_id, ami_band))""")  # fmt: skip
def plan_unit_totals(spark, sf_dir):
    return finance.unit_totals(_units(spark, sf_dir).withColumnRenamed("unit_type", "bedroom")).drop("level")


@query("""WITH s AS (SELECT p_partkey // 7 AS g, p_partkey AS k, (p_size + 1)::DOUBLE AS w FROM part), t AS (SELECT *, w / sum(w) OVER (PARTITION BY g) AS share, 100 AS total FROM s),
  f AS (SELECT *, floor(total * share) AS fl, total * share - floor(total * share) AS rest FROM t)
  SELECT g, k, (fl + CASE WHEN row_number() OVER (PARTITION BY g ORDER BY rest DESC, share DESC, k) <= total - sum(fl) OVER (PARTITION BY g) THEN 1 ELSE 0 END)::INT AS units FROM f""")  # fmt: skip
def largest_remainder(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey div 7 as g", "p_partkey as k", "cast(p_size + 1 as double) as w")
    shares = part.withColumns({"share": F.col("w") / F.sum("w").over(Window.partitionBy("g")), "total": F.lit(100)})
    return finance.apportion(shares, ["g"], "total", "share", ties=["k"]).select("g", "k", "units")


@query(f"""WITH {PARCELS}, l AS (SELECT substr(bbl, 2, 5) AS group_id, *, substr(bbl, 1, 1) = '1' AS is_primary FROM parcels)
  SELECT group_id, sum(lot_area) AS lot_area, sum(bldg_area) AS bldg_area, coalesce(min(resid_far) FILTER (resid_far > 0), 0) AS resid_far, coalesce(arg_min(zone_dist, bbl) FILTER (is_primary), arg_min(zone_dist, bbl)) AS zone_dist,
    count(DISTINCT zone_dist) > 1 AS multi_zone, count(*) AS n_lots FROM l GROUP BY group_id""")  # fmt: skip
def lot_assemblages(spark, sf_dir):
    typed = screening.parcel_metrics(derived.parcels(spark, sf_dir))
    number = F.regexp_extract("address", r"^\d+", 0).cast("long")
    lots = typed.withColumns({"group_id": F.substring("bbl", 2, 5), "is_primary": F.col("bbl").startswith("1"), "comm_far": F.lit(2.0), "facil_far": F.lit(1.0), "number": number})
    return finance.assemble(lots, order=["bbl", "number"]).drop("comm_far", "facil_far")


@query()
def contacts_of_documents(spark, sf_dir):
    return contacts.extract_contacts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?is)<nav.*?</nav>', ' ', 'g'), '(?is)<footer.*?</footer>', ' ', 'g'),
    '(?is)<header.*?</header>', ' ', 'g'), '(?is)<noscript.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&nbsp;', ' ', 'g'), '(?i)&amp;', '&', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'), '&#?\w+;', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def text_of_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.html_to_text(F.col("html")).alias("text"))


_TOKENS = lambda c: rf"list_sort(list_distinct(list_filter(string_split_regex(trim(regexp_replace(trim(regexp_replace(upper({c}), '[^A-Z0-9_\s,.-]', '', 'g')), '(\s*,?\s*\b(LLC|INC|CORP|LP)\b\.?)+$', '')), '\s+'), lambda t: t <> '')))"
_WIDE = ["", " EAST", " EAST WING", " EAST WING SOUTH", " SOUTH"]


@query(f"""WITH {PARTIES}, e AS (SELECT substr(document_id, 1, 15) AS bbl, CASE party_type WHEN '1' THEN 'SELLER' ELSE 'OWNER' END AS role, document_id::BIGINT * 10000000 + seq * 1000000 + regexp_extract(name, '([0-9]+)', 1)::BIGINT % 1000000 AS seq,
    regexp_replace(name, '[#0-9]+', '') || ' OF THE OLD TOWN AND RIVER' || {_list(_WIDE)}[(document_id::BIGINT * 3 + seq * 7) % 5 + 1] AS name FROM parties),
  t AS (SELECT bbl, role, min(seq) AS seq, any_value(name) AS name, {_TOKENS('name')} AS tokens, count(*) AS n FROM e GROUP BY bbl, role, {_TOKENS('name')}),
  g AS (SELECT bbl, role, list([{{'seq': seq, 'tokens': tokens, 'head': 0::BIGINT, 'n': n}}] ORDER BY seq) AS l FROM t GROUP BY ALL),
  f AS (SELECT bbl, role, unnest(list_reduce(l, lambda done, x: done || [{{'seq': x[1].seq, 'tokens': x[1].tokens, 'n': x[1].n,
      'head': coalesce(list_filter(done, lambda h: h.seq = h.head AND len(list_intersect(h.tokens, x[1].tokens)) / len(list_distinct(h.tokens || x[1].tokens)) >= 0.85)[1].head, x[1].seq)}}],
      [{{'seq': -1::BIGINT, 'tokens': ['-'], 'head': -2::BIGINT, 'n': 0::BIGINT}}])) AS c FROM g)
  SELECT bbl, role, c.head AS cluster, sum(c.n)::BIGINT AS n_entries, count(*) AS n_sets FROM f WHERE c.seq >= 0 GROUP BY ALL""")  # fmt: skip
def stakeholder_clusters(spark, sf_dir):
    wide = F.element_at(F.array(*map(F.lit, _WIDE)), ((F.col("document_id").cast("long") * 3 + F.col("seq") * 7) % 5 + 1).cast("int"))
    rows = derived.parties(spark, sf_dir).select(
        F.substring("document_id", 1, 15).alias("bbl"), keys.map_role_party(F.col("party_type")).alias("role"), F.expr("cast(document_id as long) * 10000000 + seq * 1000000 + cast(regexp_extract(name, '([0-9]+)', 1) as long) % 1000000 as seq"),
        F.concat(F.regexp_replace("name", "[#0-9]+", ""), F.lit(" OF THE OLD TOWN AND RIVER"), wide).alias("name"),
    )
    found = stakeholders.cluster_stakeholders(rows)
    return found.groupBy("bbl", "role", "cluster").agg(F.count("*").alias("n_entries"), F.countDistinct(names.stakeholder_tokens(F.col("name"))).alias("n_sets"))


# The entries of eight sources in SQL: source order, source, record, role, name, organisation, licence, telephone, e-mail, address and what they are worth.
ENTRIES = f"""f AS (SELECT bbl, event_id AS j, event_id::VARCHAR AS k FROM (SELECT {_bbl('user_id')} AS bbl, event_id FROM events)),
live AS (SELECT * FROM docs WHERE doc_type IN ('DEED', 'DEEDO', 'ADED', 'EXED', 'RDED', 'TORD', 'MTGE', 'AGMT') QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY recorded_date DESC NULLS LAST, document_id DESC) <= 20),
e(o, source, bbl, record_key, role, name, org, licence, phone, phone_worth, email, email_worth, line1, place, address_worth) AS (
  SELECT 0, 'ACRIS_LIVE', bbl, document_id, 'OWNER', trim(unnest(string_split(party2, ';'))), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM live
  UNION ALL SELECT 0, 'ACRIS_LIVE', bbl, document_id, 'SELLER', trim(unnest(string_split(party1, ';'))), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM live
  UNION ALL SELECT 1, 'ACRIS_GRANTEE', bbl, k, CASE WHEN j % 2 = 0 THEN 'OWNER' ELSE 'SELLER' END, 'Bo N' || j % 3, NULL, NULL, NULL, NULL, NULL, NULL, '9 OAK', 'NYC|NY|10001', 0.5 FROM f WHERE j % 5 = 0
  UNION ALL SELECT 2, 'HPD_CONTACTS', bbl, k, CASE WHEN j % 8 = 0 THEN 'MANAGING_AGENT' ELSE 'OWNER' END, 'Bo N' || j % 3, NULL, NULL, NULL, NULL, NULL, NULL, '1 ELM ' || j % 2, 'NYC|NY|10002', 0.9 FROM f WHERE j % 4 = 0
  UNION ALL SELECT 3, 'DOF_VALUATION', bbl, bbl, 'OWNER', 'CITY OF N' || substr(bbl, 10, 1), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM parcels
  UNION ALL SELECT 4, 'PLUTO', bbl, bbl, 'OWNER', trim(owner_name), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM parcels WHERE trim(owner_name) <> ''
  UNION ALL SELECT 5, 'DOB_FILING', bbl, k, 'ARCHITECT', 'Ann Lee', 'ARCH', 'L' || substr(bbl, 10, 1)::INT % 4, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f WHERE j % 2 = 0
  UNION ALL SELECT 5, 'DOB_FILING', bbl, k, 'OWNER', 'BO N' || j % 3 || ' LLC', CASE WHEN j % 6 = 0 THEN 'BO HOLDINGS' END, NULL, '212555000' || j % 4, 0.75, 'b' || j % 2 || '@x.org', 0.8, '1 ELM', '', 0.7 FROM f WHERE j % 2 = 0
  UNION ALL SELECT 5, 'DOB_FILING', bbl, k, 'FILING_REP', 'Rep', 'REPS', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f WHERE j % 2 = 0
  UNION ALL SELECT 6, 'DOB_PERMIT_ISSUANCE', bbl, k, 'OWNER', 'Bo N' || j % 3, NULL, NULL, '(212) 555-000' || j % 4, 0.8, NULL, NULL, '1 ELM 1', '', 0.7 FROM f WHERE j % 3 = 0
  UNION ALL SELECT 7, 'BIS_WEB', bbl, k, 'ENGINEER', 'Ed', NULL, 'L' || substr(bbl, 10, 1)::INT % 4, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM f WHERE j % 7 = 0),
t AS (SELECT *, {_TOKENS('name')} AS tokens FROM e WHERE name <> '')"""
MERGED = f"""{PARCELS}, {DOCS}, {ENTRIES}, people AS (
  SELECT bbl, role, tokens, arg_min(name, o) AS name, arg_min(org, o) AS org_name, min(licence) AS licence, count(*) AS n_entries, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources,
    count(DISTINCT source || record_key) AS n_provenance, max({_map(stakeholders.BASE_CONFIDENCE)}[source]) AS base, count(DISTINCT source) AS n FROM t GROUP BY ALL),
p AS (SELECT bbl, role, tokens, string_agg(v, '|' ORDER BY v) AS phones FROM (SELECT bbl, role, tokens, arg_min(phone || ':' || phone_worth::DOUBLE, (-phone_worth, o)) AS v FROM t WHERE phone IS NOT NULL GROUP BY bbl, role, tokens, regexp_replace(phone, '[^0-9]', '', 'g')) GROUP BY ALL),
m AS (SELECT bbl, role, tokens, string_agg(DISTINCT email, '|' ORDER BY email) AS emails FROM t WHERE email IS NOT NULL GROUP BY ALL),
a AS (SELECT bbl, role, tokens, string_agg(v, '; ' ORDER BY v) AS addresses FROM (SELECT bbl, role, tokens, arg_min(line1 || ':' || place || ':' || source || ':' || address_worth::DOUBLE, (-address_worth, o)) AS v FROM t WHERE line1 IS NOT NULL GROUP BY bbl, role, tokens, line1, place) GROUP BY ALL),
merged AS (SELECT bbl, role, name, org_name, licence, n_entries, sources, n_provenance, phones, emails, addresses, floor(least(base + 0.05::DOUBLE * (n - 1), 0.99::DOUBLE) * 100 + 0.5::DOUBLE) / 100 AS confidence
  FROM people LEFT JOIN p USING (bbl, role, tokens) LEFT JOIN m USING (bbl, role, tokens) LEFT JOIN a USING (bbl, role, tokens))"""


def _merged_stakeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stakeholders of eight sources, merged."""
    f = derived.filings(spark, sf_dir).selectExpr("bbl", "job_number", "cast(job_number as long) as j")
    parcels = derived.parcels(spark, sf_dir)
    blank = lambda *columns: [f"cast(null as string) as {c}" for c in columns]
    sources = {
        "ACRIS_LIVE": _docs(spark, sf_dir),
        "ACRIS_GRANTEE": f.filter("j % 5 = 0").selectExpr("bbl", "job_number as document_id", "if(j % 2 = 0, '2', '1') as party_type", "concat(' Bo N', j % 3) as name", "'9 OAK' as address1", "'NYC' as city", "'NY' as state", "'10001' as zip", *blank("address2")),
        "HPD_CONTACTS": f.filter("j % 4 = 0").selectExpr("bbl", "job_number as registrationcontactid", "if(j % 8 = 0, 'Site Manager', 'JointOwner') as type", "'Bo' as firstname", "concat('N', j % 3) as lastname", "'1' as businesshousenumber", "concat('ELM ', j % 2) as businessstreetname", "'NYC' as businesscity", "'NY' as businessstate", "'10002' as businesszip", *blank("corporationname", "businessapartment")),
        "DOF_VALUATION": parcels.selectExpr("bbl", "concat('CITY OF N', substr(bbl, 10, 1)) as owner"),
        "PLUTO": parcels.select("bbl", "ownername"),
        "DOB_FILING": f.filter("j % 2 = 0").selectExpr(
            "bbl", "job_number", "'RA' as applicant_title", "'Ann Lee' as applicant_name", "'ARCH' as applicant_business", "concat('L', cast(substr(bbl, 10, 1) as int) % 4) as license", "concat('BO N', j % 3, ' LLC') as owner_name", "if(j % 6 = 0, 'BO HOLDINGS', '') as owner_business",
            "concat('212555000', j % 4) as owner_phone", "concat('b', j % 2, '@x.org') as owner_email", "'1 ELM' as owner_address", "'Rep' as rep_name", "'REPS' as rep_business", *blank("permittee_business", "permittee_license", "rep_address"),
        ),
        "DOB_PERMIT_ISSUANCE": f.filter("j % 3 = 0").selectExpr("bbl", "job_number", "concat('Bo N', j % 3) as owner_name", "concat('(212) 555-000', j % 4) as owner_phone", "'1 ELM 1' as owner_address", *blank("owner_business", "permittee_name", "permittee_business", "permittee_license_type", "permittee_license", "permittee_phone")),
        "BIS_WEB": f.filter("j % 7 = 0").selectExpr("bbl", "job_number", "'PE' as applicant_license_type", "'Ed' as applicant_name", "concat('L', cast(substr(bbl, 10, 1) as int) % 4) as applicant_license", *blank("rep_name", "rep_business", "owner_name", "owner_business")),
    }
    return stakeholders.merge_stakeholders(stakeholders.cluster_stakeholders(written(stakeholders.stakeholder_entries(sources), "entries")))


@query(f"""WITH {MERGED}, l AS (SELECT unnest(['L0', 'L1', 'L2']) AS licence, unnest(['2125550009', '(212) 555-0001', '']) AS bp, unnest(['ACTIVE', '', 'EXPIRED']) AS status)
  SELECT bbl, role, name, org_name, n_entries, sources, n_provenance, addresses, CASE WHEN l.bp <> '' THEN coalesce(phones || '|', '') || l.bp || ':0.95' ELSE coalesce(phones, '') END AS phones, coalesce(emails, '') AS emails,
    CASE WHEN status IS NULL THEN confidence ELSE least(confidence + 0.15::DOUBLE, 0.95::DOUBLE) END AS confidence, nullif(status, '') AS license_status FROM merged LEFT JOIN l USING (licence)""")  # fmt: skip
def merged_stakeholders(spark, sf_dir):
    merged = _merged_stakeholders(spark, sf_dir)
    merged = merged.withColumn("license_status", F.lit(None).cast("string"))
    licences = spark.sql("SELECT * FROM VALUES ('L0', 1, '2125550009', '', 'ACTIVE'), ('L1', 1, '(212) 555-0001', NULL, ''), ('L2', 1, '', '', 'EXPIRED') AS t(license, issued, business_phone, business_email, status)")
    found = records.attach_licenses(merged, licences)
    pair = lambda x: F.concat_ws(":", x["value"], x["confidence"].cast("string"))
    sorted_ = lambda c, f, by: F.array_join(F.array_sort(F.transform(c, f)), by)
    place = lambda a: F.concat_ws("|", a["city"], a["state"], a["zip"])
    return found.select(
        "bbl", "role", "name", "org_name", "n_entries", F.array_join("sources", ",").alias("sources"), F.size("provenance").cast("long").alias("n_provenance"),
        F.when(F.size("addresses") > 0, sorted_("addresses", lambda a: F.concat_ws(":", a["line1"], place(a), a["source"], a["confidence"].cast("string")), "; ")).alias("addresses"),
        sorted_("phones", pair, "|").alias("phones"), sorted_("emails", lambda e: e["value"], "|").alias("emails"), "confidence", "license_status",
    )


@query(f"""WITH {MERGED}, o AS (SELECT *, CASE WHEN length(org_name) > 2 THEN org_name ELSE name END AS n FROM merged WHERE role IN ('OWNER', 'MANAGING_AGENT'))
  SELECT {_KEY('n')} AS key, count(DISTINCT bbl) AS n_parcels, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN phones IS NULL THEN [] ELSE list_transform(string_split(phones, '|'), lambda p: regexp_replace(string_split(p, ':')[1], '[^0-9]', '', 'g')) END)))), ',') AS phones,
    array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN emails IS NULL THEN [] ELSE string_split(emails, '|') END)))), ',') AS emails, bool_or(role = 'MANAGING_AGENT') AS manages FROM o WHERE length({_KEY('n')}) >= 3 GROUP BY ALL""")  # fmt: skip
def owners_of_stakeholders(spark, sf_dir):
    mentions = owners.owner_mentions(owners.mentions_from_stakeholders(_merged_stakeholders(spark, sf_dir)))
    entities = owners.build_entities(mentions)
    kinds = owners.entity_links(mentions, owners.entity_ids(mentions)).groupBy("owner_entity_id").agg(F.bool_or(F.col("relationship_type") == "other").alias("manages"))
    of = lambda kind, f: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("contacts", F.array().cast("array<struct<kind:string,value:string,confidence:double>>")), lambda c: c["kind"] == kind), lambda c: f(c["value"])))), ",")
    return entities.join(kinds, F.col("id") == F.col("owner_entity_id")).select("key", "n_parcels", of("phone", names.norm_phone).alias("phones"), of("email", F.lower).alias("emails"), "manages")


@query(rf"""WITH {PARCELS}, o AS (SELECT DISTINCT trim(upper({_STRIP(_NORM('owner_name'))})) AS owner FROM parcels), c AS (SELECT DISTINCT upper(trim(owner_name)) AS entity_name FROM parcels),
  m AS (SELECT owner, entity_name, string_split_regex(owner, '\s+') AS a, string_split_regex(entity_name, '\s+') AS b FROM o JOIN c ON contains(entity_name, owner) WHERE length(owner) >= 3),
  s AS (SELECT owner, entity_name, CASE WHEN owner = entity_name THEN 1 WHEN starts_with(entity_name, owner) THEN 0.9 ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(a)), len(list_distinct(b))) END::DOUBLE AS similarity FROM m)
  SELECT owner, entity_name, similarity FROM s WHERE similarity >= 0.4 QUALIFY row_number() OVER (PARTITION BY owner ORDER BY similarity DESC, entity_name) = 1""")  # fmt: skip
def corporations_of_owners(spark, sf_dir):
    c = F.col("ownername")
    all_names = derived.parcels(spark, sf_dir).select(c)
    asked = all_names.select(F.trim(F.upper(names.strip_suffixes(names.norm_name(c)))).alias("owner"))
    return stakeholders.match_corporations(asked, all_names.select(c.alias("entity_name")))


_GRAMS = lambda c: rf"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3)))))"


@query(rf"""WITH {MENTIONS}, a AS (SELECT id, canonical_name AS name FROM entities UNION SELECT id, m.name FROM mentions m JOIN entities USING (key)),
  q AS (SELECT DISTINCT 'CUSTOMER ' || right(c_name, 4) AS query FROM customer WHERE c_custkey % 50 = 0),
  g AS (SELECT *, {_GRAMS('name')} AS x FROM a), h AS (SELECT *, {_GRAMS('query')} AS y FROM q),
  s AS (SELECT query, id, max(CASE WHEN sim >= 0.3 THEN sim ELSE 0 END) AS similarity FROM (SELECT query, id, name, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS sim FROM g, h) WHERE sim >= 0.3 OR contains(lower(name), lower(query)) GROUP BY ALL)
  SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) <= 25""")  # fmt: skip
def search_owner_entities(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 50 = 0")
    asked = customers.select(F.concat(F.lit("CUSTOMER "), F.right("c_name", F.lit(4))).alias("query"))
    found = owners.search_entities(owners.build_entities(*_mentions(spark, sf_dir)), asked)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH p AS (SELECT p_partkey::VARCHAR AS bbl, -74.0::DOUBLE + (p_partkey % 500) * 0.0005::DOUBLE AS lng, 40.7::DOUBLE + (p_partkey % 331) * 0.0004::DOUBLE AS lat, {_list(['R7D', 'C4-4D', 'R6A', ' r5x ', 'M1', 'D'])}[p_partkey % 6 + 1] AS zone FROM part),
  n AS (SELECT n_nationkey AS k, n_name AS area, -74.0::DOUBLE + (n_nationkey % 5) * 0.05::DOUBLE + 0.00012::DOUBLE AS x, 40.7::DOUBLE + (n_nationkey // 5) * 0.03::DOUBLE + 0.00012::DOUBLE AS y FROM nation),
  z AS (SELECT k AS seq, area, x AS x0, x + 0.02::DOUBLE AS x1, y AS y0, y + 0.02::DOUBLE AS y1, x + 0.005::DOUBLE AS h0, x + 0.01::DOUBLE AS h1, y + 0.005::DOUBLE AS g0, y + 0.01::DOUBLE AS g1 FROM n
    UNION ALL SELECT k, area, x + 0.025::DOUBLE, x + 0.03::DOUBLE, y, y + 0.004::DOUBLE, 0, 0, 0, 0 FROM n UNION ALL SELECT 99, 'ALL', -73.99, -73.8, 40.78, 40.81, 0, 0, 0, 0),
  o AS (SELECT unnest([0, 1, 2, 3, 4]) AS probe, unnest([0, 0, 0, 0.0003, -0.0003])::DOUBLE AS dx, unnest([0, 0.0003, -0.0003, 0, 0])::DOUBLE AS dy),
  h AS (SELECT bbl, arg_min(area, (probe, seq)) AS area, min(probe) > 0 AS via_buffer FROM p, o, z WHERE lng + dx > x0 AND lng + dx < x1 AND lat + dy > y0 AND lat + dy < y1 AND NOT (lng + dx > h0 AND lng + dx < h1 AND lat + dy > g0 AND lat + dy < g1) GROUP BY bbl)
  SELECT bbl, area, via_buffer, CASE WHEN area IS NOT NULL THEN 'eligible' WHEN zone IN ('R7D', ' r5x ') OR zone = 'C4-4D' THEN 'needs_verification' ELSE 'not_eligible' END AS status FROM p LEFT JOIN h USING (bbl)""")  # fmt: skip
def parcels_in_polygons(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("cast(p_partkey as string) as bbl", "-74.0D + (p_partkey % 500) * 0.0005D as lng", "40.7D + (p_partkey % 331) * 0.0004D as lat", "array('R7D', 'C4-4D', 'R6A', ' r5x ', 'M1', 'D')[p_partkey % 6] as zone_dist")
    corner = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey as seq", "n_name as area", "-74.0D + (n_nationkey % 5) * 0.05D + 0.00012D as x", "40.7D + (n_nationkey div 5) * 0.03D + 0.00012D as y")
    box = lambda x0, x1, y0, y1: f"array(array({x0}, {y0}), array({x1}, {y0}), array({x1}, {y1}), array({x0}, {y1}))"
    parts = [corner.selectExpr("cast(seq as int) as seq", "area", f"array({box('x', 'x + 0.02D', 'y', 'y + 0.02D')}, {box('x + 0.005D', 'x + 0.01D', 'y + 0.005D', 'y + 0.01D')}) as rings"), corner.selectExpr("cast(seq as int) as seq", "area", f"array({box('x + 0.025D', 'x + 0.03D', 'y', 'y + 0.004D')}) as rings")]
    city = spark.range(1).selectExpr("99 as seq", "'ALL' as area", f"array({box('-73.99D', '-73.8D', '40.78D', '40.81D')}) as rings")
    return spatial.overlay(points, parts[0].unionByName(parts[1]).unionByName(city), outline=False).select("bbl", "area", "via_buffer", "status")


PLANS = """pages AS (
  SELECT doc_id, page, CASE page WHEN 0 THEN 'COVER SHEET PROPOSED ' || (doc_id % 90 + 1) || ' DWELLING UNITS ' || left(text, 200) WHEN 1 THEN 'ZONING ANALYSIS LOT AREA: ' || (1500 + doc_id % 50 * 100) || ' SF FAR: ' || (doc_id % 9 + 1)
    ELSE 'TOTAL UNITS: ' || (doc_id % 90 + doc_id % 4) || ' ' || text END AS text FROM documents, (SELECT unnest([0, 1, 2]) AS page) WHERE text IS NOT NULL)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL").selectExpr("doc_id", "text", "explode(array(0, 1, 2)) as page")
    return docs.selectExpr(
        "doc_id", "page",
        """case page when 0 then concat('COVER SHEET PROPOSED ', doc_id % 90 + 1, ' DWELLING UNITS ', left(text, 200)) when 1 then concat('ZONING ANALYSIS LOT AREA: ', 1500 + doc_id % 50 * 100, ' SF FAR: ', doc_id % 9 + 1)
        else concat('TOTAL UNITS: ', doc_id % 90 + doc_id % 4, ' ', text) end as text""",
    )


_HITS = " + ".join(f"CASE WHEN regexp_matches(upper(text), '{p}') THEN {w} ELSE 0 END" for p, w, _ in pages.RULES)


@query(f"WITH {PLANS} SELECT doc_id, page, {_HITS} AS score, {_HITS} >= 3 AS relevant FROM pages")
def page_relevance(spark, sf_dir):
    return pages.score_pages(_pages(spark, sf_dir)).select("doc_id", "page", "score", "relevant")


@query(f"""WITH {PLANS}, m AS (SELECT doc_id, page, unnest(flatten([{', '.join(f"regexp_extract_all(upper(text), '{p}', 1)" for p in pages.UNITS)}])) AS v FROM pages)
  SELECT DISTINCT doc_id, page, v::INT AS value FROM m WHERE v::INT BETWEEN 1 AND 500""")  # fmt: skip
def declared_units(spark, sf_dir):
    return pages.unit_mentions(_pages(spark, sf_dir))


@query(f"""WITH {PLANS} SELECT doc_id, (doc_id % 90 + 1)::DOUBLE AS units, (1500 + doc_id % 50 * 100)::DOUBLE AS lot_area, (doc_id % 9 + 1)::DOUBLE AS far FROM pages WHERE page = 0""")
def plan_signals(spark, sf_dir):
    return pages.extract_signals(_pages(spark, sf_dir))


@query("""WITH e AS (SELECT user_id % 20 AS session_id, event_type AS kind, user_id::VARCHAR AS key, ts FROM events), t AS (SELECT max(ts) AS m FROM e)
  SELECT session_id::VARCHAR AS session_id, kind, key, epoch_us(max(ts)) AS at FROM e WHERE kind IN ('view', 'click') GROUP BY ALL""")  # fmt: skip
def search_history(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(user_id % 20 as string) as session_id", "event_type", "cast(user_id as string) as key", "ts as searched_at")
    logs = {k: events.filter(F.col("event_type") == k) for k in ("view", "click")}
    found = activity.search_activity(logs, "2100-01-01", 100 * 366, None)
    return found.select("session_id", "kind", "key", F.unix_micros(F.col("searched_at").cast("timestamp")).alias("at"))


FILINGS = f"""filings AS (SELECT {_bbl('user_id')} AS bbl, event_id::VARCHAR AS job_number, ts::DATE AS filing_date, CASE event_type WHEN 'signup' THEN 'New Building' WHEN 'purchase' THEN 'Demolition' WHEN 'click' THEN 'Alteration' WHEN 'view' THEN 'A2' ELSE 'Foundation' END AS job_type, value FROM events)"""


@query(f"""WITH {FILINGS} SELECT bbl, job_type, job_number, filing_date, n - 1 AS additional_jobs FROM (SELECT *, count(*) OVER (PARTITION BY bbl, job_type) AS n FROM filings)
  QUALIFY row_number() OVER (PARTITION BY bbl, job_type ORDER BY filing_date DESC, job_number DESC) = 1""")  # fmt: skip
def collapsed_jobs(spark, sf_dir):
    return owners.collapse_jobs(derived.filings(spark, sf_dir))


@query(f"""WITH {MENTIONS}, s AS (SELECT bbl, address FROM parcels WHERE year_built % 2 = 0), p AS (SELECT bbl, address FROM parcels WHERE year_built % 3 = 0), l AS (SELECT DISTINCT owner_entity_id, bbl FROM links)
  SELECT owner_entity_id, l.bbl, coalesce(s.address, p.address, ['Manhattan', 'Bronx', 'Brooklyn', 'Queens', 'Staten Island'][left(l.bbl, 1)::INT] || ', Block ' || substr(l.bbl, 2, 5)::INT || ', Lot ' || substr(l.bbl, 7, 4)::INT) AS address
  FROM l LEFT JOIN s ON s.bbl = l.bbl LEFT JOIN p ON p.bbl = l.bbl""")  # fmt: skip
def portfolio_addresses(spark, sf_dir):
    lots = derived.parcels(spark, sf_dir).select("bbl", "address", F.col("yearbuilt").cast("int").alias("y"))
    links, entities = _links(spark, sf_dir)
    return owners.identified(portfolio.portfolio_addresses(links, lots.filter("y % 2 = 0"), lots.filter("y % 3 = 0")), entities)


@query(f"WITH {MENTIONS} SELECT id, canonical_name, n_aliases FROM entities WHERE n_aliases > 1")
def entities_with_aliases(spark, sf_dir):
    return portfolio.alias_warnings(owners.build_entities(*_mentions(spark, sf_dir)), 1).select("id", "canonical_name", F.size("aliases").cast("long").alias("n_aliases"))


@query(f"""WITH {DOCS}, k AS (SELECT bbl FROM docs WHERE doc_type = 'MTGE' AND amount > 300000) SELECT document_id, bbl, doc_type, recorded_date FROM docs WHERE bbl IN (SELECT bbl FROM k)""")
def documents_of_mortgaged_parcels(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return deeds.docs_for_parcels(docs, docs.filter("doc_type = 'MTGE' AND amount > 300000")).select("document_id", "bbl", "doc_type", "recorded_date")


@query(f"""WITH {SCORED}, n AS (SELECT bbl, sale_date, sale_price FROM sales WHERE sale_date < DATE '1997-01-01' QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY sale_date DESC, sale_price DESC, document_id DESC) = 1)
  SELECT s.bbl, CASE WHEN n.bbl IS NULL THEN last_sale_date ELSE n.sale_date END AS last_sale_date, CASE WHEN n.bbl IS NULL THEN last_sale_price ELSE n.sale_price END AS last_sale_price, score FROM scored s LEFT JOIN n USING (bbl)""")  # fmt: skip
def backfilled_last_sales(spark, sf_dir):
    old = derived.rolling_sales(spark, sf_dir).filter("sale_date < DATE '1997-01-01'")
    return sales.backfill_last_sale(_scored(spark, sf_dir), sales.latest_sales(old)).select("bbl", "last_sale_date", "last_sale_price", "score")


@query(f"""WITH {DOCS}, e AS (SELECT borough, max(recorded_date) AS m FROM docs GROUP BY borough) SELECT borough, m + 1 AS gap_from, greatest(date_diff('day', m, DATE '2002-06-30'), 0) AS gap_days FROM e""")
def bulk_source_gaps(spark, sf_dir):
    return live.coverage_gap(deeds.coverage(_docs(spark, sf_dir), AS_OF), "socrata_poll", "2002-06-30")


@query(f"""WITH {DOCS}, e AS (SELECT CASE WHEN doc_type = 'DEED' THEN 'deeds' ELSE 'others' END AS source, recorded_date FROM docs),
  c AS (SELECT source, max(recorded_date) AS d FROM e WHERE source = 'deeds' OR recorded_date < DATE '1998-01-01' GROUP BY source)
  SELECT e.source, max(recorded_date) AS latest, max(d) AS covered_to, max(recorded_date) > max(d) AS run FROM e LEFT JOIN c USING (source) GROUP BY e.source""")  # fmt: skip
def sources_to_poll(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.when(F.col("doc_type") == "DEED", "deeds").otherwise("others").alias("source"), "recorded_date")
    covered = rows.filter("source = 'deeds' OR recorded_date < DATE '1998-01-01'").groupBy("source").agg(F.max("recorded_date").alias("date_to"))
    return live.needs_run(rows, covered)


@query(f"""WITH {FILINGS}, m AS (SELECT bbl, 'job ' || job_type AS name, 'email' AS kind, 'p' || (job_number::BIGINT % 10) || '@acme.org' AS value, value / 1000 AS confidence FROM filings)
  SELECT bbl, kind, value, max(confidence) AS confidence FROM m GROUP BY ALL""")  # fmt: skip
def best_contacts(spark, sf_dir):
    rows = derived.filings(spark, sf_dir).selectExpr("bbl", "'email' as kind", "concat('p', cast(job_number as bigint) % 10, '@acme.org') as value", "value / 1000 as confidence")
    return contacts.dedupe_contacts(rows, ["bbl"])


_PLAIN_OPTIONS = lambda p: "[" + ", ".join(f"{{'o': '{n}', 's': {s}::DOUBLE, 'ami': {ami}, 'pct': {pct}}}" for n, s, _, bands in programs.OPTIONS[p] for ami, pct in bands) + "]"
_UNITS_OF = lambda a: f"CASE WHEN {a} <= 0 THEN 0 ELSE floor({a} / du_factor) + CASE WHEN {a} / du_factor - floor({a} / du_factor) >= 0.75 THEN 1 ELSE 0 END END::INT"


def _option_sql(program: str, eligible: str) -> str:
    return f"""SELECT bbl, '{program}' AS program, x.o AS option, x.ami AS max_ami, total_units, aff AS affordable_units, ceil(aff * x.pct / 100)::INT AS band_units, {_R(f'x.pct::DOUBLE / 100 * {_R("x.s * max_res_fa")}')} AS band_fa, {eligible} AS eligible
  FROM (SELECT *, CASE WHEN total_units <= 0 THEN 0 ELSE ceil(total_units * x.s) END::INT AS aff FROM (SELECT *, {_UNITS_OF('max_res_fa')} AS total_units, unnest({_PLAIN_OPTIONS(program)}) AS x FROM cap))"""


@query(f"WITH {TAXED} {_option_sql('MIH', 'allows_res AND new_res_fa > 0')} UNION ALL {_option_sql('421-a', 'false')}")
def program_options_by_band(spark, sf_dir):
    cap = _capacity(spark, sf_dir)
    both = programs.option_bands(cap, "MIH").unionByName(programs.option_bands(cap, "421-a"))
    return both.select("bbl", "program", "option", "max_ami", "total_units", "affordable_units", "band_units", "band_fa", "eligible")


@query(f"""WITH {TAXED}, b AS (SELECT *, coalesce(qualifying_fa > max_res_fa, false) AS has, {_R('CASE WHEN coalesce(qualifying_fa > max_res_fa, false) THEN (qualifying_fa - max_res_fa) * 0.8::DOUBLE ELSE 0 END')} AS bonus_fa FROM cap),
  u AS (SELECT *, {_UNITS_OF('max_res_fa')} AS base_units, {_UNITS_OF('(max_res_fa + bonus_fa)')} AS units_with_bonus FROM b),
  v AS (SELECT *, greatest(units_with_bonus - base_units, 0) AS bonus_units, bonus_fa >= 10000 AS deep FROM u)
  SELECT bbl, bonus_fa, base_units, units_with_bonus, bonus_units, deep, CASE WHEN units_with_bonus > 0 THEN {_R('bonus_units / units_with_bonus * 10000')} / 100 ELSE 0 END AS affordable_pct,
    CASE WHEN deep THEN greatest(ceil(bonus_units * 0.2::DOUBLE), 1) ELSE ceil(bonus_units * 0.5::DOUBLE) END::INT AS first_units, CASE WHEN deep THEN {_R('bonus_fa * 0.2::DOUBLE')} ELSE {_R('bonus_fa / 2')} END AS first_area,
    allows_res AND max_res_fa > 0 AND has AND regexp_matches(coalesce({_RES}, zone_dist), '^R([6-9]|1[0-2])') AS uap_eligible FROM v""")  # fmt: skip
def affordability_bonus(spark, sf_dir):
    first = F.col("bands")[0]
    found = programs.uap_option(_capacity(spark, sf_dir), 80)
    return found.select("bbl", "bonus_fa", "base_units", "units_with_bonus", "bonus_units", "deep", "affordable_pct", first["units"].alias("first_units"), first["floor_area"].alias("first_area"), "uap_eligible")


@query(f"""WITH {TAXED}, a AS (SELECT *, {_R('max_res_fa * 0.25::DOUBLE')} AS affordable_fa, {_R('max_res_fa * 0.05::DOUBLE')} AS deep_fa, {_UNITS_OF('max_res_fa')} AS n FROM cap),
  h AS (SELECT *, CASE WHEN n <= 0 THEN 0 ELSE ceil(n * 0.25::DOUBLE) END::INT AS affordable_units, {_R('(affordable_fa - deep_fa) * 0.5::DOUBLE')} AS half FROM a)
  SELECT bbl, affordable_fa, deep_fa, affordable_units, CASE WHEN affordable_fa > 0 THEN {_R('(40 * deep_fa + 80 * half + 100 * (affordable_fa - deep_fa - half)) / affordable_fa')} ELSE 0 END AS avg_ami,
    allows_res AND new_res_fa > 0 AND year_built % 3 <> 0 AND NOT (bldg_area > 0 AND NOT is_vacant AND CASE WHEN max_buildable_sf > 0 THEN bldg_area / max_buildable_sf ELSE 0 END < 0.5) AS may_qualify FROM h""")  # fmt: skip
def conversions_467m(spark, sf_dir):
    active = F.when(F.col("year_built") % 3 == 0, F.array(F.lit("Old 421-A benefit"))).otherwise(F.array(F.lit("none")))
    found = programs.program_467m(_capacity(spark, sf_dir).withColumn("active_programs", active))
    return found.select("bbl", "affordable_fa", "deep_fa", "affordable_units", "avg_ami", "may_qualify")


_MIX = "CASE WHEN borough = '1' OR regexp_matches(zone_dist, '^(R10|C5|C6|C1-9|C2-8)') THEN {dense} WHEN borough IN ('2', '5') OR regexp_matches(zone_dist, '^R[3-6]') THEN {family} WHEN regexp_matches(zone_dist, '^R[789]') THEN {middle} ELSE {even} END::DOUBLE[]".format(**programs.MIXES)


@query(f"""WITH {PARCELS}, m AS (SELECT bbl, {_MIX} AS b, CASE WHEN resid_far >= 6 AND year_built % 40 >= 15 THEN 0.05 ELSE 0 END::DOUBLE AS t, CASE WHEN lot_area > 20000 AND resid_far < 3 THEN 0.05 ELSE 0 END::DOUBLE AS l,
    CASE WHEN units_res > 0 AND units_res <= 10 THEN 0.05 ELSE 0 END::DOUBLE AS s FROM parcels),
  r AS (SELECT bbl, b[1] + t - l - s AS w1, b[2] + t - l - s AS w2, b[3] - t + l + s AS w3, b[4] - t + l + s AS w4 FROM m),
  w AS (SELECT bbl, greatest(w1 / (w1 + w2 + w3 + w4), 0) AS studio, greatest(w4 / (w1 + w2 + w3 + w4), 0) AS three, [w1 / (w1 + w2 + w3 + w4), w2 / (w1 + w2 + w3 + w4), w3 / (w1 + w2 + w3 + w4), w4 / (w1 + w2 + w3 + w4)] AS ws FROM r),
  e AS (SELECT bbl, unnest(ws) AS v, unnest(['Studio', '1BR', '2BR', '3BR']) AS ty, unnest([1, 2, 3, 4]) AS i FROM w)
  SELECT bbl, studio, three, (SELECT string_agg(ty, ',' ORDER BY v DESC, i) FROM e WHERE e.bbl = w.bbl AND v >= 0.10::DOUBLE) AS recommended FROM w""")  # fmt: skip
def recommended_unit_mix(spark, sf_dir):
    typed = screening.parcel_metrics(derived.parcels(spark, sf_dir)).withColumn("num_floors", F.col("year_built") % 40)
    return programs.unit_mix(typed).select("bbl", F.col("weights")[0].alias("studio"), F.col("weights")[3].alias("three"), F.array_join("recommended", ",").alias("recommended"))


_MARKET = "[" + ", ".join(f"{{'b': '{b}', 't': '{t}', 'r': {r}::DOUBLE, 'a': {a}::DOUBLE}}" for b, v in programs.MARKET.items() for t, r, a in zip(programs.UNIT_TYPES, *v, strict=True)) + "]"


@query(f"""WITH {PARCELS}, k AS (SELECT bbl, CASE WHEN year_built % 10 = 0 THEN '9' ELSE borough END AS borough FROM parcels), f AS (SELECT unnest({_MARKET}) AS x),
  e AS (SELECT borough, '1BR' AS t, max(lot_area) AS r, 600::DOUBLE AS a, 'stored' AS rent_source FROM k JOIN parcels USING (bbl, borough) WHERE borough = '2' GROUP BY borough UNION ALL SELECT x.b, x.t, x.r, x.a, 'fallback' FROM f WHERE x.b <> '2' UNION ALL SELECT '9', x.t, x.r, x.a, 'default' FROM f WHERE x.b = '3')
  SELECT bbl, t AS unit_type, r AS monthly_rent, rent_source, {_R('a * 0.85::DOUBLE')} AS min_sf, {_R('a * 1.15::DOUBLE')} AS max_sf FROM k JOIN e USING (borough)""")  # fmt: skip
def market_rents_of_parcels(spark, sf_dir):
    lots = screening.parcel_metrics(derived.parcels(spark, sf_dir)).select("bbl", F.when(F.col("year_built") % 10 == 0, "9").otherwise(F.col("borough")).alias("borough"), "lot_area")
    stored = lots.filter("borough = '2'").groupBy(F.col("borough").alias("borough_code")).agg(F.lit("1BR").alias("unit_type"), F.max("lot_area").alias("monthly_rent"), F.lit(600.0).alias("avg_sf"))
    return programs.market_rents(lots.drop("lot_area"), stored).select("bbl", "unit_type", "monthly_rent", "rent_source", "min_sf", "max_sf")


@query(f"""WITH {FILINGS}, f AS (SELECT bbl, job_number, job_type, 'Owner ' || (job_number::BIGINT % 100) AS n, job_number::BIGINT AS j FROM filings)
  SELECT bbl, job_number, CASE WHEN j % 2 = 0 THEN 'Hand ' || n WHEN j % 3 = 0 THEN 'Portal ' || n WHEN j % 5 = 0 THEN n END AS owner_name, CASE WHEN j % 2 = 0 THEN 'a@b.org' END AS owner_email,
    CASE WHEN j % 2 = 0 THEN 'by hand' WHEN j % 3 = 0 OR j % 5 = 0 THEN 'dobnow_payload' END AS owner_contact_source, CASE job_type WHEN 'New Building' THEN 'NB' WHEN 'Demolition' THEN 'DM' WHEN 'Alteration' THEN 'A1' ELSE upper(job_type) END AS job FROM f""")  # fmt: skip
def enriched_filings(spark, sf_dir):
    jobs = derived.filings(spark, sf_dir).withColumns({"j": F.col("job_number").cast("long"), "n": F.concat(F.lit("Owner "), F.col("job_number").cast("long") % 100)})
    none = F.lit(None).cast("string")
    rows = jobs.select("bbl", F.concat("job_number", F.lit("-I1")).alias("job_number"), none.alias("owner_name"), none.alias("owner_email"), none.alias("owner_phone"), filings.norm_job_type(F.col("job_type")).alias("job"))
    manual = jobs.filter("j % 2 = 0").selectExpr("job_number", "concat('Hand ', n) as name", "'a@b.org' as email", "'' as phone", "'by hand' as source")
    portal = jobs.filter("j % 3 = 0").selectExpr("job_number", "concat('Portal ', n) as name", "'' as email", "'' as phone")
    permits = jobs.filter("j % 5 = 0").selectExpr("concat(job_number, '-S2') as job_number", "n as owner_name", "filing_date as approved_date")
    found = filings.enrich_filings(rows, manual, portal, permits)
    return found.select("bbl", F.substring_index("job_number", "-", 1).alias("job_number"), "owner_name", "owner_email", "owner_contact_source", "job")


_TEXTS = "texts AS (SELECT bbl, job_type || CASE WHEN job_number::BIGINT % 7 = 0 THEN ' section 485-x' WHEN job_number::BIGINT % 11 = 0 THEN ' with MIH' ELSE '' END AS text FROM filings)"
_MENTIONED = "p AS (SELECT DISTINCT bbl, '485-x' AS program FROM texts WHERE contains(upper(text), '485-X') UNION ALL SELECT DISTINCT bbl, 'MIH' FROM texts WHERE contains(upper(text), 'MIH'))"


def _mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = "cast(job_number as bigint)"
    return filings.program_mentions(derived.filings(spark, sf_dir).selectExpr("bbl", f"concat(job_type, case when {j} % 7 = 0 then ' section 485-x' when {j} % 11 = 0 then ' with MIH' else '' end) as text"))


@query(f"WITH {FILINGS}, {_TEXTS}, {_MENTIONED} SELECT bbl, string_agg(program, ',' ORDER BY program) AS mentions FROM p GROUP BY bbl")
def mentioned_programs(spark, sf_dir):
    return _mentioned(spark, sf_dir).select("bbl", F.array_join("mentions", ",").alias("mentions"))


@query(f"""WITH {SCORED}, {FILINGS}, {_TEXTS}, {_MENTIONED}, n AS (SELECT bbl, count(*) AS n, bool_or(program = '485-x') AS x FROM p GROUP BY bbl),
  j AS (SELECT bbl, least(15, max(CASE job_type WHEN 'New Building' THEN 15 ELSE 0 END) + max(CASE job_type WHEN 'Demolition' THEN 12 ELSE 0 END) + max(CASE job_type WHEN 'Alteration' THEN 8 ELSE 0 END)) AS pipeline FROM filings GROUP BY bbl),
  d AS (SELECT bbl, CASE WHEN ubr >= 3 THEN 30 WHEN ubr >= 2 THEN 25 WHEN ubr >= 1.5 THEN 20 WHEN ubr >= 1.2 THEN 15 WHEN ubr >= 1 THEN 10 ELSE 0 END
      + CASE WHEN last_sale_price > 0 OR year_built % 2 = 0 THEN least(25, 5 + CASE WHEN days <= 730.5 THEN 10 WHEN days <= 1826.25 THEN 5 ELSE 0 END + CASE WHEN ppsf > 0 AND ppsf < 100 THEN 10 WHEN ppsf > 0 AND ppsf < 250 THEN 5 ELSE 0 END
          + CASE WHEN last_sale_price > 0 AND year_built % 2 = 0 THEN 3 ELSE 0 END) ELSE 0 END
      + least(45, CASE WHEN land_use = '11' THEN 20 WHEN land_use = '10' THEN 15 WHEN land_use IN ('01', '02', '03') AND year_built % 5 <= 2 AND lot_area > 5000 THEN 10 ELSE 0 END + CASE WHEN bldg_area / lot_area < 1 AND max_buildable_sf / lot_area > 2 THEN 5 ELSE 0 END
          + CASE WHEN regexp_matches(zk, '^R([6-9]|10)') THEN 5 ELSE 0 END + 5 * (uap::INT + p485::INT + p467::INT) + CASE WHEN resid_far >= 3 THEN 5 ELSE 0 END) + coalesce(pipeline, 0) - 3 * coalesce(n, 0) AS dev,
      least(30, CASE WHEN regexp_matches(zone_dist, '^(R|C|M1)') THEN 10 ELSE 0 END + CASE WHEN x THEN 10 ELSE 0 END + CASE WHEN year_built % 4 = 0 THEN 5 ELSE 0 END) AS rental_overlay
    FROM scored LEFT JOIN n USING (bbl) LEFT JOIN j USING (bbl)),
  e AS (SELECT bbl, least(greatest(dev, 0), 100)::INT AS dev_score, rental_overlay::INT AS rental_overlay FROM d)
  SELECT *, CASE WHEN dev_score + rental_overlay >= 76 THEN 'Very High' WHEN dev_score + rental_overlay >= 51 THEN 'High' WHEN dev_score + rental_overlay >= 26 THEN 'Moderate' ELSE 'Low' END AS class FROM e""")  # fmt: skip
def lot_scores(spark, sf_dir):
    area, lot, most = F.col("bldg_area"), F.col("lot_area"), F.col("max_buildable_sf")
    lots = _scored(spark, sf_dir).withColumns(
        {
            "ratio": F.when(area > 0, most / area).when(most > 0, 999.0).otherwise(0.0), "ppsf": F.when(area > 0, F.col("last_sale_price") / area), "sale_amount": F.col("last_sale_price"), "sale_date": F.col("last_sale_date"),
            "other_amount": F.when(F.col("year_built") % 2 == 0, 1.0), "num_floors": F.col("year_built") % 5, "built_far_calc": area / lot, "max_far": most / lot, "registered": F.col("year_built") % 4 == 0,
            "eligible": F.transform(F.filter("program_flags", lambda f: f["eligible"]), lambda f: f["program"]),
        }
    )
    types = derived.filings(spark, sf_dir).groupBy("bbl").agg(F.collect_set(filings.norm_job_type(F.col("job_type"))).alias("job_types"))
    joined = lots.join(types, "bbl", "left").join(_mentioned(spark, sf_dir), "bbl", "left")
    return filings.lot_score(joined, AS_OF).select("bbl", "dev_score", "rental_overlay", "class")


@query("""WITH r AS (SELECT l_orderkey % 50 AS group_id, [40, 60, 80, 75, 100, 130, 55][l_linenumber] AS band, l_returnflag AS program, l_quantity / 64 AS pct FROM lineitem),
  b AS (SELECT group_id, band, max(pct) AS pct, string_agg(DISTINCT program, ',' ORDER BY program) AS programs FROM r GROUP BY ALL),
  s AS (SELECT *, CASE WHEN t > 1 THEN pct / t ELSE pct END AS share FROM (SELECT *, sum(pct) OVER (PARTITION BY group_id) AS t FROM b)),
  f AS (SELECT *, greatest(floor(share * 100), 1) AS fl, share * 100 - greatest(floor(share * 100), 1) AS rest FROM s)
  SELECT group_id, band, share AS pct, 100 AS target, (fl + CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY rest DESC, band) <= 100 - sum(fl) OVER (PARTITION BY group_id) THEN 1 ELSE 0 END)::INT AS min_units, programs FROM f""")  # fmt: skip
def merged_constraints(spark, sf_dir):
    rules = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey % 50 as group_id", "array(40, 60, 80, 75, 100, 130, 55)[l_linenumber - 1] as band", "l_returnflag as program", "l_quantity / 64 as pct", "0.25D as min_affordable", "400 as est_units"
    )
    return programs.merge_constraints(rules).withColumn("programs", F.array_join("programs", ","))


# Detailed metrics, overlay, valuations, registrations, licences, filings of two systems.
_R2 = lambda x: f"floor(({x}) * 100 + 0.5::DOUBLE) / 100"


@query(f"""WITH {PARCELS}, m AS (SELECT *, greatest(coalesce(resid_far, 0), 2.0::DOUBLE, 0.5::DOUBLE) AS far, CASE WHEN year_built % 3 = 0 THEN lot_area * 100 WHEN year_built % 2 = 0 THEN 5000 ELSE 0 END::DOUBLE AS paid FROM parcels)
  SELECT bbl, {_R2('CASE WHEN lot_area > 0 THEN bldg_area / lot_area ELSE 0 END')} AS built_far_calc, {_R2('far')} AS max_allowable_far, {_R('far * lot_area')} AS max_buildable_sf, {_R('far * lot_area - bldg_area')} AS buildable_slack_sf,
    {_R2('CASE WHEN bldg_area > 0 THEN far * lot_area / bldg_area WHEN far * lot_area > 0 THEN 999 ELSE 0 END')} AS underbuilt_ratio, CASE WHEN paid > 0 AND bldg_area > 0 THEN {_R2('paid / bldg_area')} END AS ppsf, CASE WHEN paid > 0 AND far * lot_area > 0 THEN {_R2('paid / (far * lot_area)')} END AS ppbsf FROM m""")  # fmt: skip
def detailed_lot_metrics(spark, sf_dir):
    year = F.col("year_built")
    lots = screening.parcel_metrics(derived.parcels(spark, sf_dir)).withColumns({"comm_far": F.lit(2.0), "facil_far": F.lit(0.5), "amount": F.when(year % 3 == 0, F.col("lot_area") * 100), "other_amount": F.when(year % 2 == 0, 5000.0)})
    return records.lot_metrics(lots).select("bbl", "built_far_calc", "max_allowable_far", "max_buildable_sf", "buildable_slack_sf", "underbuilt_ratio", "ppsf", "ppbsf")


@query(f"""WITH {PARCELS}, b AS (SELECT bbl, ['no', 'yes', 'unknown'][year_built % 3 + 1] AS eligible, year_built % 3 = 0 AS gap, CASE year_built % 5 WHEN 0 THEN 'eligible' WHEN 1 THEN 'not_eligible' WHEN 2 THEN 'needs_verification' WHEN 3 THEN 'unavailable' END AS status, 'A' || borough AS area FROM parcels),
  r AS (SELECT *, coalesce(status, 'unavailable') AS s FROM b)
  SELECT bbl, CASE s WHEN 'unavailable' THEN CASE WHEN eligible = 'no' THEN 'no' ELSE 'unknown' END WHEN 'needs_verification' THEN CASE WHEN eligible = 'no' THEN 'no' ELSE 'needs_verification' END WHEN 'not_eligible' THEN 'no' ELSE CASE WHEN gap THEN eligible ELSE 'yes' END END AS eligible,
    CASE WHEN s <> 'not_eligible' THEN 'Option 1' END AS applicable_option, CASE WHEN gap THEN 'Zoning does not allow it' ELSE '' END || CASE WHEN s = 'not_eligible' THEN CASE WHEN gap THEN '|' ELSE '' END || 'Property is not within an MIH-designated area' ELSE '' END AS gaps,
    CASE s WHEN 'unavailable' THEN 'Check zoning map overlay|Own note' WHEN 'needs_verification' THEN 'Own note|Ask' WHEN 'not_eligible' THEN 'Own note' ELSE CASE WHEN gap THEN 'Own note|Located in MIH area: ' || area ELSE 'Own note|MIH area: ' || area || '|Ask' END END AS notes,
    CASE WHEN s = 'unavailable' THEN 'MIH map layer could not be loaded' ELSE '' END AS missing FROM r""")  # fmt: skip
def overlay_status_of_parcels(spark, sf_dir):
    lots = screening.parcel_metrics(derived.parcels(spark, sf_dir)).select("bbl", "address", "borough", "year_built")  # a key may stand for several lots, an address for one
    gap = F.when(F.col("year_built") % 3 == 0, F.array(F.lit("Zoning does not allow it"))).otherwise(F.array().cast("array<string>"))
    base = lots.select("bbl", "address", F.expr("array('no', 'yes', 'unknown')[year_built % 3]").alias("eligible"), F.lit("Option 1").alias("applicable_option"), gap.alias("gaps"), F.expr("array('Check zoning map overlay', 'Own note')").alias("notes"), F.lit(None).cast("array<string>").alias("missing"))
    place = lots.filter("year_built % 5 < 4").selectExpr("address", "array('eligible', 'not_eligible', 'needs_verification', 'unavailable')[year_built % 5] as status", "concat('A', borough) as area_name", "cast(null as string) as overlay_option", "array('Ask') as overlay_notes")
    return records.apply_overlay(base, place, "address").select("bbl", "eligible", "applicable_option", *(F.array_join(c, "|").alias(c) for c in ("gaps", "notes", "missing")))


@query(f"""WITH v AS (SELECT {_bbl('l_partkey')} AS bbl, l_shipdate::DATE AS extract_date, l_extendedprice AS market_value, 'OWNER ' || l_suppkey AS owner FROM lineitem) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY extract_date DESC, market_value DESC, owner DESC) = 1""")
def latest_valuations(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "lineitem").selectExpr(f"{derived.parcel_key('l_partkey')} as bbl", "cast(l_shipdate as date) as extract_date", "l_extendedprice as market_value", "concat('OWNER ', l_suppkey) as owner")
    return records.latest_valuation(rows)


@query(f"""WITH r AS (SELECT {_bbl('o_custkey')} AS bbl, (o_orderkey % 5000)::VARCHAR AS registration_id, o_orderdate::DATE AS d FROM orders), c AS (SELECT (c_custkey % 5000)::VARCHAR AS registration_id, c_name AS name, c_mktsegment AS phone FROM customer)
  SELECT DISTINCT bbl, registration_id, name, phone FROM r JOIN c USING (registration_id)""")
def contacts_of_registrations(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "orders").selectExpr(f"{derived.parcel_key('o_custkey')} as bbl", "cast(o_orderkey % 5000 as string) as registration_id")
    people = derived.table(spark, sf_dir, "customer").selectExpr("cast(c_custkey % 5000 as string) as registration_id", "c_name as name", "c_mktsegment as phone")
    return records.registration_contacts(rows, people).select("bbl", "registration_id", "name", "phone")


@query(f"""WITH r AS (SELECT {_bbl('o_custkey')} AS bbl, o_orderdate::DATE AS last_registration_date, o_orderkey AS registration_id FROM orders) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY last_registration_date DESC, registration_id DESC) = 1""")
def latest_registrations(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "orders").selectExpr(f"{derived.parcel_key('o_custkey')} as bbl", "cast(o_orderdate as date) as last_registration_date", "o_orderkey as registration_id")
    return records.latest_registration(rows)


@query("""WITH p AS (SELECT c_custkey, 'L' || (c_custkey % 700) AS license, '212-555-' || lpad((c_custkey % 100)::VARCHAR, 4, '0') AS phone, c_custkey % 10 / 10 AS confidence FROM customer),
  l AS (SELECT 'L' || (s_suppkey % 1000) AS license, max(s_suppkey) AS issued FROM supplier GROUP BY ALL), n AS (SELECT l.license, issued, '(212) 555' || lpad((issued % 100)::VARCHAR, 4, '0') AS bp FROM l)
  SELECT c_custkey, p.license, CASE WHEN n.license IS NULL OR issued % 4 = 0 OR regexp_replace(bp, '[^0-9]', '', 'g') = regexp_replace(phone, '[^0-9]', '', 'g') THEN phone ELSE phone || '|' || bp END AS phones, CASE WHEN n.license IS NOT NULL THEN 'x' || issued || '@b.org' ELSE '' END AS emails,
    CASE WHEN n.license IS NULL THEN confidence ELSE least(confidence + 0.15, 0.95::DOUBLE) END AS confidence, CASE WHEN n.license IS NULL OR issued % 3 = 0 THEN 'OLD' ELSE 'ACTIVE' END AS license_status FROM p LEFT JOIN n USING (license)""")  # fmt: skip
def licensed_people(spark, sf_dir):
    some = "array<struct<value:string,confidence:double>>"
    people = derived.table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('L', c_custkey % 700) as license", f"cast(array(struct(concat('212-555-', lpad(cast(c_custkey % 100 as string), 4, '0')) as value, 0.5D as confidence)) as {some}) as phones", f"filter(cast(array(struct(null as value, 0D as confidence)) as {some}), x -> false) as emails", "c_custkey % 10 / 10D as confidence", "'OLD' as license_status")
    licences = derived.table(spark, sf_dir, "supplier").selectExpr("concat('L', s_suppkey % 1000) as license", "s_suppkey as issued", "if(s_suppkey % 4 = 0, 'none', concat('(212) 555', lpad(cast(s_suppkey % 100 as string), 4, '0'))) as business_phone", "concat('X', s_suppkey, '@b.org') as business_email", "if(s_suppkey % 3 = 0, '', 'ACTIVE') as status")
    found = records.attach_licenses(people, licences)
    values = lambda c: F.array_join(F.transform(c, lambda x: x["value"]), "|")
    return found.select("c_custkey", "license", values("phones").alias("phones"), F.lower(values("emails")).alias("emails"), "confidence", "license_status")


_OLD_FORM = {"job": "job_number", "job_description": "job_type", "job_status": "'A'", "existing_no_of_stories": "'0'", "proposed_no_of_stories": "'12 floors'", "applicant_s_first_name": "' Ann '", "applicant_s_last_name": "''", "applicant_professional_title": "'RA'", "applicant_license": "' '", "owner_s_first_name": "'Bo'",
             "owner_s_last_name": "concat('N', cast(j % 50 as string))", "owner_s_business_name": "'B'", "owner_sphone": "'2125550000'", "owner_s_house": "'1'", "owner_s_street": "'MAIN'", "owner_s_city": "''", "owner_s_state": "'NY'", "owner_s_zip": "'10001'", "initial_cost": "'$1,200'", "existing_dwelling_units": "'x'", "proposed_dwelling_units": "cast(j % 20 as string)",
             "approved": "''", "fully_permitted": "'2001-02-03'"}
_NEW_FORM = {"job_filing_number": "job_number", "job_description": "job_type", "filing_status": "'P'", "proposed_no_of_stories": "'5'", "applicant_first_name": "'Cy'", "applicant_last_name": "'Doe'", "applicant_professional_title": "''", "applicant_license": "'77'", "owner_s_business_name": "if(j % 4 = 1, 'Not Applicable', 'ACME')", "owner_s_street_name": "'ELM'", "city": "'NYC'",
             "state": "''", "zip": "''", "rep_first_name": "'R'", "rep_last_name": "'S'", "rep_business_name": "'T'", "initial_cost": "''", "existing_dwelling_units": "'3'", "proposed_dwelling_units": "''", "first_permit_date": "''"}


def _two_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = derived.filings(spark, sf_dir).withColumn("j", F.col("job_number").cast("long")).withColumn("filing_date", F.col("filing_date").cast("string"))
    form = lambda rows, columns: rows.selectExpr("bbl", "job_type", "filing_date", *(f"{e} as {c}" for c, e in columns.items()))
    return records.union_filings(form(jobs.filter("j % 2 = 0"), _OLD_FORM), form(jobs.filter("j % 2 = 1"), _NEW_FORM))


@query(f"""WITH {FILINGS}, f AS (SELECT *, job_number::BIGINT AS j FROM filings)
  SELECT CASE WHEN j % 2 = 0 THEN 'dob_bis' ELSE 'dob_now' END AS source, bbl, job_number, job_type, filing_date::VARCHAR AS filing_date, CASE WHEN j % 2 = 0 THEN 12 ELSE 5 END AS proposed_stories, CASE WHEN j % 2 = 0 THEN 'Ann' ELSE 'Cy Doe' END AS applicant_name, CASE WHEN j % 2 = 1 THEN '77' END AS license,
    CASE WHEN j % 2 = 0 THEN 1200::DOUBLE END AS initial_cost, CASE WHEN j % 2 = 1 THEN 3 END AS existing_units, CASE WHEN j % 2 = 0 AND j % 20 > 0 THEN (j % 20)::INTEGER END AS proposed_units, CASE WHEN j % 2 = 0 THEN 'Bo N' || (j % 50) END AS owner_name, CASE WHEN j % 2 = 0 THEN 'B' WHEN j % 4 <> 1 THEN 'ACME' END AS owner_business,
    CASE WHEN j % 2 = 0 THEN '1, MAIN, NY, 10001' ELSE 'ELM, NYC' END AS owner_address, CASE WHEN j % 2 = 1 THEN 'R S' END AS rep_name, CASE WHEN j % 2 = 0 THEN '2001-02-03' END AS permitted_date, NULL::VARCHAR AS approved_date FROM f""")  # fmt: skip
def filings_of_two_systems(spark, sf_dir):
    found = _two_systems(spark, sf_dir)
    return found.select("source", "bbl", "job_number", "job_type", "filing_date", "proposed_stories", "applicant_name", "license", "initial_cost", "existing_units", "proposed_units", "owner_name", "owner_business", "owner_address", "rep_name", "permitted_date", "approved_date")


@query(f"""WITH {FILINGS}, f AS (SELECT *, job_number::BIGINT AS j FROM filings),
  e AS (SELECT bbl, 'Owner' AS role, CASE WHEN j % 2 = 0 THEN 'Bo N' || (j % 50) WHEN j % 4 <> 1 THEN 'ACME' END AS name, CASE WHEN j % 2 = 0 THEN 'B' END AS business, CASE WHEN j % 2 = 0 THEN '2125550000' END AS phone, CASE WHEN j % 2 = 0 THEN '1, MAIN, NY, 10001' ELSE 'ELM, NYC' END AS address, CASE WHEN j % 2 = 0 THEN 'DOB BIS' ELSE 'DOB NOW' END AS source, j FROM f
    UNION ALL SELECT bbl, 'Filing Rep', 'R S', 'T', NULL, NULL, 'DOB NOW', j FROM f WHERE j % 2 = 1)
  SELECT bbl, role, arg_min(name, j) AS name, arg_min(business, j) FILTER (business IS NOT NULL) AS business, arg_min(phone, j) FILTER (phone IS NOT NULL) AS phone, arg_min(address, j) FILTER (address IS NOT NULL) AS address, array_to_string(list_distinct(list(source)), ',') AS sources FROM e WHERE name IS NOT NULL GROUP BY bbl, role, upper(name)""")  # fmt: skip
def contacts_of_filings(spark, sf_dir):
    rows = _two_systems(spark, sf_dir).withColumns({"seq": F.col("job_number").cast("long"), "from": F.when(F.col("source") == "dob_now", "DOB NOW").otherwise("DOB BIS")})
    none = F.lit(None).cast("string")
    entry = lambda role, name, business, phone, address: F.struct(F.lit(role).alias("role"), F.col(name).alias("name"), F.col(business).alias("business"), phone.alias("phone"), none.alias("email"), address.alias("address"), none.alias("license"), none.alias("license_type"))
    both = F.explode(F.array(entry("Owner", "owner_name", "owner_business", F.col("owner_phone"), F.col("owner_address")), entry("Filing Rep", "rep_name", "rep_business", none, none)))
    entries = rows.select("bbl", both.alias("e"), F.col("from").alias("source"), "seq").select("bbl", "e.*", "source", "seq")
    return records.filing_contacts(entries).select("bbl", "role", "name", "business", "phone", "address", F.array_join("sources", ",").alias("sources"))


# Plan extraction.
@query("""WITH t AS (SELECT p_partkey, p_partkey % 6 AS k, p_partkey % 4 = 0 AND p_partkey % 6 <> 5 AS rooms FROM part)
  SELECT p_partkey, CASE WHEN rooms OR k = 0 THEN 'light_ventilation_schedule' WHEN k IN (1, 4) THEN 'unit_schedule' WHEN k = 2 THEN 'zoning_table' WHEN k = 3 THEN 'occupancy_load' ELSE 'unknown' END AS table_type,
    CASE WHEN rooms THEN 0.95 WHEN k = 0 THEN 0.9 WHEN k = 1 THEN 0.9 WHEN k = 2 THEN 0.8 WHEN k = 3 THEN 0.8 WHEN k = 4 THEN 0.4 ELSE 0.2 END::DOUBLE AS type_confidence FROM t""")  # fmt: skip
def table_classes(spark, sf_dir):
    heads = ["array('Room ID', 'Natural light', 'Ventilation')", "array('Apt', 'AMI')", "array('Lot Area', 'Use Group')", "array('Persons', 'Capacity')", "array('Studio', 'No')", "array('Colour')"]
    cases = " ".join(f"when {i} then {h}" for i, h in enumerate(heads))
    rows = derived.table(spark, sf_dir, "part").selectExpr("p_partkey", f"case p_partkey % 6 {cases} end as headers", "if(p_partkey % 4 = 0 and p_partkey % 6 <> 5, array(array('1', ' kitchen '), array('Bath', '2'), array('x')), array(array('1', 'Kitchen'), array('no', 'room'))) as rows")
    return extraction.classify_tables(rows).select("p_partkey", "table_type", "type_confidence")


@query("""WITH u AS (SELECT l_orderkey % 300 AS doc_id, CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'U' || (l_partkey % 40) END AS unit_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, CASE WHEN l_quantity % 3 = 0 THEN 'UNKNOWN' ELSE '1BR' END AS bedroom_type, CASE WHEN l_quantity % 2 = 0 THEN 1 END AS bedroom_count, CASE WHEN l_returnflag = 'A' THEN 'UNKNOWN' ELSE 'MARKET' END AS allocation, CASE WHEN l_linenumber > 3 THEN 60 END AS ami_band FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY (bedroom_type <> 'UNKNOWN')::INT + (allocation <> 'UNKNOWN')::INT + (bedroom_count IS NOT NULL)::INT + (ami_band IS NOT NULL)::INT DESC, seq, bedroom_type NULLS FIRST, bedroom_count NULLS FIRST, allocation NULLS FIRST, ami_band NULLS FIRST) AS n FROM u)
  SELECT doc_id, unit_id, seq, bedroom_type, bedroom_count, allocation, ami_band FROM r WHERE unit_id = '' OR n = 1""")  # fmt: skip
def deduped_units(spark, sf_dir):
    return extraction.dedupe_units(_unit_records(spark, sf_dir))


def _unit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 300 as doc_id", "if(l_partkey % 9 = 0, '', concat('U', l_partkey % 40)) as unit_id", "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as seq", "if(l_quantity % 3 = 0, 'UNKNOWN', '1BR') as bedroom_type",
        "if(l_quantity % 2 = 0, 1, null) as bedroom_count", "if(l_returnflag = 'A', 'UNKNOWN', 'MARKET') as allocation", "if(l_linenumber > 3, 60, null) as ami_band",
    )


@query("""WITH u AS (SELECT l_orderkey % 300 AS doc_id, l_quantity % 3 = 0 AS b, l_returnflag = 'A' AS a FROM lineitem), s AS (SELECT doc_id, count(*) AS n, count_if(b) AS b, count_if(a) AS a FROM u GROUP BY doc_id)
  SELECT doc_id, n, CASE WHEN b > 0.3::DOUBLE * n THEN b END::BIGINT AS unknown_bedrooms, CASE WHEN a > 0.5::DOUBLE * n THEN a END::BIGINT AS unknown_allocations FROM s""")
def warnings_of_plans(spark, sf_dir):
    return extraction.plan_warnings(_unit_records(spark, sf_dir))


@query("""WITH c AS (SELECT o_orderkey AS doc_id, (10 + o_orderkey % 40)::DOUBLE AS a, CASE WHEN o_orderkey % 3 > 0 THEN 10 + o_orderkey % 40 + o_orderkey % 5 END::DOUBLE AS b, CASE WHEN o_orderkey % 4 = 0 THEN (10 + o_orderkey % 40) * 3 END::DOUBLE AS t FROM orders),
  n AS (SELECT *, 1 + (b IS NOT NULL)::INT + (t IS NOT NULL)::INT AS k, coalesce(abs(a - b) <= 2, false) AS near, t IS NOT NULL AND a < 30 AS conflict FROM c),
  w AS (SELECT *, CASE WHEN near THEN least(1::DOUBLE, 0.9::DOUBLE * 0.9::DOUBLE + 0.1::DOUBLE) ELSE 0.9::DOUBLE * 0.9::DOUBLE END AS ca, CASE WHEN near THEN least(1::DOUBLE, 0.95::DOUBLE * 0.85::DOUBLE + 0.1::DOUBLE) ELSE 0.95::DOUBLE * 0.85::DOUBLE END AS cb FROM n)
  SELECT doc_id, a AS units, CASE WHEN k = 1 THEN 0.6 ELSE ca END::DOUBLE AS confidence, 'cover_sheet' AS source, k AS n_sources, conflict FROM w""")  # fmt: skip
def resolved_units(spark, sf_dir):
    entry = lambda source, value, confidence: f"struct('{source}' as source, cast({value} as double) as value, cast({confidence} as double) as confidence)"
    every = f"array({entry('cover_sheet', '10 + o_orderkey % 40', 0.9)}, {entry('zoning', 'if(o_orderkey % 3 > 0, 10 + o_orderkey % 40 + o_orderkey % 5, null)', 0.95)}, {entry('table', 'if(o_orderkey % 4 = 0, (10 + o_orderkey % 40) * 3, null)', 0.99)})"
    rows = derived.table(spark, sf_dir, "orders").selectExpr("o_orderkey as doc_id", f"explode({every}) as c").select("doc_id", "c.*")
    return extraction.resolve_units(rows)


@query(f"""WITH {PARCELS}, p AS (SELECT bbl AS doc_id, (year_built % 60)::DOUBLE AS units, resid_far * 1.3::DOUBLE AS far, lot_area * (0.8::DOUBLE + year_built % 5 * 0.1::DOUBLE) AS lot, lot_area, resid_far, [(year_built % 60)::DOUBLE, (year_built % 7 * 10)::DOUBLE] AS m FROM parcels),
  q AS (SELECT *, ceil(lot_area * resid_far * 0.8::DOUBLE / 800) AS hi, greatest(1, floor(lot_area * resid_far * 0.8::DOUBLE / 1020)) AS lo FROM p),
  g AS (SELECT doc_id, 'totalUnits' AS field, units AS extracted, greatest(1, floor(lo * 0.25::DOUBLE)) AS low, ceil(hi * 1.5::DOUBLE) AS high,
      CASE WHEN units > ceil(hi * 1.5::DOUBLE) OR units < greatest(1, floor(lo * 0.25::DOUBLE)) THEN 'NEEDS_OVERRIDE' WHEN units > hi * 1.2::DOUBLE OR units < lo * 0.5::DOUBLE THEN 'WARN' ELSE 'PASS' END AS status FROM q WHERE lot_area > 0 AND resid_far > 0
    UNION ALL SELECT doc_id, 'far', far, resid_far * (1 - 0.2::DOUBLE), resid_far * 1.5::DOUBLE, CASE WHEN abs(far - resid_far) / resid_far > 0.2::DOUBLE THEN CASE WHEN far <= resid_far * 1.5::DOUBLE THEN 'WARN' ELSE 'NEEDS_OVERRIDE' END ELSE 'PASS' END FROM q WHERE resid_far > 0
    UNION ALL SELECT doc_id, 'unitCountRedundancy', units, list_min(m), list_max(m), CASE WHEN CASE WHEN units > 0 THEN abs(m[2] - units) / units ELSE 1 END > 0.3::DOUBLE THEN 'CONFLICTING' ELSE 'WARN' END FROM q WHERE abs(m[1] - m[2]) > 2
    UNION ALL SELECT doc_id, 'lotArea', lot, lot_area * 0.85::DOUBLE, lot_area * 1.15::DOUBLE, CASE WHEN abs(lot - lot_area) / lot_area > 0.15::DOUBLE THEN 'NEEDS_OVERRIDE' WHEN abs(lot - lot_area) / lot_area > 0.08::DOUBLE THEN 'WARN' ELSE 'PASS' END FROM q WHERE lot_area > 0)
  SELECT doc_id, field, extracted, low::DOUBLE AS low, high::DOUBLE AS high, status, status IN ('NEEDS_OVERRIDE', 'CONFLICTING') AS needs_manual FROM g""")  # fmt: skip
def gates_of_plans(spark, sf_dir):
    lots = screening.parcel_metrics(derived.parcels(spark, sf_dir))
    plans = lots.selectExpr(
        "bbl as doc_id", "cast(year_built % 60 as double) as units", "resid_far * 1.3D as far", "lot_area * (0.8D + year_built % 5 * 0.1D) as lot_area", "lot_area as parcel_lot", "resid_far as parcel_far",
        "cast(null as double) as legal_far", "array(cast(year_built % 60 as double), cast(year_built % 7 * 10 as double)) as mentions",
    )
    return extraction.validation_gates(plans)


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS w, CASE WHEN l_linenumber >= 3 THEN 0.3 WHEN l_linenumber >= 2 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN l_partkey % 2 = 0 AND l_partkey % 3 = 0 THEN 0.25 WHEN l_partkey % 2 = 0 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN l_partkey % 12 >= 10 THEN 0.2 WHEN l_partkey % 12 >= 5 THEN 0.1 WHEN l_partkey % 12 >= 1 THEN 0.05 ELSE 0 END::DOUBLE
    + CASE WHEN l_suppkey % 2 = 0 THEN 0.15::DOUBLE * ((l_suppkey % 100)::DOUBLE / 100) ELSE 0 END + CASE WHEN l_suppkey % 7 = 0 THEN -0.3 ELSE 0 END::DOUBLE AS s FROM lineitem)
  SELECT doc_id, least(0.99::DOUBLE, floor(sum(greatest(0, least(0.99::DOUBLE, s)) * w) / sum(w) * 100 + 0.5::DOUBLE) / 100) AS confidence FROM p GROUP BY doc_id""")  # fmt: skip
def confidence_of_plans(spark, sf_dir):
    pages_ = derived.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as doc_id", "l_linenumber as weight", "l_linenumber as mapped_columns", "l_partkey % 2 = 0 as total_found", "l_partkey % 3 = 0 as total_consistent", "l_partkey % 12 as unit_rows",
        "l_suppkey % 2 = 0 as ocr_used", "cast(l_suppkey % 100 as double) as ocr_confidence", "l_suppkey % 7 = 0 as totals_conflict",
    )
    return extraction.plan_confidence(extraction.page_confidence(pages_))


@query("""WITH r AS (SELECT p_partkey % 50 AS doc_id, p_partkey AS page, 0 AS nth, 'U' || (p_partkey % 7) AS unit_id, '1BR' AS bedroom_type, 650::DOUBLE AS area_sf FROM part
    UNION ALL SELECT p_partkey % 50, p_partkey, 2, 'u' || (p_partkey % 70), '4BR_PLUS', 1200 FROM part UNION ALL SELECT p_partkey % 50, p_partkey, 3, p_brand, CASE WHEN p_size % 2 = 0 THEN 'STUDIO' ELSE 'UNKNOWN' END, NULL FROM part)
  SELECT doc_id, unit_id, bedroom_type, area_sf, page FROM r WHERE page % 3 > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, upper(unit_id) ORDER BY page, nth) = 1""")  # fmt: skip
def units_of_schedules(spark, sf_dir):
    tables = derived.table(spark, sf_dir, "part").selectExpr(
        "p_partkey % 50 as doc_id", "p_partkey as page", "0 as table_index", "if(p_partkey % 3 = 0, 'zoning_table', 'unit_schedule') as table_type", "array('Floor', 'Apt No.', 'Bed type', 'Net SF') as headers",
        "array(array('1', concat(' U', p_partkey % 7), '1 BR', '650'), array('1', 'Total', '', '9'), array('2', concat('u', p_partkey % 70), '4-bdrm', '1,200'), array('3', p_brand, if(p_size % 2 = 0, 'Studio', 'loft'))) as rows",
    )
    return units.units_from_tables(tables)


@query("""WITH l AS (SELECT o_orderkey AS doc_id, o_custkey % 12 AS n, o_orderkey % 4 AS k FROM orders)
  SELECT doc_id, 'STUDIO' AS bedroom_type, 0 AS bedroom_count, 'MIH_RESTRICTED' AS allocation, 60 AS ami_band, NULL AS unit_id, n AS units FROM l WHERE k = 0 AND n > 0
  UNION ALL SELECT doc_id, '2BR', 2, 'MARKET', NULL, NULL, n FROM l WHERE k = 1 AND n > 0
  UNION ALL SELECT doc_id, '3BR', 3, 'UNKNOWN', NULL, 'A' || n, 1 FROM l WHERE k = 2""")  # fmt: skip
def units_of_lines(spark, sf_dir):
    lines = derived.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as doc_id", "1 as page", "1 as seq",
        """case o_orderkey % 4 when 0 then concat(o_custkey % 12, ' Studio affordable 60% AMI') when 1 then concat('2 BR: ', o_custkey % 12, ' DU free market') when 2 then concat('Apt A', o_custkey % 12, ' with 3 bed') else 'roof' end as text""",
    )
    return units.units_from_lines(lines).groupBy("doc_id", "bedroom_type", "bedroom_count", "allocation", "ami_band", "unit_id").agg(F.count("*").alias("units"))


_LABELLED = "concat(text, ' UNIT ', doc_id % 9 + 1, 'A ', 300 + doc_id % 700, ' SF; 90 SF APT B', doc_id, ' ONE-BEDROOM 650 SF, 1 BR APT ', 400 + doc_id % 50, ' sq. ft')"


@query("""WITH t AS (SELECT doc_id, doc_id % 20 AS page, text || ' UNIT ' || (doc_id % 9 + 1) || 'A ' || (300 + doc_id % 700) || ' SF; 90 SF APT B' || doc_id || ' ONE-BEDROOM 650 SF, 1 BR APT ' || (400 + doc_id % 50) || ' sq. ft' AS text FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, '1BR' AS unit_type, 2 AS n, floor((650 + 400 + doc_id % 50) / 2 + 0.5)::DOUBLE AS average_sf FROM t""")  # fmt: skip
def unit_sizes_of_plans(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return units.unit_sizes(docs.selectExpr("doc_id", f"{_LABELLED} as text"))


def unit_labels_matched(spark, sf_dir):
    """Labels of one sheet a size: no SQL, as the matching is sequential; tested against a plain loop."""
    return units.match_unit_labels(_labels_of_sheets(spark, sf_dir))


QUERIES["unit_labels_matched"] = unit_labels_matched


def _labels_of_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "part").selectExpr(
        "p_partkey div 40 as doc_id", "p_size % 2 as page", "p_partkey as seq", "if(p_partkey % 2 = 0, concat('Unit ', p_partkey % 30, 'B'), concat(50 + p_size * 10, ' sq ft')) as str",
        "cast(p_partkey * 37 % 400 as double) as x", "cast(p_partkey * 91 % 300 as double) as y", "10D as width", "4D as height",
    )


@query("""SELECT o_orderkey AS text_id, 1 AS line, CASE WHEN o_orderkey % 3 > 0 THEN 'C' || o_orderkey END AS crfn, o_orderdate::DATE::VARCHAR AS recorded_date, 'MTGE' AS doc_type, '3' AS borough, o_custkey::VARCHAR AS block, 'John O''Doe Llc' AS party1, '1500000' AS amount,
    CASE WHEN o_orderkey % 3 > 0 THEN 'crfn_C' || o_orderkey ELSE 'hash_' || sha256(o_orderdate::DATE || '|MTGE|' || o_custkey || '||John O''Doe Llc|') END AS dedupe_key FROM orders""")  # fmt: skip
def pasted_rows(spark, sf_dir):
    line = "concat_ws('{0}', if(o_orderkey % 3 > 0, concat('C', o_orderkey), ''), date_format(o_orderdate, 'MM/dd/yyyy'), 'Mortgage', 'Brooklyn', concat('#', o_custkey), \"JOHN  o'doe LLC\", '$1,500,000')"
    head = "concat_ws('{0}', 'CRFN', 'Recorded / Filed', 'Doc Type', 'Boro', 'Block', 'Party 1', 'Amount')"
    form = lambda sign: f"concat_ws('\\n', {head.format(sign)}, {line.format(sign)}, '', {line.format(sign)})"
    texts = derived.table(spark, sf_dir, "orders").selectExpr("o_orderkey as text_id", f"if(o_orderkey % 2 = 0, {form(chr(9))}, {form(' | ')}) as text")
    return pasted.parse_pasted_tables(texts).select("text_id", "line", "crfn", "recorded_date", "doc_type", "borough", "block", "party1", "amount", "dedupe_key")


@query("""WITH m AS (SELECT l_orderkey % 900 AS doc_id, ['cover_sheet', 'zoning', 'table'][l_linenumber % 3 + 1] AS source, l_suppkey % 5 AS page, 10 + l_partkey % 7 AS value FROM lineitem WHERE l_orderkey % 900 > 40),
  r AS (SELECT p_partkey % 1000 AS doc_id, max(8 + p_size % 9) AS units FROM part GROUP BY ALL), n AS (SELECT r.doc_id, count(DISTINCT (source, page)) FILTER (abs(value - units) <= 2) AS n, count(source) AS told FROM r LEFT JOIN m USING (doc_id) GROUP BY ALL)
  SELECT doc_id, CASE WHEN told = 0 THEN 0 WHEN n >= 3 THEN 0.95 WHEN n = 2 THEN 0.85 WHEN n = 1 THEN 0.6 ELSE 0.3 END::DOUBLE AS redundancy FROM n""")  # fmt: skip
def unit_redundancy(spark, sf_dir):
    mentions = derived.table(spark, sf_dir, "lineitem").filter("l_orderkey % 900 > 40").selectExpr("l_orderkey % 900 as doc_id", "array('cover_sheet', 'zoning', 'table')[l_linenumber % 3] as source", "l_suppkey % 5 as page", "10 + l_partkey % 7 as value")
    resolved = derived.table(spark, sf_dir, "part").selectExpr("p_partkey % 1000 as doc_id", "8 + p_size % 9 as u").groupBy("doc_id").agg(F.max("u").alias("units"))
    return pages.redundancy(mentions, resolved)


@query(f"""WITH {PARCELS}, {DOCS}, {FILINGS}, k AS (SELECT * FROM docs WHERE doc_type IN ('DEED', 'DEEDO', 'ADED', 'EXED', 'RDED', 'TORD', 'MTGE', 'AGMT') QUALIFY row_number() OVER (PARTITION BY bbl ORDER BY recorded_date DESC NULLS LAST, document_id DESC) <= 20),
  p AS (SELECT bbl, document_id, 'OWNER' AS role, unnest(string_split(party2, ';')) AS name FROM k UNION ALL SELECT bbl, document_id, 'SELLER', unnest(string_split(party1, ';')) FROM k),
  f AS (SELECT *, job_number::BIGINT AS j FROM filings)
  SELECT bbl, document_id AS record_key, 'ACRIS_LIVE' AS source, role, trim(name) AS name, NULL AS org_name, NULL AS phone, NULL AS address, NULL::DOUBLE AS confidence FROM p WHERE trim(name) <> ''
  UNION ALL SELECT bbl, bbl, 'PLUTO', 'OWNER', trim(owner_name), NULL, NULL, NULL, NULL FROM parcels WHERE trim(owner_name) <> ''
  UNION ALL SELECT bbl, job_number, 'DOB_PERMIT_ISSUANCE', 'GC', CASE WHEN j % 2 = 0 THEN 'Ann' ELSE 'ACME' END, CASE WHEN j % 2 = 0 THEN 'ACME' END, '212' || (j % 100), NULL, NULL FROM f
  UNION ALL SELECT bbl, job_number, 'DOB_PERMIT_ISSUANCE', 'OWNER', 'Bo', NULL, NULL, '1 ELM', 0.7 FROM f WHERE j % 3 = 0""")  # fmt: skip
def stakeholder_entries(spark, sf_dir):
    permits = derived.filings(spark, sf_dir).withColumn("j", F.col("job_number").cast("long")).selectExpr(
        "bbl", "job_number", "if(j % 2 = 0, 'Ann', '') as permittee_name", "'ACME' as permittee_business", "'GC' as permittee_license_type", "'77' as permittee_license", "concat('212', j % 100) as permittee_phone",
        "if(j % 3 = 0, 'Bo', null) as owner_name", "'' as owner_business", "null as owner_phone", "'1 ELM' as owner_address",
    )
    found = stakeholders.stakeholder_entries({"ACRIS_LIVE": _docs(spark, sf_dir), "PLUTO": derived.parcels(spark, sf_dir).select("bbl", "ownername"), "DOB_PERMIT_ISSUANCE": permits})
    return found.select("bbl", "record_key", "source", "role", "name", "org_name", F.get("phones.raw", F.lit(0)).alias("phone"), F.get("addresses.line1", F.lit(0)).alias("address"), F.get("addresses.confidence", F.lit(0)).alias("confidence"))


_RULES_FOUND = """stack(5, 'totalUnits', cast(p_size as string), 0.8D, 'far', cast(p_size % 7 + 1 as string), 0.95D, 'lotArea', cast(2000 + p_size * 10 as string), 0.9D, 'zone', if(p_size % 5 = 0, null, 'R7A'), 0.9D, 'br1', cast(p_size % 3 as string), 0.5D) as (field, value, confidence)"""
_SECOND_FOUND = """stack(6, 'totalUnits', cast(p_size + p_partkey % 5 as string), 'far', cast((p_size % 7 + 1) * if(p_partkey % 2 = 0, 1.5D, 1D) as string), 'lotArea', cast((2000 + p_size * 10) * if(p_partkey % 3 = 0, 2, 1) as string), 'zone', if(p_partkey % 4 = 0, ' r7a', 'R8'), 'br1', cast(p_partkey % 2 as string), 'floors', cast(p_partkey % 2 as string)) as (field, value)"""


@query("""WITH t AS (SELECT p_partkey AS doc_id, p_size::INT AS s, p_partkey AS k, (p_size % 7 + 1)::DOUBLE AS f, CASE WHEN p_partkey % 2 = 0 THEN 1.5 ELSE 1 END::DOUBLE * (p_size % 7 + 1) AS g, (2000 + p_size * 10)::DOUBLE AS l, (2000 + p_size * 10) * CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END::DOUBLE AS m FROM part)
  SELECT doc_id, 'totalUnits' AS field, k % 5 <= 2 AS agreement, s::DOUBLE AS final, NULL AS zone, CASE WHEN k % 5 <= 2 THEN 0.8::DOUBLE + 0.1::DOUBLE ELSE 0.8::DOUBLE - 0.1::DOUBLE END AS confidence FROM t
  UNION ALL SELECT doc_id, 'far', k % 2 = 1, CASE WHEN k % 2 = 0 AND k % 10 < 5 AND abs(f - 9) > abs(g - 9) THEN g ELSE f END, NULL, CASE WHEN k % 2 = 1 THEN 1 ELSE 0.95::DOUBLE END FROM t
  UNION ALL SELECT doc_id, 'lotArea', k % 3 > 0, CASE WHEN k % 3 = 0 AND k % 10 >= 5 AND abs(l - 4000) > abs(m - 4000) THEN m ELSE l END, NULL, CASE WHEN k % 3 > 0 THEN 0.9 ELSE 0.7 END FROM t
  UNION ALL SELECT doc_id, 'zone', CASE WHEN s % 5 > 0 THEN k % 4 = 0 END, NULL, CASE WHEN s % 5 > 0 THEN 'R7A' WHEN k % 4 = 0 THEN 'r7a' ELSE 'R8' END, CASE WHEN s % 5 = 0 THEN 0.7 WHEN k % 4 = 0 THEN 0.9 ELSE 0.6 END FROM t
  UNION ALL SELECT doc_id, 'br1', CASE WHEN s % 3 > 0 THEN s % 3 = k % 2 END, CASE WHEN s % 3 > 0 THEN s % 3 ELSE k % 2 END, NULL, CASE WHEN s % 3 = 0 THEN 0.7 WHEN s % 3 = k % 2 THEN 0.9 ELSE 0.65 END FROM t WHERE s % 3 > 0 OR k % 2 > 0
  UNION ALL SELECT doc_id, 'floors', NULL, 1, NULL, 0.7 FROM t WHERE k % 2 = 1""")  # fmt: skip
def reconciled_fields(spark, sf_dir):
    part = derived.table(spark, sf_dir, "part")
    parcels = part.selectExpr("p_partkey as doc_id", "if(p_partkey % 10 < 5, 'far', 'lotArea') as field", "if(p_partkey % 10 < 5, 9D, 4000D) as value")
    found = reconcile.reconcile_fields(part.selectExpr("p_partkey as doc_id", _RULES_FOUND), part.selectExpr("p_partkey as doc_id", _SECOND_FOUND), parcels)
    zone = F.col("field") == "zone"
    return found.select("doc_id", "field", "agreement", F.when(~zone, F.col("final_value").try_cast("double")).alias("final"), F.when(zone, F.col("final_value")).alias("zone"), "confidence")


@query("""WITH s AS (SELECT l_orderkey % 500 AS doc_id, l_orderkey * 10 + l_linenumber AS seq, ['COVER_SHEET', 'ZONING_SCHEDULE', 'FLOOR_PLAN_LABEL', 'GENERIC'][l_partkey % 4 + 1] AS section, l_quantity::BIGINT % 4 AS q, l_suppkey AS k, l_partkey AS p, l_tax AS c FROM lineitem),
  f AS (SELECT doc_id, arg_min(q * 1000.0::DOUBLE, (seq, section, q)) FILTER (q > 0 AND section IN ('COVER_SHEET', 'ZONING_SCHEDULE')) AS lot_area, least(0.6::DOUBLE, max(c)) AS confidence,
      arg_min(q + k % 9, (seq, section, q + k % 9)) FILTER (k % 3 = 0 AND q + k % 9 > 0 AND section <> 'FLOOR_PLAN_LABEL') AS total FROM s GROUP BY doc_id),
  m AS (SELECT doc_id, sum(q) FILTER (section = 'ZONING_SCHEDULE') AS z, min((seq, section, q)) FILTER (q > 0) AS lead FROM s WHERE section IN ('ZONING_SCHEDULE', 'GENERIC') GROUP BY doc_id),
  n AS (SELECT doc_id, coalesce(z, 0) + CASE WHEN lead[2] = 'GENERIC' THEN lead[3] ELSE 0 END AS br1 FROM m),
  a AS (SELECT doc_id, floor(avg(v) + 0.5) AS sf FROM (SELECT doc_id, unnest([400 + p % 100, 500 + k % 10]) AS v FROM s WHERE section = 'FLOOR_PLAN_LABEL') GROUP BY doc_id)
  SELECT doc_id, lot_area, coalesce(total, nullif(br1, 0))::BIGINT AS total_units, br1::BIGINT AS br1, sf AS studio_sf, confidence FROM f LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id)""")  # fmt: skip
def merged_sections(spark, sf_dir):
    sections = derived.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 500 as doc_id", "l_orderkey * 10 + l_linenumber as seq", "element_at(array('COVER_SHEET', 'ZONING_SCHEDULE', 'FLOOR_PLAN_LABEL', 'GENERIC'), cast(l_partkey % 4 + 1 as int)) as section",
        "cast(l_quantity as bigint) % 4 * 1000D as lot_area", "null as zoning_floor_area", "0D as far", "if(l_suppkey % 3 = 0, cast(l_quantity as bigint) % 4 + l_suppkey % 9, null) as total_units",
        "map('1BR', cast(l_quantity as bigint) % 4) as unit_mix", "map('Studio', array(400D + l_partkey % 100, 500D + l_suppkey % 10)) as unit_sizes", "l_tax as confidence",
    )
    return reconcile.merge_sections(sections).select("doc_id", "lot_area", "total_units", "br1", F.col("average_sf")["Studio"].alias("studio_sf"), "confidence")


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents after a sheet of facts."""
    sheet = """concat('Lot Area: ', 1 + doc_id % 9, ',500 SF; FAR 99; Residential F.A.R.: ', 1 + doc_id % 6, '.25 MAX FAR ', 2 + doc_id % 4, '; Zoning floor area 10,000; proposed GSF: 9,', 100 + doc_id % 800,
      ' Number of dwelling units: ', doc_id % 300, ' bldg area 7000 sq ft # of floors ', doc_id % 40, ' Zone: R', 1 + doc_id % 9, '-2A BIN: ', 1000000 + doc_id, ' Existing building: 4,000 sf, new construction area ', 1000 + doc_id % 3 * 40,
      ' SF; total ', if(doc_id % 5 = 0, 'area 5,000 sq.ft', 'residential area: 5,000 SF'), ' ', text) as text"""
    return derived.table(spark, sf_dir, "documents").filter("text IS NOT NULL").selectExpr("doc_id", sheet)


@query("""WITH t AS (SELECT doc_id AS d FROM documents WHERE text IS NOT NULL)
  SELECT d AS doc_id, unnest(['lotArea', 'zoningFloorArea', 'proposedFloorArea', 'totalUnits', 'buildingArea', 'floors', 'far', 'residFar']) AS field, unnest([(1 + d % 9) * 1000 + 500, 10000, 9100 + d % 800, d % 300, 7000, d % 40, 1.25 + d % 6, 1.25 + d % 6]::DOUBLE[]) AS number, NULL AS code, 0.8::DOUBLE AS confidence FROM t
  UNION ALL SELECT d, unnest(['zoneDistrict', 'bin']), NULL, unnest(['R' || (1 + d % 9) || '-2A', (1000000 + d)::VARCHAR]), 0.85 FROM t""")  # fmt: skip
def facts_of_plans(spark, sf_dir):
    return facts.plan_facts(_stated(spark, sf_dir))


@query("""SELECT doc_id, 4000::DOUBLE AS pre_existing, (1000 + doc_id % 3 * 40)::DOUBLE AS new, 5000::DOUBLE AS total, 0.75::DOUBLE + 0.1::DOUBLE AS sure_pre_existing, 0.75::DOUBLE + 0.1::DOUBLE AS sure_new, 0.75::DOUBLE + 0.1::DOUBLE AS sure_total, true AS reconciled FROM documents WHERE text IS NOT NULL""")
def areas_of_conversions(spark, sf_dir):
    return facts.conversion_areas(_stated(spark, sf_dir))


def _sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned rows of a unit schedule for each order: headers (but for every fourth), a row an item, a sum and a note far below."""
    rows = derived.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("slot")).agg(F.min("l_partkey").alias("p"))
    item = lambda x, text, down="0": f"named_struct('x', {x}D, 'str', {text}, 'down', {down})"
    cells = [item(50, "concat(slot, 'A')"), item(150, "array('STUDIO', '1BR', '2BR', '3BR')[p % 4]", "p % 3 * 0.5"), item(250, "cast(300 + p % 900 as string)", "p % 2 * 0.7"), item(350, "if(p % 5 = 0, null, if(p % 2 = 0, 'INCLUSIONARY', 'MARKET'))", "p % 4 * 0.2"), item(450, "if(p % 2 = 0, '60% AMI', null)", "0.9")]
    heads = [item(50, "'UNIT'"), item(150, "'TYPE'", "0.5"), item(250, "'NET'"), item(272, "'SF'", "1"), item(350, "'ALLOCATION'"), item(450, "'AMI'")]
    of = lambda df, *items: df.select("doc_id", "slot", F.expr(f"inline(array({', '.join(items)}))")).filter("str IS NOT NULL")
    docs = rows.select("doc_id").distinct()
    head = of(docs.filter("doc_id % 4 <> 3").withColumn("slot", F.lit(0)), *heads)
    total = of(docs.withColumn("slot", F.lit(8)), item(50, "concat('TOTAL: ', doc_id % 30, ' UNITS')"))
    note = of(docs.withColumn("slot", F.lit(20)), item(50, "'UNIT 99Z 2BR 900 SF'"))
    every = of(rows, *cells).unionByName(head).unionByName(total).unionByName(note)
    items = every.select("doc_id", F.lit(1).alias("page"), F.xxhash64("slot", "x").alias("seq"), "str", "x", F.expr("700D - 20 * slot - down").alias("y"), (F.length("str") * 6.0).alias("width"), F.lit(10.0).alias("height"))
    return layout.table_rows(layout.page_lines(items))


SHEETS = """r AS (SELECT l_orderkey AS o, l_linenumber AS s, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
a AS (SELECT o, s, p, 0 AS kind FROM r UNION ALL SELECT DISTINCT o, 8, 0, 1 FROM r UNION ALL SELECT DISTINCT o, 20, 0, 2 FROM r),
g AS (SELECT *, 20 * (s - lag(s) OVER (PARTITION BY o ORDER BY s)) AS gap, 20 * min(s) OVER (PARTITION BY o) AS base FROM a),
k AS (SELECT *, max(CASE WHEN gap > greatest(2.5 * base, 24) THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY s) AS cut FROM g)"""


@query(f"""WITH {SHEETS} SELECT o AS doc_id, CASE kind WHEN 2 THEN '99Z' ELSE s || 'A' END AS unit_id, CASE kind WHEN 2 THEN '2BR' ELSE ['STUDIO', '1BR', '2BR', '3BR'][p % 4 + 1] END AS bedroom_type, CASE kind WHEN 2 THEN 2 ELSE p % 4 END::INT AS bedroom_count,
    CASE WHEN kind = 2 OR p % 5 = 0 THEN 'UNKNOWN' WHEN p % 2 = 0 THEN 'MIH_RESTRICTED' ELSE 'MARKET' END AS allocation, CASE WHEN kind = 0 AND p % 2 = 0 THEN 60 END AS ami_band, CASE kind WHEN 2 THEN 900 ELSE 300 + p % 900 END::INT AS area_sf
  FROM k WHERE kind <> 1 AND (o % 4 = 3 OR cut = 0)""")  # fmt: skip
def units_of_positioned_text(spark, sf_dir):
    return layout.units_of_pages(_sheet_rows(spark, sf_dir)).select("doc_id", "unit_id", "bedroom_type", "bedroom_count", "allocation", "ami_band", "area_sf")


@query(f"""WITH {SHEETS} SELECT o AS doc_id, (o % 30)::INT AS total_units FROM k WHERE kind = 1 AND cut = 0 AND o % 4 <> 3 AND o % 30 > 0""")
def totals_of_sheets(spark, sf_dir):
    return layout.declared_totals(layout.tables_of_pages(_sheet_rows(spark, sf_dir))).select("doc_id", "total_units")


@query(f"""WITH {DOCS}, r AS (SELECT *, document_id::BIGINT AS d, row_number() OVER (PARTITION BY document_id ORDER BY bbl) AS n FROM docs),
  k AS (SELECT *, CASE WHEN d % 3 = 0 THEN NULL ELSE 'C' || d END AS c, CASE WHEN d % 5 = 0 THEN NULL ELSE document_id END AS i FROM r WHERE d % 7 > 0 OR n % 2 = 1)
  SELECT document_id AS page_id, i AS document_id, borough, block, lot, bbl, c AS crfn, strftime(recorded_date, '%Y-%m-%d') AS recorded_date, 'Smith & Co' AS party1, 'Roe N' || n AS party2, CASE WHEN d % 4 = 0 THEN NULL ELSE amount END AS amount, d % 2 = 0 AS corrected,
    CASE WHEN d % 6 = 0 THEN 'MTGE' WHEN d % 6 = 1 THEN 'ASST' ELSE 'DEED' END AS doc_type FROM k WHERE c IS NOT NULL OR i IS NULL OR n = (SELECT min(n) FROM k k2 WHERE k2.document_id = k.document_id)""")  # fmt: skip
def saved_result_pages(spark, sf_dir):
    """Every document's parcels as the page that a search shows: rows of two colours, tables inside cells, other rows between."""
    d, row = "cast(document_id as long)", "row_number() OVER (PARTITION BY document_id ORDER BY bbl)"
    cells = [
        f"if({d} % 5 = 0, '<font>det</font>', concat('<a href=# onclick=\"go_detail(&quot;', document_id, '&quot;)\">DET</a> <input type=button onclick=\"go_image(1)\">'))", "array('?', 'Manhattan', 'BRONX', '3', 'queens', 'Staten Island')[cast(borough as int)]", "block", "'1/2'", f"if({d} % 3 = 0, '&nbsp;', concat('C', {d}))",
        "concat(' ', lot, '&nbsp;')", "'ENTIRE LOT'", "''", "date_format(recorded_date, 'M/d/yyyy')", "'9'", "'SMITH &amp; <i>CO</i>'", "concat('roe  n', n)", "'&nbsp;'", "''", f"if({d} % 2 = 0, '<IMG src=\"/img/CHECK.gif\">', '<img src=none.gif>')", f"if({d} % 4 = 0, 'n/a', concat('$', format_number(amount, 2)))",
    ]
    made = _docs(spark, sf_dir).withColumn("n", F.expr(row)).filter(f"{d} % 7 > 0 OR n % 2 = 1")
    line = "concat('<tr bgcolor=', if(n % 2 = 1, '\"#FFFFFF\"', '#c6e2ff'), '>', " + ", ".join(f"'<td>', {c}, '</td>'" for c in cells) + ", '</tr><TR bgcolor=\"#EEEEEE\"><td>note', repeat('<td>x', 16), '</tr>')"
    made = made.select("document_id", F.struct("n", F.expr(line).alias("line")).alias("l")).groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("rows"))
    kind = f"""case {d} % 6 when 0 then '<INPUT value="mtge" type=hidden name="hid_doctype"><b>Deed</b>' when 1 then '<b>Search Results</b><strong class=x> assignment </strong>' else '<input name="hid_doctype" value=""><input name="hid_doctypeselection" value=" deed ">' end"""
    html = made.select(F.col("document_id").alias("page_id"), F.expr(f"concat('<html>', {kind}, '<table><tr><td><table><tr><td>menu</td></tr></table></td></tr><table border=1><tr><th>x</th></tr>', rows, '</table></table></html>')").alias("html"))
    found = result_pages.parse_result_pages(html)
    # The key of the derived tables, which cuts blocks of over five digits.
    found = found.withColumn("bbl", F.when(F.col("bbl").isNotNull(), F.concat("borough", F.lpad("block", 5, "0"), F.lpad("lot", 4, "0"))))
    return found.select("page_id", "document_id", "borough", "block", "lot", "bbl", "crfn", "recorded_date", "party1", "party2", "amount", "corrected", "doc_type")


@query(f"""WITH {DOCS} SELECT document_id AS page_id, document_id, 'C' || document_id AS crfn, doc_type, strftime(recorded_date, '%Y-%m-%d') AS recorded_date, party1, 'B' AS party2, amount, borough, block, lot FROM docs WHERE document_id::BIGINT % 2 = 0
  UNION ALL SELECT document_id, 'L' || document_id, 'X-' || bbl, doc_type, strftime(recorded_date, '%Y-%m-%d'), 'A', '', NULL, '', '', '' FROM docs WHERE document_id::BIGINT % 2 = 1 AND document_id::BIGINT % 3 > 0""")  # fmt: skip
def saved_grid_pages(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("d", F.col("document_id").cast("long"))
    full = """concat('<tr><td><b>', document_id, '</b></td><td>C', document_id, '</td><td>', lower(doc_type), '</td><td></td><td>on ', date_format(recorded_date, 'M/d/yyyy'), '</td><td> ', party1, ' </td><td>B</td><td>$', format_number(amount, 2), '<a href="?borough=', borough, '&amp;block=', block, '&lot=', lot, '"></a></td></tr>')"""
    short = """concat('<tr class="GridAltRow"><td>', if(d % 3 = 0, 'short', ''), '</td><td>', doc_type, '</td><td>', recorded_date, '</td><td>A</td><td>free<i> CRFN: X-', bbl, '</i>', if(d % 3 = 0, '', concat('<a href="/DocumentDetail/L', document_id, '">')), '</td></tr>')"""
    rows = docs.select("document_id", "d", F.expr(f"if(d % 2 = 0, {full}, {short})").alias("r")).groupBy("document_id", "d").agg(F.array_join(F.collect_list("r"), " ").alias("r"))
    html = rows.selectExpr("document_id as page_id", "if(d % 2 = 0, concat('<table id=\"ContentPlaceHolder1_GridViewResults\"><tr><th>h</th></tr>', r, '</table><tr class=\"Row\"><td>1<td>2'), concat('<table>', r, '</table>')) as html")
    return result_pages.parse_grid_pages(html).drop("row")


def _declared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages a document: a sheet before its whole text (a cover for two thirds), a zoning analysis, and one that says otherwise."""
    docs = derived.table(spark, sf_dir, "documents").filter("text IS NOT NULL").selectExpr("doc_id", "text", "posexplode(array(0, 1, 2)) as (page, one)")
    return docs.selectExpr("doc_id", "page", """case page
      when 0 then concat(if(doc_id % 3 = 0, '', 'Cover sheet '), if(doc_id % 5 = 0, '', concat('TOTAL UNITS: ', doc_id % 90 + 1, ' ')), doc_id % 30 + 2, '-STORY; Zoning district R', doc_id % 9 + 1, '-2 / lot area 1,', 100 + doc_id % 800, ' SF. ', translate(text, '0123456789', ''))
      when 1 then concat('ZONING ANALYSIS permitted FAR: ', doc_id % 20, '.5 DWELLING UNITS: ', doc_id % 700, ' ZFA 9,', 100 + doc_id % 800, ' Zone: C', doc_id % 6 + 1, '-4/R8')
      else concat('proposed ', doc_id % 70 + 1, ' dwelling units, 99 stories above grade') end as text""")


@query("""WITH d AS (SELECT doc_id AS k FROM documents WHERE text IS NOT NULL), c AS (SELECT *, k % 3 > 0 AS cover FROM d)
  SELECT k AS doc_id, 'cover_sheet' AS source, 'units' AS signal, (CASE WHEN cover THEN k % 90 + 1 ELSE k % 70 + 1 END)::DOUBLE AS number, NULL AS zone, CASE WHEN cover THEN 0 ELSE 2 END AS page, CASE WHEN cover THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM c WHERE NOT cover OR k % 5 > 0
  UNION ALL SELECT k, 'cover_sheet', 'floors', CASE WHEN cover THEN k % 30 + 2 ELSE 99 END, NULL, CASE WHEN cover THEN 0 ELSE 2 END, CASE WHEN cover THEN 0.9 ELSE 0.7 END FROM c
  UNION ALL SELECT k, 'cover_sheet', 'zone', NULL, 'R' || (k % 9 + 1) || '-2', 0, CASE WHEN cover THEN 0.9 ELSE 0.7 END FROM c
  UNION ALL SELECT k, 'cover_sheet', 'lot_area', 1100 + k % 800, NULL, 0, CASE WHEN cover THEN 0.9 ELSE 0.7 END FROM c
  UNION ALL SELECT k, 'cover_sheet', 'far', k % 20 + 0.5, NULL, 1, 0.7 FROM c WHERE NOT cover AND k % 20 < 15
  UNION ALL SELECT k, 'zoning_text', 'units', CASE WHEN k % 700 = 0 THEN k % 70 + 1 ELSE k % 700 END, NULL, CASE WHEN k % 700 = 0 THEN 2 ELSE 1 END, 0.85 FROM c WHERE k % 700 BETWEEN 1 AND 500
  UNION ALL SELECT k, 'zoning_text', 'lot_area', 1100 + k % 800, NULL, 0, 0.85 FROM c UNION ALL SELECT k, 'zoning_text', 'far', k % 20 + 0.5, NULL, 1, 0.85 FROM c WHERE k % 20 < 15
  UNION ALL SELECT k, 'zoning_text', 'zoning_floor_area', 9100 + k % 800, NULL, 1, 0.85 FROM c UNION ALL SELECT k, 'zoning_text', 'zone', NULL, 'R' || (k % 9 + 1) || '-2', 0, 0.85 FROM c""")  # fmt: skip
def signals_of_plans(spark, sf_dir):
    pages = _declared_pages(spark, sf_dir)
    found = signals.cover_signals(pages).unionByName(signals.zoning_signals(pages))
    return found.select("doc_id", "source", "signal", "number", F.when(F.col("signal") == "zone", F.col("value")).alias("zone"), "page", "confidence")


@query(f"WITH {SCORED}, chosen AS (SELECT * FROM scored WHERE starts_with(bldg_class, 'A') OR starts_with(bldg_class, 'D4')) SELECT bbl, score, ppbsf, (SELECT count(*) FROM chosen) AS total FROM chosen ORDER BY ppbsf DESC NULLS FIRST, score DESC NULLS FIRST, bbl OFFSET 20 LIMIT 20")
def page_with_total_of_screened(spark, sf_dir):
    return screening.page_with_total(screening.search_parcels(_scored(spark, sf_dir), classes=["A", "D4"]), "ppbsf", page=1, size=20).select("bbl", "score", "ppbsf", "total")


@query(f"""WITH {SCORED} SELECT bbl AS "BBL", printf('%.1f', score::DOUBLE) AS "Score", programs AS "Programs", strftime(last_sale_date, '%Y-%m-%d') AS "Last Sale Date", nullif(last_sale_price, 0) AS "Last Sale Price", owner_name AS "Owner", 22 AS n_columns FROM scored""")
def exported_parcels(spark, sf_dir):
    rows = extracts.export_rows(_scored(spark, sf_dir))
    return rows.select("BBL", "Score", "Programs", F.col("Last Sale Date").cast("string").alias("Last Sale Date"), "Last Sale Price", "Owner", F.lit(len(rows.columns)).alias("n_columns"))
