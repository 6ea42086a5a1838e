"""Scalar functions on small rows, with the expectations of the rules they implement."""

import pytest
from pyspark.sql import functions as F

from lotledger.functions import coerce, keys, names, text, zoning


def value(spark, column, **row):
    names_ = list(row)
    types = {str: "string", int: "long", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{n} {types[type(row[n])]}" for n in names_)
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("2025-01-15", "2025-01-15"), ("1/5/2025", "2025-01-05"), ("01.15.2025 10:30 AM", "2025-01-15"), ("Jan 5, 2025", "2025-01-05"), ("5 January 2025", "2025-01-05"), ("1/5/1825", None), ("13/40/2025", None), ("x", None)],
)
def test_to_iso_date(spark, given, wanted):
    assert value(spark, coerce.to_iso_date(F.col("a")), a=given) == wanted


@pytest.mark.parametrize(("given", "wanted"), [("12abc", 12.0), ("", 0.0), (" -3.5", -3.5), ("abc", 0.0), (None, 0.0), ("1e3", 1000.0)])
def test_js_float(spark, given, wanted):
    assert value(spark, coerce.js_float(F.col("a")), a=given) == wanted


def test_rounding(spark):
    assert value(spark, coerce.js_round(F.col("a"), 2), a=1.005) == 1.0
    assert value(spark, coerce.js_round(F.col("a")), a=-0.5) == 0.0
    assert [value(spark, coerce.round34(F.col("a")), a=x) for x in (2.74, 2.75, 3.0)] == [2, 3, 3]
    assert value(spark, coerce.affordable_units(F.col("a"), F.col("b")), a=101, b=25.0) == 26
    assert value(spark, coerce.affordable_units(F.col("a"), F.col("b")), a=0, b=0.25) == 0


def test_build_bbl(spark):
    build = lambda b, k, n: value(spark, keys.build_bbl(F.col("b"), F.col("k"), F.col("n")), b=b, k=k, n=n)
    assert build("1", "100", "50") == "1001000050"
    assert build("6", "100", "50") == "" == build("1", "x", "50")
    assert value(spark, keys.sanitize_bbl(F.col("a")), a="1000010001.00000000") == "1000010001"
    assert value(spark, keys.sanitize_bbl(F.col("a")), a="12") == "0000000012"
    assert value(spark, keys.format_bbl(F.col("a")), a="1000010001") == "1-00001-0001"
    assert value(spark, keys.parse_bbl(F.col("a")), a="9000010001") is None
    assert value(spark, keys.bbl_label(F.col("a")), a="3001230045") == "Brooklyn, Block 123, Lot 45"


def test_names(spark):
    one = lambda f, a: value(spark, f(F.col("a")), a=a)
    assert one(names.strip_suffixes, "ACME HOLDINGS, L.L.C.") == "ACME HOLDINGS"
    assert one(names.strip_suffixes, "ACME CORP LLC") == "ACME"
    assert one(names.owner_match_key, "The Acme Co., Inc.") == "ACME"
    assert one(names.entity_type, "123 Main Street LLC") == "org"
    assert one(names.entity_type, "John Smith") == "person"
    assert one(names.entity_type, "J") == "unknown"
    assert one(names.title_name, "JOHN  o'NEIL") == "John O'Neil"
    assert "JOHN DOE" in one(names.name_variants, "Doe, John")
    assert one(names.format_phone, "1-212-555-0100") == "(212) 555-0100"
    assert value(spark, names.token_set_similarity(F.col("a"), F.col("b")), a="ABC HOLDINGS LLC", b="XYZ PARTNERS LP") == 0.0
    assert value(spark, names.trigram_similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(4 / 11)
    assert value(spark, names.dedupe_aliases(F.col("a"), F.col("b")), a=["A. B"], b=["a b", "Acme", "ACME"]) == ["A. B", "Acme"]


def test_zones(spark):
    one = lambda f, a: value(spark, f(F.col("a")), a=a)
    assert one(zoning.zone_key, "M1-2/R7A") == "R7A"
    assert one(zoning.zone_key, "C4-4") == "R7"
    assert one(zoning.zone_allows_res, "M1-1") is False
    assert one(zoning.uap_zone, "C6-2") is True
    df = zoning.zone_params(spark.createDataFrame([("R7B",), ("R8C",), ("R10A",)], "zone_dist string"))
    assert {r.zone_dist: r.standard_far for r in df.collect()} == {"R7B": None, "R8C": 6.02, "R10A": 10.0}


def test_text(spark):
    one = lambda f, a: value(spark, f(F.col("a")), a=a)
    assert one(text.html_to_text, "<nav>x</nav><p>A&amp;B</p>\n<script>1</script>c&nbsp;d") == "A&B c d"
    assert one(text.clean_ocr, "resi-\ndential 1O5 2l3 1, 234 ||") == "residential 105 213 1,234 |"
    assert one(text.is_blocked_domain, "https://www.linkedin.com/x") is True
    assert one(text.is_blocked_domain, "https://acme.com/x") is False
