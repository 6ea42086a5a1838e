"""Unit records, labels of plans, pasted tables and entries of stakeholders."""

from math import hypot

from lotledger import queries
from lotledger.operators import stakeholders
from lotledger.plans import facts, units
from lotledger.sources import pasted


def test_pasted_tables(spark):
    tabs = "CRFN\tDocument ID\tRecorded\tDoc Type\tBorough\tBlock\tLot\tParty 1\tParty 2\tAmount\n2025000123456\tFT_1234\t01/15/2025\tDEED\tManhattan\t100\t50\tJOHN DOE\tJANE SMITH\t$1,500,000\n"
    twice = "Recorded  Doc Type  Block  Lot  Party 1\n01/15/2025  DEED  100  50  John Doe\n01/15/2025  DEED  100  50  John Doe"
    texts = [(1, tabs + tabs.split("\n")[1]), (2, twice), (3, "one line\nand one more"), (4, ""), (5, None), (6, "CRFN | Lot\n | 5\n7 | 5"), (7, "CRFN\tLot")]
    rows = pasted.parse_pasted_tables(spark.createDataFrame(texts, "text_id int, text string")).collect()
    found = {i: [r for r in rows if r.text_id == i] for i in range(1, 8)}
    assert [len(found[i]) for i in range(1, 8)] == [1, 1, 2, 0, 0, 1, 0]
    r = found[1][0]
    assert (r.crfn, r.document_id, r.recorded_date, r.doc_type, r.borough, r.block, r.lot, r.party1, r.party2, r.amount, r.dedupe_key) == (
        "2025000123456", "FT_1234", "2025-01-15", "DEED", "1", "100", "50", "John Doe", "Jane Smith", "1500000", "crfn_2025000123456",
    )
    assert found[2][0].dedupe_key.startswith("hash_") and found[3][0].dedupe_key is None and found[6][0].crfn == "7"


def test_units_from_lines(spark):
    texts = ["12 STUDIO", "1BR: 3 units MIH 60% AMI", "Unit 4C 2 BR market", "7D 0 BED", "0 STUDIO", "stairs", None, "", "999 2BR", "3 BEDROOM"]
    lines = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "doc_id int, page int, seq int, text string")
    rows = units.units_from_lines(lines).collect()
    assert {s: sum(r.seq == s for r in rows) for s in range(len(texts))} == {0: 12, 1: 3, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 500, 9: 3}
    one = {r.seq: (r.unit_id, r.bedroom_type, r.bedroom_count, r.allocation, r.ami_band) for r in rows}
    assert one[1] == (None, "1BR", 1, "MIH_RESTRICTED", 60) and one[2] == ("4C", "2BR", 2, "MARKET", None) and one[3] == ("7D", "STUDIO", 0, "UNKNOWN", None)
    assert one[9][1:3] == ("UNKNOWN", None)


def test_unit_areas_first_label(spark):
    pages = spark.createDataFrame([(1, 1, "UNIT 2A 700 SF and 650 SF UNIT 3B"), (1, 3, "apt 9\nlevel 2 810 SF"), (1, 2, "UNIT 2A 900 SF, UNIT 4 99 SF"), (2, 1, None)], "doc_id int, page int, text string")
    assert sorted((r.unit_id, r.area_sf, r.page) for r in units.unit_areas(pages).collect()) == [("2A", 700, 1), ("3B", 650, 1), ("9", 810, 3)]


def test_labels_match_a_plain_loop(spark, sf_dir):
    sheets = {}
    for r in sorted(queries._labels_of_sheets(spark, sf_dir).collect(), key=lambda r: r.seq):
        sheets.setdefault((r.doc_id, r.page), []).append(r)
    want = []
    for sheet, items in sheets.items():
        free = [(int(r.str.split()[0]), r) for r in items if r.seq % 2 and 100 <= int(r.str.split()[0]) <= 5000]
        seen = set()
        for r in (r for r in items if r.seq % 2 == 0):
            near = min(((hypot(r.x - a.x, r.y - a.y), a.seq, i) for i, (_, a) in enumerate(free) if hypot(r.x - a.x, r.y - a.y) <= 80), default=None)
            if near and r.str.split()[1] not in seen:
                seen.add(r.str.split()[1])
                want.append((*sheet, r.str.split()[1], free.pop(near[2])[0]))
    got = [tuple(r) for r in queries.QUERIES["unit_labels_matched"](spark, sf_dir).collect()]
    assert len(want) > 10 and sorted(got) == sorted(want)


def test_entries_of_filings_and_contacts(spark):
    filing = spark.createDataFrame(
        [("1", "J1", "RA", "Ann", "Arch Co", "55", "Bo", "Bo LLC", "212", "b@x.org", "1 Elm", "Build Inc", "G7", " ", None, None)],
        "bbl string, job_number string, applicant_title string, applicant_name string, applicant_business string, license string, owner_name string, owner_business string, owner_phone string, owner_email string, owner_address string, "
        "permittee_business string, permittee_license string, rep_name string, rep_business string, rep_address string",
    )
    contact = spark.createDataFrame(
        [("1", "R1", "Head Officer", "Cy", "Roe", "Roe Corp", "12", "Oak St", None, "NY", "NY", "10001"), ("1", None, "Agent", None, "", "Agents Inc", None, None, None, None, None, None), ("1", "R3", None, None, None, None, None, None, None, None, None, None)],
        "bbl string, registrationcontactid string, type string, firstname string, lastname string, corporationname string, businesshousenumber string, businessstreetname string, businessapartment string, businesscity string, businessstate string, businesszip string",
    )
    rows = stakeholders.stakeholder_entries({"DOB_FILING": filing, "HPD_CONTACTS": contact}).orderBy("seq").collect()
    assert {(r.source, r.role, r.name, r.org_name) for r in rows} == {
        ("HPD_CONTACTS", "OWNER", "Cy Roe", "Roe Corp"), ("HPD_CONTACTS", "MANAGING_AGENT", "Agents Inc", None),
        ("DOB_FILING", "ARCHITECT", "Ann", "Arch Co"), ("DOB_FILING", "OWNER", "Bo", "Bo LLC"), ("DOB_FILING", "GC", "Build Inc", None),
    }
    assert [r.source for r in rows] == ["HPD_CONTACTS"] * 2 + ["DOB_FILING"] * 3
    bo = next(r for r in rows if r.name == "Bo")
    assert (bo.phones[0].raw, bo.phones[0].confidence, bo.emails[0].email, bo.addresses[0].line1, bo.addresses[0].confidence) == ("212", 0.75, "b@x.org", "1 Elm", 0.7)
    cy = next(r for r in rows if r.name == "Cy Roe")
    assert (cy.addresses[0].line1, cy.addresses[0].zip, cy.phones, cy.record_key) == ("12 Oak St", "10001", [], "R1")
    assert next(r for r in rows if r.name == "Agents Inc").record_key == "1"


def test_conversion_areas(spark):
    texts = ["existing area 4,000 SF new area 900 sf total area 6,000 sf", "new retail area 5 SF, total area 70 sq ft", "existing building", None, "Existing floor area: 10 new area 20 sf overall project area 30 sf"]
    rows = facts.conversion_areas(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert sorted((r.doc_id, r.pre_existing, r.new, r.total, r.sure_pre_existing, r.sure_new, r.reconciled) for r in rows.collect()) == [
        (0, 4000, 900, 6000, 0.6, 0.75, False), (1, None, None, 70, None, None, None), (4, 10, 20, 30, 0.85, 0.85, True),
    ]


def test_clusters_match_a_plain_loop(spark, sf_dir):
    """Entries join the first cluster, in the order of seq, whose first entry's tokens are like their own."""
    from pyspark.sql import functions as F

    from lotledger.functions.names import stakeholder_tokens
    from lotledger.sources import derived

    names = derived.parties(spark, sf_dir).select(F.substring("document_id", 1, 14).alias("bbl"), F.lit("OWNER").alias("role"), F.xxhash64("document_id", "name", "seq").alias("seq"), "name")
    wide = names.unionByName(names.select(F.lit("1").alias("bbl"), "role", "seq", F.concat("name", F.lit(" a b c d e f g h"), (F.col("seq") % 3).cast("string")).alias("name")).limit(200))
    rows = wide.filter("length(trim(name)) > 0").withColumn("t", F.array_sort(stakeholder_tokens(F.col("name")))).collect()
    entries = spark.createDataFrame([(r.bbl, r.role, r.seq, r.name) for r in rows], "bbl string, role string, seq long, name string")
    first, heads, want = {}, {}, {}
    for r in sorted(rows, key=lambda r: r.seq):
        first.setdefault((r.bbl, frozenset(r.t)), r.seq)
    for r in sorted(rows, key=lambda r: r.seq):
        own, group = frozenset(r.t), heads.setdefault(r.bbl, [])
        found = next((s for s, h in group if (len(own & h) / len(own | h) if own | h else 1.0) >= 0.85), None)
        if first[r.bbl, own] == r.seq and found is None:
            group.append((r.seq, own))
            found = r.seq
        want[r.bbl, r.seq] = found
    got = {(r.bbl, r.seq): r.cluster for r in stakeholders.cluster_stakeholders(entries).collect()}
    assert got == want and len({c for k, c in got.items() if k[0] == "1"}) < sum(k[0] == "1" for k in got)
