"""Owners and stakeholders: clusters of one large parcel, merged contacts, hub parcels, redundancy of plans."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lotledger.operators import deeds, owners, portfolio, stakeholders
from lotledger.plans import pages, reconcile

ENTRY = (
    "bbl string, role string, seq long, record_key string, source string, name string, org_name string, license_type string, license_number string, phones array<struct<raw:string,confidence:double>>, "
    "emails array<struct<email:string,confidence:double>>, addresses array<struct<line1:string,city:string,state:string,zip:string,source:string,confidence:double>>"
)


def test_clusters_of_one_parcel_with_thousands_of_names(spark):
    rng = random.Random(5)
    rare = [f"W{i}" for i in range(60)]
    rows = []
    for seq in range(2500):
        base = random.Random(seq % 90).sample(rare, 9)
        extra = rng.sample(["EAST", "WEST", "WING", "OLD", "NEW"], rng.randint(0, 3))
        rows.append((None if seq % 2 else "1", "OWNER", seq, " ".join(rng.sample(base[: 9 - rng.randint(0, 1)] + extra, len(base[:8])))))
    heads, want = defaultdict(list), {}
    for bbl, _, seq, name in rows:
        own = frozenset(name.split())
        found = next((s for s, h in heads[bbl] if len(own & h) / len(own | h) >= 0.85), None)
        if found is None:
            heads[bbl].append((seq, own))
            found = seq
        want[seq] = found
    got = stakeholders.cluster_stakeholders(spark.createDataFrame(rows, "bbl string, role string, seq long, name string").repartition(5))
    assert {r.seq: r.cluster for r in got.collect()} == want
    assert 1 < len(set(want.values())) < len(want)
    assert "Pandas" not in got._jdf.queryExecution().toString()


def test_chain_of_similar_names(spark):
    """Each name is like the next only, so every second one is a head: a round for each."""
    rows = [("1", "OWNER", i, " ".join(f"T{j}" for j in range(i, i + 13))) for i in range(12)]
    got = {r.seq: r.cluster for r in stakeholders.cluster_stakeholders(spark.createDataFrame(rows, "bbl string, role string, seq long, name string")).collect()}
    assert got == {i: i - i % 2 for i in range(12)}


def test_merged_contacts_and_provenance(spark):
    rows = [
        ("1", "OWNER", 1, "r1", "PLUTO", "ABC HOLDINGS LLC", None, None, None, [("(212) 555-0100", 0.5)], [("A@x.org", 0.4)], []),
        ("1", "OWNER", 2, "r2", "HPD_CONTACTS", "HOLDINGS ABC", "ABC", "RA", " 7 ", [("212-555-0100", 0.9), ("none", 1.0)], [("a@X.org", 0.4)], [("1 Elm", "NYC", None, "1", "HPD_CONTACTS", 0.9)]),
        ("1", "OWNER", 3, "r2", "HPD_CONTACTS", "ABC HOLDINGS", "XYZ", "PE", "8", [("718 555 0000", None)], [], [("1 elm", "nyc", "", "1", "DOB_FILING", 0.7), ("2 Elm", None, None, None, "DOB_FILING", 0.7)]),
        ("1", "AGENT", 4, "r4", "NEW_SOURCE", "ABC HOLDINGS", None, None, None, None, None, None),
    ]
    merged = stakeholders.merge_stakeholders(stakeholders.cluster_stakeholders(spark.createDataFrame(rows, ENTRY)))
    got = {r.role: r for r in merged.collect()}
    r = got["OWNER"]
    assert (r.name, r.org_name, r.license, r.license_type, r.n_entries, r.sources, r.confidence) == ("ABC HOLDINGS LLC", "ABC", " 7 ", "RA", 3, ["HPD_CONTACTS", "PLUTO"], 0.95)
    assert [tuple(p) for p in r.phones] == [("212-555-0100", 0.9), ("718 555 0000", None)] and [tuple(e) for e in r.emails] == [("A@x.org", 0.4)]
    assert [(a.line1, a.confidence) for a in r.addresses] == [("1 Elm", 0.9), ("2 Elm", 0.7)]
    assert [tuple(p) for p in r.provenance] == [("PLUTO", "r1"), ("HPD_CONTACTS", "r2")]
    assert (got["AGENT"].confidence, got["AGENT"].phones, got["AGENT"].addresses) == (0.5, [], [])
    mentions = owners.mentions_from_stakeholders(merged).collect()
    assert {(m.name, m.relationship, m.confidence) for m in mentions} == {("ABC", "owner", 0.95)}
    assert Counter(m.kind for m in mentions) == {"phone": 2, "email": 1, "address": 2}
    assert "1 Elm, NYC, 1" in {m.value for m in mentions}


def test_hub_parcels_meet_in_blocks(spark):
    rng = random.Random(2)
    kinds = ["owner", "lender", "other", "unheard of"]
    links = [(f"e{i:03d}", "hub", rng.choice(kinds)) for i in range(150)] + [(f"e{rng.randrange(150):03d}", f"p{rng.randrange(60)}", rng.choice(kinds)) for _ in range(500)]
    links += [("lone", None, "owner"), ("e001", "hub", "lender"), ("e001", "hub", "owner")]
    df = spark.createDataFrame(links, "owner_entity_id string, bbl string, relationship_type string")
    lots = defaultdict(lambda: defaultdict(set))
    for e, bbl, kind in links:
        if bbl:
            lots[bbl][e].add(kind)
    total = Counter(e for held in lots.values() for e in held)
    shared, types = Counter(), defaultdict(set)
    for held in lots.values():
        for a in held:
            for b in held:
                if a != b:
                    shared[a, b] += 1
                    types[a, b] |= held[b] & set(portfolio.RELATIONSHIPS)
    for k, block in ((None, 20), (5, 1000), (5, 7)):
        want = {}
        for (a, b), n in shared.items():
            want.setdefault(a, []).append((-n, -total[b], b))
        want = sorted((a, b, -n, sorted(types[a, b]), -t) for a, all_ in want.items() for n, t, b in sorted(all_)[:k])
        assert sorted((r.owner_entity_id, r.other_id, r.shared_parcels, r.relationship_types, r.total_parcels) for r in portfolio.associated_entities(df, k, block).collect()) == want


def test_redundancy_counts_sources_and_pages(spark):
    mentions = spark.createDataFrame([(1, s, 1, 40) for s in ("cover_sheet", "zoning", "table")] + [(2, "zoning", p, 9 + p) for p in range(3)] + [(3, "table", 1, 90)], "doc_id int, source string, page int, value int")
    got = pages.redundancy(mentions, spark.createDataFrame([(1, 42), (2, 8), (3, 1), (4, 5)], "doc_id int, units int")).collect()
    assert {r.doc_id: r.redundancy for r in got} == {1: 0.95, 2: 0.85, 3: 0.3, 4: 0.0}


def test_types_stated_as_none_are_none(spark):
    rows = [(1, "ZONING_SCHEDULE", 1, {"STUDIO": 0, "1BR": 2}), (1, "GENERIC", 2, {"STUDIO": 0, "2BR": 4}), (2, "GENERIC", 1, {"1BR": 0})]
    df = spark.createDataFrame(rows, "doc_id int, section string, seq int, unit_mix map<string,long>").selectExpr(
        "*", "cast(null as double) as lot_area", "cast(null as double) as zoning_floor_area", "cast(null as double) as far", "cast(null as long) as total_units", "cast(null as map<string,array<double>>) as unit_sizes", "0.5D as confidence"
    )
    key = {k.upper(): v for k, v in reconcile.MIX.items()}
    got = {r.doc_id: r for r in reconcile.merge_sections(df).collect()}
    assert (got[1][key["1BR"]], got[1][key["2BR"]], got[1].total_units, got[2][key["1BR"]], got[2].total_units) == (2, 4, 6, 0, None)


def test_packed_mentions_are_those_of_rows(spark):
    """Names with ;, short and blank ones, other parties, documents without lots, lots without parties, lots that come twice."""
    lots = spark.createDataFrame(
        [("d1", "1000010001", "DEED", "2001-01-01"), ("d1", "1000010001", "DEED", "2001-01-01"), ("d1", "2000010001", "DEED", "2001-01-01"), ("d2", "1000010001", "MTGE", "2001-01-01"), ("d3", "3000010001", "RPTT", "1960-01-01"), ("d5", "3000010001", "DEED", "2000-01-01")],
        "document_id string, bbl string, doc_type string, day string",
    ).selectExpr("document_id", "bbl", "doc_type", "cast(day as date) as recorded_date")
    parties = [("d1", "1", "ACME LLC; Bo Lee"), ("d1", "2", "ACME, INC"), ("d1", "2", " Bo Lee "), ("d1", "3", "NOBODY INC"), ("d2", "1", "ACME"), ("d2", "2", "The Acme"), ("d2", "2", "XY"), ("d3", "1", ""), ("d3", "2", "Q LLC"), ("d3", "2", "BO LEE"), ("d4", "1", "ACME"), ("d5", "1", None)]
    parties = spark.createDataFrame([(*p, i) for i, p in enumerate(parties)], "document_id string, party_type string, name string, seq int")
    parcels = spark.createDataFrame([("1000010001", " ACME LLC "), ("3000010001", ""), ("3000010001", None)], "bbl string, owner_name string")
    docs = lots.join(deeds.party_lists(parties), "document_id", "left")
    plain = owners.owner_mentions(owners.mentions_from_documents(docs), owners.mentions_from_parcels(parcels))
    ids = owners.entity_ids(plain)
    packed = owners.packed_mentions(lots, parties, parcels)
    first, mentions = owners.named(*packed), owners.unpacked(*packed)
    numbered = owners.entity_ids(first)
    of = lambda df: Counter(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert of(owners.identified(owners.entity_links(mentions, None), numbered)) == of(owners.entity_links(plain, ids))
    assert of(owners.identified(owners.dedupe_events(mentions, None), numbered)) == of(owners.dedupe_events(plain, ids))
    built = lambda df: df.select("id", "key", "canonical_name", "entity_type", F.array_join("aliases", "|").alias("aliases"), "n_parcels")
    assert of(built(owners.build_entities(first, mentions))) == of(built(owners.build_entities(plain)))
    links = owners.entity_links(mentions, None)
    named = lambda df: df.withColumn("relationship_types", F.array_join("relationship_types", ","))
    assert of(named(portfolio.portfolio(links, ["owner", "borrower", "lender"]))) == of(named(portfolio.portfolio(links)))
