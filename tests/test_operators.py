"""Invariants of keyed writes, streams and small operators."""

import os

from pyspark.sql import functions as F

from lotledger.operators import contacts, finance, sales, screening, stakeholders, upserts
from lotledger.queries import AS_OF, _docs
from lotledger.sources import derived, extracts
from lotledger.streaming import deeds as stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    once = upserts.upsert(old, new, ["k"])
    assert rows(once) == [(1, "a"), (2, "d"), (3, "e")] == rows(upserts.upsert(once, new, ["k"]))
    assert rows(upserts.insert_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "e")]


def test_pages_add_up(spark, sf_dir):
    scored = screening.score_parcels(derived.parcels(spark, sf_dir), derived.rolling_sales(spark, sf_dir), AS_OF).cache()
    total = scored.count()
    pages = [r.bbl for p in range(0, total // 50 + 1) for r in screening.page_of(scored, "ppbsf", page=p).collect()]
    assert len(pages) == total == len(set(pages))


def test_stream_ends_as_batch(spark, sf_dir, tmp_path):
    docs = _docs(spark, sf_dir).cache()
    docs.repartitionByRange(3, "recorded_date").write.parquet(str(tmp_path / "in"))
    for at, part in enumerate(sorted((tmp_path / "in").glob("part-*"))):
        os.utime(part, (1e9 + at, 1e9 + at))  # files arrive in the order of their dates
    docs.orderBy(F.desc("recorded_date")).limit(50).write.mode("append").parquet(str(tmp_path / "in"))  # rows that come again
    arriving = stream.read_documents(spark, str(tmp_path / "in"), docs.schema, 1)
    stream.ingest(arriving, str(tmp_path / "out"), AS_OF).awaitTermination()
    got = stream.stored_table(spark, str(tmp_path / "out"), "documents", docs.schema)
    keys = ["document_id", "bbl"]
    assert rows(got.select(*keys)) == rows(docs.select(*keys).distinct())
    query = stream.stream_latest_sale(stream.read_documents(spark, str(tmp_path / "in"), docs.schema)).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("latest").select("bbl", "sale_date", "sale_price")) == rows(sales.latest_sales(sales.sales_from_documents(docs)).select("bbl", "sale_date", "sale_price"))


def test_newer_sale_only(spark):
    parcels = spark.createDataFrame([("1", 100.0, "2000-01-01", 5.0, "a", 1.0), ("2", 100.0, None, None, None, None)], "bbl string, slack_sf double, last_sale_date string, last_sale_price double, last_sale_source string, ppbsf double")
    parcels = parcels.withColumn("last_sale_date", F.to_date("last_sale_date"))
    new = spark.createDataFrame([("1", "1999-01-01", 9.0, "b"), ("2", "1999-01-01", 250.0, "b")], "bbl string, sale_date string, sale_price double, source string").withColumn("sale_date", F.to_date("sale_date"))
    got = {r.bbl: (r.last_sale_price, r.ppbsf) for r in sales.apply_newer_sales(parcels, new).collect()}
    assert got == {"1": (5.0, 1.0), "2": (250.0, 2.5)}


def test_contacts():
    found = contacts.find_contacts("write to Jane.Doe@acme.org or info@acme.org, call (212) 555-0100 or 212-555-0100, not 111-111-1111")
    assert [(c["kind"], c["value"]) for c in found] == [("email", "jane.doe@acme.org"), ("phone", "(212) 555-0100")]


def test_clusters(spark):
    data = [("1", "OWNER", 1, "ABC HOLDINGS LLC"), ("1", "OWNER", 2, "HOLDINGS ABC"), ("1", "OWNER", 3, "XYZ PARTNERS LP"), ("1", "SELLER", 4, "ABC HOLDINGS LLC"), ("1", "OWNER", 5, " ")]
    got = stakeholders.cluster_stakeholders(spark.createDataFrame(data, "bbl string, role string, seq long, name string"))
    assert {r.seq: r.cluster for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_rent_of_nearest_band_is_the_lower(spark):
    df = finance.rent_limit(spark.createDataFrame([("1BR", 55), ("1BR", 60), ("Loft", 60)], "unit_type string, ami_band int"))
    assert {(r.unit_type, r.ami_band): r.max_rent for r in df.collect()} == {("1BR", 55): 1518.0, ("1BR", 60): 1822.0, ("Loft", 60): None}


def test_export_and_read_back(spark, sf_dir, tmp_path):
    scored = screening.score_parcels(derived.parcels(spark, sf_dir), derived.rolling_sales(spark, sf_dir), AS_OF)
    extracts.export_csv(scored.withColumn("address", F.lit('1 "A", B')), str(tmp_path / "csv"))
    back = extracts.read_extract(spark, str(tmp_path / "csv"), "csv", list(extracts.EXPORTED))
    assert len(back.columns) == 22 and back.count() == scored.count()
    assert back.first().Address == '1 "A", B'


def test_geojson(spark, tmp_path):
    square = "[[[0,0],[1,0],[1,1],[0,1],[0,0]]]"
    (tmp_path / "z.json").write_text(f'{{"features": [{{"properties": {{"n": "A"}}, "geometry": {{"type": "Polygon", "coordinates": {square}}}}}, {{"properties": {{"m": "B"}}, "geometry": {{"type": "GeometryCollection", "geometries": [{{"type": "MultiPolygon", "coordinates": [{square}, {square}]}}]}}}}]}}')
    got = extracts.read_geojson_polygons(spark, str(tmp_path / "z.json"), ["n", "m"])
    assert [(r.seq, r.area, len(r.rings[0])) for r in got.orderBy("seq").collect()] == [(0, "A", 5), (1, "B", 5), (1, "B", 5)]


def test_merged_unit_rules_share_out_to_one(spark):
    from lotledger.operators import programs

    rows = [(1, "A", "1BR", 500, 0.5), (1, "B", "1BR", 575, 0.25), (1, "A", "2BR", 700, 0.5)]
    found = programs.merge_unit_rules(spark.createDataFrame(rows, "group_id int, program string, unit_type string, min_sf int, share double"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "1BR", 575, 0.5), (1, "2BR", 700, 0.5)]


def test_mentions_of_null_and_repeated_texts(spark):
    from lotledger.operators import filings

    rows = [("1", "tax 421a"), ("1", "tax 421a"), ("1", None), ("2", ""), ("3", "UAP and 467-M")]
    found = {r.bbl: (r.mentions, len(r.evidence)) for r in filings.program_mentions(spark.createDataFrame(rows, "bbl string, text string")).collect()}
    assert found == {"1": (["421-a"], 1), "3": (["467-m", "UAP"], 2)}


def test_search_answers_every_short_query(spark):
    from itertools import product

    from lotledger.operators import owners

    letters = "abcdefghijklmnopqrstuvwxyzäöü0123456789&-"
    asked = ["".join(q) for q in product(letters, repeat=2)] + list(letters) + ["A &", "HOLD", "q-holding"]
    names = [("1", "Alpha-Beta & Sons", ["A"]), ("2", "QZ Holding", ["9ü", "Q-Holdings"]), ("3", "Zä", []), ("4", "", None)]
    found = owners.search_entities(spark.createDataFrame(names, "id string, canonical_name string, aliases array<string>"), spark.createDataFrame([(q,) for q in asked], "query string"), least=2.0)
    wanted = {(q, i) for q in asked if q for i, name, more in names if any(q.lower() in x.lower() for x in [name, *(more or [])])}
    got = [(r.query, r.id) for r in found.collect()]
    assert len(asked) > 1000 and len(got) == len(set(got)) and set(got) == wanted


def test_signals_far_on_in_a_text(spark, tmp_path):
    import re

    from lotledger import queries
    from lotledger.plans import pages

    far_on = "x " * 20_000
    rows = [(1, 0, far_on + "PROPOSED 12 DWELLING UNITS"), (1, 1, far_on + "lot area: 2,500 sf " + far_on + "FAR: 3.5"), (2, 0, far_on), (2, 3, "Number of units: 7"), (2, 5, "proposed 9 units"), (3, 0, None)]
    wanted = {}
    for i, patterns, low, high in ((0, pages.UNITS, 1, 500), (1, pages.LOT_AREA, 100, 1_000_000), (2, pages.FAR, 0.1, 30)):
        for doc, page, text in rows:
            for n, p in enumerate(patterns):
                m = re.search(p, (text or "").upper())
                if m and low <= float(m[1].replace(",", "")) <= high:
                    wanted.setdefault((doc, i), []).append((n, page, float(m[1].replace(",", ""))))
    got = {r.doc_id: tuple(r)[1:] for r in pages.extract_signals(spark.createDataFrame(rows, "doc_id long, page int, text string")).collect()}
    assert got == {d: tuple(min(wanted[d, i])[2] if (d, i) in wanted else None for i in range(3)) for d in (1, 2, 3)}
    assert got[1] == (12.0, 2500.0, 3.5)
    # Negative ids write no number of units and no FAR at the head of a plan, so the query must find the text's own.
    spark.createDataFrame([(-5, far_on + "proposed 31 units, FAR: 3.5")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r.units, r.lot_area, r.far) for r in queries.plan_signals(spark, str(tmp_path)).collect()] == [(31.0, 1000.0, 3.5)]


def test_batches_write_the_partitions_they_touch(spark, sf_dir, tmp_path):
    folder, docs = tmp_path / "out", _docs(spark, sf_dir).cache()
    run = stream.batch_upsert(spark, str(folder), AS_OF)
    run(docs, 0)
    files = lambda name: {p: p.stat().st_mtime_ns for p in (folder / name).rglob("*.parquet")}
    before, sold = files("documents"), files("sales")
    first = docs.filter("bbl LIKE '3%' AND doc_type = 'DEED' AND amount > 0").orderBy("document_id", "bbl").limit(1)
    moved = first.withColumn("recorded_date", F.lit("1971-05-06").cast("date")).withColumn("amount", F.lit(5.0))
    run(moved, 1)
    after = files("documents")
    gone = {p.parent.name for p in before.keys() - after.keys()}
    assert len(gone) == 1 and {p.parent.name for p in after.keys() - before.keys()} <= gone | {"part_month=1971-05"}
    assert {p.parent.name for p in files("sales").keys() - sold.keys()} == {"part_month=1971-05"}
    got = stream.stored_table(spark, str(folder), "documents", docs.schema)
    keys = ["document_id", "bbl"]
    want = docs.join(first.select(*keys), keys, "left_anti").unionByName(moved)
    assert rows(got.select(*keys, "recorded_date", "amount")) == rows(want.dropDuplicates(keys).select(*keys, "recorded_date", "amount"))
    held = rows(spark.read.parquet(str(folder / "coverage")))
    run(moved.withColumn("amount", F.lit(7.0)), 1)  # a batch of that number is done
    assert files("documents") == after and rows(spark.read.parquet(str(folder / "coverage"))) == held
    assert not list((folder / "staging").glob("*"))


def test_the_last_row_of_a_partition_moves(spark, tmp_path):
    put = lambda stored, new: upserts.upsert(stored, new, ["k"])
    path, parts = str(tmp_path / "t"), {"p": "v"}
    for n, row in enumerate([(1, "a"), (1, "b"), (2, None)]):
        folders = upserts.merge_partitions(path, spark.createDataFrame([row], "k int, v string"), ["k"], parts, put, f"{tmp_path}/s{n}")
    assert folders == ["p=none"] and not os.path.exists(f"{path}/p=a")
    assert rows(spark.read.schema("k int, v string").parquet(path).select("k", "v")) == [(1, "b"), (2, None)]
    # A run that broke off after it had staged its rows goes on from them.
    upserts.merge_partitions(path, spark.createDataFrame([(9, "z")], "k int, v string"), ["k"], parts, put, f"{tmp_path}/s1")
    assert rows(spark.read.schema("k int, v string").parquet(path).select("k", "v")) == [(1, "b"), (2, None)]
