"""Signals of plan pages against plain loops over patterns and pages."""

import random
import re

from pyspark.sql import functions as F

from lotledger.plans import signals


def plain(pages, table, searched, sure):
    out = {}
    for name, patterns in table.items():
        for p in patterns:
            hit = next(((page, m) for page, text in searched if (m := re.search(p, text, re.I)) and (m[1].strip() if name == "zone" else float(re.match(r"\d*\.?\d*", m[1].replace(",", ""))[0].strip(".") or 0) > 0)), None)
            if hit:
                page, m = hit
                text = dict(pages)[page]
                number = None if name == "zone" else float(re.match(r"\d*\.?\d*", m[1].replace(",", ""))[0])
                low, high = signals.RANGES.get(name, (0, 1e12))
                if number is None or low <= number <= high:
                    out[name] = (m[1].strip(), number, page, text[max(0, m.start() - 30) : m.end() + 30].replace("\n", " ").strip(), sure)
                break
    return out


PHRASES = ["COVER SHEET", "Project data", "proposed 24 new dwelling units", "12 proposed units", "TOTAL UNITS: 700", "Number of units 0", "40-unit residential building", "zoning district: R7-2", "Zone C4-4/R8", "LOT AREA: 12,500 SF", "site area 9,000", "FAR: 3.44.", "max FAR 99", "FAR = 2", "5 DUs", "DU: 18",
           "6 stories above grade", "FLOORS: 7", "12-STORY", "GROSS FLOOR AREA 44,000", "ZFA 30,100", "permitted", "use group 2", "units: 31 units: 33", "comprising 9 units", "\n", "lot size (SF) 4,400", "BULK FAR 1.5"]


def test_signals_are_those_of_a_loop(spark):
    rng = random.Random(8)
    docs = {d: [(p, " ".join(rng.sample(PHRASES, rng.randint(0, 9)))) for p in range(rng.randint(1, 5))] for d in range(120)}
    df = spark.createDataFrame([(d, p, t) for d, pages in docs.items() for p, t in pages] + [(500, 0, None)], "doc_id int, page int, text string").repartition(5)
    got_cover, got_zoning = {}, {}
    for got, found in ((got_cover, signals.cover_signals(df)), (got_zoning, signals.zoning_signals(df))):
        for r in found.collect():
            got.setdefault(r.doc_id, {})[r.signal] = (r.value, r.number, r.page, r.snippet, r.confidence)
    mentions = {}
    for r in signals.unit_mentions(df).collect():
        mentions.setdefault((r.doc_id, r.source), set()).add((r.page, r.value, r.snippet, r.confidence))
    for d, pages in docs.items():
        cover = [(p, t) for p, t in pages if any(w in t.upper() for w in signals.COVER)]
        zoning = [(p, t) for p, t in pages if sum(w in t.upper() for w in signals.ZONING) >= 2]
        sure = 0.9 if cover else 0.7
        assert got_cover.get(d, {}) == plain(pages, signals.COVER_PATTERNS, cover or pages, sure)
        assert got_zoning.get(d, {}) == plain(pages, signals.ZONING_PATTERNS, zoning, 0.85)
        for source, searched, table, c in (("cover_sheet", cover or pages, signals.COVER_PATTERNS, sure), ("zoning_text", zoning, signals.ZONING_PATTERNS, 0.85)):
            want = {}
            for p in table["units"]:
                for page, text in searched:
                    for m in re.finditer(p, text, re.I):
                        if 1 <= int(m[1]) <= 500:
                            want.setdefault((page, int(m[1])), text[max(0, m.start() - 30) : m.end() + 30].replace("\n", " ").strip())
            assert mentions.get((d, source), set()) == {(page, n, s, c) for (page, n), s in want.items()}


def test_places_of_matches(spark):
    df = spark.createDataFrame([("a 12 b 7", ), ("", ), (None, ), ("99", )], "text string")
    got = df.select(signals.match_places(F.col("text"), r"(\d+)").alias("m")).collect()
    assert [[(x.at, x.value) for x in r.m or []] for r in got] == [[(3, "12"), (8, "7")], [], [], [(1, "99")]]
