"""Queries against their SQL where blocks have six digits, so that keys are cut and several lots stand under one."""

import os
from collections import Counter

import pytest

from lotledger import queries
from lotledger.operators import records

SHIFT = {"p_partkey": 700_000, "l_partkey": 700_000, "c_custkey": 700_000, "o_custkey": 700_000, "user_id": 700_000}


@pytest.fixture(scope="module")
def large(sf_dir, tmp_path_factory):
    """A folder with the smallest tables, their keys shifted, and their views."""
    import duckdb

    con, out = duckdb.connect(), tmp_path_factory.mktemp("large")
    for f in os.listdir(sf_dir):
        name = f.split(".")[0]
        columns = [r[0] for r in con.execute(f"DESCRIBE SELECT * FROM '{sf_dir}/{f}'").fetchall()]
        moved = ", ".join(f"{c} + {SHIFT[c]} AS {c}" if c in SHIFT else c for c in columns)
        con.execute(f"COPY (SELECT {moved} FROM '{sf_dir}/{f}') TO '{out}/{f}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{out}/{f}'")
    return str(out), con


@pytest.mark.parametrize("name", [
    "normalize_deed_documents", "recent_deeds_of_borough", "latest_deed_of_parcels", "backfill_sales_from_documents", "documents_of_mortgaged_parcels", "enrich_recording_numbers",
    "resolve_and_diff_documents", "resolve_sale_of_parcels", "saved_grid_pages", "stakeholder_entries", "upsert_documents", "growing_tax", "lot_assemblages", "overlay_status_of_parcels",
    "portfolio_addresses",
])
def test_query_matches_sql_under_cut_keys(name, spark, large):
    folder, con = large
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    df, found = queries.QUERIES[name](spark, folder), con.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert Counter(tuple(map(plain, r)) for r in df.select(*columns).collect()) == Counter(tuple(map(plain, r)) for r in found.fetchall())


def test_equal_contacts_of_a_registration_are_one(spark):
    held = spark.createDataFrame([("1", "7"), ("1", "7"), ("2", "7"), ("3", " ")], "bbl string, registration_id string")
    people = spark.createDataFrame([("7", "Ann", "1"), ("7", "Ann", "1"), ("7", "Bo", None), ("7", "Bo", None)], "registration_id string, name string, phone string")
    got = records.registration_contacts(held, people).select("bbl", "name", "phone").collect()
    assert sorted(map(tuple, got), key=str) == [("1", "Ann", "1"), ("1", "Bo", None), ("2", "Ann", "1"), ("2", "Bo", None)]
