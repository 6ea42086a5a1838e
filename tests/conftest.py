from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture
def same(spark, duck):
    """Compare a query with its SQL, row by row."""

    def plain(v):
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    def check(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
        relation = duck.sql(sql)
        assert sorted(relation.columns) == columns
        at = [relation.columns.index(c) for c in columns]
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())

    return check
