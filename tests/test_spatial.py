"""Points in polygons against a plain ray cast."""

import random

from pyspark.sql import functions as F

from lotledger.operators import spatial


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def shape(rng, size):
    cx, cy = rng.uniform(0, 1), rng.uniform(0, 1)
    ring = [[cx + rng.uniform(-size, size), cy + rng.uniform(-size, size)] for _ in range(rng.randint(3, 9))]
    hole = [[cx + rng.uniform(-size, size) / 4, cy + rng.uniform(-size, size) / 4] for _ in range(4)]
    return [ring, hole] if rng.random() < 0.5 else [ring]


SCHEMA = "seq int, area string, rings array<array<array<double>>>"


def test_overlay_is_a_ray_cast(spark):
    """Holes, crossing rings, several polygons of one name, shapes of any size, points on corners and edges."""
    rng = random.Random(3)
    polygons = [(i // 2, f"a{i // 2}", shape(rng, rng.choice([0.002, 0.02, 0.1, 0.8]))) for i in range(40)]
    polygons += [(90, "city", [[[-1.0, -1.0], [5.0, -1.0], [5.0, 0.25], [-1.0, 0.25]]]), (91, "none", [])]
    points = [(str(i), rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(150)] + [("edge", 4.5, 0.25), ("corner", 5.0, -1.0), ("far", 9.0, 9.0), ("near", 5.0002, 0.0), ("null", None, 0.1)]
    df = spark.createDataFrame(points, "bbl string, lng double, lat double")
    got = {r.bbl: (r.area, r.via_buffer, r.status) for r in spatial.overlay(df, spark.createDataFrame(polygons, SCHEMA)).collect()}
    o = spatial.OFFSET
    for bbl, x, y in points:
        hits = [] if x is None else [(p, seq, area) for p, (dx, dy) in enumerate([(0, 0), (0, o), (0, -o), (o, 0), (-o, 0)]) for seq, area, rings in polygons if inside(x + dx, y + dy, rings)]
        want = (min(hits)[2], min(hits)[0] > 0, "eligible") if hits else (None, None, "not_eligible")
        assert got[bbl] == want, bbl
    assert (got["edge"][0], got["corner"][0], got["near"]) == ("city", "city", ("city", True, "eligible"))


def test_large_polygons_make_few_rows_and_no_python(spark):
    city = spark.createDataFrame([(1, "city", [[[0.0, 0.0], [40.0, 0.0], [40.0, 40.0], [0.0, 40.0]]])], SCHEMA)
    points = spark.range(200).select(F.col("id").cast("string").alias("bbl"), (F.col("id") / 10).alias("lng"), (F.col("id") / 10).alias("lat"))
    out = spatial.overlay(points, city)
    assert out.filter("area = 'city'").count() == 200
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    level, bands = spatial._level(F.lit(40.0)), spatial._bands(F.lit(0.0), F.lit(40.0), spatial._level(F.lit(40.0)))
    assert spark.range(1).select(bands, level).count() <= 2


def test_pip(spark):
    rings = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]]]
    df = spark.createDataFrame([(x / 2, y / 2, rings) for x in range(-1, 10) for y in range(-1, 10)], "x double, y double, rings array<array<array<double>>>")
    assert all(r.i == inside(r.x, r.y, rings) for r in df.withColumn("i", spatial.pip(F.col("x"), F.col("y"), F.col("rings"))).collect())


def test_outline_can_be_left_out(spark):
    """On the first ring: out, if asked; on a hole's border: in; in the hole: out."""
    rings = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]]]
    points = spark.createDataFrame([(f"{x},{y}", float(x), float(y)) for x in range(-1, 6) for y in range(-1, 6)], "bbl string, lng double, lat double")
    polygons = spark.createDataFrame([(1, "a", rings)], SCHEMA)
    for outline, low, high in ((True, 0, 4), (False, 1, 3)):
        got = {r.bbl for r in spatial.overlay(points, polygons, 0.0, outline).collect() if r.area}
        assert got == {f"{x},{y}" for x in range(low, high + 1) for y in range(low, high + 1)} - {"2,2"}


def test_query_matches_sql_on_points_of_borders(spark):
    """The points of sf0.01 that lie on the outline of the city are told as the SQL tells them."""
    import duckdb

    from lotledger import queries

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for name in ("part", "nation"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.sql(f"SELECT bbl, area, via_buffer, status FROM ({queries.SQL['parcels_in_polygons']})").fetchall()
    got = [tuple(r) for r in queries.QUERIES["parcels_in_polygons"](spark, sf).select("bbl", "area", "via_buffer", "status").collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
