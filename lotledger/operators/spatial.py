"""Parcels in polygons: ray parity as a join of points with edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSET = 0.0003
#: Height and width in degrees of the finest band; each level's bands are STEP times those of the one below.
BAND, STEP, LEVELS = 0.01, 4, 8


def _edges(ring: Column) -> Column:
    """The edges of a ring: each point (a) with the next (b), the last with the first."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))


def _crosses(x: Column, y: Column, e: Column) -> Column:
    """Whether a ray from the point to the right crosses the edge."""
    at = e["ax"] + (y - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
    return ((e["ay"] > y) != (e["by"] > y)) & F.coalesce(x < at, F.lit(False))


def _on(x: Column, y: Column, e: Column) -> Column:
    """Whether the point lies on the edge."""
    between = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
    straight = (e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])
    return straight & between(x, e["ax"], e["bx"]) & between(y, e["ay"], e["by"])


def pip(x: Column, y: Column, rings: Column) -> Column:
    """Whether points lie in a polygon (array of rings, each an array of [x, y]) or on its border."""
    edges = F.flatten(F.transform(rings, _edges))
    return F.exists(edges, lambda e: _on(x, y, e)) | (F.size(F.filter(edges, lambda e: _crosses(x, y, e))) % 2 == 1)


def _level(extent: Column) -> Column:
    """The finest level whose bands are as wide as the extent, so that it touches two of them at most."""
    return reduce(lambda acc, i: acc.when(extent <= BAND * STEP**i, i), range(1, LEVELS), F.when(extent <= BAND, 0)).otherwise(LEVELS)


def _band(c: Column, level: Column) -> Column:
    return F.floor(c / (F.pow(F.lit(float(STEP)), level) * BAND)).cast("long")


def _bands(low: Column, high: Column, level: Column) -> Column:
    """The bands that an extent touches; one that reaches beyond all levels touches them all."""
    return F.explode(F.sequence(_band(low, level), _band(high, level)))


def _inside(points: DataFrame, polygons: DataFrame, outline: bool) -> DataFrame:
    """key, seq, area of every point (key, x, y) and polygon that it lies in or on; without outline not on its first ring.

    An edge stands in the bands of latitude that it spans and in the bands of longitude that its polygon spans, of
    the level of either extent: four rows at most, however large it is. A point stands once in each pair of levels
    that occurs. They meet in an equi-join, and crossings are summed for each point and polygon.
    """
    ringed = lambda ring, i: F.transform(_edges(ring), lambda e: F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by"), (i == 0).alias("outer")))
    parts = polygons.select("seq", "area", F.monotonically_increasing_id().alias("part"), F.flatten(F.transform("rings", ringed)).alias("edges"))
    width = lambda f, g: f(F.transform("edges", lambda e: g(e["ax"], e["bx"])))
    edges = parts.withColumns({"x0": width(F.array_min, F.least), "x1": width(F.array_max, F.greatest)})
    edges = edges.select("seq", "area", "part", "x0", "x1", F.explode("edges").alias("e")).withColumns({"y0": F.least("e.ay", "e.by"), "y1": F.greatest("e.ay", "e.by")})
    edges = edges.withColumns({"lx": _level(F.col("x1") - F.col("x0")), "ly": _level(F.col("y1") - F.col("y0"))})
    edges = edges.withColumn("bx", _bands(F.col("x0"), F.col("x1"), F.col("lx"))).withColumn("by", _bands(F.col("y0"), F.col("y1"), F.col("ly")))
    levels = edges.agg(F.collect_set(F.struct("lx", "ly")).alias("levels"))  # (LEVELS + 1) squared at most, one row
    placed = points.join(F.broadcast(levels), F.lit(True)).withColumn("l", F.explode("levels")).select("key", "x", "y", "l.lx", "l.ly")
    placed = placed.withColumns({"bx": _band(F.col("x"), F.col("lx")), "by": _band(F.col("y"), F.col("ly"))})
    met = placed.join(edges, ["lx", "ly", "bx", "by"]).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    x, y, e = F.col("x"), F.col("y"), F.col("e")
    crosses, on, outer = _crosses(x, y, e).cast("int"), _on(x, y, e), e["outer"]
    sums = [F.sum(crosses).alias("n"), F.sum(F.when(outer, crosses).otherwise(0)).alias("n_outer"), F.max(on & outer).alias("on_outer"), F.max(on & ~outer).alias("on_hole")]
    counted = met.groupBy("key", "seq", "area", "part").agg(*sums)
    inside = "on_outer OR on_hole OR n % 2 = 1" if outline else "NOT on_outer AND IF(on_hole, n_outer, n) % 2 = 1"
    return counted.filter(inside).select("key", "seq", "area")


def overlay(parcels: DataFrame, polygons: DataFrame, offset: float = OFFSET, outline: bool = True) -> DataFrame:
    """parcels (bbl, lng, lat, and zone_dist if there is one) with area (name of the first polygon by seq), via_buffer (whether only a
    point offset to a side lies in it) and status: eligible in an area; else needs_verification for a zone whose number ends
    in D or X; else not_eligible. polygons: seq, area, rings; the parts of a multipolygon are rows of one seq. outline: whether
    points on a first ring lie in the polygon; those on a hole's border do in either case."""
    offsets = [(0.0, 0.0), (0.0, offset), (0.0, -offset), (offset, 0.0), (-offset, 0.0)]
    probes = F.array(*(F.struct(F.lit(i).alias("probe"), (F.col("lng") + dx).alias("x"), (F.col("lat") + dy).alias("y")) for i, (dx, dy) in enumerate(offsets)))
    points = parcels.select("bbl", F.explode(probes).alias("p")).select(F.struct("bbl", "p.probe").alias("key"), "p.x", "p.y")
    hits = _inside(points, polygons, outline).groupBy(F.col("key.bbl").alias("_bbl")).agg(F.min(F.struct("key.probe", "seq", "area")).alias("h"))
    joined = parcels.join(hits, F.col("bbl") == F.col("_bbl"), "left").withColumns({"area": F.col("h.area"), "via_buffer": F.col("h.probe") > 0})
    verify = F.trim("zone_dist").rlike(r"(?i)\d[DX]$") if "zone_dist" in parcels.columns else F.lit(False)
    status = F.when(F.col("h").isNotNull(), "eligible").when(F.coalesce(verify, F.lit(False)), "needs_verification").otherwise("not_eligible")
    return joined.withColumn("status", status).drop("h", "_bbl")
