"""Connected components of a graph that is never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _lowest(edges: DataFrame) -> DataFrame:
    """u, v, m: edges with the least of u and its neighbours. The minimum is aggregated before the
    shuffle and joined back, so a vertex with very many edges can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def _is_star(edges: DataFrame) -> bool:
    """Whether every u has one edge and no u is another's v: then each v is the least vertex of a component."""
    ends = edges.select(F.col("u").alias("vertex"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("vertex").agg(F.sum("a").alias("a"), F.max("b").alias("b")).filter("a > 1 OR (a = 1 AND b = 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """vertex, component (the least vertex that can be reached) of all vertices of edges (u, v), u <> v.

    Alternates two star steps: every vertex links its larger neighbours to its least neighbour, then its
    smaller neighbours (and itself) to the least of them. The edges end up as one star for each component.
    Each round is written to the shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _is_star(now):
            break
        both = now.union(now.select("v", "u"))
        large = _lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _lowest(large)
        after = materialize(small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").filter("u <> v").distinct(), "edges")
        discard(spark, now)
        now = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
