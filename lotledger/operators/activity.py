"""Search history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sales import union_sales


def search_activity(logs: dict[str, DataFrame], as_of: str, days: int = 30, limit: int | None = 20) -> DataFrame:
    """session_id, kind, key, searched_at: the latest entry of each key of the logs (session_id, key,
    searched_at) in the last days, newest first."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    tagged = [df.filter(F.col("searched_at") >= since).select("session_id", F.lit(kind).alias("kind"), "key", "searched_at") for kind, df in logs.items()]
    latest = union_sales(*tagged).groupBy("session_id", "kind", "key").agg(F.max("searched_at").alias("searched_at"))
    return latest if limit is None else latest.orderBy(F.desc("searched_at"), "session_id", "kind", "key").limit(limit)
