"""Shards that all match the mixture of sources: proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; a row's place in the whole is its fractional
rank, (rank + 1/2) / (rows of its source), so every stretch of the sorted places holds all sources in
proportion. The places are cut into shards of equal numbers of rows (law "rows") or of about equal bytes (law
"bytes"). A shard's rows of a source differ from the exact proportion by about one.

Neither a source nor the whole is ever ranked in one task: rows are dealt into blocks in the order of their
hash (and of their place, which is about uniform as well), block totals are summed, and ranks inside blocks
start from the total of the blocks before. n rows make about sqrt(n) blocks of sqrt(n) rows. Rows alike in id,
source and text, which a hash can't tell apart, are counted first and then given ranks next to each other.

Defined results: null texts are empty, of size 1 with the checksum of nothing; a null source is a source of its own; repeated
rows and repeated or null ids are rows like any other; equal texts may be in different shards, as a group of
copies can hold more than a shard; with fewer rows than shards some shards are empty; an empty table gives no
rows; results depend on ids, sources, texts, the number of shards and the seed only; further columns pass
through sharded() untouched.

Windows without a partition run over about the root of the number of rows of blocks.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, each, materialize, number_alike, place_of, running_sum

SHARDS, SEED = 16, "shards"
MAX_BROADCAST_ROWS = 50_000


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with size, text_crc32 and key, the place of the row in the shuffle of its source."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    of = F.coalesce(F.concat(F.length("source"), F.lit(":"), F.col("source")), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text), of).cast("binary"))
    return docs.withColumns({"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text), "key": key})


def assign(docs: DataFrame, shards: int = SHARDS, law: str = "rows", seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, key, copy, copies, shard, slot: a row for each of docs. Rows alike in
    id, source and text, copies of them, are numbered by copy."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    rows = keyed(docs.select("doc_id", "source", "text"), seed).drop("text")
    rows = materialize(rows.groupBy("doc_id", "source", "size", "text_crc32", "key").agg(F.count("*").alias("copies")), "rows")
    sources = materialize(rows.groupBy(F.col("source").alias("_source")).agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("bytes")), "sources")
    total = sources.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    ranked = rows.join(broadcast_if_small(sources.drop("bytes"), MAX_BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranked = ranked.withColumn("block", F.floor(place_of(F.col("key")) * F.ceil(F.sqrt("n"))).cast("long"))
    ranked = running_sum(ranked, ["source"], "block", [F.col("key"), F.col("size"), F.col("doc_id")], "copies", "upto").drop("block")
    ranked = each(materialize(ranked, "ranked"), "copies", "copy").withColumn("rank", F.col("upto") - F.col("copies") + F.col("copy"))
    ranked = ranked.withColumn("place", (F.col("rank") + 0.5) / F.col("n")).drop("n", "upto")
    spans = max(1, ceil(sqrt(total["n"] or 0)))
    ranked = ranked.withColumns({"span": F.floor(F.col("place") * spans).cast("long"), "one": F.lit(1).cast("long")})
    order = [F.col("place"), F.col("source").asc_nulls_last(), F.col("rank")]
    ranked = running_sum(ranked, [], "span", order, "one", "position").withColumn("position", F.col("position") - 1)
    keep = ["doc_id", "source", "size", "text_crc32", "key", "copy", "copies"]
    if law == "rows":
        n = total["n"] or 1
        shard = F.expr(f"(position * {shards}L) div {n}L")
        first = F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")  # the shard's least position
        return ranked.withColumn("shard", shard).withColumn("slot", F.col("position") - first).select(*keep, F.col("shard").cast("int"), "slot")
    ranked = running_sum(ranked, [], "span", order, "size", "bytes")
    middle = F.col("bytes") - F.col("size") / 2
    ranked = ranked.withColumn("shard", F.least(F.floor(middle / (total["bytes"] or 1) * shards), F.lit(shards - 1)).cast("int")).select(*keep, "position", "shard")
    ranked = materialize(ranked, "positions")
    first = ranked.groupBy(F.col("shard").alias("_shard")).agg(F.min("position").alias("_first"))  # a row a shard
    return ranked.join(F.broadcast(first), F.col("shard") == F.col("_shard")).select(*keep, "shard", (F.col("position") - F.col("_first")).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, law: str = "rows", seed: str = SEED) -> DataFrame:
    """shard, slot and row, a struct of the columns of docs: write it by shard, sorted by slot. Texts move once,
    to meet their place."""
    places = materialize(assign(docs, shards, law, seed), "places").select(*(F.col(c).alias(f"_{c}") for c in ("key", "copy", "copies", "shard", "slot")))
    rows = keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text"), seed).select("row", "key")
    # A key is one row, but for rows alike in id, source and text.
    repeated = materialize(places.filter("_copies > 1 AND _copy = 0").select(F.col("_key").alias("key")), "repeated")
    rows = number_alike(rows, "key", repeated, MAX_BROADCAST_ROWS)
    joined = rows.join(places, (F.col("key") == F.col("_key")) & (F.col("copy") == F.col("_copy")))
    return joined.select("_shard", "_slot", "row").toDF("shard", "slot", "row")
