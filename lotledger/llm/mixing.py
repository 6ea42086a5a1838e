"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, pass after pass up to the limit of repeats. A queued
copy finishes at the virtual time (words of its source up to and including it) / (target of its source);
all copies are ranged by that time and the mix ends at the total budget. Queues advance in proportion to
their targets, so every source's share comes out within about one document of its target.

Running sums never put a source, or the whole queue, into one task: rows are dealt into blocks in order,
block totals are summed, and running sums inside blocks start from the total of the blocks before. A
source of n rows gets about sqrt(n) blocks of sqrt(n) rows, so both levels grow with the root only.

Defined results: null texts have size 0; sources come by code point with null last; documents of size 0
are never taken; a source without words has target 0; rows alike in doc_id, source and text, which a hash can't
tell apart, are counted, stand next to each other in the queue and are taken one by one; an empty table gives
no rows; further columns pass through mix() untouched, whatever their names.

Windows without a partition run over the sources, and over about the root of the number of documents of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, each, materialize, number_alike, place_of, running_sum, words

WEIGHTS = (3, 1, 2)
SHARE_PERCENT, MAX_REPEATS = 150, 2
MAX_BROADCAST_ROWS = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, n_docs, target: one row a source, from rows of (source, size).

    The budget is shared by weight; a share above repeats times its source's size stops there and the
    excess is shared again. Sorted by size / weight, the stopped sources come first, so the level at
    which the others stand is found in one pass of running sums over the source table.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    s = s.withColumn("w", weight.cast("double")).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "budget": F.sum("source_size").over(Window.partitionBy()) * F.lit(percent / 100),
        }
    ).withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    stopped = F.col("cap") <= F.col("level") * F.col("w")
    # Levels rise while sources are stopped; the first source that isn't has the level of all that follow.
    s = s.withColumn("common", F.min(F.when(~stopped, F.struct(F.col("cap") / F.col("w"), F.col("level").alias("level")))).over(Window.partitionBy())["level"])
    return s.select("source", "source_size", "n_docs", F.when(stopped, F.col("cap")).otherwise(F.col("common") * F.col("w")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the words of its text, and key, its place in the shuffle: by id and text, so rows without
    an id, or that share one, are spread as well."""
    content = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), content).cast("binary"))
    return docs.withColumns({"size": F.size(words(F.col("text"))).cast("long"), "key": key})


def alike(rows: DataFrame) -> DataFrame:
    """source, doc_id, size, key, same: rows alike in all of them, counted before they are moved."""
    return rows.groupBy("source", "doc_id", "size", "key").agg(F.count("*").alias("same"))


def _alike_key() -> Column:
    return F.concat(F.col("key"), F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("")))


def _place_in_source() -> Column:
    return F.struct("key", "size", F.coalesce(F.col("doc_id"), F.lit(-1).cast("long")).alias("doc_id"), "copy")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, repeats: int = MAX_REPEATS) -> DataFrame:
    """A row a source: source, source_size, target and last_0, last_1, ...: the place of the last document
    that the mix takes in each pass over the source (null: none). rows: as from alike(), on disk."""
    sizes = rows.select("source", (F.col("size") * F.col("same")).alias("size"))
    shares = materialize(targets(sizes, weights, percent, repeats), "targets")
    by_source = broadcast_if_small(shares.withColumnRenamed("source", "_source"), MAX_BROADCAST_ROWS)
    queue = rows.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").filter("size > 0 AND target > 0")
    queue = queue.withColumns({"words": F.col("size") * F.col("same"), "block": F.floor(place_of(F.col("key")) * F.ceil(F.sqrt("n_docs"))).cast("long")})
    queue = running_sum(queue.drop("n_docs"), ["source"], "block", [F.col("key"), F.col("size"), F.col("doc_id")], "words", "upto").drop("block", "words")
    queue = each(materialize(queue, "queue"), "same", "copy").withColumn("cum", F.col("upto") - (F.col("same") - 1 - F.col("copy")) * F.col("size"))
    queue = queue.withColumn("place", _place_in_source()).drop("upto", "same", "key", "doc_id", "copy")
    copies = queue.withColumn("pass", F.explode(F.array(*(F.lit(i) for i in range(repeats)))))
    copies = copies.withColumn("finish", (F.col("cum") + F.col("pass") * F.col("source_size")) / F.col("target"))
    copies = copies.withColumn("turn", F.struct("finish", F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source"), F.lit("")).alias("source"), "place"))
    # The targets add up to the budget, so the mix ends close to the virtual time 1.
    n = max(1, int((rows.agg(F.sum("same")).first()[0] or 0) ** 0.5))
    copies = copies.withColumn("span", F.least(F.floor(F.col("finish") * n), F.lit(4 * n)).cast("long"))
    spans = copies.groupBy("span").agg(F.sum("size").alias("words")).withColumn("cum", F.sum("words").over(Window.orderBy("span")))
    budget = F.lit((shares.agg(F.sum("source_size")).first()[0] or 0) * (percent / 100))
    # Whole spans that fit, then the copies of the next span in turn: the last one that fits ends the mix.
    full = spans.filter(F.col("cum") <= budget).agg(F.max("span"), F.max("cum")).first()
    last = spans.filter(F.col("cum") > budget).agg(F.min("span")).first()[0]
    taken = F.lit(True)
    if last is not None:
        ends = copies.filter(F.col("span") == last).withColumn("cum", F.lit(full[1] or 0) + F.sum("size").over(Window.orderBy("turn")))
        cut = materialize(ends.filter(F.col("cum") <= budget).agg(F.max("turn").alias("cut")), "cut")
        copies = copies.crossJoin(F.broadcast(cut))  # one row
        taken = (F.col("span") < last) | F.coalesce((F.col("span") == last) & (F.col("turn") <= F.col("cut")), F.lit(False))
    ends = copies.filter(taken).groupBy("source").agg(*(F.max(F.when(F.col("pass") == i, F.col("place"))).alias(f"last_{i}") for i in range(repeats)))
    ends = ends.withColumnRenamed("source", "_source")
    return materialize(shares.join(ends, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "n_docs"), "plan")


def with_copies(rows: DataFrame, mixed: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """rows (doc_id, source, size, key, copy, ...) with source_size, target and copies, the times each is taken. copy
    numbers rows that are alike."""
    mixed = broadcast_if_small(mixed.withColumnRenamed("source", "_source"), MAX_BROADCAST_ROWS)
    place = _place_in_source()
    copies = sum((F.coalesce((place <= F.col(f"last_{i}")).cast("int"), F.lit(0)) for i in range(1, repeats)), F.coalesce((place <= F.col("last_0")).cast("int"), F.lit(0)))
    joined = rows.join(mixed, F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0)).drop("_source", "key", "copy", *(f"last_{i}" for i in range(repeats)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = SHARE_PERCENT, repeats: int = MAX_REPEATS) -> DataFrame:
    """docs as mixed: every document as many times as the mix takes it. Texts stay where they were read;
    only the plan, a row a source, is joined to them."""
    rows = materialize(alike(sized(docs.select("doc_id", "source", "text")).drop("text")), "sized")
    mixed = plan(rows, weights, percent, repeats)
    packed = sized(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text")).withColumn("alike", _alike_key())
    repeated = materialize(rows.filter("same > 1").select(_alike_key().alias("alike")), "repeated")
    out = with_copies(number_alike(packed.drop("text"), "alike", repeated, MAX_BROADCAST_ROWS), mixed, repeats)
    return out.filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")
