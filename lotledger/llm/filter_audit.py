"""How filters of a corpus work together: what every order of them removes at every step.

A document counts only by the set of filters that it fails, so each part of the corpus is a table of at most
2^k counts. Orders of k filters are paths through the lattice of the subsets applied so far, from none to all:
an edge adds one filter and removes the documents that fail it and none before. Going forward, each state
gets the number of ways to reach it; going backward, the number of ways to leave it. Their product over an
edge is the number of orders that use it, so a filter's removals over all orders are a weighted sum over its
edges, and what each order does at each step is read from the same edges.

Defined results: null texts are empty; null languages are the part ''; documents with a null id are never later
than another, so they fail no test of copies; rows that repeat text and id are not copies of each other;
several labels of one id count as one that has what any has; labels of a null id belong to no document; an
empty table has no parts and gives no rows; very long texts are one row's work; further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, words

#: The tests of a text, in order of their letters; the last filter is that of copies.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
FILTERS = "ABCDE"
MAX_BROADCAST_ROWS = 50_000


def text_failures(text: Column) -> list[Column]:
    """Whether a text, which isn't null, fails the filters A to D."""
    w = words(text)
    n = F.size(w).cast("long")
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(w)).cast("long") < MIN_DISTINCT_PERCENT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITAL_PERCENT * F.length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask: the set of filters that each document fails, filter i as bit i.

    Texts are read once; what is written and shuffled is a digest a document. Copies meet as one row with
    the least id, aggregated before the shuffle, and only texts that occur more than once are joined back.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("_t"))
    mask = sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_failures(F.col("_t"))))
    rows = materialize(rows.select("doc_id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("digest")), "digests")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("_digest"), "first")
    joined = rows.join(broadcast_if_small(materialize(first, "copies"), MAX_BROADCAST_ROWS), F.col("digest") == F.col("_digest"), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: the number of documents for each set of failed filters."""
    label = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = failed.join(label, F.col("doc_id") == F.col("_id"), "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))


def paths(k: int) -> tuple[list[int], list[int]]:
    """For every subset of k filters, the orders that lead to it from none and from it to all."""
    full = (1 << k) - 1
    reach, leave = [1] + [0] * full, [0] * full + [1]
    for s in range(full + 1):  # a subset's number is above those of its subsets
        for f in range(k):
            if not s >> f & 1:
                reach[s | 1 << f] += reach[s]
    for s in range(full, -1, -1):
        for f in range(k):
            if s >> f & 1:
                leave[s ^ 1 << f] += leave[s]
    return reach, leave


def lattice(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, state, filter and what the edge from state to state with filter does, with shapley, a sum over the
    filter's edges weighted by the number of orders that use them. counted: as from cells()."""
    k = len(filters)
    reach, leave = paths(k)
    e = counted.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(k * 2**k - 1))))
    e = e.select("*", F.expr(f"edge div {k}").cast("int").alias("state"), (F.col("edge") % k).alias("filter"))
    e = e.withColumn("bit", F.expr("shiftleft(1, filter)")).filter("state & bit = 0")
    fails, before = F.expr("mask & bit <> 0"), F.expr("mask & state <> 0")
    only = F.col("mask") == F.col("bit")
    here = fails & ~before
    total = lambda test, n="n": F.sum(F.when(test, F.col(n)).otherwise(0))
    e = e.groupBy("part", "state", "filter", "bit").agg(
        total(~fails & ~before).alias("kept"),
        total(here).alias("removed"),
        total(fails & before).alias("redundant"),
        total(only).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    at = lambda numbers, state: F.element_at(F.array(*(F.lit(n).cast("long") for n in numbers)), state + 1)
    e = e.withColumn("orders", at(reach, F.col("state")) * at(leave, F.col("state") + F.col("bit")))
    sums = e.groupBy(F.col("part").alias("_part"), F.col("filter").alias("_filter")).agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    return e.join(sums, (F.col("part") == F.col("_part")) & (F.col("filter") == F.col("_filter"))).drop("_part", "_filter", "bit")


def orders(edges: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of its edge, for every order of the filters."""
    steps = []
    for order in permutations(range(len(filters))):
        state = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), step, state, f))
            state |= 1 << f
    table = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, _state int, _filter int")
    joined = edges.join(F.broadcast(table), (F.col("state") == F.col("_state")) & (F.col("filter") == F.col("_filter")))  # k * k! rows, whatever the corpus
    return joined.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counted = materialize(cells(failures(docs), labels), "cells")
    return orders(materialize(lattice(counted), "edges"))
