"""Nearest neighbours by inner product: an inverted file with product-quantised residuals, searched by bounds.

Coarse centroids and the codebooks of residuals are fitted on a bounded sample; every vector is indexed: it
goes to its nearest centroid's list with the code of what is left, and with the length of what the code loses.
A query meets the index twice. It visits the lists whose centroids have the largest inner products with it until
they hold FIRST rows for each answer; the k-th best of these is what any other answer must reach. Then it visits
all further lists that can reach that: the centroid's inner product plus a slack, which is the query's length
times that of the list's longest residual. Within a list, asymmetric distance tables (query against codebook)
give each vector's inner product up to what its code loses, with a slack alike, and those that can reach the
bound are scored exactly on the original vectors in double precision.

With both slacks in full nothing is ever missed, but then hardly anything is ruled out. What part of them is
needed is measured: MEASURED of the queries are compared with all rows, and the parts are those that WANTED of
their true neighbours need, list by list and code by code. As the slacks go by a query's, a list's and a
vector's own length, rows of very different lengths, tight clusters and queries unlike the rows are served alike. Clustered
vectors need few lists; vectors without structure need most.

Lists are packed into bins of bounded size, a long list into several, so a list that holds a third of all
vectors is many tasks' work. Queries go to the bins of the lists that they visit.

With exact=True every list is visited and every vector of it is scored, which finds the true neighbours.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, as queries or as candidates; null ids take no part; ties go to the smaller id, also
among equal vectors; of several vectors under one id the least, component by component, counts, so an id is
one query and one candidate; a query has fewer than k answers only if there are fewer candidates; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows that the centroids and codebooks are fitted on, at most; rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: Lists: about the root of the number of vectors, up to a most.
MAX_LISTS = 4096
#: Queries that are compared with all rows, at most, and the share of their neighbours that each of the two bounds must leave.
MEASURED, WANTED = 200, 0.999
#: Parts of a vector that are quantised, and codes a part; rows of a bin; rows of the lists that are visited first, for each answer.
PARTS, CODES, BIN_ROWS, FIRST = 16, 256, 4000, 100
#: Rounding of an inner product, for lengths of 1.
ROUNDING = 1e-9
#: Queries that meet a bin in one task, about.
QUERY_ROWS = 20_000


def valid(embedding: Column) -> Column:
    inside = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(inside & F.exists(embedding, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """id, x: the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & valid(F.col("x")))
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("x") == (usual["n"] if usual else 0)).groupBy("id").agg(F.min("x").alias("x"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list, and the codes of its residual."""
        at = _nearest(x, self.centres)
        rest = x - self.centres[at]
        return at, np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        x = self.centres[at]
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            x[:, c] += b[codes[:, i]]
        return x

    def approximate(self, q: np.ndarray, codes: np.ndarray, centre: int) -> np.ndarray:
        """Inner products of the queries with the coded vectors of a list: one table look-up a part."""
        total = np.repeat((q @ self.centres[centre])[:, None], len(codes), axis=1)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            total += (q[:, c] @ b.T)[:, codes[:, i]]
        return total


def fit(rows: DataFrame, n: int) -> Index:
    """From at most SAMPLE rows, the first by a hash of their ids."""
    sample = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(SAMPLE).select("x").toPandas()
    x = np.stack(sample["x"].to_numpy())
    centres = _k_means(x, max(1, min(MAX_LISTS, round(n**0.5))), 0)
    rest = x - centres[_nearest(x, centres)]
    cuts = [c for c in np.array_split(np.arange(x.shape[1]), min(PARTS, x.shape[1])) if len(c)]
    return Index(centres, [_k_means(rest[:, c], CODES, 1) for c in cuts], cuts)


def _bins(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(list, first bin, bins) of every list: whole lists share a bin up to BIN_ROWS, longer ones get several."""
    out, bin_, room = [], 0, BIN_ROWS
    for i, n in sorted(sizes.items()):
        if n > BIN_ROWS:
            many = -(-n // BIN_ROWS)
            out.append((i, bin_ + 1, many))
            bin_, room = bin_ + many + 1, BIN_ROWS
            continue
        if n > room:
            bin_, room = bin_ + 1, BIN_ROWS
        room -= n
        out.append((i, bin_, 1))
    return out


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


@dataclass
class Lists:
    """What a query must know of the lists: rows, and the longest residual."""

    index: Index
    filled: np.ndarray
    far: np.ndarray

    def first(self, q: np.ndarray, n: int) -> np.ndarray:
        """Whether a query visits a list first: as many of the nearest as hold n rows."""
        order = np.argsort(-(q @ self.index.centres.T), axis=1, kind="stable")
        before = np.cumsum(self.filled[order], axis=1) - self.filled[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, before < n, axis=1)
        return out

    def reach(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroids' inner products with the queries, and the slacks in full."""
        near, size = q @ self.index.centres.T, _length(q)[:, None]
        return near + ROUNDING * size * (_length(self.index.centres) + self.far), size * self.far


def _part(short: np.ndarray, slack: np.ndarray) -> float:
    """The part of the slacks that makes up for what WANTED of the pairs are short of."""
    if not len(short):
        return 0.0
    needed = np.where(short <= 0, 0.0, np.divide(short, slack, out=np.ones_like(short), where=slack > 0))
    return float(min(1.0, np.quantile(needed, WANTED, method="higher")))


def _slacks(asked: pd.DataFrame, filed: DataFrame, lists: Lists, k: int, n: int) -> tuple[float, float]:
    """The parts of the slacks of lists and of codes that are needed. asked: some queries, id, x and least (their
    bound), which every row is compared with."""
    ids, q, least, size = asked["id"].to_numpy(), np.stack(asked["x"].to_numpy()), asked["least"].to_numpy(), _length(np.stack(asked["x"].to_numpy()))
    columns = ["query", "id", "score", "list", "short", "slack"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({c: [] for c in columns})
        for f in frames:
            if not len(f):
                continue
            x, own = np.stack(f["x"].to_numpy()), f["id"].to_numpy()
            score = q @ x.T
            score[ids[:, None] == own] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            query, row = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
            at, codes = f["list"].to_numpy()[row], np.frombuffer(b"".join(f["code"].iloc[row]), np.uint8).reshape(len(row), -1)
            code = (q[query] * lists.index.decode(at, codes)).sum(axis=1) + ROUNDING * size[query] * f["size"].to_numpy()[row]
            some = pd.DataFrame(dict(zip(columns, (query, own[row], score[query, row], at, least[query] - code, size[query] * f["lost"].to_numpy()[row]), strict=True)))
            best = pd.concat([best, some[some["score"] > -np.inf]]).sort_values(["query", "score", "id"], ascending=[True, False, True]).groupby("query").head(k)
        yield best

    compared = filed.mapInPandas(compare, "query int, id long, score double, list int, short double, slack double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    true = compared.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r").toPandas()  # k rows for each of MEASURED queries
    query, at = true["query"].to_numpy(), true["list"].to_numpy()
    near, slack = lists.reach(q)
    later = ~lists.first(q, n)[query, at]
    short = np.where(later, least[query] - near[query, at], -np.inf)
    return _part(short, slack[query, at]), _part(np.where(later, true["short"].to_numpy(), -np.inf), true["slack"].to_numpy())


def nearest(vectors: DataFrame, k: int = 20, is_query: Column | None = None, key: str = "vec_id", embedding: str = "embedding", exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows with the largest inner products found,
    its own row left out. is_query: a condition on the column id; all rows by default."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, key, embedding), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(rows, n)
    held = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centroids and 256 codes a part

    def file(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = np.stack(f["x"].to_numpy())
                at, codes = held.value.encode(x)
                lost, far = _length(x - held.value.decode(at, codes)), _length(x - held.value.centres[at])
                yield pd.DataFrame({"list": at.astype(np.int32), "id": f["id"], "x": f["x"], "code": [c.tobytes() for c in codes], "lost": lost, "far": far, "size": _length(x)})

    filed = materialize(rows.mapInPandas(file, "list int, id long, x array<double>, code binary, lost double, far double, size double"), "index")
    held_by = {r["list"]: r for r in filed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row a list
    sizes = {i: r["n"] for i, r in held_by.items()}
    bins = _bins(sizes)
    of = range(len(index.centres))
    lists = Lists(index, np.array([sizes.get(i, 0) for i in of]), np.array([held_by[i]["far"] if i in held_by else 0.0 for i in of]))
    known = spark.sparkContext.broadcast(lists)
    bins_of = {i: range(first, first + many) for i, first, many in bins}
    at_first = n if exact else min(n, k * FIRST + 1)  # the query's own row may be one

    queries = rows if is_query is None else rows.filter(is_query)
    # Both sides of a task are bounded: a bin's vectors, which meet the queries block by block.
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    places = F.broadcast(spark.createDataFrame(bins, "list int, first int, many int"))  # at most MAX_LISTS rows
    filed_in = filed.join(places, "list").withColumn("in_bin", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int"))
    filed_in = filed_in.select("in_bin", "list", "id", "x", "code", "lost", "size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("for_block"))

    def met(queries: DataFrame, slack: tuple[float, float] | None) -> DataFrame:
        """query_id, vec_id, score: at most k of each bin, from the lists visited first, or (queries with least) from the others."""

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for a in range(0, len(f), 1000):
                    some = f.iloc[a : a + 1000]
                    q = np.stack(some["x"].to_numpy())
                    go = known.value.first(q, at_first)
                    if slack:
                        near, full = known.value.reach(q)
                        go = ~go & (near + slack[0] * full >= some["least"].to_numpy()[:, None])
                    out = []
                    for i, row in enumerate(go):
                        visits: dict[int, list[int]] = {}
                        for visited in np.flatnonzero(row):
                            for b in bins_of.get(int(visited), ()):
                                visits.setdefault(b, []).append(int(visited))
                        out += [(b, some["id"].iloc[i], some["x"].iloc[i], some["least"].iloc[i], v) for b, v in visits.items()]
                    yield pd.DataFrame(out, columns=["bin", "query_id", "q", "least", "visits"])

        def search(asked: pd.DataFrame, filed: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(filed):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            filed = filed.sort_values(["list", "id"], kind="stable")
            ids, x, size = filed["id"].to_numpy(), np.stack(filed["x"].to_numpy()), filed["size"].to_numpy()
            codes, lost = np.frombuffer(b"".join(filed["code"]), np.uint8).reshape(len(filed), -1), filed["lost"].to_numpy()
            here, first = np.unique(filed["list"].to_numpy(), return_index=True)
            last, out = [*first[1:], len(filed)], []
            for a in range(0, len(asked), 256):
                some = asked.iloc[a : a + 256]
                q, least = np.stack(some["q"].to_numpy()), some["least"].to_numpy()
                rounding = ROUNDING * _length(q)
                near = np.full((len(q), len(filed)), -np.inf)
                visits = [set(v) for v in some["visits"]]
                for centre, i, j in zip(here, first, last, strict=True):
                    by = [row for row, v in enumerate(visits) if centre in v]
                    if by and slack:
                        near[by, i:j] = held.value.approximate(q[by], codes[i:j], centre) + slack[1] * _length(q[by])[:, None] * lost[i:j]
                    elif by:
                        near[by, i:j] = q[by] @ x[i:j].T
                near += rounding[:, None] * size
                for i, query in enumerate(some["query_id"].to_numpy()):
                    best = np.flatnonzero((near[i] > -np.inf) & (ids != query))
                    if slack:
                        best = best[near[i][best] >= least[i]]
                    elif len(best) > k:
                        best = best[near[i][best] >= np.partition(near[i][best], -k)[-k] - 2 * rounding[i] * size[best].max()]
                    score = (x[best] * q[i]).sum(axis=1)
                    if slack:
                        best, score = best[score >= least[i]], score[score >= least[i]]
                    top = np.lexsort((ids[best], -score))[:k]
                    out.append(pd.DataFrame({"query_id": query, "vec_id": ids[best][top], "score": score[top]}))
            return pd.concat(out)

        asked = queries.mapInPandas(ask, "bin int, query_id long, q array<double>, least double, visits array<int>").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        return asked.groupBy("bin", "block").cogroup(filed_in.groupBy("in_bin", "for_block")).applyInPandas(search, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = best(met(queries.withColumn("least", F.lit(float("-inf"))), None))
    if at_first < n:
        found = materialize(found, "first")
        least = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
        queries = materialize(queries.join(least, "id", "left").fillna(float("-inf"), ["least"]), "queries")
        some = queries.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(MEASURED).select("id", "x", "least").toPandas()
        if len(some):
            found = best(found.drop("rank").unionByName(met(queries, _slacks(some, filed, lists, k, at_first))))
    return found
