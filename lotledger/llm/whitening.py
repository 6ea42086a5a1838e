"""Whitening of embeddings by the principal components of their distinct quantised vectors.

Vectors are quantised to whole numbers and each distinct one counts once. Their sums are exact; their scatter
is summed over tasks, each vector centred before it is multiplied. The scatter (dimension x dimension, which
does not grow with the rows) is factored on the driver: a Cholesky factor with diagonal pivoting, then
one-sided Jacobi rotations of the columns of that triangular factor until all are orthogonal. The squared
norms of the rotated columns are the eigenvalues of the scatter, the normalised columns its eigenvectors; the
scatter of the factor is never formed again, so small eigenvalues keep their digits.

Defined results: vectors that are null or hold null or non-finite entries are dropped; vectors of different
lengths are different spaces, each fitted apart; repeated rows and repeated or null ids are all returned, but
equal vectors count once in the fit; directions without variance are no components, so a space of one distinct
vector, or of vectors without entries, has none and gives no rows; quantised entries end at the range of a
long; a deviation beyond that range is null; an empty table gives no rows; further columns are not read.

Each task holds one matrix of dimension x dimension for each length that it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Steps of the grid that one unit of an embedding is divided into; components returned.
STEPS, COMPONENTS = 256, 4
#: Sweeps of rotations over all pairs of columns, at most; some ten are usual.
SWEEPS = 60
#: Floating-point sums of squares from here on need not fit a long.
LONG = 9.2e18


def quantised(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", steps: int = STEPS) -> DataFrame:
    """id, x (array of long): the vectors that take part."""
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("c"))
    finite = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False))).select("id", F.transform("c", lambda v: F.floor(v * steps).cast("long")).alias("x"))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Columns l with l @ l.T = a for a positive semidefinite a, the largest remaining diagonal entry first: lower
    triangular up to the order of its rows. As many columns as a has numerical rank."""
    rest, columns = a.astype(np.float64), []
    least = len(a) * np.finfo(np.float64).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    while len(columns) < len(a):
        p = int(rest.diagonal().argmax())
        if not rest[p, p] > least:
            break
        column = rest[:, p] / np.sqrt(rest[p, p])
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0
        columns.append(column)
    return np.array(columns).T.reshape(len(a), len(columns))


def orthogonal_columns(l: np.ndarray) -> np.ndarray:
    """l times a rotation that makes its columns orthogonal. A round rotates pairs without a common column at once."""
    a = l.copy()
    n = a.shape[1] + a.shape[1] % 2
    tolerance = np.finfo(np.float64).eps * max(4.0, np.sqrt(len(a)))
    seats = list(range(n))
    for _ in range(SWEEPS):
        rotated = False
        for _ in range(n - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[: n // 2], reversed(seats[n // 2 :]), strict=True)]
            p, q = np.array([x for x in pairs if x[1] < a.shape[1]], dtype=int).reshape(-1, 2).T
            u, v = a[:, p], a[:, q]
            alpha, beta, gamma = (u * u).sum(axis=0), (v * v).sum(axis=0), (u * v).sum(axis=0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if turn.any():
                rotated = True
                zeta = (beta - alpha)[turn] / (2 * gamma[turn])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                u, v = u[:, turn], v[:, turn]
                a[:, p[turn]], a[:, q[turn]] = c * u - c * t * v, c * t * u + c * v
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if not rotated:
            break
    return a


@dataclass(frozen=True)
class Space:
    """What the vectors of one length have in common. mean = whole + part / n, exactly."""

    n: int
    whole: np.ndarray
    part: np.ndarray
    components: np.ndarray  # (components, dimension), of unit length
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float64) - self.whole.astype(np.float64)) - self.part / self.n

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sum((n * x - sum) ** 2) of each row and where it fits a long: exact there, as whole numbers wrap around."""
        d = np.int64(self.n) * (x - self.whole) - self.part
        return (d * d).sum(axis=1, dtype=np.int64), ((self.n * self.centred(x)) ** 2).sum(axis=1) < LONG

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the places of its rows in the batch, and their vectors as a matrix."""
    x = batch.column("x")
    lengths = np.asarray(x.value_lengths(), dtype=np.int64)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        rows = x if len(at) == len(lengths) else x.take(pa.array(at))
        yield at, np.asarray(rows.flatten(), dtype=np.int64).reshape(len(at), d)


def _sums(fit_rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and sums of the vectors of each length."""
    per = fit_rows.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "v")).groupBy("d", "i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(19,0)")).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in per.orderBy("d", "i").collect():  # a row for each dimension
        found.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    return found




def _scatters(fit_rows: DataFrame, spaces: dict[int, Space]) -> dict[int, np.ndarray]:
    """The centred scatter of each length: a triangle from every task, added up before and after the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                d = x.shape[1]
                if d in spaces:
                    c = spaces[d].centred(x)
                    sums[d] = sums.get(d, 0) + c.T @ c
        for d, m in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.full(len(i), d, np.int32), i.astype(np.int32), j.astype(np.int32), m[i, j])], ["d", "i", "j", "v"])

    found = {d: np.zeros((d, d)) for d in spaces}
    for r in fit_rows.select("x").mapInArrow(partial, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():  # dimension squared
        found[r.d][r.i, r.j] = found[r.d][r.j, r.i] = r.v
    return found


def _identity_errors(fit_rows: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """Largest absolute entry of the covariance of the whitened fit rows minus the identity. Every task centres on
    its own mean; what its mean is off that of all is added when tasks are merged."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                d = x.shape[1]
                if d not in spaces:
                    continue
                w = spaces[d].whitened(x)
                n, mean = len(w), w.mean(axis=0)
                m2 = (w - mean).T @ (w - mean)
                if d in merged:
                    before, mean0, m20 = merged[d]
                    off = mean - mean0
                    m2 = m2 + m20 + np.outer(off, off) * (before * n / (before + n))
                    n, mean = before + n, mean0 + off * (n / (before + n))
                merged[d] = (n, mean, m2)
        for d, (n, mean, m2) in merged.items():
            yield pa.RecordBatch.from_pylist([{"d": d, "n": n, "mean": mean.tolist(), "m2": m2.ravel().tolist()}], pa.schema([("d", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))]))

    parts = materialize(fit_rows.select("x").mapInArrow(partial, "d int, n long, mean array<double>, m2 array<double>"), "whitened")
    k = max((len(s.eigenvalues) for s in spaces.values()), default=0)
    n = F.col("n").cast("double")
    means = parts.groupBy("d").agg(F.sum("n").alias("all"), *(F.sum(n * F.get("mean", F.lit(i))).alias(f"m{i}") for i in range(k)))
    means = {r.d: [r[f"m{i}"] / r["all"] for i in range(len(spaces[r.d].eigenvalues))] for r in means.collect()}
    errors = {}
    for d, space in spaces.items():
        size = len(space.eigenvalues)
        off = [F.get("mean", F.lit(i)) - means[d][i] for i in range(size)]
        at = [(i, j) for i in range(size) for j in range(size)]
        row = parts.filter(F.col("d") == d).agg(*(F.sum(F.get("m2", F.lit(i * size + j)) + n * off[i] * off[j]).alias(f"c{i}_{j}") for i, j in at)).first()
        errors[d] = max(abs(row[f"c{i}_{j}"] / space.n - (i == j)) for i, j in at)
    return errors


def fit(fit_rows: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """The space of each length of vector that has a direction with variance. fit_rows: x, each vector once."""
    spaces = {}
    for d, (n, s) in _sums(fit_rows).items():
        whole = np.array([v // n for v in s], dtype=np.int64)
        part = np.array([v % n for v in s], dtype=np.int64)
        spaces[d] = Space(n, whole, part, np.zeros((0, d)), np.zeros(0), 0.0)
    found = {}
    for d, scatter in _scatters(fit_rows, spaces).items():
        rotated = orthogonal_columns(pivoted_cholesky(scatter))
        squared = (rotated * rotated).sum(axis=0)
        order = np.argsort(-squared, kind="stable")[:components]
        if len(order):
            found[d] = replace(spaces[d], components=(rotated[:, order] / np.sqrt(squared[order])).T, eigenvalues=squared[order] / spaces[d].n, trace=float(np.trace(scatter)) / spaces[d].n)
    errors = _identity_errors(fit_rows, found) if found else {}
    return {d: replace(space, identity_error=float(errors[d])) for d, space in found.items()}


def project(rows: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of every row (id, x) and component."""
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    types = ["int", "long", "long", "double", "double", "double"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch):
                space = spaces.get(x.shape[1])
                if space is None:
                    continue
                k, m = len(space.eigenvalues), len(x)
                deviation, fits = space.deviation(x)
                whole = (np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, space.n, np.int64))
                real = (space.whitened(x).ravel(), np.tile(space.eigenvalues / space.trace, m), np.full(m * k, space.identity_error))
                ids = batch.column("id").take(pa.array(np.repeat(at, k)))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, whole), pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)), *map(pa.array, real)], ["id", *names])

    return rows.select("id", "x").mapInArrow(rows_of, ", ".join(["id " + rows.schema["id"].dataType.simpleString(), *(f"{a} {b}" for a, b in zip(names, types, strict=True))]))


def whiten(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, steps: int = STEPS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: vectors in the directions of their
    largest variance, each with unit variance over the distinct ones."""
    rows = quantised(vectors, key, embedding, steps)
    distinct = materialize(rows.select("x").distinct(), "distinct")
    return project(rows, fit(distinct, components)).withColumnRenamed("id", key)
