"""Quality classifier: regularised quadratic discriminant over document statistics.

Every document becomes a short vector of transformed text statistics. For each class, counts, sums and
second moments of the labelled documents are added up by Spark (partial sums before one small shuffle),
so all labelled rows count and only 2 * (1 + d + d * d) numbers reach the driver. Covariances are shrunk
towards the pooled one and towards its diagonal, their Cholesky factors are computed once, and a document's
score is the logistic of its log prior odds plus the difference of two log densities, each a Mahalanobis
distance by one triangular product.

Defined results: a null text counts as empty and gets a score as any other; labels that are null, not 0
or 1, or contradict each other for one doc_id aren't learnt from; repeated rows of documents are scored one
by one; with no usable label of one class every score is the share of label 1 (0.5 with none at all); an
empty table gives no rows; further columns pass through score() untouched unless they carry the name of a
result column, which replaces them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD

THRESHOLD = 0.3
#: Shares of the pooled covariance and of the diagonal in a class's covariance; least variance.
POOLED, DIAGONAL, FLOOR = 0.2, 0.05, 1e-4
_WORD = re.compile(WORD)
_UPPER, _DIGIT, _SYMBOL, _SHOUT = bytes(range(65, 91)), b"0123456789", b"#*$%&<>", b"!?"
N_FEATURES = 14


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    joined = "".join(words)
    raw = joined.encode()
    share = lambda drop: ((len(raw) - len(raw.translate(None, drop))) / len(joined)) ** 0.5
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    distinct = len(set(words))
    return [
        np.log1p(n),
        np.log(len(joined) / n),
        np.log1p(distinct) / np.log1p(n),
        share(_UPPER),
        share(_DIGIT),
        share(_SYMBOL),
        share(_SHOUT),
        share(b"|"),
        (joined.count(".") / n) ** 0.5,
        (joined.count(",") / n) ** 0.5,
        (1 - len(set(lines)) / len(lines)) ** 0.5,
        (sum(map(eq, words, words[1:])) / n) ** 0.5,
        np.log(max(map(len, words))),
        (len(lines) / n) ** 0.5,
    ]


def with_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """docs with the statistics as array<double> in place of the text."""
    rest = [f for f in docs.schema.fields if f.name not in (text, name)]
    schema = T.StructType([*rest, T.StructField(name, T.ArrayType(T.DoubleType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics(t) for t in batch.column(text).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in rest} | {name: found})

    return docs.mapInArrow(run, schema)


@dataclass
class Model:
    """Log prior odds and, for classes 0 and 1, means, inverse Cholesky factors and log determinants."""

    odds: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    logdets: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.odds)
        if self.means is not None:
            for c, sign in ((0, -1), (1, 1)):
                d = (x - self.means[c]) @ self.factors[c].T
                z += sign * -0.5 * ((d * d).sum(axis=1) + self.logdets[c])
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def moments(rows: DataFrame, label: str = "label", stats: str = "stats") -> DataFrame:
    """label, at, value: per class the count (at 0), the sums (1 to d) and the products (from d + 1)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c, part in frame.groupby(label):
                x = np.stack(part[stats].to_numpy())
                values = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                yield pd.DataFrame({"label": int(c), "at": np.arange(len(values), dtype=np.int32), "value": values})

    return rows.select(label, stats).mapInPandas(run, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value"))


def fit(rows: DataFrame, label: str = "label", stats: str = "stats") -> Model:
    """Learn from rows of (label 0 or 1, statistics)."""
    found = moments(rows, label, stats).toPandas().sort_values(["label", "at"])  # 2 * (1 + d + d * d) rows
    sums = {int(c): part["value"].to_numpy() for c, part in found.groupby("label")}
    n = np.array([sums[c][0] if c in sums else 0.0 for c in (0, 1)])
    if not n.all():
        return Model(float(np.log((n[1] + 1) / (n[0] + 1))) if n.any() else 0.0)
    d = int((4 * len(sums[0]) - 3) ** 0.5 - 1) // 2
    means = np.stack([sums[c][1 : d + 1] / n[c] for c in (0, 1)])
    scatter = [sums[c][d + 1 :].reshape(d, d) - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    factors, logdets = [], []
    for c in (0, 1):
        own = (scatter[c] + 10 * pooled) / (n[c] + 10)
        cov = (1 - POOLED) * own + POOLED * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(d)
        root = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(root))
        logdets.append(2 * np.log(np.diag(root)).sum())
    return Model(float(np.log(n[1] / n[0])), means, np.stack(factors), np.array(logdets))


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether the CRC-32 of the id as text leaves the remainder fold (null: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """label, stats of the documents that may be learnt from: labelled 0 or 1 without contradiction, and
    not held out. stats: doc_id, stats."""
    clear = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("_most")).filter("label = _most")
    return stats.filter(~held_out(F.col("doc_id"))).join(clear, "doc_id").select(F.col("label").cast("int"), "stats")


def score(rows: DataFrame, model: Model, stats: str = "stats", threshold: float = THRESHOLD) -> DataFrame:
    """rows with score and predicted, from a column of statistics."""
    rest = [f for f in rows.schema.fields if f.name not in (stats, "score", "predicted")]
    schema = T.StructType([*rest, T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(stats).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = model.scores(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_pydict(
                {f.name: batch.column(f.name) for f in rest} | {"score": pa.array(found), "predicted": pa.array((found >= threshold).astype(np.int32))}
            )

    return rows.mapInArrow(run, schema)


def score_texts(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted, in one pass over the texts."""
    schema = T.StructType(
        [*(f for f in docs.schema.fields if f.name not in ("score", "predicted")), T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)]
    )
    names = schema.fieldNames()[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(text).to_pylist()]).reshape(batch.num_rows, N_FEATURES)
            found = model.scores(x)
            yield pa.RecordBatch.from_pydict(
                {n: batch.column(n) for n in names} | {"score": pa.array(found), "predicted": pa.array((found >= threshold).astype(np.int32))}
            )

    return docs.mapInArrow(run, schema)
