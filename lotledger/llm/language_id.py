"""Language identification by Bayesian fusion of what a page says, declares and is served from.

The posterior of a language is its prior at the host, times the likelihood of the text, of the language
that the markup declares and of the address suffix:

* the text likelihood is a smoothed byte-trigram model of documents of known language, summed over all
  documents; as neighbouring trigrams depend on each other, a text counts as at most EVIDENCE of them;
* the likelihoods of declaration and suffix are shares among all pages, weighted by what their texts say;
* the host's prior shrinks towards its domain's, which shrinks towards that of all pages; each level sums
  text posteriors by group, and a page is left out of its own host's sum.

All counts are grouped aggregations with partial sums, so a host with a third of all pages costs one row a
task; pages meet their host's prior in a join that Spark may split.

Defined results: a page without text, host or declaration has no such evidence, and the rest decides; null
html or url are such cases; documents without text or language aren't learnt from; ties go to the language
that comes first by name; repeated pages are judged one by one; with no known language or no pages there are
no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Least share of a language's trigrams that the model keeps, so at most 1 / MIN_SHARE for each language.
MIN_SHARE, SMOOTHING, EVIDENCE = 1e-6, 0.5, 40
#: Trigrams that a task counts at once.
AT_ONCE = 2_000_000
MAX_BROADCAST_ROWS = 50_000
#: Weight of the level above in a host's and a domain's prior, and of even shares in the likelihoods.
SHRINK, EVEN = 5.0, 1.0
_DROP = re.compile(r"(?is)<(script|style|nav|footer|header|aside|noscript)\b.*?</\1\s*>|<!--.*?-->|<div class=\"ad\">.*?</div>|<[^>]*>|&[#a-z0-9]+;")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 33 or 48 <= c <= 57 else c for c in range(256))


def visible(html: str | None) -> str:
    """The text of a page without navigation, advertisements and markup."""
    return _DROP.sub(" ", html or "")


def _trigrams(text: str | None) -> np.ndarray:
    raw = np.frombuffer(b" " + b" ".join((text or "").encode().translate(_LOWER).split()) + b" ", np.uint8).astype(np.int32)
    return raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:] if len(raw) > 2 else np.zeros(0, np.int32)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """lang, trigram, n over whole texts."""

    def counted(by: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, held in by.items():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int32)), pa.array(n)], ["lang", "trigram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            for i, lang in enumerate(langs):
                by.setdefault(lang, []).append(_trigrams(texts[i].as_py()))
                held += len(by[lang][-1])
                if held >= AT_ONCE:
                    yield from counted(by)
                    by, held = {}, 0
        yield from counted(by)

    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(run, "lang string, trigram int, n long")
    return rows.groupBy("lang", "trigram").agg(F.sum("n").alias("n"))


class TextModel:
    """Log likelihoods of texts by language."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.keys = np.unique(counts["trigram"].to_numpy())
        n = np.zeros((len(self.langs), len(self.keys) + 1))
        n[np.searchsorted(self.langs, counts["lang"]), np.searchsorted(self.keys, counts["trigram"])] = counts["n"]
        self.logs = np.log((n + SMOOTHING) / (n.sum(axis=1, keepdims=True) + SMOOTHING * n.shape[1]))

    def posterior(self, text: str | None) -> np.ndarray:
        """Shares of the languages by the text alone; even without text."""
        t = _trigrams(text)
        if not len(t):
            return np.full(len(self.langs), 1 / len(self.langs))
        at = np.minimum(np.searchsorted(self.keys, t), len(self.keys) - 1)
        at = np.where(self.keys[at] == t, at, len(self.keys))
        z = self.logs[:, at].mean(axis=1) * min(len(t), EVIDENCE)
        p = np.exp(z - z.max())
        return p / p.sum()


def fit(docs: DataFrame) -> TextModel | None:
    counts = materialize(trigram_counts(docs), "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    often = counts.join(totals, "lang").filter(F.col("n") >= MIN_SHARE * F.col("total")).select("lang", "trigram", "n").toPandas()  # at most 1 / MIN_SHARE a language
    return TextModel(often) if len(often) else None


def _shares(rows: DataFrame, by: str, langs: int) -> DataFrame:
    """by, likelihood: for each language the smoothed share of its pages that have this value."""
    sums = _sums(rows.filter(F.col(by).isNotNull()), by)
    totals = sums.agg(*(F.sum(F.col("s")[i]).alias(f"t{i}") for i in range(langs)), F.count("*").alias("values"))
    parts = [(F.col("s")[i] + EVEN) / (F.col(f"t{i}") + EVEN * F.col("values")) for i in range(langs)]
    return sums.crossJoin(F.broadcast(totals)).select(F.col(by).alias(f"_{by}"), F.array(*parts).alias(f"p_{by}"))  # totals: one row


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    n = len(rows.first()["text_p"]) if rows.take(1) else 1
    return rows.groupBy(*by).agg(F.array(*(F.sum(F.col("text_p")[i]) for i in range(n))).alias("s"))


def domain(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def identify(pages: DataFrame, docs: DataFrame, key: str = "page_id") -> DataFrame:
    """key, lang, probability, text_lang, declared, host for each page (key, url, html), from documents
    (text, lang) of known language."""
    spark = pages.sparkSession
    model = fit(docs)
    if model is None:
        return spark.createDataFrame([], f"{key} long, lang string, probability double, text_lang string, declared string, host string")
    held, langs = spark.sparkContext.broadcast(model), model.langs
    n = len(langs)
    fields = pages.select(
        key,
        "html",
        F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)).alias("host"),
        F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z]{2,3})", 1)).alias("declared"),
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            found = [held.value.posterior(visible(html[i].as_py())).tolist() for i in range(len(html))]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("host"), batch.column("declared"), pa.array(found, pa.list_(pa.float64()))], [key, "host", "declared", "text_p"])

    read_pages = fields.mapInArrow(read, f"{key} long, host string, declared string, text_p array<double>")
    none = lambda c: F.when(F.col(c) != "", F.col(c))
    read_pages = read_pages.withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    rows = materialize(read_pages.withColumns({c: none(c) for c in ("host", "declared", "suffix")}), "pages")
    everything = _sums(rows.withColumn("all", F.lit(0)), "all").select(F.col("s").alias("g"))
    hosts = _sums(rows.filter("host IS NOT NULL"), "host").withColumn("domain", domain(F.col("host")))
    domains = hosts.groupBy("domain").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(n))).alias("d"))
    total = lambda a: sum((F.col(a)[i] for i in range(1, n)), F.col(a)[0])
    above = lambda i: (F.col("d")[i] + SHRINK * F.col("g")[i] / total("g")) / (total("d") + SHRINK)
    priors = hosts.join(domains, "domain").crossJoin(F.broadcast(everything))  # one row
    priors = materialize(priors.select(F.col("host").alias("_host"), F.col("s").alias("h"), F.array(*(above(i) for i in range(n))).alias("a")), "priors")
    priors = broadcast_if_small(priors, MAX_BROADCAST_ROWS)  # one row a host: a host with very many pages isn't met in one task
    joined = (
        rows.join(priors, F.col("host") == F.col("_host"), "left")
        .join(_shares(rows, "declared", n), F.col("declared") == F.col("_declared"), "left")
        .join(_shares(rows, "suffix", n), F.col("suffix") == F.col("_suffix"), "left")
        .crossJoin(F.broadcast(everything))
    )
    own = lambda i: F.greatest(F.col("h")[i] - F.col("text_p")[i], F.lit(0.0))  # noqa: E731  without the page itself
    size = sum((own(i) for i in range(1, n)), own(0))
    prior = lambda i: F.coalesce((own(i) + SHRINK * F.col("a")[i]) / (size + SHRINK), F.col("g")[i] / total("g"))
    one = F.lit(1.0)
    weights = [F.col("text_p")[i] * prior(i) * F.coalesce(F.col("p_declared")[i], one) * F.coalesce(F.col("p_suffix")[i], one) for i in range(n)]
    fused = joined.select(key, "host", "declared", "text_p", F.array(*weights).alias("w"))
    names = F.array(*map(F.lit, langs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return fused.select(key, best(F.col("w")).alias("lang"), (F.array_max("w") / total("w")).alias("probability"), best(F.col("text_p")).alias("text_lang"), "declared", "host")
