"""Quality rules with thresholds that follow the data.

Word, line and repetition counts of every document feed one mergeable quantile sketch for each
language, source and metric. The sketches give each (language, source) its own fences, which replace
fixed cutoffs, and a join with the fences decides every document. Fences of small groups lean on those of
their language, and these on those of all, by the number of documents, without a switch at any size.

The sketch is a log-linear histogram: a count for each bucket, where values below 64 have a bucket of
their own and a larger value shares one with values within 1/32 of it. Merging two sketches adds their
counts, so partial aggregation builds them before the shuffle, a language's sketch is the sum of its
sources' sketches, and the result doesn't depend on the order of rows.

Defined results: a null text counts as empty (n_words 0, so base_failed); null language or source is a
group of its own; repeated rows and repeated or null ids are judged one by one and all returned; an
empty table gives no rows; further columns of the input pass through quality_rules() untouched unless
they carry the name of a result column, in which case the result replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, words

#: Tests of the base, as documented in the contract.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Metric: (numerator, denominator, scale, has a lower fence, lower and upper percentile, reach). The fences lie
#: reach times the distance of the two percentiles beyond them. Traits of most documents are measured by
#: quartiles, which junk can hardly move; repetitions, which few documents have but good ones too, by the tail.
#: A reach of 3 is the usual one for values far out of the quartiles; that of word length is larger, as the mean of
#: a short text varies more than those of most.
FAR_OUT = 3
METRICS = {
    "word_length": ("word_chars", "n_words", 100, True, (25, 75), 5),
    "symbols": ("n_symbols", "n_words", 1000, False, (25, 75), FAR_OUT),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, False, (75, 99), 1),
    "repeats": ("n_repeat_words", "n_words", 1000, False, (75, 99), 1),
}
PERCENTILES = sorted({p for m in METRICS.values() for p in m[4]})
#: Documents that the language's fences weigh next to a (language, source)'s own, and those of all next to a language's.
PRIOR = 100
MAX_BROADCAST_ROWS = 50_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _pairs(hashes: Column, step: int) -> Column:
    """Hash of each element with the one that stands step later."""
    return F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word).

    Repeated windows are found inside the row: neighbouring word hashes are combined three times into
    64-bit hashes of 8-word windows, and only rows in which two of them agree sort their windows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    keep = [F.col(c) for c in docs.columns if c not in COUNTS]
    df = docs.select(
        *keep,
        words(F.col(text)).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    keep += [F.col("n_symbols")]
    df = df.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    keep += [F.col(c) for c in ("n_words", "word_chars", "n_lines", "n_dup_lines")]
    for step in (1, 2, 4):
        df = df.select(*keep, _pairs(F.col("_h"), step).alias("_h"))
    df = df.select(*keep, F.slice("_h", 1, F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))).alias("_h"))
    df = df.select(*keep, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.col("_h")).alias("_h"))
    df = df.select(*keep, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("_s"))
    df = df.select(
        *keep,
        "_s",
        F.zip_with("_s", F.slice("_s", 2, F.size("_s")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))).alias("_eq"),
    )
    df = df.select(
        *keep,
        F.zip_with(
            F.zip_with("_s", "_eq", lambda a, e: F.struct(a["i"].alias("i"), e.alias("e"))),
            F.concat(F.array(F.lit(False)), "_eq"),
            lambda x, before: F.when(x["e"] | before, x["i"]),
        ).alias("_at"),
    )
    df = df.select(*keep, F.sort_array(F.filter("_at", lambda i: i.isNotNull())).alias("_at"))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "_at", start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"]
    )
    return df.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def metric(name: str) -> Column:
    top, bottom, scale, *_ = METRICS[name]
    return F.expr(f"CASE WHEN {bottom} > 0 THEN ({scale} * {top}) div {bottom} ELSE 0L END")


def bucket(value: Column) -> Column:
    """The sketch's bucket of a whole number of 0 or more; grows with the value."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 64 + F.floor(value / F.pow(F.lit(2.0), shift))).cast("int")


def edge(bucket_: str, last: bool = False) -> Column:
    """The least value in a bucket, or the greatest."""
    width = f"pow(2, {bucket_} div 64)"
    return F.expr(f"CAST(({bucket_} % 64 + 1) * {width} - 1 AS BIGINT)" if last else f"CAST(({bucket_} % 64) * {width} AS BIGINT)")


def sketches(counted: DataFrame) -> DataFrame:
    """level, lang, source, metric, bucket, n: sketches of (lang, source), of lang and of all, over the
    documents that pass the base. Additions of such tables merge the sketches."""
    long = counted.filter(~base_failed()).select(
        "lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(metric(m)).alias("bucket")) for m in METRICS))).alias("x")
    )
    fine = long.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))
    return (
        fine.groupingSets([["lang", "source", "metric", "bucket"], ["lang", "metric", "bucket"], ["metric", "bucket"]], "lang", "source", "metric", "bucket")
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
        .select(F.expr("CASE WHEN gid >= 8 THEN 2 WHEN gid >= 4 THEN 1 ELSE 0 END").alias("level"), "lang", "source", "metric", "bucket", "n")
    )


def fences(sketch: DataFrame) -> DataFrame:
    """level, lang, source, n and, for each metric, lo_<metric> and hi_<metric>.

    Both follow from the sketch alone; values of the bucket in which a percentile lies count as not beyond it.
    A trait that fewer than a quarter of a group's documents have leaves no distance between its quartiles. Its
    width is then the lower quartile of those that have it, in proportion to their share: a few documents
    with very much of it can't widen it to their own level, and it passes into the distance of the quartiles
    as the share grows.
    """
    group = Window.partitionBy("level", "lang", "source", "metric")
    ranked = sketch.withColumns({"cum": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group), "none": F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(group)})
    held = F.col("total") - F.col("none")
    found = ranked.groupBy("level", "lang", "source", "metric").agg(
        F.max("total").alias("n"),
        F.max(held).alias("held"),
        F.min(F.when((F.col("bucket") > 0) & (4 * (F.col("cum") - F.col("none")) >= held), F.col("bucket"))).alias("some"),
        *(F.min(F.when(100 * F.col("cum") >= p * F.col("total"), F.col("bucket"))).alias(f"b{p}") for p in PERCENTILES),
    )
    few = F.coalesce(F.col("held") * edge("some") / F.col("n"), F.lit(0.0))
    columns = []
    for m, (_, _, _, low, (p, q), times) in METRICS.items():
        reach = times * (edge(f"b{q}") - edge(f"b{p}")).cast("double")
        if m == "symbols":
            reach = F.greatest(reach, times * few)
        mine = F.col("metric") == m
        columns.append((F.max(F.when(mine, edge(f"b{p}") - reach)) if low else F.lit(None).cast("double")).alias(f"lo_{m}"))
        columns.append(F.max(F.when(mine, edge(f"b{q}", last=True) + reach)).alias(f"hi_{m}"))
    return found.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), *columns)


def thresholds(counted: DataFrame) -> DataFrame:
    """lang, source and the fences that hold for them: a row for each pair in the input."""
    names = [f"{side}_{m}" for m in METRICS for side in ("lo", "hi")]
    f = materialize(fences(sketches(counted)), "fences")
    own, lang, whole = (f.filter(F.col("level") == i).drop("level") for i in range(3))
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), *(F.col(c).alias(f"l_{c}") for c in names))
    whole = whole.select(*(F.col(c).alias(f"w_{c}") for c in names))
    pairs = counted.select("lang", "source").distinct()
    own = own.select(F.col("lang").alias("o_lang"), F.col("source").alias("o_source"), F.col("n").alias("o_n"), *(F.col(c).alias(f"o_{c}") for c in names))
    joined = (
        pairs.join(own, pairs.lang.eqNullSafe(own.o_lang) & pairs.source.eqNullSafe(own.o_source), "left")
        .join(F.broadcast(lang) if lang.count() <= MAX_BROADCAST_ROWS else lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")
        .join(F.broadcast(whole), F.lit(True), "left")  # one row
    )

    def lean(n: str, own: Column, on: Column) -> Column:
        return F.coalesce((F.col(n).cast("double") * own.cast("double") + PRIOR * on) / (F.col(n) + PRIOR).cast("double"), on)

    pick = lambda c: lean("o_n", F.col(f"o_{c}"), lean("l_n", F.col(f"l_{c}"), F.col(f"w_{c}").cast("double")))
    return joined.select("lang", "source", *(pick(c).alias(c) for c in names))


def judge(counted: DataFrame) -> DataFrame:
    """counted, from with_counts(), with base_failed and kept.

    The counted rows are written once and read twice, for the sketches and for the verdicts. The fences
    have a row for each (lang, source) in the data; the join broadcasts them if they are few.
    """
    counted = materialize(counted.drop("base_failed", "kept"), "counted")
    limits = materialize(thresholds(counted), "thresholds")
    names = [c for c in limits.columns if c not in ("lang", "source")]
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *names)
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    inside = F.lit(True)
    for m in METRICS:
        below = F.coalesce(metric(m) <= F.col(f"hi_{m}"), F.lit(True))
        if m == "symbols":  # a text measures the rate in steps of one symbol, so a width is one of them at least
            below |= F.col("n_symbols") <= FAR_OUT
        inside &= F.coalesce(metric(m) >= F.col(f"lo_{m}"), F.lit(True)) & below
    judged = counted.join(broadcast_if_small(limits, MAX_BROADCAST_ROWS), same, "left")
    return judged.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & inside}).drop("_lang", "_source", *names)


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs (text, lang, source, ...) with the counts, base_failed and kept."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang", "source")
    judged = judge(with_counts(packed).drop("text"))
    results = [*COUNTS, "base_failed", "kept"]
    return judged.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in results), *results)
