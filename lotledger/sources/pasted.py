"""Tables of deed documents that were pasted as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_iso_date
from ..functions.keys import borough_code, norm_doc_type

# What the headers of the columns contain, the first that fits.
HEADERS = {
    "crfn": ["crfn", "city register filing number"],
    "document_id": ["document id", "doc id", "document_id", "docid", "document #"],
    "recorded_date": ["recorded", "filed", "date recorded", "date filed", "recording date", "file date", "recorded / filed"],
    "doc_type": ["doc type", "document type", "type", "doc_type", "instrument"],
    "borough": ["borough", "boro", "county"],
    "block": ["block", "blk"],
    "lot": ["lot"],
    "party1": ["party 1", "party1", "grantor", "seller", "party name/address 1", "party name 1"],
    "party2": ["party 2", "party2", "grantee", "buyer", "party name/address 2", "party name 2"],
    "amount": ["amount", "consideration", "price", "sale price", "doc amount"],
}
HEAD_LINES, LEAST_CELLS = 5, 2
COLUMNS = list(HEADERS)


def _field(header: Column) -> Column:
    """The field that a header cell names, or null."""
    h = F.lower(header)
    fits = [(reduce(lambda a, b: a | b, (h.contains(w) for w in words)), name) for name, words in HEADERS.items()]
    return reduce(lambda acc, f: acc.when(*f), fits[1:], F.when(*fits[0]))


def _capitals(c: Column) -> Column:
    """Every word with a capital first, its rest small, blanks squeezed."""
    words = F.split(F.regexp_replace(F.trim(c), r"\s+", " "), r"(?<=\W)(?=\w)")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def parse_pasted_tables(texts: DataFrame) -> DataFrame:
    """texts (text_id, text) as rows: text_id, line, the columns of HEADERS, dedupe_key, raw_line.

    Cells are told by tabs or bars, where the first five lines have one a line on average, else by two blanks. The
    header is the first of these lines with two known cells; a text without one gives its lines as they are, with the
    columns null. Of rows with one key (filing number, document id, else the fields) the first stays; rows of fewer than
    two cells are none. Null and empty texts give nothing.
    """
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x, F.lit(" \t")) != "")
    df = texts.filter(F.col("text").isNotNull()).select("text_id", lines.alias("lines")).filter(F.size("lines") > 0)
    head = F.array_join(F.slice("lines", 1, HEAD_LINES), "\n")
    count = lambda sign: F.length(head) - F.length(F.replace(head, F.lit(sign), F.lit("")))
    sample = F.least(F.size("lines"), F.lit(HEAD_LINES))
    df = df.withColumn("sign", F.when(count("\t") >= sample, "\t").when(count("|") >= sample, r"\|").otherwise(r"\s{2,}"))
    cells = lambda line: F.transform(F.split(line, F.col("sign")), lambda x: F.trim(x))
    heads = F.transform(F.slice("lines", 1, HEAD_LINES), lambda x, i: F.struct(i.alias("at"), F.transform(cells(x), _field).alias("fields")))
    df = df.withColumn("head", F.get(F.filter(heads, lambda x: F.size(F.array_compact(x["fields"])) >= LEAST_CELLS), F.lit(0)))
    rows = df.select("text_id", "sign", "head", F.posexplode("lines").alias("line", "raw_line")).filter("head IS NULL OR line > head.at")
    rows = rows.withColumn("cells", F.when(F.col("head").isNotNull(), cells(F.col("raw_line"))))
    rows = rows.filter(F.col("head").isNull() | (F.size(F.filter("cells", lambda x: x != "")) >= LEAST_CELLS))
    told = F.arrays_zip(F.col("head.fields").alias("field"), F.col("cells").alias("value"))
    rows = rows.withColumn("told", F.filter(told, lambda x: F.coalesce(x["value"] != "", F.lit(False))))
    value = {n: F.try_element_at(F.filter("told", lambda x: x["field"] == n), F.lit(-1))["value"] for n in COLUMNS}
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    made = {
        "recorded_date": F.coalesce(to_iso_date(value["recorded_date"]), value["recorded_date"]),
        "doc_type": norm_doc_type(value["doc_type"]),
        "borough": F.coalesce(borough_code(value["borough"]), value["borough"]),
        "block": digits(value["block"]),
        "lot": digits(value["lot"]),
        "party1": _capitals(value["party1"]),
        "party2": _capitals(value["party2"]),
        "amount": F.regexp_replace(value["amount"], r"[$,\s]", ""),
    }
    rows = rows.select("text_id", "line", *((made.get(n, value[n])).alias(n) for n in COLUMNS), "raw_line", F.col("head").isNotNull().alias("typed"))
    fields = F.sha2(F.concat_ws("|", *(F.coalesce(n, F.lit("")) for n in ("recorded_date", "doc_type", "block", "lot", "party1", "party2"))), 256)
    key = F.coalesce(F.concat(F.lit("crfn_"), "crfn"), F.concat(F.lit("docid_"), "document_id"), F.concat(F.lit("hash_"), fields))
    rows = rows.withColumn("dedupe_key", F.when(F.col("typed"), key))
    kept = rows.groupBy("text_id", F.coalesce("dedupe_key", F.concat(F.lit("line_"), F.col("line").cast("string"))).alias("_k"))
    first = kept.agg(F.min(F.struct("line", *COLUMNS, "dedupe_key", "raw_line")).alias("r"))
    return first.select("text_id", "r.*")
