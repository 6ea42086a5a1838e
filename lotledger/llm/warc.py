"""WARC records: reading them, and resolving not-modified revisits.

A server that answers 304 sends no body, so a crawler stores a revisit record. Here every revisit finds the
latest full response of the same canonical URL before it (an as-of join); the validators must agree (the
entity tag if both have one, else the time of last modification, else the payload digest); and its headers
are the response's, overwritten by those that a 304 answer may update.

The as-of join sorts all records by (URL, time) into ranges, so a URL with a third of all records is spread
over many tasks: inside a range a window carries the last response on, and what stands at the end of the
ranges before comes from a table of one row for each URL and range.

Defined results: a record without URL or date is returned unresolved ("no_response"); a response at the very
time of the revisit isn't earlier; of responses at one time the one with the greatest id counts; if neither
side has a validator in common the outcome is "no_validator"; repeated records are resolved one by one;
header names compare in lower case, the last of repeated ones counts; entity tags compare weakly, as for a
304; records may be of any length; an empty table gives no rows; further columns are not read. A page without
URL makes records without one, a page without an id none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Header fields that a 304 answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]

#: Records of a range, about.
RANGE_ROWS = 1_000_000


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host in lower case, no default port, fragment, tracking or session
    parameters, parameters in order, no closing slash."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    parameters = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(parameters, lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[a-z]*|ref|sessionid|sid|phpsessid|fbclid|gclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def with_headers(df: DataFrame, block: str, name: str) -> DataFrame:
    """df with the lines "Name: value" of a block as a map, names in lower case; the last of repeated ones
    counts. The lines are read once, in a column of their own."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^:\s]+:"))
    pair = lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("v"))
    pairs = df.withColumn("_pairs", F.transform(lines, pair))
    last = lambda k: F.element_at(F.filter("_pairs", lambda p: p["k"] == k), -1)["v"]
    names = F.array_distinct(F.transform("_pairs", lambda p: p["k"]))
    return pairs.withColumn(name, F.map_from_entries(F.transform(names, lambda k: F.struct(k, last(k))))).drop("_pairs")


def parse_records(raw: DataFrame, column: str = "record") -> DataFrame:
    """record_id, kind, url, date, status, headers, digest, from whole WARC records as text."""
    blocks = raw.select(F.split(F.col(column), "\r\n\r\n", 3).alias("b")).select(F.col("b")[0].alias("warc"), F.get("b", F.lit(1)).alias("http"))
    parsed = with_headers(with_headers(blocks, "warc", "w"), "http", "headers")
    return parsed.select(
        F.regexp_replace(F.col("w")["warc-record-id"], r"^<urn:uuid:|>$", "").alias("record_id"),
        F.col("w")["warc-type"].alias("kind"),
        F.col("w")["warc-target-uri"].alias("url"),
        F.try_to_timestamp(F.col("w")["warc-date"], F.lit("yyyy-MM-dd'T'HH:mm:ssX")).alias("date"),
        F.expr(r"try_cast(regexp_extract(http, '^HTTP/[0-9.]+ ([0-9]+)', 1) AS int)").alias("status"),
        "headers",
        F.col("w")["warc-payload-digest"].alias("digest"),
    )


def _agree() -> Column:
    """Whether the validators of answer (r) and revisit agree; null if they have none in common."""
    h, r = F.col("headers"), F.col("r.headers")
    tag = lambda x: F.regexp_replace(x["etag"], r"^W/", "")
    return F.coalesce(tag(h) == tag(r), h["last-modified"] == r["last-modified"], F.col("digest") == F.col("r.digest"))


def resolve_revisits(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """record_id, url (canonical), date, response_id, outcome, merged for every revisit; see the module.

    records: record_id, kind ("response" or "revisit"), url, date, status, headers, digest. Full responses
    are those of status 200. outcome: resolved, validator_mismatch, no_validator or no_response.
    """
    spark = records.sparkSession
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    rows = records.filter(full | (F.col("kind") == "revisit")).select("record_id", canonical_url(F.col("url")).alias("url"), "date", full.alias("full"), "headers", "digest")
    rows = materialize(rows, "records")  # the ranges are sampled before they are dealt, and undated records are read apart
    dated = rows.filter(F.col("url").isNotNull() & F.col("date").isNotNull())
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    order = ["date", "full", "record_id"]  # at one time revisits stand before responses
    dealt = materialize(dated.repartitionByRange(ranges, "url", *order).withColumn("range", F.spark_partition_id()), "captures")
    answer = F.when(F.col("full"), F.struct("date", "record_id", "headers", "digest"))
    inside = Window.partitionBy("url", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = dealt.groupBy("url", "range").agg(F.max_by(answer, F.when(F.col("full"), F.struct("date", "record_id"))).alias("end"))
    before = Window.partitionBy("url").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("url").alias("_url"), F.col("range").alias("_range"), F.last("end", ignorenulls=True).over(before).alias("carried"))
    joined = dealt.withColumn("own", F.last(answer, ignorenulls=True).over(inside)).filter("NOT full").join(carried, (F.col("url") == F.col("_url")) & (F.col("range") == F.col("_range")))
    asof = joined.select("record_id", "url", "date", "headers", "digest", F.coalesce("own", "carried").alias("r"))
    lost = rows.filter("NOT full AND (url IS NULL OR date IS NULL)").select("record_id", "url", "date", "headers", "digest", F.lit(None).cast(asof.schema["r"].dataType).alias("r"))
    agree = _agree()
    outcome = F.when(F.col("r").isNull(), "no_response").when(agree, "resolved").when(~agree, "validator_mismatch").otherwise("no_validator")
    update = F.map_filter("headers", lambda k, v: k.isin(PERMITTED))
    found = asof.unionByName(lost).withColumn("outcome", outcome).withColumn("update", update)
    merged = F.map_concat(F.map_filter(F.col("r.headers"), lambda k, v: ~F.map_contains_key(F.col("update"), k)), F.col("update"))
    return found.select(
        "record_id", "url", "date", F.when(F.col("outcome") == "resolved", F.col("r.record_id")).alias("response_id"), "outcome", F.when(F.col("outcome") == "resolved", merged).alias("merged")
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records (record, text) as a crawler would have written them for pages (page_id, url, html):
    a response for each page, and for some a later revisit, now and then with another entity tag or none."""
    p = pages.filter("page_id IS NOT NULL").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    at = lambda seconds: F.date_format(F.timestamp_seconds(F.lit(1577836800) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"'))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    seconds = F.col("page_id") * 60
    response = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit("response")), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:r"), F.col("page_id"), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")), line("WARC-Date", at(seconds)), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(F.col("html").cast("binary"), 256))), F.lit("\r\n"),
        F.lit("HTTP/1.1 200 OK\r\n"), line("Date", at(seconds)), F.when(F.col("page_id") % 4 != 3, line("ETag", tag)).otherwise(""), line("Last-Modified", at(seconds - 86400)),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.octet_length("html").cast("string")), F.lit("\r\n"), F.col("html"),
    )
    later = seconds + 30 + (F.col("page_id") % 7) * 86400
    revisit = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit("revisit")), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:v"), F.col("page_id"), F.lit(">"))),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")), line("WARC-Date", at(later)), F.lit("\r\n"),
        F.lit("HTTP/1.1 304 Not Modified\r\n"), line("Date", at(later)), F.when(F.col("page_id") % 4 < 2, line("ETag", F.when(F.col("page_id") % 11 == 0, F.lit('"other"')).otherwise(tag))).otherwise(""),
        F.when(F.col("page_id") % 4 >= 2, line("Last-Modified", at(seconds - 86400))).otherwise(""), line("Cache-Control", F.lit("max-age=60")), line("Content-Length", F.lit("0")), F.lit("\r\n"),
    )
    return p.select(F.explode(F.when(F.col("page_id") % 3 != 1, F.array(response, revisit)).otherwise(F.array(response))).alias("record"))
