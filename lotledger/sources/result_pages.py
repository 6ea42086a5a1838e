"""Saved result pages of the deed register as records.

A page is one row and is split where it stands: into tables, so that those inside cells can be told from the
one of results, then into rows by their colour and cells in document order. Nothing but tags, attributes and
entities of the page is looked at; no document tree is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import clean_amount, to_iso_date
from ..functions.keys import borough_code, build_bbl, norm_doc_type
from ..functions.names import title_name

# Colours of data rows, the fewest cells of one, and the cells in their order (the first holds the document id,
# the fourteenth nothing that is read, the fifteenth an image if the record was corrected).
DATA_ROW = r"""(?i)^<tr\b[^>]*\bbgcolor\s*=\s*["']?\s*(?-i:#FFFFFF|#C6E2FF|#ffffff|#c6e2ff)\s*["'\s>]"""
LEAST_CELLS, CORRECTED_CELL = 10, 14
CELLS = {"borough": 1, "block": 2, "reel_page_file": 3, "crfn": 4, "lot": 5, "partial": 6, "doc_date": 7, "recorded_date": 8, "pages": 9, "party1": 10, "party2": 11, "party3": 12, "amount": 15}
ID_OF_DETAIL = r"""(?i)go_detail\s*\(\s*(?:["']|&quot;|&#39;)(\d+)(?:["']|&quot;|&#39;)\s*\)"""
CHECK_IMAGE = r"""(?i)<img\b[^>]*\bsrc\s*=\s*["']?[^"'>]*check"""
HIDDEN = r"""(?i)<input\b(?=[^>]*\bname\s*=\s*["']?%s["'\s>])[^>]*\bvalue\s*=\s*["']([^"']*)["']"""
BOLD, NO_TYPE = r"(?is)<(?:b|strong)(?:\s[^>]*)?>(.*?)</(?:b|strong)\s*>", r"(?i)search|result|criteria|document|date|borough"
ENTITIES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
# The grid of the other system, its rows and their links, and the fewest cells of a row and of a full one.
GRID = r"""(?is)id="(?:ContentPlaceHolder1_)?GridViewResults?"[^>]*>(.*?)</table>"""
GRID_ROW, CLASSED_ROW, GRID_CELL = r"(?is)<tr[^>]*>(.*?)</tr>", r"""(?is)<tr[^>]*class="[^"]*Row[^"]*"[^>]*>(.*?)</tr>""", r"(?is)<td[^>]*>(.*?)</td>"
DETAIL_LINK, CRFN_TEXT, LOT_LINK = r"(?i)DocumentDetail[/\\]([A-Z0-9]+)", r"(?i)CRFN[:\s]*([A-Z0-9-]+)", r"(?i)borough=(\d)&(?:amp;)?block=(\d+)&(?:amp;)?lot=(\d+)"
GRID_LEAST, GRID_FULL, LEAST_ID = 5, 8, 10
#: Tables inside tables inside a cell that are told apart.
NESTED = 4


def _text(html: Column) -> Column:
    """What an element shows: tags dropped, entities read, blanks squeezed."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", "")
    for name, char in ENTITIES.items():
        t = F.regexp_replace(t, f"(?i){name}", char)
    return F.trim(F.regexp_replace(t, r"[\s\x{A0}]+", " "))


def _without_inner_tables(pages: DataFrame) -> DataFrame:
    """pages with _html, in which the tags of tables without a data row are renamed, from the inside out: their cells are
    still cells (ntd), but no longer end those around them."""
    pages = pages.withColumn("_html", F.col("html"))
    part = lambda i: F.coalesce(F.get("_p", i), F.lit(""))
    for _ in range(NESTED):
        pages = pages.withColumn("_p", F.split("_html", r"(?i)(?=</?table\b)"))
        inner = F.transform("_p", lambda x, i: x.rlike(r"(?i)^<table\b") & part(i + 1).rlike(r"(?i)^</table\b") & ~x.rlike(DATA_ROW.replace("^<tr", "<tr")))
        pages = pages.withColumn("_inner", inner)
        renamed = lambda x: F.regexp_replace(x, r"(?i)<(/?)(table|tr|td)\b", "<$1n$2")
        closing = lambda x: F.regexp_replace(x, r"(?i)^</table\b", "</ntable")
        parts = F.transform("_p", lambda x, i: F.when(F.get("_inner", i), renamed(x)).when(F.coalesce(F.get("_inner", i - 1), F.lit(False)), closing(x)).otherwise(x))
        pages = pages.withColumn("_html", F.array_join(parts, ""))
    return pages.drop("_p", "_inner")


def _doc_type(html: Column) -> Column:
    """The type that the search was for: a hidden field, else the first bold text that can be one, else ''."""
    hidden = [F.upper(F.trim(F.nullif(F.regexp_extract(html, HIDDEN % n, 1), F.lit("")))) for n in ("hid_doctype", "hid_doctypeselection")]
    bold = F.filter(F.transform(F.regexp_extract_all(html, F.lit(BOLD), 1), _text), lambda t: F.length(t).between(2, 40) & ~t.rlike(NO_TYPE))
    return F.coalesce(*hidden, norm_doc_type(F.get(bold, F.lit(0))), F.lit(""))


def parse_result_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, html) as records: page_id, row, document_id, the columns of CELLS, doc_type, bbl, corrected, dedupe_key.

    Rows have a data colour and ten cells or more; cells of tables inside a cell count in document order, and their
    text belongs to the cell around them too. Of rows of a page with one key (filing number and parcel, else document
    id, else the fields) the first stays. Null and empty pages give nothing.
    """
    flat = _without_inner_tables(pages.filter("html IS NOT NULL").select("page_id", "html", _doc_type(F.col("html")).alias("doc_type")))
    rows = flat.select("page_id", "doc_type", F.posexplode(F.filter(F.split("_html", r"(?i)(?=<tr\b)"), lambda r: r.rlike(DATA_ROW))).alias("row", "_row"))
    body = F.split("_row", r"(?i)</tr\b|</table\b")[0]
    parts = F.split(body, r"(?i)(?=<n?td\b)")
    rows = rows.withColumn("_parts", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).filter(F.size("_parts") >= LEAST_CELLS)
    outer = F.filter(F.transform("_parts", lambda p, i: F.when(p.rlike(r"(?i)^<td\b"), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_outer", outer)
    end = lambda i: F.coalesce(F.array_min(F.filter("_outer", lambda o: o > i)), F.size("_parts"))
    whole = lambda p, i: F.when(F.array_contains("_outer", i), F.array_join(F.slice("_parts", i + 1, end(i) - i), "")).otherwise(p)
    rows = rows.withColumn("_cells", F.transform("_parts", whole))
    cell = lambda i: F.coalesce(F.get("_cells", F.lit(i)), F.lit(""))
    shown = {n: _text(cell(i)) for n, i in CELLS.items()}
    told = rows.select("page_id", "row", "doc_type", F.nullif(F.regexp_extract(cell(0), ID_OF_DETAIL, 1), F.lit("")).alias("document_id"), cell(CORRECTED_CELL).rlike(CHECK_IMAGE).alias("corrected"), *(c.alias(n) for n, c in shown.items()))
    some = lambda c: F.nullif(c, F.lit(""))
    borough = F.coalesce(borough_code(F.col("borough")), F.col("borough"))
    made = {"borough": borough, "doc_date": to_iso_date(F.col("doc_date")), "recorded_date": to_iso_date(F.col("recorded_date")), "amount": clean_amount(F.col("amount"))}
    made |= {n: title_name(F.col(n)) for n in ("party1", "party2")} | {"party3": some(title_name(F.col("party3")))} | {n: some(F.col(n)) for n in ("crfn", "reel_page_file", "partial", "pages")}
    told = told.withColumns(made).withColumn("bbl", some(build_bbl(F.col("borough"), F.col("block"), F.col("lot"))))
    fields = F.concat_ws("|", *(F.coalesce(n, F.lit("")) for n in ("recorded_date", "doc_type", "block", "lot", "party1", "party2")))
    told = told.withColumn("dedupe_key", F.coalesce(F.concat("crfn", F.coalesce(F.concat(F.lit("|"), "bbl"), F.lit(""))), "document_id", fields))
    rest = [c for c in told.columns if c not in ("page_id", "dedupe_key")]
    first = told.groupBy("page_id", "dedupe_key").agg(F.min_by(F.struct(*rest), "row").alias("r"))
    return first.select("page_id", "r.row", "r.document_id", *(f"r.{n}" for n in CELLS), "r.doc_type", "r.bbl", "r.corrected", "dedupe_key")


def _grid_date(c: Column) -> Column:
    """Month, day and year found anywhere, else year, month and day, else the text as it is."""
    us, iso = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", r"\d{4}-\d{2}-\d{2}"
    two = lambda i: F.lpad(F.regexp_extract(c, us, i), 2, "0")
    return F.when(c.rlike(us), F.concat_ws("-", F.regexp_extract(c, us, 3), two(1), two(2))).when(c.rlike(iso), F.regexp_extract(c, f"({iso})", 1)).otherwise(c)


def parse_grid_pages(pages: DataFrame) -> DataFrame:
    """The same for pages with a grid: page_id, row, document_id, crfn, doc_type, recorded_date, party1, party2, amount, borough, block, lot.

    Rows of the grid but its first, or rows of a class of rows where there is no grid; eight cells or more are a full
    record, five to seven a short one. Ids come from the link, else the first cell; under ten characters they are none.
    """
    grid = F.regexp_extract("html", GRID, 1)
    listed = F.regexp_extract_all(grid, F.lit(GRID_ROW), 1)
    html = F.when(F.col("html").rlike(GRID), F.slice(listed, 2, F.greatest(F.size(listed) - 1, F.lit(0)))).otherwise(F.regexp_extract_all("html", F.lit(CLASSED_ROW), 1))
    rows = pages.filter("html IS NOT NULL").select("page_id", F.posexplode(html).alias("row", "_row"))
    rows = rows.withColumn("_c", F.transform(F.regexp_extract_all("_row", F.lit(GRID_CELL), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", ""), F.lit(" \t\r\n")))).filter(F.size("_c") >= GRID_LEAST)
    full = F.size("_c") >= GRID_FULL
    cell = lambda i: F.coalesce(F.get("_c", F.lit(i)), F.lit(""))
    found = lambda p, i=1: F.nullif(F.regexp_extract("_row", p, i), F.lit(""))
    either = lambda a, b: F.when(full, a).otherwise(b)
    out = rows.select(
        "page_id", "row", F.coalesce(found(DETAIL_LINK), F.regexp_replace(cell(0), r"\s", "")).alias("document_id"), F.coalesce(found(CRFN_TEXT), either(cell(1), F.lit(""))).alias("crfn"),
        F.upper(either(cell(2), cell(1))).alias("doc_type"), _grid_date(either(F.coalesce(F.nullif(cell(3), F.lit("")), cell(4)), cell(2))).alias("recorded_date"),
        either(cell(5), cell(3)).alias("party1"), either(cell(6), F.lit("")).alias("party2"), clean_amount(either(cell(7), cell(4))).alias("amount"),
        *(F.coalesce(found(LOT_LINK, i), F.lit("")).alias(n) for i, n in enumerate(("borough", "block", "lot"), 1)),
    )
    return out.filter(F.length("document_id") >= LEAST_ID)
