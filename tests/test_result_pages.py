"""Saved pages of results with the markup that such pages have."""

from lotledger.sources import result_pages


def page(*rows, before=""):
    return f"<html>{before}<TABLE><tr><th>Borough</th></tr>{''.join(rows)}</TABLE></html>"


def row(cells, color='"#FFFFFF"'):
    return f"<tr valign=top bgcolor={color}>" + "".join(f"<td class='c'>{c}</td>" for c in cells) + "</tr>"


CELLS = ["<input type='button' onclick='go_detail(\"2025012300456001\")'>", "Brooklyn", " 100 ", "12/345", "2025000012345", "50", "E", "01/15/2025", "1/20/2025 10:05:00 AM", "4", "DOE,&nbsp;JOHN", "O'NEIL &amp; SONS", "", "", "<img src='images/Check.gif'>", "$1,500,000"]


def parsed(spark, *html):
    df = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    return sorted(result_pages.parse_result_pages(df).collect(), key=lambda r: (r.page_id, r.row))


def test_a_row_of_sixteen_cells(spark):
    (r,) = parsed(spark, page(row(CELLS), row(CELLS, "#c6e2ff"), row(CELLS, "#EEEEEE"), row(CELLS[:9]), before="<b>Search results</b><b> Deed </b>"))
    assert (r.document_id, r.borough, r.block, r.lot, r.bbl, r.crfn) == ("2025012300456001", "3", "100", "50", "3001000050", "2025000012345")
    assert (r.doc_date, r.recorded_date, r.party1, r.party2, r.party3, r.amount, r.corrected, r.doc_type) == ("2025-01-15", "2025-01-20", "Doe, John", "O'Neil & Sons", None, 1500000.0, True, "DEED")
    assert r.dedupe_key == "2025000012345|3001000050"


def test_tables_inside_cells(spark):
    """Cells of inner tables count; what is around them keeps their text; a table inside an inner one too."""
    inner = "<table><tr><td>A</td><td>B<table><tr bgcolor=#EEEEEE><td>C</td></tr></table></td></tr></table>"
    (r,) = parsed(spark, page(row([CELLS[0], "Queens", "7" + inner, "9", "x", "y", "1/2/2024", "z", "p", "q", "r"])))
    assert (r.block, r.reel_page_file, r.crfn, r.lot, r.partial, r.doc_date, r.pages) == ("7ABC", "A", "B", "C", "9", None, "1/2/2024")
    hidden = "<input value=' mtge ' type=hidden name=hid_doctype>"
    pages = parsed(spark, page(row(CELLS), before=hidden + "<table><tr><td>menu</td></tr></table>"), page(), "", "<tr bgcolor=#FFFFFF>" + "<td>1" * 10)
    assert [(r.page_id, r.doc_type, r.crfn) for r in pages] == [(0, "MTGE", "2025000012345"), (3, "", "1")]


def test_rows_without_numbers_are_told_by_their_fields(spark):
    bare = ["", *CELLS[1:4], "", *CELLS[5:]]
    rows = parsed(spark, page(row(bare), row(bare), row([*bare[:10], "ROE", *bare[11:]])), None)
    assert [r.party1 for r in rows] == ["Doe, John", "Roe"] and {r.document_id for r in rows} == {None}
