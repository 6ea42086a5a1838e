"""Text of web pages and scanned documents, addresses of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that contacts aren't looked for on.
BLOCKED = ["linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "pinterest.com", "reddit.com", "login.", "signin.", "auth.", "accounts.google.com", "appleid.apple.com"]


def html_to_text(c: Column, most: int | None = None) -> Column:
    """The visible text of a page; with most, only so many of its first characters."""
    t = F.regexp_replace(c, r"(?is)<(script|style|nav|footer|header|noscript).*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), "(?i)&nbsp;", " ")
    for name, char in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        t = F.regexp_replace(t, f"(?i)&{name};", char)
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"&#?\w+;", " "), r"\s+", " "))
    return t if most is None else F.left(t, F.lit(most))


def clean_ocr(c: Column) -> Column:
    """Hyphenated words joined, letters between digits read as digits, numbers and rules tidied."""
    t = F.regexp_replace(c, r"(\w)-\s*\n\s*(\w)", "$1$2")
    for letters, digit in (("[Oo]", "0"), ("[lI]", "1"), ("S", "5"), ("B", "8")):
        t = F.regexp_replace(t, rf"(?<=\d){letters}(?=\d)", digit)
    t = F.regexp_replace(F.regexp_replace(t, r"(\d),\s+(\d)", "$1,$2"), r"[ \t]{3,}", "  ")
    t = F.regexp_replace(F.regexp_replace(t, " ", " "), r"\|{2,}", "|")
    return F.regexp_replace(F.regexp_replace(t, r"_{3,}", ""), r"\.{4,}", "...")


def url_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(c, F.lit("HOST"))), r"^www\.", "")


def is_blocked_domain(c: Column) -> Column:
    host = F.lower(F.try_parse_url(c, F.lit("HOST")))
    found = host.isNull()
    for d in BLOCKED:
        found |= (host == d) | host.endswith("." + d) | host.startswith(d)
    return F.coalesce(found, F.lit(True))
