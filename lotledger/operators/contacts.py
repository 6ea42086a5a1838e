"""Contacts in texts: extraction with evidence, scoring, dedupe, owner blocks, filings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import join_names, trim_or_null
from ..functions.names import contact_key, norm_phone

# Patterns of contacts, and addresses that aren't a person's.
_EMAIL = re.compile(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")
_PHONE = re.compile(r"(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}", re.ASCII)
_SKIP_NAMES = "noreply no-reply donotreply do-not-reply support help info admin webmaster privacy abuse postmaster mailer-daemon unsubscribe feedback newsletter notifications".split()
_SKIP_DOMAINS = "example.com example.org test.com localhost sentry.io gravatar.com schema.org w3.org googleapis.com googleusercontent.com".split()
CONTACTS = "array<struct<kind string, value string, at int, evidence string>>"


def _evidence(text: str, start: int, end: int, radius: int) -> str:
    a, b = max(0, start - radius), min(len(text), end + radius)
    return ("..." if a else "") + re.sub(r"\s+", " ", text[a:b]).strip() + ("..." if b < len(text) else "")


def _skipped(email: str) -> bool:
    name, _, domain = email.partition("@")
    if name.split("+")[0] in _SKIP_NAMES or re.search(r"\.(png|jpg|jpeg|gif|svg|webp|css|js)$", domain):
        return True
    return any(domain == d or domain.endswith("." + d) for d in _SKIP_DOMAINS)


def find_contacts(text: str | None, radius: int = 60) -> list[dict]:
    """E-mail addresses, then phone numbers of a text, each once, where it first stands."""
    out, seen = [], set()
    for m in _EMAIL.finditer(text or ""):
        value = m[0].lower()
        if value not in seen and not _skipped(value):
            seen.add(value)
            out.append({"kind": "email", "value": value, "at": m.start(), "evidence": _evidence(text, *m.span(), radius)})
    for m in _PHONE.finditer(text or ""):
        digits = re.sub(r"\D", "", m[0])
        digits = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
        if len(digits) in (10, 11) and not re.fullmatch(r"(\d)\1{9}", digits) and digits not in seen:
            seen.add(digits)
            out.append({"kind": "phone", "value": m[0].strip(), "at": m.start(), "evidence": _evidence(text, *m.span(), radius)})
    return out


def extract_contacts(pages: DataFrame, text: str = "text", radius: int = 60) -> DataFrame:
    """pages without their text, a row for each contact: kind, value, at, evidence. Offsets of matches need
    Python; texts go to it in Arrow batches, those without @ or four digits not at all."""

    @F.pandas_udf(CONTACTS)
    def matches(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_contacts(t, radius))

    likely = pages.filter(F.col(text).contains("@") | F.col(text).rlike(r"\d{4}"))
    found = likely.withColumn("_c", F.explode(matches(F.col(text))))
    return found.select(*(c for c in pages.columns if c != text), "_c.*")


def score_page_contacts(contacts: DataFrame, owner: str = "owner", text_at: str = "owner_at") -> DataFrame:
    """With confidence: .75 (e-mail) or .65 (phone) within 500 characters of the owner's name, else .7 or .5."""
    near = F.abs(F.col("at") - F.col(text_at)) < 500
    email = F.col("kind") == "email"
    return contacts.withColumn("confidence", F.when(near, F.when(email, 0.75).otherwise(0.65)).otherwise(F.when(email, 0.7).otherwise(0.5)))


def dedupe_contacts(contacts: DataFrame, by: list[str]) -> DataFrame:
    """The contact of greatest confidence of each key within by."""
    keyed = contacts.withColumn("_k", contact_key(F.col("kind"), F.col("value"))).filter("_k <> ''")
    rest = [c for c in contacts.columns if c not in (*by, "kind")]
    return keyed.groupBy(*by, "kind", "_k").agg(F.max_by(F.struct(*rest), F.struct("confidence", "value")).alias("r")).select(*by, "kind", "r.*")


def directory_candidates(df: DataFrame) -> DataFrame:
    """Mail-directory results (owner, value, confidence 0 to 100, ...) as candidates: lower case, once each, best first."""
    rows = df.withColumns({"value": F.lower(F.trim("value")), "confidence": F.col("confidence") / 100})
    rest = [c for c in rows.columns if c not in ("owner", "value")]
    return rows.groupBy("owner", "value").agg(F.max_by(F.struct(*rest), "confidence").alias("r")).select("owner", "value", "r.*")


def filings_to_contacts(filings: DataFrame) -> DataFrame:
    """Filing rows as owner contacts: digits of the phone, trimmed fields, and a JSON snippet of the filing."""
    text = lambda c: trim_or_null(F.col(c))
    return filings.select(
        "bbl", "job_number", join_names(F.col("first_name"), F.col("last_name")).alias("name"), text("business_name").alias("business_name"), F.lower(text("email")).alias("email"),
        F.nullif(norm_phone(F.col("phone")), F.lit("")).alias("phone"), F.to_json(F.struct("filing_date", "job_type", "work_type")).alias("evidence_snippet"),
    )


def parse_owner_blocks(texts: DataFrame, labels: dict[str, str]) -> DataFrame:
    """job_number and a column for each label of "Label: value" lines; N/A and blanks are null. labels: name by
    label in lower case; the first line of a label counts."""
    lines = texts.select("job_number", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    pairs = lines.select("job_number", "n", F.lower(F.trim(F.regexp_extract("line", r"^([^:]+):", 1))).alias("label"), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("value"))
    some = pairs.filter(F.col("label").isin(list(labels)) & (F.col("value") != "") & ~F.upper("value").isin("N/A", "NA", "NONE"))
    return some.groupBy("job_number").agg(*(F.min_by("value", F.when(F.col("label") == label, F.col("n"))).alias(name) for label, name in labels.items()))
