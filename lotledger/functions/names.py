"""Owner and stakeholder names, similarities, phones and contact keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes at the end of a name, words that mark an organisation, leading articles.
_SUFFIX = r"\s*,?\s*\b(?:LLC|L\.?L\.?C\.?|LP|L\.?P\.?|INC\.?|CORP\.?|CORPORATION|CO\.?|LTD\.?|PLLC|P\.?L\.?L\.?C\.?|LLP|L\.?L\.?P\.?)\b\.?\s*,?\s*"
_ORGANISATION = (
    r"\b(LLC|LP|INC|CORP|CORPORATION|LTD|PLLC|LLP|TRUST|ASSOCIATES|REALTY|HOLDINGS|ENTERPRISES|PROPERTIES|GROUP|PARTNERS|DEVELOPMENT|MGMT|MANAGEMENT)\b"
)
_ARTICLE = r"(?i)^(THE|A|AN)\s+"
_SHORT_SUFFIX = r"\b(?:LLC|L\.L\.C|LP|L\.P|INC|CORP|CORPORATION|CO|LTD|PLLC|P\.L\.L\.C)\b\.?"


def title_name(c: Column) -> Column:
    squeezed = F.regexp_replace(F.trim(c), r"\s+", " ")
    return F.array_join(F.transform(F.split(squeezed, r"(?<=\W)|(?=\W)"), lambda x: F.initcap(x)), "")


def norm_name(c: Column) -> Column:
    """Upper case, punctuation but commas to blanks, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Za-z0-9_\s,]", " "), r"\s+", " "))


def strip_suffixes(c: Column) -> Column:
    """Legal suffixes at the end go, however many there are."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, f"(?i)(?:{_SUFFIX})+$", ""), r",\s*$", ""))


def owner_match_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(strip_suffixes(norm_name(c)), _ARTICLE, ""))


def entity_type(c: Column) -> Column:
    tokens = F.filter(F.split(strip_suffixes(norm_name(c)), r"\s+"), lambda t: t != "")
    person = F.size(tokens).between(2, 4) & F.forall(tokens, lambda t: t.rlike("^[A-Z][A-Z]+$"))
    return F.when(F.upper(c).rlike(_ORGANISATION), "org").when(person, "person").otherwise("unknown")


def name_variants(c: Column) -> Column:
    """Normalised, stripped, without article, and "LAST, FIRST" turned round; those over two characters."""
    full = norm_name(c)
    bare = strip_suffixes(full)
    plain = F.trim(F.regexp_replace(bare, _ARTICLE, ""))
    parts = F.transform(F.split(full, ","), F.trim)
    turned = F.when((F.size(parts) == 2) & (F.length(parts[0]) > 0) & (F.length(F.get(parts, F.lit(1))) > 0), F.concat_ws(" ", F.get(parts, F.lit(1)), parts[0]))
    return F.array_distinct(F.filter(F.array(full, bare, plain, turned, strip_suffixes(turned)), lambda v: v.isNotNull() & (F.length(v) > 2)))


def dedupe_aliases(existing: Column, incoming: Column) -> Column:
    """existing, then those of incoming whose normal form is new and over two characters, in order."""
    start = F.struct(existing.alias("out"), F.transform(existing, norm_name).alias("seen"))

    def add(acc: Column, alias: Column) -> Column:
        n = norm_name(alias)
        fresh = ~F.array_contains(acc["seen"], n) & (F.length(n) > 2)
        return F.struct(F.when(fresh, F.array_append(acc["out"], alias)).otherwise(acc["out"]).alias("out"), F.when(fresh, F.array_append(acc["seen"], n)).otherwise(acc["seen"]).alias("seen"))

    return F.aggregate(incoming, start, add, lambda acc: acc["out"])


def _set_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda t: t != ""))


def stakeholder_name(c: Column) -> Column:
    """Upper case, punctuation but . , - dropped, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Za-z0-9_\s,.\-]", ""), r"\s+", " "))


def stakeholder_tokens(c: Column) -> Column:
    return _set_of(F.trim(F.regexp_replace(stakeholder_name(c), rf"(?i)(?:\s*{_SHORT_SUFFIX})+$", "")))


def token_set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the token sets of two names; 1 for two empty sets."""
    x, y = stakeholder_tokens(a), stakeholder_tokens(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)))


def contact_name_tokens(c: Column) -> Column:
    """Tokens over one character, without legal forms anywhere."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(c), r"\b(LLC|INC|CORP|LTD|LP|CO|THE)\b", ""), r"[^A-Z0-9\s]", "")
    return F.filter(_set_of(bare), lambda t: F.length(t) > 1)


def name_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over the larger token count."""
    x, y = contact_name_tokens(a), contact_name_tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def dos_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.9 if one begins with the other, else shared tokens over the larger count."""
    x, y = F.trim(F.upper(a)), F.trim(F.upper(b))
    s, t = _set_of(x), _set_of(y)
    ratio = F.size(F.array_intersect(s, t)) / F.greatest(F.size(s), F.size(t), F.lit(1))
    return F.when(x == y, 1.0).when(x.startswith(y) | y.startswith(x), 0.9).otherwise(ratio)


def trigrams(c: Column) -> Column:
    """The set of trigrams of the words of a text, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def norm_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def format_phone(c: Column) -> Column:
    d = norm_phone(c)
    return F.when(F.length(d) == 10, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))).otherwise(c)


def contact_key(kind: Column, value: Column) -> Column:
    return F.when(kind == "phone", norm_phone(value)).when(kind == "email", F.lower(F.trim(value))).otherwise(F.left(F.regexp_replace(F.upper(value), "[^A-Z0-9]", ""), F.lit(40)))


def owner_cache_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
