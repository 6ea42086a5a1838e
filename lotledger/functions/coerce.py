"""Numbers, rounding and dates from extracts in which every field is text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.


def js_float(c: Column, default: float | None = 0.0) -> Column:
    """The number that a text begins with, else the default."""
    found = F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
    return found if default is None else F.coalesce(found, F.lit(default))


def js_int(c: Column, default: int | None = 0) -> Column:
    """The whole number that a text begins with, else the default."""
    found = F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return found if default is None else F.coalesce(found, F.lit(default))


def js_round(c: Column, digits: int = 0) -> Column:
    """Halves upwards on doubles: floor(x * 10^digits + 0.5) / 10^digits."""
    scale = float(10**digits)
    return F.floor(c.cast("double") * scale + 0.5).cast("double") / scale


def round34(c: Column) -> Column:
    """Whole units: a fraction of three quarters or more counts as one."""
    whole = F.floor(c)
    return (whole + F.when(c - whole >= 0.75, 1).otherwise(0)).cast("int")


def affordable_units(units: Column, share: Column) -> Column:
    """Units of a share, rounded up; shares above 1 are percentages, above 100 everything."""
    part = F.when((share > 1) & (share <= 100), share / 100).when(share > 100, F.lit(1.0)).otherwise(share)
    return F.when((units <= 0) | (share <= 0), 0).otherwise(F.ceil(units * part)).cast("int")


def clean_amount(c: Column) -> Column:
    return F.regexp_replace(c, r"[$,\s]", "").try_cast("double")


def trim_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def join_names(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(" ", *(trim_or_null(p) for p in parts)), F.lit(""))


# Forms of dates, once commas are gone and blanks squeezed.
DATE_FORMS = ["yyyy-M-d", "M/d/yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy"]


def to_iso_date(c: Column) -> Column:
    """yyyy-mm-dd from year-month-day, month/day/year (also - and .), "Mon d, yyyy" and "d Mon yyyy", with
    or without a time; null for days that don't exist, outside 1900 to 2100 or for no known form."""
    day = F.regexp_replace(F.trim(c), r"(?i)\s+\d{1,2}:\d{2}(:\d{2})?\s*(AM|PM)?$", "")
    day = F.trim(F.regexp_replace(day, r"[,\s]+", " "))
    day = F.regexp_replace(day, r"^(\d{1,2})[.\-/](\d{1,2})[.\-/](\d{4})$", "$1/$2/$3")
    found = F.coalesce(*(F.try_to_timestamp(day, F.lit(form)).cast("date") for form in DATE_FORMS))
    return F.when(F.year(found).between(1900, 2100), F.date_format(found, "yyyy-MM-dd"))
