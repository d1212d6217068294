"""Date texts to dates, by ordered formats; what does not parse is null and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

_YMD, _MDY, _DMY = r"^(\d{4})S(\d{1,2})S(\d{1,2})$", r"^(\d{1,2})S(\d{1,2})S(\d{4})$", r"^(\d{1,2})S(\d{1,2})S(\d{4})$"


def _made(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _parts(text: Column, pattern: str, order: str, sign: str) -> Column:
    """The date that ``pattern`` captures; ``order`` names its groups (y, m, d)."""
    p = pattern.replace("S", sign)
    at = {k: F.nullif(F.regexp_extract(text, p, i + 1), F.lit("")) for i, k in enumerate(order)}
    return F.when(text.rlike(p), _made(at["y"], at["m"], at["d"]))


def two_digit_year(year: Column, pivot: int = 69) -> Column:
    """Years below ``pivot`` are of this century."""
    y = year.cast("int")
    return F.when(y < pivot, y + 2000).otherwise(y + 1900).cast("string")


def _short(text: Column, sign: str, pivot: int = 69) -> Column:
    p = rf"^(\d{{1,2}}){sign}(\d{{1,2}}){sign}(\d{{2}})$"
    m, d, y = (F.nullif(F.regexp_extract(text, p, i), F.lit("")) for i in (1, 2, 3))
    return F.when(text.rlike(p), _made(two_digit_year(y, pivot), m, d))


def base(text: Column, year: Column | None = None) -> Column:
    """Of row parsers: m/d/Y, m/d/y, Y-m-d, m-d-Y, m/d (with the given year, else 1900), d/m/Y."""
    p = r"^(\d{1,2})/(\d{1,2})$"
    hint = F.coalesce(year.cast("string"), F.lit("1900")) if year is not None else F.lit("1900")

    def body(t: Column) -> Column:
        yearless = F.when(t.rlike(p), _made(hint, F.nullif(F.regexp_extract(t, p, 1), F.lit("")), F.nullif(F.regexp_extract(t, p, 2), F.lit(""))))
        return F.coalesce(_parts(t, _MDY, "mdy", "/"), _short(t, "/"), _parts(t, _YMD, "ymd", "-"), _parts(t, _MDY, "mdy", "-"), yearless, _parts(t, _DMY, "dmy", "/"))

    return let(F.trim(text), body)


def validated(text: Column) -> Column:
    """Of the validator: Y-m-d, m/d/Y, m/d/y, d/m/Y, m-d-Y, Y/m/d."""
    return let(F.trim(text), lambda t: F.coalesce(_parts(t, _YMD, "ymd", "-"), _parts(t, _MDY, "mdy", "/"), _short(t, "/"), _parts(t, _DMY, "dmy", "/"), _parts(t, _MDY, "mdy", "-"), _parts(t, _YMD, "ymd", "/")))


def month_day(text: Column, year: Column) -> Column:
    """``Jun 2`` or ``June 2``, with or without ``, 2025``; the given year without."""
    p = r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+(\d{1,2})(?:,\s*(\d{4}))?$"
    months = F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")])

    def body(t: Column) -> Column:
        month = F.array_position(months, F.lower(F.regexp_extract(t, p, 1))).cast("string")
        given = F.nullif(F.regexp_extract(t, p, 3), F.lit(""))
        return F.when(t.rlike(p), _made(F.coalesce(given, year.cast("string")), month, F.nullif(F.regexp_extract(t, p, 2), F.lit(""))))

    return let(F.trim(text), body)


def statement(text: Column, year: Column) -> Column:
    """m/d/y, m/d/Y, m-d (with the given year), m-d-Y: short years are of the 2000s."""
    p = r"^(\d{2})-(\d{2})$"

    def body(t: Column) -> Column:
        yearless = F.when(t.rlike(p), _made(year.cast("string"), F.nullif(F.regexp_extract(t, p, 1), F.lit("")), F.nullif(F.regexp_extract(t, p, 2), F.lit(""))))
        return F.coalesce(_parts(t, _MDY, "mdy", "/"), _short(t, "/", 100), yearless, _parts(t, _MDY, "mdy", "-"))

    return let(F.trim(text), body)


def in_line(text: Column) -> Column:
    """The first date inside a line; short years pivot at 50."""
    found = []
    for p, order in ((r"(\d{1,2})/(\d{1,2})/(\d{2,4})", "mdy"), (r"(\d{1,2})-(\d{1,2})-(\d{2,4})", "mdy"), (r"(\d{4})/(\d{1,2})/(\d{1,2})", "ymd"), (r"(\d{4})-(\d{1,2})-(\d{1,2})", "ymd")):
        at = {k: F.nullif(F.regexp_extract(text, p, i + 1), F.lit("")) for i, k in enumerate(order)}
        year = F.when(F.length(at["y"]) <= 2, two_digit_year(at["y"], 50)).otherwise(at["y"])
        found.append(F.when(text.rlike(p), _made(year, at["m"], at["d"])))
    return F.coalesce(*found)


def year_hint(text: Column, default: int) -> Column:
    """The year of the first full date or month and year of a statement's text, else ``default``."""
    full = F.nullif(F.regexp_extract(text, r"\d{1,2}/\d{1,2}/(20\d{2})", 1), F.lit(""))
    spelt = F.nullif(F.regexp_extract(text, r"(?i)(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+(?:\d{1,2},?\s+)?(20\d{2})", 1), F.lit(""))
    return F.coalesce(full, spelt, F.lit(str(default))).cast("int")


def add_year(text: Column, year: Column) -> Column:
    """m/d gets the year behind it; anything else stays."""
    return F.when(text.rlike(r"^[^/]*/[^/]*$"), F.concat_ws("/", text, year.cast("string"))).otherwise(text)


def month_key(text: Column) -> Column:
    """The month key of the filter's fingerprint: the first number before a day, or a month's name.

    On ISO dates this is the last two digits of the year, which is what the rule does.
    """
    number = F.regexp_extract(text, r"(\d{1,2})[/\-]\d{1,2}[/\-]?\d*", 1)
    return F.when(number != "", number).when(text.rlike("^[A-Z][a-z]{2}"), F.substring(text, 1, 3)).otherwise(F.lit(""))
