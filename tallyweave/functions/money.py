"""Money tokens to DECIMAL(18,2), one function for each dialect; what does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

MONEY = "decimal(18,2)"


def _number(text: Column) -> Column:
    """A plain decimal number, or null. Digits beyond cents are rounded half up."""
    plain = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), text)
    return plain.try_cast("decimal(30,10)").try_cast(MONEY)


def _signed(negative: Column, text: Column) -> Column:
    return let(_number(text), lambda v: F.when(negative, -v).otherwise(v).cast(MONEY))


def _unwrapped(t: Column) -> Column:
    """struct(neg, t): whether the text stands in parentheses, and the text within them."""
    inside = t.startswith("(") & t.endswith(")") & (F.length(t) >= 2)
    return F.struct(inside.alias("neg"), F.when(inside, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t).alias("t"))


def _minus_first(x: Column) -> Column:
    """The same after a leading minus is taken off."""
    minus = x["t"].startswith("-")
    return F.struct((x["neg"] | minus).alias("neg"), F.when(minus, x["t"].substr(F.lit(2), F.length(x["t"]))).otherwise(x["t"]).alias("t"))


def stated(token: Column) -> Column:
    """Of stated totals: parentheses or a leading minus; an equals sign and a leading plus are dropped."""

    def plus(x: Column) -> Column:
        return F.struct(x["neg"].alias("neg"), F.regexp_replace(x["t"], r"^\+", "").alias("t"))

    read = let(let(let(F.trim(token), _unwrapped), plus), _minus_first)
    return let(read, lambda x: _signed(x["neg"], F.trim(F.translate(x["t"], "$,=", ""))))


def word(token: Column) -> Column:
    """Of word boxes: parentheses, a trailing minus, then a leading one."""

    def minus_last(x: Column) -> Column:
        return F.struct((x["neg"] | x["t"].endswith("-")).alias("neg"), F.regexp_replace(x["t"], "-$", "").alias("t"))

    read = let(let(let(F.trim(token), _unwrapped), minus_last), _minus_first)
    return let(read, lambda x: _signed(x["neg"], F.trim(F.translate(x["t"], "$,", ""))))


def row(token: Column) -> Column:
    """Of row parsers: parentheses or the number's own sign; all white space is dropped."""
    return let(let(F.regexp_replace(token, r"[$,\s]", ""), _unwrapped), lambda x: _signed(x["neg"], x["t"]))


def validated(value: Column) -> Column:
    """Of the validator: parentheses or the number's own sign."""
    return let(let(F.trim(F.translate(value.cast("string"), "$,", "")), _unwrapped), lambda x: _signed(x["neg"], x["t"]))


def in_line(text: Column) -> Column:
    """The last amount of a line of the strictest pattern that matches; negative by words or any minus."""

    def body(line: Column) -> Column:
        last = lambda pattern: F.try_element_at(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), F.lit(-1))
        value = F.coalesce(last(r"\$?([0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2})"), last(r"\$?([0-9]+\.[0-9]{2})"))
        negative = F.lower(line).rlike("-|debit|withdrawal|fee|charge")
        return let(_number(F.translate(value, ",", "")), lambda a: F.when(negative, -F.abs(a)).otherwise(a).cast(MONEY))

    return let(text, body)


def looks_like_amount(token: Column) -> Column:
    """Digits with one or two decimals, after the signs and separators of money are dropped."""
    t = F.regexp_replace(F.translate(token, "$,()", ""), "^-+|-+$", "")
    return F.coalesce(t.rlike(r"^[0-9]+\.[0-9]{1,2}$"), F.lit(False))


def mask(number: Column) -> Column:
    """The last four characters behind four stars."""
    return F.concat(F.lit("****"), F.right(number, F.lit(4)))


def shown(amount: Column) -> Column:
    """$1,234.56, the sign before the dollar."""
    return F.concat(F.when(amount < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(amount), 2))


def form_value(amount: Column) -> Column:
    """Whole dollars with separators, as form fields take them."""
    return F.format_number(F.bround(amount, 0), 0)
