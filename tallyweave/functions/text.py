"""Descriptions: noise, references, states, names and fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .base import let


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether any phrase is in the text, as one alternation."""
    return text.rlike("|".join(re.escape(p).replace(r"\ ", " ") for p in phrases)) if phrases else F.lit(False)


def strip_prefix(text: Column) -> Column:
    """Leading noise, as often as it repeats."""
    return F.regexp_replace(text, "(?i)^(?:" + "|".join(rules.LEADING) + ")+", "")


def strip_references(text: Column) -> Column:
    """Long digit runs and phone numbers become blanks."""
    return F.regexp_replace(F.regexp_replace(text, rules.LONG_DIGITS, " "), rules.PHONE, " ")


def _peel_once(text: Column) -> Column:
    text = F.regexp_replace(text, rules.TRAILING_DIGITS, "")
    text = F.regexp_replace(text, rules.TRAILING_PHONE, "")
    return F.rtrim(F.regexp_replace(text, rules.TRAILING_STATE, ""))


def peel_trailing(text: Column) -> Column:
    """Trailing digits, phone numbers and state codes, peeled until nothing changes.

    A round that changes anything takes a word at least, so as many rounds as there are words reach the
    end; texts that a second round leaves as they are, which is nearly all, take no more.
    """

    def rest(t: Column) -> Column:
        every = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.split(t, r"\s+")))), t, lambda s, _: _peel_once(s))
        return F.when(_peel_once(t) == t, t).otherwise(every)

    return let(_peel_once(text), rest)


def split_state(text: Column) -> Column:
    """A blank before the last two of four capitals that end a last word of more than four letters."""

    def body(t: Column) -> Column:
        tidy = F.trim(F.regexp_replace(t, r"\s+", " "))
        return F.when(t.rlike(r"(^|\s)\S*[A-Z]{4}\s*$") & t.rlike(r"\S{5,}\s*$"), F.regexp_replace(tidy, "([A-Z]{2})([A-Z]{2})$", "$1 $2")).otherwise(t)

    return let(text, body)


def drop_references(text: Column) -> Column:
    """Words that are one long reference go; white space collapses."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~w.rlike(rules.REFERENCE_TOKEN))
    return F.array_join(words, " ")


def title(text: Column) -> Column:
    """Capitalised words; short all-capital words and those after a hash stay."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def one(w: Column) -> Column:
        acronym = (F.upper(w) == w) & (F.lower(w) != w) & F.length(w).between(2, 5)
        return F.when(acronym | w.startswith("#"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w)))))

    return F.array_join(F.transform(words, one), " ")


def normalized(text: Column) -> Column:
    """Everything above in order; never empty unless the input is."""

    def body(raw: Column) -> Column:
        step = split_state(strip_references(strip_prefix(raw)))
        step = F.trim(F.regexp_replace(drop_references(peel_trailing(step)), r"\s+", " "))
        return F.when(raw == "", F.lit("")).otherwise(F.coalesce(F.nullif(title(step), F.lit("")), raw))

    return F.coalesce(let(F.trim(text), body), F.lit(""))


def for_categories(text: Column) -> Column:
    return F.lower(normalized(text))


def vendor(text: Column) -> Column:
    """Vendor names without trailing numbers, states, codes and stars; capitalised."""
    for pattern in (r"\s+\d{10,}.*$", r"\s+[A-Z]{2}\s*$", r"\s+\d{5}\s*$", r"\*+"):
        text = F.regexp_replace(text, pattern, "")
    return F.initcap(F.trim(text))


def for_bank(text: Column, bank: str) -> Column:
    """A bank's own clean-up: prefixes one after the other, then artifacts; white space collapses."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    for prefix in rules.BANK_PREFIXES[bank]:
        out = F.trim(F.regexp_replace(out, "(?i)^" + re.escape(prefix), ""))
    for pattern in rules.BANK_ARTIFACTS[bank]:
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def label_field(label: Column) -> Column:
    """The field that a stated-total label names, by keywords."""
    low, out = F.lower(label), F.lit(None).cast("string")
    for name, words in reversed(rules.LABEL_FIELDS):
        out = F.when(any_of(low, words), name).otherwise(out)
    out = F.when(out.isNull() & low.contains("deposits") & low.contains("credit"), "deposits").otherwise(out)
    return F.when(out.isNull() & low.contains("withdrawals") & low.contains("debit"), "withdrawals").otherwise(out)


def sheet_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[^\w]", "_"), 1, 31)


def is_junk(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in rules.JUNK)), F.lit(False))


def is_summary(text: Column, phrases: tuple[str, ...] = rules.SUMMARY_FILTER, bare: tuple[str, ...] = rules.BARE_FILTER) -> Column:
    """Summary and header lines: a phrase inside, a bare marker alone, a rate, or nothing at all."""
    d = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (d == "") | any_of(d, phrases) | d.isin(*bare) | d.rlike(rules.PERCENT)


def header_words(text: Column) -> Column:
    """Capital letters of the first three lines with text, 24 at most, where there are three or more."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    letters = F.transform(F.slice(lines, 1, 3), lambda x: F.regexp_replace(F.upper(x), "[^A-Z]", ""))
    return F.array_join(F.transform(F.filter(letters, lambda x: F.length(x) >= 3), lambda x: F.substring(x, 1, 24)), "|")


def date_style(text: Column) -> Column:
    """The most frequent of three date styles, the first on ties, or none."""
    counts = [(name, F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))) for name, p in (("mdy", r"\b\d{1,2}/\d{1,2}/\d{4}\b"), ("ymd", r"\b\d{4}-\d{2}-\d{2}\b"), ("dmon", r"\b\d{1,2}\s[A-Z][a-z]{2}\b"))]
    most = F.greatest(*[n for _, n in counts])
    style = F.lit("none")
    for name, n in reversed(counts):
        style = F.when((n == most) & (most > 0), name).otherwise(style)
    return style


def fingerprint(text: Column) -> Column:
    """Hash of a statement's layout: header words and date style."""
    quoted = F.replace(F.replace(header_words(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    blob = F.concat(F.lit('{"dominant_date_format": "'), date_style(text), F.lit('", "header": "'), quoted, F.lit('"}'))
    return F.substring(F.sha1(blob.cast("binary")), 1, 16)
