"""Statement text to rows by each bank's ordered patterns: the first that matches a line decides."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import dates, money, text
from ..functions.base import let
from .reconcile import lines_of


def _parsed(line: Column, bank: str, year: Column) -> Column:
    """struct(kind, date_raw, txn_date, description, amount, type) of a line, or null."""
    out = F.lit(None).cast("struct<kind:string,date_raw:string,txn_date:date,description:string,amount:decimal(18,2),type:string>")
    for p in reversed(rules.ROW_PATTERNS[bank]):
        rx = ("" if bank == "Chase" and not p.date else "(?i)") + p.regex
        group = lambda i, rx=rx: F.regexp_extract(line, rx, i)
        said = F.trim(group(p.text))
        if p.more and bank == "Navy Federal" and p.kind == "card_state":
            said = F.concat_ws(" ", said, group(p.more))
        parts = F.struct((group(p.date) if p.date else F.lit("")).alias("d"), said.alias("t"), group(p.amount).alias("a"))
        out = F.when(line.rlike(rx), let(let(parts, _row_of(p.kind, bank, year)), lambda r: F.when(F.coalesce(r["keep"] & r["txn_date"].isNotNull() & r["amount"].isNotNull(), F.lit(False)), r["row"]))).otherwise(out)
    return out


def _row_of(kind: str, bank: str, year: Column):
    return lambda g: _row(g, kind, bank, year)


def _row(g: Column, kind: str, bank: str, year: Column) -> Column:
    """keep, txn_date, amount and the row of a pattern's groups (d, t, a)."""
    raw, said, side, keep = g["d"], g["t"], F.lit("debit"), F.lit(True)
    amount = money.row(F.regexp_replace(g["a"], "-+$", "") if bank == "Navy Federal" else g["a"])
    if bank == "Navy Federal":
        day = dates.statement(raw, year)
        side = F.when(g["a"].endswith("-") | F.lit(kind != "checking"), "debit").otherwise("credit")
        keep = ~F.lower(said).rlike("beginning balance|ending balance")
    elif bank == "Capital One":
        day = dates.base(raw, year) if kind == "numeric" else dates.month_day(raw, year)
        keep = ~(said.contains(" - ") | said.endswith(" -"))
    elif bank == "Citibank":
        day = dates.base(dates.add_year(raw, year), year)
        said = F.concat_ws(" ", F.lit("AUTOPAY"), said) if kind == "autopay" else said
    elif bank == "Bank of America":
        day = dates.base(raw)
    else:
        day = F.make_date(year, F.lit(1), F.lit(1)) if kind == "dateless" else dates.base(dates.add_year(raw, year), year)

    def made(v: Column) -> Column:
        ok = keep & {"Citibank": v["amount"] != 0, "Bank of America": v["amount"] <= 0, "Chase": v["amount"] >= 0}.get(bank, F.lit(True))
        shown = F.abs(v["amount"]) if bank in ("Citibank", "Bank of America") else v["amount"]
        row = F.struct(F.lit(kind).alias("kind"), raw.alias("date_raw"), v["day"].alias("txn_date"), said.alias("description"), shown.cast("decimal(18,2)").alias("amount"), side.alias("type"))
        return F.struct(ok.alias("keep"), v["day"].alias("txn_date"), v["amount"].alias("amount"), row.alias("row"))

    return let(F.struct(day.alias("day"), amount.alias("amount")), made)


def parse(pages: DataFrame, bank: str, default_year: int) -> DataFrame:
    """doc_id, pos, kind, date_raw, txn_date, description, amount, type of each line that gives a row.

    Lines of the bank's skip list and blank lines give none, nor do Citibank's lines over 500 characters. The year of
    dates without one is the statement's, else ``default_year``.
    """
    dated = pages.withColumn("_y", dates.year_hint(F.col("text"), default_year))
    lines = dated.select("doc_id", "_y", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    some = lines.where((F.col("line") != "") & F.col("line").rlike(r"[0-9]"))
    if bank == "Citibank":
        some = some.where(F.length("line") <= 500)
    skip = rules.ROW_SKIP[bank]
    if skip:
        some = some.where(~F.col("line").rlike("(?i)" + "|".join(f"(?:{s})" for s in skip)))
    found = some.withColumn("r", _parsed(F.col("line"), bank, F.col("_y"))).where("r is not null").select("doc_id", "pos", "r.*")
    return found.unionByName(_second_pass(dated)) if bank == "Citibank" else found


_DAY, _CENTS = re.compile(r"[0-9]{2}/[0-9]{2}"), re.compile(r"\$[0-9,]+\.[0-9]{2}")
_CRAMMED = re.compile(r"([0-9]{2}/[0-9]{2})\s+[0-9]{2}/[0-9]{2}\s+([^0-9]+?)(?=[0-9]{2}/[0-9]{2}|$)")


def crammed(body: str | None, reach: int = 10) -> list[tuple[int, str, str, str]]:
    """(line, date, description, amount) of rows whose amounts stand on other lines.

    Lines of four or more dates without money are split; each row takes the first amount not taken yet,
    of lines without dates, within ``reach`` lines. Rows without such an amount are left out.
    """
    rows, amounts = [], []
    for i, line in enumerate((body or "").split("\n")):
        line = line.strip()
        days, money_here = len(_DAY.findall(line)), _CENTS.findall(line)
        if days >= 4 and not money_here:
            rows += [(i, d, t.strip()) for d, t in _CRAMMED.findall(line)]
        elif money_here and not days:
            amounts += [(i, a) for a in money_here]
    out, at = [], 0
    for i, day, said in rows:
        while at < len(amounts) and amounts[at][0] < i - reach:  # nor within reach of later rows
            at += 1
        if at < len(amounts) and amounts[at][0] <= i + reach:
            out.append((i, day, said, amounts[at][1]))
            at += 1
    return out


def _second_pass(dated: DataFrame) -> DataFrame:
    """Rows of Citibank's crammed lines; the first pass sees neither these lines nor their amounts."""
    rows = F.udf(crammed, "array<struct<pos:int,d:string,t:string,a:string>>")
    some = dated.where(F.regexp_count("text", F.lit("[0-9]{2}/[0-9]{2}")) >= 4).select("doc_id", "_y", F.explode(rows("text")).alias("g"))
    day = dates.base(dates.add_year(F.col("g.d"), F.col("_y")), F.col("_y"))
    out = some.select("doc_id", "g.pos", F.lit("crammed").alias("kind"), F.col("g.d").alias("date_raw"), day.alias("txn_date"), F.col("g.t").alias("description"), money.row(F.col("g.a")).cast("decimal(18,2)").alias("amount"), F.lit("debit").alias("type"))
    return out.where("txn_date is not null and amount is not null")


def orphans(lines: DataFrame, reach: int = 10) -> DataFrame:
    """Lines with a date but no money, with the nearest later or earlier money-only line within ``reach``.

    ``lines``: doc_id, pos, line. The variant that does not use an amount up; ties by position.
    """
    has_date, has_money = F.col("line").rlike(r"^\d{1,2}/\d{1,2}\s+\S"), F.col("line").rlike(rf"\$?{rules.MONEY2}")
    want = lines.where(has_date & ~has_money).select("doc_id", F.col("pos").alias("line_at"), F.col("line").alias("said"), F.floor(F.col("pos") / reach).alias("b"))
    have = lines.where(~has_date & F.trim("line").rlike(rf"^-?\$?{rules.MONEY2}$")).select("doc_id", F.col("pos").alias("money_at"), money.row(F.trim("line")).alias("amount"), F.explode(F.array(*[F.floor(F.col("pos") / reach) + k for k in (-1, 0, 1)])).alias("b"))
    near = want.join(have, ["doc_id", "b"]).where(F.abs(F.col("money_at") - F.col("line_at")) <= reach)
    best = F.min_by(F.struct("money_at", "amount"), F.struct(F.abs(F.col("money_at") - F.col("line_at")).alias("d"), "money_at")).alias("m")
    return near.groupBy("doc_id", "line_at", "said").agg(best).select("doc_id", "line_at", "said", "m.money_at", "m.amount")


def generic(pages: DataFrame) -> DataFrame:
    """Rows of any text: lines with a date and money that are no summary lines; vendor names cleaned."""
    lines = lines_of(pages).withColumn("line", F.trim("line"))
    dated = lines.where(F.col("line").rlike(r"\d{1,2}/\d{1,2}") & F.col("line").rlike(rules.MONEY2) & ~text.is_summary(F.col("line")))
    said = F.regexp_replace(F.regexp_replace("line", r"^.*?\d{1,2}/\d{1,2}(/\d{2,4})?\s+", ""), rf"\s*[-+]?\$?{rules.MONEY2}.*$", "")
    return dated.select("doc_id", "pos", dates.in_line(F.col("line")).alias("txn_date"), text.vendor(said).alias("description"), money.in_line(F.col("line")).alias("amount"))


def strategy(n_chars: Column) -> Column:
    return F.when(n_chars < 1000, "pattern_based").when(n_chars < 3000, "light_clustering").when(n_chars < 8000, "adaptive_clustering").otherwise("full_clustering")


def derived_pattern(lines: DataFrame) -> str:
    """The row pattern of a cluster of lines (text): two amounts if half of the lines or more have them.

    One aggregate goes to the driver, which builds a literal pattern from it.
    """
    share = lines.agg(F.avg((F.regexp_count("text", F.lit(rules.MONEY_PART)) >= 2).cast("int"))).first()[0]
    tail = rf"\s+({rules.MONEY_PART})" * (2 if (share or 0) >= 0.5 else 1)
    return rf"^\s*{rules.DATE_PART}(.+?){tail}\s*$"


#: Parsers by name, in order: a predicate on a text column and a function of pages. ``register`` adds one.
PARSERS: dict[str, tuple] = {}


def register(name: str, can_parse, extract) -> None:
    """Plug in a parser: ``can_parse(text column) -> boolean column``, ``extract(pages) -> rows``."""
    PARSERS[name] = (can_parse, extract)


def parse_registered(pages: DataFrame, parsers: dict[str, tuple] | None = None) -> DataFrame:
    """doc_id, parser and the rows of the first parser that takes each text; texts that none takes give none."""
    parsers = PARSERS if parsers is None else parsers
    taken, out = F.lit(None).cast("string"), None
    for name, (can_parse, _) in reversed(parsers.items()):
        taken = F.when(can_parse(F.col("text")), name).otherwise(taken)
    marked = pages.withColumn("parser", taken)
    for name, (_, extract) in parsers.items():
        rows = extract(marked.where(F.col("parser") == name).drop("parser")).withColumn("parser", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parser is registered")
    return out
