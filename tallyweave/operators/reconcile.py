"""Stated totals, reconciliation and repair.

Rows carry doc_id, seq, amount and, for the chain, page, line_top, account and running_balance; stated
totals are one row per document with the nine fields of ``rules.TOTAL_FIELDS``, null where not stated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import money
from ..functions.base import let

CENTS = "decimal(18,2)"


def lines_of(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos and line of every line, in one pass over the text."""
    return pages.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def after_label(line: Column, label: Column) -> Column:
    """The first money right of the label on the line, else the first anywhere on it."""
    first = lambda t: F.nullif(F.regexp_extract(t, rules.MONEY_ON_LINE, 0), F.lit(""))

    def body(at: Column) -> Column:
        tail = line.substr(at + F.length(label), F.length(line))
        return F.when((at > 0) & ~line.rlike(rules.YEAR_TO_DATE), money.stated(F.coalesce(first(tail), first(line))))

    return let(F.instr(F.lower(line), label), body)


def stated_totals(pages: DataFrame, labels: tuple[tuple[str, str], ...] = rules.TOTAL_LABELS) -> DataFrame:
    """One row per document: for each field the money of the longest label that has any, first line first."""
    ranked = sorted(enumerate(labels), key=lambda x: (-len(x[1][0]), x[0]))
    known = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(name).alias("field"), F.lit(rank).alias("rank")) for rank, (_, (label, name)) in enumerate(ranked)])
    lines = lines_of(pages).withColumn("line", F.trim("line")).where(F.lower("line").rlike("|".join(re.escape(x) for x, _ in labels)))
    each = lines.select("doc_id", "pos", "line", F.explode(F.filter(known, lambda k: F.contains(F.lower("line"), k["label"]))).alias("k"))
    each = each.select("doc_id", "pos", "k.field", "k.rank", after_label(F.col("line"), F.col("k.label")).alias("value")).where("value is not null")
    best = [F.min(F.when(F.col("field") == name, F.struct("rank", "pos", "value"))).getField("value").alias(name) for name in rules.TOTAL_FIELDS]
    return pages.select("doc_id").distinct().join(each.groupBy("doc_id").agg(*best), "doc_id", "left")


def sums(rows: DataFrame) -> DataFrame:
    """charges (amounts above zero), credits (below, as stored) and net of each document."""
    a = F.col("amount")
    return rows.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(a > 0, a)), F.lit(0)).cast(CENTS).alias("charges"),
        F.coalesce(F.sum(F.when(a < 0, a)), F.lit(0)).cast(CENTS).alias("credits"),
        F.coalesce(F.sum(a), F.lit(0)).cast(CENTS).alias("net"),
        F.count("*").alias("n_rows"),
    )


def chain(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Running-balance chain of each document with two balance rows or more that can be checked.

    Each balance must be the one before it in the account plus the row's amount; the first row of an
    account is not counted. matched_rows, checked_rows, drift and the first break by seq.
    """
    w = W.partitionBy("doc_id", F.coalesce("account", F.lit(""))).orderBy("page", "line_top", "seq")
    had = rows.where(F.col("running_balance").isNotNull()).withColumn("_before", F.lag("running_balance").over(w))
    expected = (F.col("_before") + F.coalesce("amount", F.lit(0))).cast(CENTS)
    off = had.where(F.col("_before").isNotNull()).select("doc_id", "seq", (expected - F.col("running_balance")).cast(CENTS).alias("_off"))
    bad = F.abs("_off") > F.lit(tolerance).cast(CENTS)
    return off.groupBy("doc_id").agg(
        F.sum(F.when(bad, 0).otherwise(1)).alias("matched_rows"),
        F.count("*").alias("checked_rows"),
        F.coalesce(F.sum(F.when(bad, F.abs("_off"))), F.lit(0)).cast(CENTS).alias("drift"),
        F.min(F.when(bad, F.col("seq"))).alias("first_break"),
    )


def reconcile(rows: DataFrame, stated: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One verdict per document of ``stated``, by the first strategy that its totals allow.

    Charges total, deposits and withdrawals, balance equation, running-balance chain, ending balance
    only, none. Within the tolerance counts as reconciled. The chain reports row counts as totals.
    """
    tol = F.lit(tolerance).cast(CENTS)
    links = chain(rows, tolerance)
    zero = F.lit(0).cast(CENTS)
    charges, credits = F.coalesce("s_charges", zero), F.abs(F.coalesce("s_credits", zero))
    all_ = stated.join(sums(rows).toDF("doc_id", "s_charges", "s_credits", "s_net", "n_rows"), "doc_id", "left").join(links, "doc_id", "left")
    net = charges - credits
    dep, wd = charges - F.abs("deposits"), credits - F.abs("withdrawals")
    depwd = F.coalesce(F.abs(dep), zero) + F.coalesce(F.abs(wd), zero)
    equation = F.col("new_balance") - F.col("previous_balance") - F.coalesce("interest", zero) - F.coalesce("fees", zero)
    kinds = (
        ("charges_total", F.col("charges").isNotNull(), charges - F.col("charges"), F.col("charges"), charges, 95, 40),
        ("deposits_withdrawals", F.col("deposits").isNotNull() | F.col("withdrawals").isNotNull(), depwd, F.abs("deposits"), charges, 95, 40),
        ("balance_equation", F.col("new_balance").isNotNull() & F.col("previous_balance").isNotNull(), net - equation, equation, net, 85, 35),
    )
    kind, off, expected, actual = F.lit("none"), zero, F.lit(None).cast(CENTS), net
    ok, sure = F.lit(False), F.lit(0.0)
    ending = F.col("ending_balance").isNotNull()
    kind, expected, sure = F.when(ending, "ending_balance_only").otherwise(kind), F.when(ending, F.col("ending_balance")), F.when(ending, 20.0).otherwise(sure)
    chained = F.coalesce(F.col("checked_rows") > 0, F.lit(False))
    whole = F.col("matched_rows") == F.col("checked_rows")
    kind, off = F.when(chained, "running_balance_chain").otherwise(kind), F.when(chained, F.col("drift")).otherwise(off)
    expected, actual = F.when(chained, F.col("matched_rows")).otherwise(expected), F.when(chained, F.col("checked_rows")).otherwise(actual)
    ok = F.when(chained, whole).otherwise(ok)
    sure = F.when(chained, F.when(whole, 95.0).when(F.col("matched_rows") > 0, 50.0).otherwise(30.0)).otherwise(sure)
    for name, when, d, e, a, yes, no in reversed(kinds):
        good = F.abs(d) <= tol
        kind, off, expected, actual = F.when(when, name).otherwise(kind), F.when(when, d).otherwise(off), F.when(when, e).otherwise(expected), F.when(when, a).otherwise(actual)
        ok, sure = F.when(when, good).otherwise(ok), F.when(when, F.when(good, float(yes)).otherwise(float(no))).otherwise(sure)
    return all_.select(
        "doc_id", kind.alias("check_type"), ok.alias("reconciled"), off.cast(CENTS).alias("discrepancy"), expected.cast(CENTS).alias("expected_total"),
        actual.cast(CENTS).alias("actual_total"), sure.cast("double").alias("confidence"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def repair_diff(found: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed rows beyond the found ones, as multisets of absolute cents; the order of proposals stays."""
    cents = F.round(F.abs("amount"), 2).cast(CENTS)
    have = found.where("amount is not null").groupBy("doc_id", cents.alias("_c")).agg(F.count("*").alias("_have"))
    rn = F.row_number().over(W.partitionBy("doc_id", "_c").orderBy("seq"))
    ranked = proposed.withColumn("_c", cents).withColumn("_rn", rn)
    return ranked.join(have, ["doc_id", "_c"], "left").where(F.col("_rn") > F.coalesce("_have", F.lit(0))).drop("_c", "_rn", "_have")


def with_repair(found: DataFrame, added: DataFrame, stated: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The verdict on the found rows and the added ones together."""
    return reconcile(found.unionByName(added, allowMissingColumns=True), stated, tolerance)


def finalize(before: DataFrame, after: DataFrame, added: DataFrame, proposals: DataFrame) -> DataFrame:
    """Method and confidence of each document from both verdicts.

    geometry where the found rows reconcile; geometry+ai_repair where rows were added and then
    reconcile; ai_only where nothing was found but proposals exist; geometry_unverified where rows
    stand unproven; failed where there is nothing.
    """
    n_added = added.groupBy("doc_id").agg(F.count("*").alias("n_added"))
    n_said = proposals.groupBy("doc_id").agg(F.count("*").alias("n_proposed"))
    both = before.alias("b").join(after.select("doc_id", F.col("reconciled").alias("again"), F.col("confidence").alias("sure_again")), "doc_id", "left").join(n_added, "doc_id", "left").join(n_said, "doc_id", "left")
    method = (
        F.when(F.col("reconciled"), "geometry").when((F.coalesce("n_added", F.lit(0)) > 0) & F.coalesce("again", F.lit(False)) & (F.col("n_rows") > 0), "geometry+ai_repair")
        .when((F.col("n_rows") == 0) & (F.coalesce("n_proposed", F.lit(0)) > 0), "ai_only").when(F.col("n_rows") > 0, "geometry_unverified").otherwise("failed")
    )
    sure = F.when(F.col("reconciled"), F.col("confidence")).when(method == "geometry+ai_repair", F.col("sure_again")).when(method == "failed", 0.0).otherwise(F.col("confidence"))
    return both.select("doc_id", method.alias("method"), sure.alias("confidence"), F.coalesce("n_added", F.lit(0)).alias("n_added"))
