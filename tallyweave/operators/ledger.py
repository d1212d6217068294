"""Filters, windows, sets and duplicates of ledger rows (doc_id, seq, txn_date, date_raw, description,
amount, page, category)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import dates, text


def without_summaries(rows: DataFrame, phrases: tuple[str, ...] = rules.SUMMARY_FILTER, bare: tuple[str, ...] = rules.BARE_FILTER) -> DataFrame:
    return rows.where(~text.is_summary(F.col("description"), phrases, bare))


def search(rows: DataFrame, words: str) -> DataFrame:
    """Rows whose description holds the words, in any case."""
    return rows.where(F.contains(F.lower("description"), F.lower(F.lit(words))))


def delete_first(rows: DataFrame, date: str, description: str, amount: str) -> DataFrame:
    """All rows but the first that equals the given date, description and amount."""
    same = F.coalesce((F.col("txn_date") == F.lit(date).cast("date")) & (F.col("description") == description) & (F.col("amount") == F.lit(amount).cast("decimal(18,2)")), F.lit(False))
    hit = rows.where(same).orderBy("doc_id", "seq").limit(1).select("doc_id", "seq")
    return rows.join(F.broadcast(hit), ["doc_id", "seq"], "left_anti")


def _first_per(rows: DataFrame, *keys: Column) -> DataFrame:
    w = W.partitionBy("doc_id", *keys).orderBy("seq")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_pipeline(rows: DataFrame) -> DataFrame:
    """First row of each description (40 characters), amount and raw date (10 characters)."""
    return _first_per(rows, F.substring(F.lower(F.trim("description")), 1, 40), F.col("amount"), F.substring("date_raw", 1, 10))


def fingerprint(month: Column) -> Column:
    """Letters and digits of the description, absolute amount and month key."""
    words = F.substring(F.regexp_replace(F.lower(F.coalesce("description", F.lit(""))), "[^a-z0-9]", ""), 1, 40)
    cents = F.coalesce(F.abs("amount").cast("decimal(18,2)").cast("string"), F.lit("0.00"))
    return F.concat_ws("|", words, cents, month)


def dedupe_filter(rows: DataFrame, month: Column | None = None) -> DataFrame:
    """First row of each fingerprint; a dateless repeat stays once for each further page."""
    raw = F.coalesce("date_raw", F.lit(""))
    key = fingerprint(dates.month_key(raw) if month is None else month)
    dateless = ~raw.rlike(r"\d")
    marked = rows.withColumn("_fp", key).withColumn("_dl", dateless).withColumn("_rn", F.row_number().over(W.partitionBy("doc_id", "_fp").orderBy("seq")))
    again = F.when((F.col("_rn") > 1) & F.col("_dl"), F.row_number().over(W.partitionBy("doc_id", "_fp", "page", (F.col("_rn") > 1) & F.col("_dl")).orderBy("seq")))
    return marked.withColumn("_again", again).where("_rn = 1 or _again = 1").drop("_fp", "_dl", "_rn", "_again")


def dedupe_month(rows: DataFrame) -> DataFrame:
    """The same with the true month of the parsed date."""
    return dedupe_filter(rows, F.coalesce(F.date_format("txn_date", "yyyy-MM"), F.lit("")))


def _validator_key() -> Column:
    words = F.regexp_replace(F.lower(F.coalesce("description", F.lit(""))), r"[^\w]", "")
    cents = F.coalesce(F.nullif(F.abs("amount"), F.lit(0)).cast("decimal(18,2)").cast("string"), F.lit("0.00"))
    return F.concat_ws("_", words, cents, F.coalesce(F.date_format("txn_date", "yyyy-MM"), F.lit("unknown")))


def flag_duplicates(rows: DataFrame) -> DataFrame:
    """is_duplicate: an earlier row of the document has the same words, amount and month."""
    rn = F.row_number().over(W.partitionBy("doc_id", _validator_key()).orderBy("seq"))
    return rows.withColumn("is_duplicate", rn > 1)


def duplicate_pairs(rows: DataFrame) -> DataFrame:
    """doc_id, first_seq and seq: every later row with the first of its key."""
    w = W.partitionBy("doc_id", _validator_key()).orderBy("seq")
    return rows.select("doc_id", F.first("seq").over(w).alias("first_seq"), "seq").where("seq <> first_seq")


def recent_average(rows: DataFrame, n: int = 10) -> DataFrame:
    """Mean amount of the last ``n`` rows of each document."""
    rn = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("seq")))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= n).groupBy("doc_id").agg(F.avg("amount").alias("mean_amount"), F.count("*").alias("n_rows"))


def multiset_minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` beyond their counts in ``right``, by whole rows."""
    return left.exceptAll(right)


def multiset_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that both have, as often as both have them."""
    return left.intersectAll(right)


def matched_counts(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of both sides that pair one to one on absolute cents, with precision and recall."""
    cents = F.abs("amount").cast("decimal(18,2)").alias("c")
    e, t = extracted.groupBy("doc_id", cents).agg(F.count("*").alias("e")), truth.groupBy("doc_id", cents).agg(F.count("*").alias("t"))
    both = e.join(t, ["doc_id", "c"], "full")
    got = both.groupBy("doc_id").agg(F.sum(F.least(F.coalesce("e", F.lit(0)), F.coalesce("t", F.lit(0)))).alias("matched"), F.sum(F.coalesce("e", F.lit(0))).alias("extracted"), F.sum(F.coalesce("t", F.lit(0))).alias("expected"))
    return got.withColumn("precision", F.when(F.col("extracted") > 0, F.col("matched") / F.col("extracted"))).withColumn("recall", F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")))


def tolerance_match(extracted: DataFrame, truth: DataFrame, cents: int = 1) -> DataFrame:
    """doc_id and matched: greedy one-to-one matches of absolute amounts within ``cents``.

    Both sides ascending; each extracted row takes the smallest free truth row in reach. A document is
    one group: its size is that of a statement.
    """
    import pandas as pd

    tagged = extracted.select("doc_id", (F.abs("amount") * 100).cast("long").alias("c"), F.lit(0).alias("side")).union(truth.select("doc_id", (F.abs("amount") * 100).cast("long"), F.lit(1)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = sorted(group.c[group.side == 0]), sorted(group.c[group.side == 1])
        j = hits = 0
        for x in a:
            while j < len(b) and b[j] < x - cents:
                j += 1
            if j < len(b) and b[j] <= x + cents:
                hits += 1
                j += 1
        return pd.DataFrame({"doc_id": [group.doc_id.iloc[0]], "matched": [hits]})

    return tagged.where("c is not null").groupBy("doc_id").applyInPandas(run, "doc_id long, matched long")


def forward_fill(lines: DataFrame, value: str, order: str = "line", within: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """The last value seen so far on the page."""
    return lines.withColumn(value, F.last(value, ignorenulls=True).over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def upsert_formats(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Format memory: first_seen stays, last_seen moves on, counts add up (fingerprint, first_seen, last_seen, seen_count)."""
    new = seen.groupBy("fingerprint").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("seen_count"))
    return known.select(*new.columns).unionByName(new).groupBy("fingerprint").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("seen_count").alias("seen_count"))
