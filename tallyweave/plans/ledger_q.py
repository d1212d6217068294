"""Filters, windows, duplicates, sets, joins and aggregates over ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import dates, text
from ..operators import ledger as L
from ..operators import validate as VA
from . import views as V

AS_OF = "2001-06-30"
KEYS = ["doc_id", "seq"]


def _esc(s: str) -> str:
    return s.replace("'", "''")


def _sql_any(column: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{_esc(p)}')" for p in phrases) + ")"


def _sql_summary(phrases: tuple[str, ...], bare: tuple[str, ...], column: str = "description") -> str:
    d = f"lower(trim(coalesce({column}, '')))"
    return f"({d} = '' OR {_sql_any(d, phrases)} OR {d} IN ({', '.join(repr(x) for x in bare)}) OR regexp_matches({d}, '{rules.PERCENT}'))"


def _on_txns(op):
    """A query that applies ``op`` to the ledger rows and returns the keys of what stays."""
    return lambda spark, sf_dir: op(V.txns(spark, sf_dir)).select(*KEYS)


def _t(sql: str) -> str:
    return "WITH " + V.TXNS + " " + sql


Q: dict = {}
S: dict[str, str] = {}

Q["flt_summary"] = _on_txns(L.without_summaries)
S["flt_summary"] = _t(f"SELECT doc_id, seq FROM txns WHERE NOT {_sql_summary(rules.SUMMARY_FILTER, rules.BARE_FILTER)}")
Q["flt_summary_geo"] = _on_txns(lambda t: L.without_summaries(t, rules.SUMMARY_GEOMETRY, rules.BARE_GEOMETRY))
S["flt_summary_geo"] = _t(f"SELECT doc_id, seq FROM txns WHERE NOT {_sql_summary(rules.SUMMARY_GEOMETRY, rules.BARE_GEOMETRY)}")
Q["flt_junk"] = _on_txns(lambda t: t.where(text.is_junk(F.col("description"))))
S["flt_junk"] = _t("SELECT doc_id, seq FROM txns WHERE regexp_matches(trim(description), '(?i)" + "|".join(f"(?:{p})" for p in rules.JUNK) + "')")
Q["flt_search"] = _on_txns(lambda t: L.search(t, "Uber"))
S["flt_search"] = _t("SELECT doc_id, seq FROM txns WHERE contains(lower(description), 'uber')")
Q["flt_delete_one"] = _on_txns(lambda t: L.delete_first(t, "1997-05-28", rules and V.DESCRIPTIONS[1], "-5.25"))
S["flt_delete_one"] = _t(f"SELECT doc_id, seq FROM txns WHERE (doc_id, seq) NOT IN (SELECT (doc_id, seq) FROM txns WHERE txn_date = DATE '1997-05-28' AND description = '{_esc(V.DESCRIPTIONS[1])}' AND amount = -5.25 ORDER BY doc_id, seq LIMIT 1)")
Q["flt_need_date"] = _on_txns(lambda t: t.where(dates.validated(F.col("date_raw")).isNotNull()))
S["flt_need_date"] = _t("SELECT doc_id, seq FROM txns WHERE seq % 4 < 2")


def prj_rawrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the optional fields as nulls."""
    b = V.balanced(spark, sf_dir)
    return b.select(*KEYS, F.nullif("date_raw", F.lit("")).alias("date_raw"), F.col("running_balance").cast("double"), F.when(F.col("account") == "savings", F.col("account")).alias("account"))


Q["prj_rawrow"] = prj_rawrow
S["prj_rawrow"] = "WITH " + V.BALANCED + " SELECT doc_id, seq, nullif(date_raw, '') AS date_raw, CAST(running_balance AS DOUBLE) AS running_balance, CASE WHEN account = 'savings' THEN account END AS account FROM balanced"
Q["prj_dates"] = lambda spark, sf_dir: V.txns(spark, sf_dir).select(*KEYS, dates.validated(F.col("date_raw")).cast("string").alias("parsed"))
S["prj_dates"] = _t("SELECT doc_id, seq, CASE WHEN seq % 4 < 2 THEN CAST(txn_date AS VARCHAR) END AS parsed FROM txns")
Q["prj_amount_float"] = lambda spark, sf_dir: V.txns(spark, sf_dir).select(*KEYS, F.col("amount").cast("double").alias("amount"))
S["prj_amount_float"] = _t("SELECT doc_id, seq, CAST(amount AS DOUBLE) AS amount FROM txns")

# --- windows and duplicates
Q["win_dedupe_pipeline"] = _on_txns(L.dedupe_pipeline)
S["win_dedupe_pipeline"] = _t("SELECT doc_id, seq FROM txns QUALIFY row_number() OVER (PARTITION BY doc_id, substr(lower(trim(description)), 1, 40), amount, substr(date_raw, 1, 10) ORDER BY seq) = 1")
Q["win_dedupe_filter"] = _on_txns(L.dedupe_filter)
S["win_dedupe_filter"] = _t("""SELECT doc_id, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, fp, page, rn > 1 AND dl ORDER BY seq) AS again FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, fp ORDER BY seq) AS rn FROM (
      SELECT *, NOT regexp_matches(date_raw, '[0-9]') AS dl, substr(regexp_replace(lower(description), '[^a-z0-9]', '', 'g'), 1, 40) || '|' || abs(amount) || '|' || regexp_extract(date_raw, '([0-9]{1,2})[/-][0-9]{1,2}[/-]?[0-9]*', 1) AS fp FROM txns)))
WHERE rn = 1 OR (rn > 1 AND dl AND again = 1)""")
Q["win_dedupe_month"] = _on_txns(L.dedupe_month)
S["win_dedupe_month"] = S["win_dedupe_filter"].replace("regexp_extract(date_raw, '([0-9]{1,2})[/-][0-9]{1,2}[/-]?[0-9]*', 1)", "strftime(txn_date, '%Y-%m')")
_VKEY = "regexp_replace(lower(description), '[^\\w]', '', 'g') || '_' || abs(amount) || '_' || strftime(txn_date, '%Y-%m')"
Q["win_dedupe_validator"] = lambda spark, sf_dir: L.flag_duplicates(V.txns(spark, sf_dir)).select(*KEYS, "is_duplicate")
S["win_dedupe_validator"] = _t(f"SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, {_VKEY} ORDER BY seq) > 1 AS is_duplicate FROM txns")
Q["win_dup_pairs"] = lambda spark, sf_dir: L.duplicate_pairs(V.txns(spark, sf_dir))
S["win_dup_pairs"] = _t(f"SELECT * FROM (SELECT doc_id, first_value(seq) OVER (PARTITION BY doc_id, {_VKEY} ORDER BY seq) AS first_seq, seq FROM txns) WHERE seq <> first_seq")


def win_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.recent_average(V.txns(spark, sf_dir)).withColumn("mean_amount", F.round(F.col("mean_amount").cast("double"), 6))


Q["win_recent"] = win_recent
S["win_recent"] = _t("SELECT doc_id, round(CAST(sum(amount) AS DOUBLE) / count(*), 6) AS mean_amount, count(*) AS n_rows FROM (SELECT * FROM txns QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) <= 10) GROUP BY doc_id")


def win_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.txns(spark, sf_dir).withColumn("header", F.when(F.col("seq") % 10 == 0, F.concat(F.lit("Savings "), F.col("seq"))))
    return L.forward_fill(t, "header", "seq").select(*KEYS, "header")


Q["win_ffill"] = win_ffill
S["win_ffill"] = _t("SELECT doc_id, seq, last_value(CASE WHEN seq % 10 = 0 THEN 'Savings ' || seq END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY seq ROWS UNBOUNDED PRECEDING) AS header FROM txns")


def win_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("doc_id", "account").orderBy("page", "line_top", "seq")
    return V.balanced(spark, sf_dir).where("running_balance is not null").select(*KEYS, F.lag("running_balance").over(w).cast("double").alias("before"))


Q["win_chain"] = win_chain
S["win_chain"] = "WITH " + V.BALANCED + " SELECT doc_id, seq, CAST(lag(running_balance) OVER (PARTITION BY doc_id, account ORDER BY page, line_top, seq) AS DOUBLE) AS before FROM balanced WHERE running_balance IS NOT NULL"


def win_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, dated = W.partitionBy("doc_id").orderBy("seq"), F.col("date_raw") != ""
    at = F.round((F.row_number().over(w) - 1) / F.count("*").over(W.partitionBy("doc_id")), 9)
    return V.txns(spark, sf_dir).select(*KEYS, F.coalesce(F.lag(dated).over(w), F.lit(False)).alias("prev_dated"), F.coalesce(F.lead(dated).over(w), F.lit(False)).alias("next_dated"), at.alias("relative_position"))


Q["win_ctx"] = win_ctx
S["win_ctx"] = _t("SELECT doc_id, seq, coalesce(lag(date_raw <> '') OVER w, false) AS prev_dated, coalesce(lead(date_raw <> '') OVER w, false) AS next_dated, round((row_number() OVER w - 1) / CAST(count(*) OVER (PARTITION BY doc_id) AS DOUBLE), 9) AS relative_position FROM txns WINDOW w AS (PARTITION BY doc_id ORDER BY seq)")

# --- sets
_cents = lambda t: t.select("doc_id", F.abs("amount").cast("double").alias("amount"))
Q["set_except_all"] = lambda spark, sf_dir: L.multiset_minus(_cents(V.txns(spark, sf_dir).where("seq % 2 = 0")), _cents(V.txns(spark, sf_dir).where("seq % 3 = 0")))
S["set_except_all"] = _t("SELECT doc_id, CAST(abs(amount) AS DOUBLE) AS amount FROM txns WHERE seq % 2 = 0 EXCEPT ALL SELECT doc_id, CAST(abs(amount) AS DOUBLE) FROM txns WHERE seq % 3 = 0")
Q["set_intersect_all"] = lambda spark, sf_dir: L.multiset_common(_cents(V.txns(spark, sf_dir).where("seq % 2 = 0")), _cents(V.txns(spark, sf_dir).where("seq % 3 = 0")))
S["set_intersect_all"] = S["set_except_all"].replace("EXCEPT ALL", "INTERSECT ALL")
Q["set_union_all"] = lambda spark, sf_dir: V.txns(spark, sf_dir).where("page = 1").unionByName(V.txns(spark, sf_dir).where("page = 2")).groupBy("doc_id").agg(F.count("*").alias("n_rows"))
S["set_union_all"] = _t("SELECT doc_id, count(*) AS n_rows FROM (SELECT * FROM txns WHERE page = 1 UNION ALL SELECT * FROM txns WHERE page = 2) GROUP BY doc_id")
Q["set_distinct"] = lambda spark, sf_dir: V.txns(spark, sf_dir).select("doc_id", "description").distinct()
S["set_distinct"] = _t("SELECT DISTINCT doc_id, description FROM txns")
Q["srt_date_nulls"] = lambda spark, sf_dir: V.txns(spark, sf_dir).withColumn("d", dates.validated(F.col("date_raw"))).select(*KEYS, F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("d").asc_nulls_last(), "seq")).alias("place"))
S["srt_date_nulls"] = _t("SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN seq % 4 < 2 THEN txn_date END ASC NULLS LAST, seq) AS place FROM txns")
Q["top_files"] = lambda spark, sf_dir: V.txns(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "doc_id").limit(10)
S["top_files"] = _t("SELECT doc_id, count(*) AS n_rows FROM txns GROUP BY doc_id ORDER BY n_rows DESC, doc_id LIMIT 10")


def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top twenty descriptions by count; those with a digit count half as much again; the best five of them."""
    n = V.txns(spark, sf_dir).groupBy("description").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "description").limit(20)
    return n.withColumn("boosted", F.when(F.col("description").rlike("[0-9]"), F.col("n") * 1.5).otherwise(F.col("n").cast("double"))).orderBy(F.desc("boosted"), "description").limit(5)


Q["top_patterns"] = top_patterns
S["top_patterns"] = _t("SELECT description, n, CASE WHEN regexp_matches(description, '[0-9]') THEN n * 1.5 ELSE n END::DOUBLE AS boosted FROM (SELECT description, count(*) AS n FROM txns GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) ORDER BY boosted DESC, description LIMIT 5")

# --- matching of extracted rows and truth
_truth = lambda spark, sf_dir: V.txns(spark, sf_dir).where("seq % 7 <> 0")
_extracted = lambda spark, sf_dir: V.txns(spark, sf_dir).where("seq % 5 <> 0")
_MATCH = _t("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(sum(least(coalesce(e, 0), coalesce(t, 0))) AS BIGINT) AS matched, CAST(sum(coalesce(e, 0)) AS BIGINT) AS extracted, CAST(sum(coalesce(t, 0)) AS BIGINT) AS expected
FROM (SELECT doc_id, abs(amount) AS c, count(*) AS e FROM txns WHERE seq % 5 <> 0 GROUP BY ALL) a FULL JOIN (SELECT doc_id, abs(amount) AS c, count(*) AS t FROM txns WHERE seq % 7 <> 0 GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.c = b.c GROUP BY 1""")
Q["jn_tolerance"] = lambda spark, sf_dir: L.matched_counts(_extracted(spark, sf_dir), _truth(spark, sf_dir)).select("doc_id", "matched", "extracted", "expected")
S["jn_tolerance"] = _MATCH
Q["jn_tolerance_greedy"] = lambda spark, sf_dir: L.tolerance_match(_extracted(spark, sf_dir), _truth(spark, sf_dir))
Q["agg_eval_pr"] = lambda spark, sf_dir: L.matched_counts(_extracted(spark, sf_dir), _truth(spark, sf_dir)).agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.count("*").alias("n"))
S["agg_eval_pr"] = "SELECT round(avg(CASE WHEN extracted > 0 THEN matched / extracted END), 6) AS precision, round(avg(CASE WHEN expected > 0 THEN matched / expected END), 6) AS recall, count(*) AS n FROM (" + _MATCH + ")"
Q["jn_multiset_anti"] = lambda spark, sf_dir: L.multiset_minus(V.txns(spark, sf_dir).select("doc_id", "description"), V.txns(spark, sf_dir).where("seq % 3 = 0").select("doc_id", "description"))
S["jn_multiset_anti"] = _t("SELECT doc_id, description FROM txns EXCEPT ALL SELECT doc_id, description FROM txns WHERE seq % 3 = 0")

# --- validation
def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.txns(spark, sf_dir).withColumn("txn_date", F.when(F.col("seq") % 13 != 0, F.col("txn_date"))).withColumn("amount", F.when(F.col("seq") % 17 == 0, F.lit(None)).when(F.col("seq") % 19 == 0, F.lit("2000000.00").cast("decimal(18,2)")).when(F.col("seq") % 29 == 0, F.lit("0.00").cast("decimal(18,2)")).otherwise(F.col("amount")).cast("decimal(18,2)"))
    return VA.validate(t, AS_OF)


_VAL = V.TXNS + f""", base AS (
  SELECT * REPLACE (CASE WHEN seq % 13 <> 0 THEN txn_date END AS txn_date, CASE WHEN seq % 17 = 0 THEN NULL WHEN seq % 19 = 0 THEN 2000000.00 WHEN seq % 29 = 0 THEN 0.00 ELSE amount END AS amount), DATE '{AS_OF}' AS d FROM txns
), errs AS (
  SELECT *, list_filter([CASE WHEN txn_date IS NULL THEN 'missing_date' END, CASE WHEN txn_date > d + 30 THEN 'future_date' END, CASE WHEN txn_date < d - 1825 THEN 'ancient_date' END], lambda x: x IS NOT NULL) AS e1,
    list_filter([CASE WHEN description = '' THEN 'missing_description' END, CASE WHEN description <> '' AND length(trim(description)) < 3 THEN 'short_description' END], lambda x: x IS NOT NULL) AS e2,
    list_filter([CASE WHEN amount IS NULL THEN 'missing_amount' END, CASE WHEN abs(amount) < 0.01 THEN 'zero_amount' END, CASE WHEN abs(amount) > 1000000 THEN 'huge_amount' END], lambda x: x IS NOT NULL) AS e3,
    row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(description), '[^\\w]', '', 'g'), coalesce(nullif(abs(amount), 0), 0.00), coalesce(strftime(txn_date, '%Y-%m'), 'unknown') ORDER BY seq) > 1 AS dup
  FROM base
), scored AS (
  SELECT *, e1 || e2 || e3 || CASE WHEN dup THEN ['duplicate'] ELSE [] END AS errors,
    len(list_filter(e1 || e2 || e3, lambda x: x NOT LIKE 'missing%')) + CASE WHEN {_sql_any("lower(description)", rules.SUSPICIOUS)} THEN 1 ELSE 0 END AS n_warnings, length(trim(description)) AS n, abs(datediff('day', d, txn_date)) AS days
  FROM errs
), validated AS (
  SELECT doc_id, seq, array_to_string(errors, ',') AS errors, CAST(n_warnings AS INTEGER) AS n_warnings, len(list_intersect(errors, ['missing_date', 'missing_description', 'missing_amount', 'huge_amount'])) = 0 AS is_valid,
    CAST(greatest(0, least(100, CASE WHEN txn_date IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN n >= 5 THEN 15 ELSE 0 END + CASE WHEN amount IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN days < 365 THEN 20 WHEN days < 730 THEN 10 WHEN days IS NOT NULL THEN 5 ELSE 0 END
      + CASE WHEN n >= 20 THEN 20 WHEN n >= 10 THEN 15 WHEN n >= 5 THEN 10 ELSE 0 END + CASE WHEN abs(amount) BETWEEN 0.01 AND 10000 THEN 20 WHEN abs(amount) > 0 AND abs(amount) <= 100000 THEN 10 WHEN abs(amount) > 0 THEN 5 ELSE 0 END - 10 * len(errors) - 5 * n_warnings)) AS DOUBLE) AS quality_score
  FROM scored
)"""
Q["x_quality"] = lambda spark, sf_dir: _validated(spark, sf_dir).select(*KEYS, F.array_join("errors", ",").alias("errors"), "n_warnings", "is_valid", "quality_score")
S["x_quality"] = "WITH " + _VAL + " SELECT * FROM validated"
Q["flt_valid"] = lambda spark, sf_dir: VA.accepted(_validated(spark, sf_dir)).select(*KEYS)
S["flt_valid"] = "WITH " + _VAL + " SELECT doc_id, seq FROM validated WHERE is_valid AND quality_score >= 30"
Q["flt_valid_rejects"] = lambda spark, sf_dir: VA.rejected(_validated(spark, sf_dir)).select(*KEYS)
S["flt_valid_rejects"] = "WITH " + _VAL + " SELECT doc_id, seq FROM validated WHERE NOT (is_valid AND quality_score >= 30)"
for _name, _column, _call in (("x_val_date", "e1", lambda t: VA.date_errors(F.col("txn_date"), F.lit(AS_OF).cast("date"))), ("x_val_desc", "e2", lambda t: VA.description_errors(F.col("description"))), ("x_val_amt", "e3", lambda t: VA.amount_errors(F.col("amount")))):
    Q[_name] = lambda spark, sf_dir, call=_call: V.txns(spark, sf_dir).select(*KEYS, F.array_join(call(None), ",").alias("errors"))
    S[_name] = "WITH " + _VAL.replace("CASE WHEN seq % 13 <> 0 THEN txn_date END AS txn_date, CASE WHEN seq % 17 = 0 THEN NULL WHEN seq % 19 = 0 THEN 2000000.00 WHEN seq % 29 = 0 THEN 0.00 ELSE amount END AS amount", "txn_date AS txn_date") + f" SELECT doc_id, seq, array_to_string({_column}, ',') AS errors FROM errs"

# positions and counts are 32-bit in Spark
S["srt_date_nulls"] = V.ints(S["srt_date_nulls"], "place")

QUERIES, ORACLE_SQL = Q, S
