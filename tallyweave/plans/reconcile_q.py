"""Reconciliation queries: totals, sums, chain, verdicts, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..operators import reconcile as R
from . import views as V


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def rec_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(R.sums(V.txns(spark, sf_dir)), "charges", "credits", "net")


def rec_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(R.chain(V.balanced(spark, sf_dir)), "drift")


def reconcile_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a verdict for every document by the first strategy that its totals allow."""
    return _doubles(R.reconcile(V.balanced(spark, sf_dir), V.stated(spark, sf_dir)), "discrepancy", "expected_total", "actual_total")


def _strategy(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reconcile_cascade(spark, sf_dir).where(F.col("check_type") == name)

    return run


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed rows: most of the found ones with the sign turned, and some of another amount."""
    t = V.txns(spark, sf_dir).where("seq % 5 <> 0")
    return t.select("doc_id", "seq", "description", F.when(F.col("seq") % 11 == 0, F.col("amount") + F.lit("500.00").cast("decimal(18,2)")).otherwise(-F.col("amount")).cast("decimal(18,2)").alias("amount"))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.balanced(spark, sf_dir).where("seq % 3 <> 0")


def rec_repair_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(R.repair_diff(_found(spark, sf_dir), _proposed(spark, sf_dir)).select("doc_id", "seq", "amount"), "amount")


def rec_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    added = R.repair_diff(found, _proposed(spark, sf_dir)).select("doc_id", "seq", "description", "amount")
    return _doubles(R.with_repair(found, added, V.stated(spark, sf_dir)).select("doc_id", "check_type", "n_rows", "actual_total"), "actual_total")


def rec_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, said, totals = _found(spark, sf_dir), _proposed(spark, sf_dir), V.stated(spark, sf_dir)
    added = R.repair_diff(found, said).select("doc_id", "seq", "description", "amount")
    return R.finalize(R.reconcile(found, totals), R.with_repair(found, added, totals), added, said).select("doc_id", "method", "n_added")


def rec_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubles(R.stated_totals(V.texts(spark, sf_dir)), *rules.TOTAL_FIELDS)


def rec_label_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.lines_of(V.texts(spark, sf_dir))
    hit = lines.withColumn("value", R.after_label(F.trim("line"), F.lit("new balance"))).where("value is not null")
    return hit.groupBy("doc_id").agg(F.min_by("value", "pos").cast("double").alias("value"))


_SUMS = """, sums AS (
  SELECT doc_id, coalesce(sum(amount) FILTER (WHERE amount > 0), 0) AS charges, coalesce(sum(amount) FILTER (WHERE amount < 0), 0) AS credits, coalesce(sum(amount), 0) AS net, count(*) AS n_rows FROM {rows} GROUP BY doc_id
)"""
_CHAIN = """, links AS (
  SELECT *, lag(running_balance) OVER (PARTITION BY doc_id, coalesce(account, '') ORDER BY page, line_top, seq) AS before FROM {rows} WHERE running_balance IS NOT NULL
), chain AS (
  SELECT doc_id, sum(CASE WHEN abs(before + amount - running_balance) > 0.01 THEN 0 ELSE 1 END) AS matched_rows, count(*) AS checked_rows,
    coalesce(sum(abs(before + amount - running_balance)) FILTER (WHERE abs(before + amount - running_balance) > 0.01), 0) AS drift,
    min(seq) FILTER (WHERE abs(before + amount - running_balance) > 0.01) AS first_break
  FROM links WHERE before IS NOT NULL GROUP BY doc_id
)"""
_VERDICT = """, pre AS (
  SELECT s.*, coalesce(u.charges, 0) AS up, abs(coalesce(u.credits, 0)) AS down, coalesce(u.n_rows, 0) AS n_rows, c.matched_rows, c.checked_rows, c.drift
  FROM stated s LEFT JOIN sums u USING (doc_id) LEFT JOIN chain c USING (doc_id)
), verdict AS (
  SELECT doc_id, n_rows,
    CASE WHEN charges IS NOT NULL THEN 'charges_total' WHEN deposits IS NOT NULL OR withdrawals IS NOT NULL THEN 'deposits_withdrawals' WHEN new_balance IS NOT NULL AND previous_balance IS NOT NULL THEN 'balance_equation' WHEN checked_rows > 0 THEN 'running_balance_chain' WHEN ending_balance IS NOT NULL THEN 'ending_balance_only' ELSE 'none' END AS check_type,
    CASE WHEN charges IS NOT NULL THEN up - charges WHEN deposits IS NOT NULL OR withdrawals IS NOT NULL THEN coalesce(abs(up - abs(deposits)), 0) + coalesce(abs(down - abs(withdrawals)), 0) WHEN new_balance IS NOT NULL AND previous_balance IS NOT NULL THEN up - down - (new_balance - previous_balance - coalesce(interest, 0) - coalesce(fees, 0)) WHEN checked_rows > 0 THEN drift ELSE 0 END AS discrepancy,
    CASE WHEN charges IS NOT NULL THEN charges WHEN deposits IS NOT NULL OR withdrawals IS NOT NULL THEN abs(deposits) WHEN new_balance IS NOT NULL AND previous_balance IS NOT NULL THEN new_balance - previous_balance - coalesce(interest, 0) - coalesce(fees, 0) WHEN checked_rows > 0 THEN matched_rows ELSE ending_balance END AS expected_total,
    CASE WHEN charges IS NOT NULL OR deposits IS NOT NULL OR withdrawals IS NOT NULL THEN up WHEN new_balance IS NOT NULL AND previous_balance IS NOT NULL THEN up - down WHEN checked_rows > 0 THEN checked_rows ELSE up - down END AS actual_total,
    matched_rows, checked_rows
  FROM pre
), verdicts AS (
  SELECT doc_id, check_type, CASE check_type WHEN 'running_balance_chain' THEN matched_rows = checked_rows WHEN 'ending_balance_only' THEN false WHEN 'none' THEN false ELSE abs(discrepancy) <= 0.01 END AS reconciled,
    CAST(discrepancy AS DOUBLE) AS discrepancy, CAST(expected_total AS DOUBLE) AS expected_total, CAST(actual_total AS DOUBLE) AS actual_total,
    CASE check_type WHEN 'charges_total' THEN CASE WHEN abs(discrepancy) <= 0.01 THEN 95.0 ELSE 40.0 END WHEN 'deposits_withdrawals' THEN CASE WHEN abs(discrepancy) <= 0.01 THEN 95.0 ELSE 40.0 END WHEN 'balance_equation' THEN CASE WHEN abs(discrepancy) <= 0.01 THEN 85.0 ELSE 35.0 END
      WHEN 'running_balance_chain' THEN CASE WHEN matched_rows = checked_rows THEN 95.0 WHEN matched_rows > 0 THEN 50.0 ELSE 30.0 END WHEN 'ending_balance_only' THEN 20.0 ELSE 0.0 END::DOUBLE AS confidence, n_rows
  FROM verdict
)"""
_CASCADE = "WITH " + V.BALANCED + V.STATED + _SUMS.format(rows="balanced") + _CHAIN.format(rows="balanced") + _VERDICT
_REPAIR = """, found AS (SELECT * FROM balanced WHERE seq % 3 <> 0), proposed AS (
  SELECT doc_id, seq, CASE WHEN seq % 11 = 0 THEN amount + 500.00 ELSE -amount END AS amount FROM txns WHERE seq % 5 <> 0
), have AS (SELECT doc_id, abs(amount) AS c, count(*) AS n FROM found GROUP BY ALL), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, abs(amount) ORDER BY seq) AS rn FROM proposed
), added AS (SELECT r.doc_id, r.seq, r.amount FROM ranked r LEFT JOIN have h ON h.doc_id = r.doc_id AND h.c = abs(r.amount) WHERE r.rn > coalesce(h.n, 0))"""
_AFTER = _REPAIR + """, joined AS (
  SELECT doc_id, seq, amount, page, line_top, account, running_balance FROM found UNION ALL SELECT doc_id, seq, amount, NULL, NULL, NULL, NULL FROM added
)"""

QUERIES = {
    "reconcile_cascade": reconcile_cascade, "rec_sums": rec_sums, "rec_chain": rec_chain, "rec_repair_diff": rec_repair_diff, "rec_merge": rec_merge,
    "rec_finalize": rec_finalize, "rec_totals": rec_totals, "rec_label_amount": rec_label_amount,
} | {f"rec_{short}": _strategy(name) for short, name in (("charges", "charges_total"), ("depwd", "deposits_withdrawals"), ("balance_eq", "balance_equation"), ("ending_only", "ending_balance_only"), ("none", "none"))}

_LABELS = sorted(enumerate(rules.TOTAL_LABELS), key=lambda x: (-len(x[1][0]), x[0]))
_VALUE = "TRY_CAST(CASE WHEN {m} LIKE '-%' THEN '-' ELSE '' END || trim(regexp_replace(ltrim(ltrim({m}, '+'), '-'), '[$,=+]', '', 'g')) AS DECIMAL(18,2))"
_MONEY = rules.MONEY_ON_LINE.replace("'", "''")


def _after_label(label: str, line: str = "trim(line)") -> str:
    tail = f"regexp_extract(substr({line}, strpos(lower({line}), '{label}') + {len(label)}), '{_MONEY}')"
    first = f"regexp_extract({line}, '{_MONEY}')"
    picked = f"coalesce(nullif({tail}, ''), {first})"
    return f"CASE WHEN strpos(lower({line}), '{label}') > 0 AND NOT regexp_matches({line}, '{rules.YEAR_TO_DATE}') THEN {_VALUE.format(m='(' + picked + ')')} END"


_TOTALS = ", found AS (" + " UNION ALL ".join(f"SELECT doc_id, pos, '{name}' AS field, {rank} AS rank, {_after_label(label)} AS value FROM text_lines" for rank, (_, (label, name)) in enumerate(_LABELS)) + ")"
ORACLE_SQL = {
    "reconcile_cascade": _CASCADE + " SELECT * FROM verdicts",
    "rec_sums": "WITH " + V.TXNS + _SUMS.format(rows="txns") + " SELECT doc_id, CAST(charges AS DOUBLE) AS charges, CAST(credits AS DOUBLE) AS credits, CAST(net AS DOUBLE) AS net, n_rows FROM sums",
    "rec_chain": "WITH " + V.BALANCED + _CHAIN.format(rows="balanced") + " SELECT doc_id, CAST(matched_rows AS BIGINT) AS matched_rows, checked_rows, CAST(drift AS DOUBLE) AS drift, first_break FROM chain",
    "rec_repair_diff": "WITH " + V.BALANCED + _REPAIR + " SELECT doc_id, seq, CAST(amount AS DOUBLE) AS amount FROM added",
    "rec_merge": "WITH " + V.BALANCED + V.STATED + _AFTER + _SUMS.format(rows="joined") + _CHAIN.format(rows="joined") + _VERDICT + " SELECT doc_id, check_type, n_rows, actual_total FROM verdicts",
    "rec_totals": "WITH " + V.TEXTS + _TOTALS + ", best AS (SELECT doc_id, field, CAST(arg_min(value, rank * 1000000 + pos) AS DOUBLE) AS value FROM found WHERE value IS NOT NULL GROUP BY ALL) SELECT t.doc_id, " + ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {f}" for f in rules.TOTAL_FIELDS) + " FROM texts t LEFT JOIN best USING (doc_id) GROUP BY t.doc_id",
    "rec_label_amount": "WITH " + V.TEXTS + f", v AS (SELECT doc_id, pos, {_after_label('new balance')} AS value FROM text_lines) SELECT doc_id, CAST(arg_min(value, pos) AS DOUBLE) AS value FROM v WHERE value IS NOT NULL GROUP BY doc_id",
} | {f"rec_{short}": _CASCADE + f" SELECT * FROM verdicts WHERE check_type = '{name}'" for short, name in (("charges", "charges_total"), ("depwd", "deposits_withdrawals"), ("balance_eq", "balance_equation"), ("ending_only", "ending_balance_only"), ("none", "none"))}
_V1 = _SUMS.format(rows="found").replace("sums AS", "sums_b AS"), _CHAIN.format(rows="found").replace("links AS", "links_b AS").replace("chain AS", "chain_b AS").replace("FROM links", "FROM links_b")
ORACLE_SQL["rec_finalize"] = (
    "WITH " + V.BALANCED + V.STATED + _AFTER + "".join(_V1) + _VERDICT.replace("pre AS", "pre_b AS").replace("FROM pre", "FROM pre_b").replace("verdict AS", "verdict_b AS").replace("verdicts AS", "verdicts_b AS").replace("FROM verdict\n", "FROM verdict_b\n").replace("sums u", "sums_b u").replace("chain c", "chain_b c")
    + _SUMS.format(rows="joined") + _CHAIN.format(rows="joined") + _VERDICT
    + """, n_add AS (SELECT doc_id, count(*) AS n FROM added GROUP BY doc_id), n_prop AS (SELECT doc_id, count(*) AS n FROM proposed GROUP BY doc_id)
SELECT b.doc_id, CASE WHEN b.reconciled THEN 'geometry' WHEN coalesce(n_add.n, 0) > 0 AND a.reconciled AND b.n_rows > 0 THEN 'geometry+ai_repair' WHEN b.n_rows = 0 AND coalesce(n_prop.n, 0) > 0 THEN 'ai_only' WHEN b.n_rows > 0 THEN 'geometry_unverified' ELSE 'failed' END AS method, coalesce(n_add.n, 0) AS n_added
FROM verdicts_b b LEFT JOIN verdicts a USING (doc_id) LEFT JOIN n_add USING (doc_id) LEFT JOIN n_prop USING (doc_id)"""
)
