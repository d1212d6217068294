"""Categories, form lines and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import money, text
from ..operators import categorise as C
from ..operators import ledger as L
from . import views as V
from .reconcile_q import ORACLE_SQL as REC_SQL
from .reconcile_q import reconcile_cascade
from .scalar_q import NORMALIZED, esc

KEYS = ["doc_id", "seq"]
CATS = list(rules.CATEGORIES)
Q: dict = {}
S: dict[str, str] = {}

_rank = sorted(rules.CATEGORIES.items(), key=lambda kv: -len(kv[1]))
_KW = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{esc(w.lower())}')" for w in words) + f" THEN '{esc(c)}'" for c, words in _rank if words) + " END"
_LEARNED = "CASE " + " ".join(f"WHEN contains(t, '{esc(m)}') THEN '{esc(c)}'" for m, c in rules.LEARNED) + " END"
_JUNK = "regexp_matches(trim(description), '(?i)" + "|".join(f"(?:{p})" for p in rules.JUNK) + "')"
CAT = V.TXNS + f""", named AS (SELECT description, lower({NORMALIZED}) AS t, {_JUNK} AS junk FROM (SELECT DISTINCT description FROM txns)),
ruled AS (SELECT *, {_LEARNED} AS l, {_KW} AS k FROM named),
categorised AS (
  SELECT x.*, CASE WHEN junk THEN '{rules.DEFAULT_CATEGORY}' ELSE coalesce(l, k, '{rules.DEFAULT_CATEGORY}') END AS category, CASE WHEN junk THEN 'default' WHEN l IS NOT NULL THEN 'learned' WHEN k IS NOT NULL THEN 'keyword' ELSE 'default' END AS source
  FROM txns x JOIN ruled USING (description)
)"""  # fmt: skip


def categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.categorise(V.txns(spark, sf_dir))


def _c(sql: str) -> str:
    return "WITH " + CAT + " " + sql


Q["c_cascade"] = lambda spark, sf_dir: categorised(spark, sf_dir).select(*KEYS, "category", "source")
S["c_cascade"] = _c("SELECT doc_id, seq, category, source FROM categorised")
Q["jn_learned"] = lambda spark, sf_dir: V.txns(spark, sf_dir).select(*KEYS, C.learned_category(text.for_categories(F.col("description"))).alias("learned"))
S["jn_learned"] = _c("SELECT doc_id, seq, l AS learned FROM txns JOIN ruled USING (description)")
Q["jn_keyword"] = lambda spark, sf_dir: V.txns(spark, sf_dir).select(*KEYS, C.keyword_category(text.for_categories(F.col("description"))).alias("keyword_category"))
S["jn_keyword"] = _c("SELECT doc_id, seq, k AS keyword_category FROM txns JOIN ruled USING (description)")


def jn_keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c, i, w.lower(), j) for i, (c, words) in enumerate(_rank) for j, w in enumerate(sorted(words, key=len, reverse=True))]
    keywords = spark.createDataFrame(rows, "category string, cat_rank int, keyword string, kw_rank int")
    return C.keyword_join(V.txns(spark, sf_dir), keywords).select(*KEYS, "keyword_category")


Q["jn_keyword_table"] = jn_keyword_table
S["jn_keyword_table"] = S["jn_keyword"]


def _off_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a category that goes by their number, so that some are wrong."""
    return V.txns(spark, sf_dir).withColumn("category", F.element_at(F.array(*[F.lit(c) for c in CATS[:6]]), (F.col("seq") % 6 + 1).cast("int")))


_OFF = V.TXNS + ", off AS (SELECT *, [" + ", ".join(f"'{esc(c)}'" for c in CATS[:6]) + "][seq % 6 + 1] AS category, lower(description) AS d FROM txns)"


def flt_suspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _off_category(spark, sf_dir).where("description <> ''")
    wanted, why = C.suspect(F.col("description"), F.col("category"))
    return c.select(*KEYS, wanted.alias("suspected"), why.alias("reason")).where("suspected is not null")


_hit = lambda words: "(" + " OR ".join(f"contains(d, '{esc(w)}')" for w in words) + ")"
_GAS, _FOOD, _OFFICE = f"{_hit(rules.GAS_TOKENS)} AND category <> '{rules.TRAVEL}'", f"{_hit(rules.RESTAURANT_TOKENS)} AND category NOT IN ('{rules.MEALS}', '{rules.TRAVEL}')", f"{_hit(rules.OFFICE_TOKENS)} AND category <> '{rules.OFFICE}'"
Q["flt_suspect"] = flt_suspect
S["flt_suspect"] = "WITH " + _OFF + f" SELECT * FROM (SELECT doc_id, seq, CASE WHEN {_GAS} THEN '{rules.TRAVEL}' WHEN {_FOOD} THEN '{rules.MEALS}' WHEN {_OFFICE} THEN '{rules.OFFICE}' END AS suspected, CASE WHEN {_GAS} THEN 'gas-station name' WHEN {_FOOD} THEN 'restaurant name' WHEN {_OFFICE} THEN 'office-supply name' END AS reason FROM off WHERE description <> '') WHERE suspected IS NOT NULL"

# --- report aggregates
_dbl = lambda c: F.col(c).cast("double")
Q["agg_cat_summary"] = lambda spark, sf_dir: categorised(spark, sf_dir).groupBy("category").agg(F.count("amount").alias("n"), F.sum("amount").cast("double").alias("total"))
S["agg_cat_summary"] = _c("SELECT category, count(amount) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM categorised GROUP BY category")
Q["agg_cat_signed"] = lambda spark, sf_dir: categorised(spark, sf_dir).groupBy("doc_id", "category").agg(F.sum("amount").cast("double").alias("total"))
S["agg_cat_signed"] = _c("SELECT doc_id, category, CAST(sum(amount) AS DOUBLE) AS total FROM categorised GROUP BY ALL")


def form_lines(spark: SparkSession, sf_dir: str, signed: bool = False) -> DataFrame:
    """Sum of absolute (or signed) amounts on each form line, with the grand total."""
    lines = spark.createDataFrame(list(rules.FORM_LINES), "category string, line string")
    amount = F.col("amount") if signed else F.abs("amount")
    rows = categorised(spark, sf_dir).join(F.broadcast(lines), "category", "left").withColumn("line", F.coalesce("line", F.lit("other_business_expenses")))
    return rows.rollup("line").agg(F.sum(amount).cast("double").alias("amount")).withColumn("line", F.coalesce("line", F.lit("total_expenses")))


_LINES = "(VALUES " + ", ".join(f"('{esc(c)}', '{x}')" for c, x in rules.FORM_LINES) + ") AS f(category, line)"
_FORM = "SELECT coalesce(line, 'total_expenses') AS line, CAST(sum({a}) AS DOUBLE) AS amount FROM (SELECT coalesce(f.line, 'other_business_expenses') AS line, amount FROM categorised LEFT JOIN " + _LINES + " USING (category)) GROUP BY ROLLUP (line)"
Q["agg_schedule_c"] = form_lines
S["agg_schedule_c"] = _c(_FORM.format(a="abs(amount)"))
Q["agg_schedule_c_signed"] = lambda spark, sf_dir: form_lines(spark, sf_dir, signed=True)
S["agg_schedule_c_signed"] = _c(_FORM.format(a="amount"))
Q["jn_cat_line"] = lambda spark, sf_dir: categorised(spark, sf_dir).join(F.broadcast(spark.createDataFrame(list(rules.FORM_LINES), "category string, line string")), "category", "left").select(*KEYS, F.coalesce("line", F.lit("other_business_expenses")).alias("line"))
S["jn_cat_line"] = _c(f"SELECT doc_id, seq, coalesce(f.line, 'other_business_expenses') AS line FROM categorised LEFT JOIN {_LINES} USING (category)")


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form fields and their formatted values: line, then label, then field; the first field of a line wins."""
    labels = spark.createDataFrame(list(rules.LINE_LABELS), "line string, label string")
    fields = spark.createDataFrame([(i, *x) for i, x in enumerate(rules.FORM_FIELDS)], "rank int, label string, form_line string, field_pattern string")
    joined = form_lines(spark, sf_dir).join(F.broadcast(labels), "line").join(F.broadcast(fields), "label")
    best = joined.groupBy("line", "amount").agg(F.min_by(F.struct("form_line", "field_pattern"), "rank").alias("f"))
    return best.select("line", "f.form_line", "f.field_pattern", money.form_value(F.col("amount")).alias("shown"))


_LABELS = "(VALUES " + ", ".join(f"('{a}', '{esc(b)}')" for a, b in rules.LINE_LABELS) + ") AS l(line, label)"
_FIELDS = "(VALUES " + ", ".join(f"({i}, '{esc(a)}', '{b}', '{c}')" for i, (a, b, c) in enumerate(rules.FORM_FIELDS)) + ") AS g(rank, label, form_line, field_pattern)"
Q["jn_line_field"] = form_fields
S["jn_line_field"] = _c(f"SELECT t.line, arg_min(form_line, rank) AS form_line, arg_min(field_pattern, rank) AS field_pattern, format('{{:,.0f}}', round_even(t.amount, 0)) AS shown FROM ({_FORM.format(a='abs(amount)')}) t JOIN {_LABELS} ON l.line = t.line JOIN {_FIELDS} USING (label) GROUP BY t.line, t.amount")


def jn_field_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full field names that hold a pattern; the first of each pattern."""
    names = spark.createDataFrame([(i, f"topmostSubform[0].Page1[0].{x[2]}[{i % 2}]") for i, x in enumerate((*rules.FORM_FIELDS, *rules.FORM_FIELDS))], "pos int, name string")
    fields = spark.createDataFrame([x for x in rules.FORM_FIELDS], "label string, form_line string, field_pattern string")
    hit = fields.join(F.broadcast(names), F.contains("name", "field_pattern"))
    return hit.groupBy("label").agg(F.min_by("name", "pos").alias("name"))


Q["jn_field_sub"] = jn_field_sub
_NAMES = "(VALUES " + ", ".join(f"({i}, 'topmostSubform[0].Page1[0].{x[2]}[{i % 2}]')" for i, x in enumerate((*rules.FORM_FIELDS, *rules.FORM_FIELDS))) + ") AS n(pos, name)"
S["jn_field_sub"] = f"SELECT label, arg_min(name, pos) AS name FROM {_FIELDS} JOIN {_NAMES} ON contains(name, field_pattern) GROUP BY label"
Q["dq_shared_fields"] = lambda spark, sf_dir: spark.createDataFrame([x for x in rules.FORM_FIELDS], "label string, form_line string, field_pattern string").groupBy("field_pattern").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("form_line")), ",").alias("form_lines")).where("n > 1")
S["dq_shared_fields"] = f"SELECT field_pattern, count(*) AS n, string_agg(form_line, ',' ORDER BY form_line) AS form_lines FROM {_FIELDS} GROUP BY 1 HAVING count(*) > 1"


def srt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("form_line", r"^(\d+)", 1).cast("int")
    fields = spark.createDataFrame([x for x in rules.FORM_FIELDS], "label string, form_line string, field_pattern string")
    return fields.select("label", "form_line", F.row_number().over(W.orderBy(n, F.regexp_extract("form_line", r"([a-z]*)$", 1))).cast("long").alias("place"))


Q["srt_lines"] = srt_lines
S["srt_lines"] = f"SELECT label, form_line, row_number() OVER (ORDER BY CAST(regexp_extract(form_line, '^([0-9]+)', 1) AS INTEGER), regexp_extract(form_line, '([a-z]*)$', 1)) AS place FROM {_FIELDS}"
Q["agg_cat_dist"] = lambda spark, sf_dir: categorised(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")
S["agg_cat_dist"] = _c("SELECT category, count(*) AS n FROM categorised GROUP BY category")
Q["agg_cat_stats"] = lambda spark, sf_dir: categorised(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
S["agg_cat_stats"] = _c("SELECT source, count(*) AS n FROM categorised GROUP BY source")

def _bank() -> Column:
    return F.element_at(F.array(*[F.lit(p.bank) for p in rules.PROFILES]), (F.col("doc_id") % 5 + 1).cast("int"))



_BANKS = "[" + ", ".join(f"'{p.bank}'" for p in rules.PROFILES) + "][doc_id % 5 + 1]"
_BY_BANK = "SELECT {cols} FROM (SELECT *, " + _BANKS + " AS bank FROM (" + REC_SQL["reconcile_cascade"] + "))"


def agg_eval_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = reconcile_cascade(spark, sf_dir).withColumn("bank", _bank())
    return v.rollup("bank").agg(F.count("*").alias("stmts"), F.round(100.0 * F.avg(F.col("reconciled").cast("int")), 4).alias("recon_pct"), F.round(F.avg(F.abs("discrepancy")), 6).alias("mean_disc"), F.round(F.avg("n_rows"), 6).alias("avg_rows"), F.sum((F.col("check_type") == "none").cast("int")).alias("errors"))


Q["agg_eval_bank"] = agg_eval_bank
S["agg_eval_bank"] = _BY_BANK.format(cols="bank, count(*) AS stmts, round(100.0 * avg(reconciled::INT), 4) AS recon_pct, round(avg(abs(discrepancy)), 6) AS mean_disc, round(avg(n_rows), 6) AS avg_rows, CAST(sum((check_type = 'none')::INT) AS BIGINT) AS errors") + " GROUP BY ROLLUP (bank)"
_wrong = lambda: ~F.col("reconciled") & ~F.col("check_type").isin("none", "ending_balance_only")
Q["agg_eval_error"] = lambda spark, sf_dir: reconcile_cascade(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.col("reconciled").cast("int")).alias("reconciled"), F.sum(F.col("check_type").isin("none", "ending_balance_only").cast("int")).alias("unverifiable"), F.sum(_wrong().cast("int")).alias("wrong"))
S["agg_eval_error"] = "SELECT count(*) AS n, CAST(sum(reconciled::INT) AS BIGINT) AS reconciled, CAST(sum((check_type IN ('none', 'ending_balance_only'))::INT) AS BIGINT) AS unverifiable, CAST(sum((NOT reconciled AND check_type NOT IN ('none', 'ending_balance_only'))::INT) AS BIGINT) AS wrong FROM (" + REC_SQL["reconcile_cascade"] + ")"
Q["agg_check_types"] = lambda spark, sf_dir: reconcile_cascade(spark, sf_dir).groupBy("check_type").agg(F.count("*").alias("n"))
S["agg_check_types"] = "SELECT check_type, count(*) AS n FROM (" + REC_SQL["reconcile_cascade"] + ") GROUP BY 1"


def agg_parser_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = reconcile_cascade(spark, sf_dir).withColumn("parser", _bank())
    return v.groupBy("parser").agg(F.sum((F.col("n_rows") > 45).cast("int")).alias("can_parse"), F.sum(F.col("reconciled").cast("int")).alias("success"), F.sum("n_rows").alias("total"), F.sum((F.col("check_type") == "none").cast("int")).alias("errors"))


Q["agg_parser_stats"] = agg_parser_stats
S["agg_parser_stats"] = _BY_BANK.format(cols="bank AS parser, CAST(sum((n_rows > 45)::INT) AS BIGINT) AS can_parse, CAST(sum(reconciled::INT) AS BIGINT) AS success, CAST(sum(n_rows) AS BIGINT) AS total, CAST(sum((check_type = 'none')::INT) AS BIGINT) AS errors") + " GROUP BY bank"


def agg_error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents of each check type that failed, and how many more there are."""
    v = reconcile_cascade(spark, sf_dir).where("not reconciled")
    rn = F.row_number().over(W.partitionBy("check_type").orderBy("doc_id"))
    few = v.withColumn("rn", rn).groupBy("check_type").agg(F.sort_array(F.collect_list(F.when(F.col("rn") <= 10, F.col("doc_id")))).alias("ids"), F.count("*").alias("n"))
    return few.select("check_type", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("docs"), F.greatest(F.col("n") - 10, F.lit(0)).alias("more"))


Q["agg_error_groups"] = agg_error_groups
S["agg_error_groups"] = "SELECT check_type, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE rn <= 10) AS docs, greatest(count(*) - 10, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY check_type ORDER BY doc_id) AS rn FROM (" + REC_SQL["reconcile_cascade"] + ") WHERE NOT reconciled) GROUP BY check_type"

# --- event statistics
_events = lambda spark, sf_dir: V.read(spark, sf_dir, "events")
Q["agg_time_stats"] = lambda spark, sf_dir: _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
S["agg_time_stats"] = "SELECT event_type, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1"
Q["agg_perf_stats"] = lambda spark, sf_dir: _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_time"), F.round(F.avg((F.col("user_id") % 2 == 0).cast("int")), 6).alias("success_rate"), F.count("*").alias("n"))
S["agg_perf_stats"] = "SELECT event_type, round(avg(value), 6) AS mean_time, round(avg((user_id % 2 = 0)::INT), 6) AS success_rate, count(*) AS n FROM events GROUP BY 1"


def agg_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent description of each document, the first one by text on ties."""
    n = V.txns(spark, sf_dir).groupBy("doc_id", "description").agg(F.count("*").alias("n"))
    w = W.partitionBy("doc_id").orderBy(F.desc("n"), "description")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("doc_id", "description", "n")


Q["agg_mode"] = agg_mode
S["agg_mode"] = "WITH " + V.TXNS + " SELECT doc_id, description, n FROM (SELECT doc_id, description, count(*) AS n FROM txns GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, description) = 1"
Q["agg_argmax"] = lambda spark, sf_dir: V.txns(spark, sf_dir).groupBy("doc_id").agg(F.max_by("seq", F.struct("amount", -F.col("seq"))).alias("seq"), F.max("amount").cast("double").alias("amount"))
S["agg_argmax"] = "WITH " + V.TXNS + " SELECT doc_id, seq, CAST(amount AS DOUBLE) AS amount FROM txns QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY amount DESC, seq) = 1"
Q["agg_median_std"] = lambda spark, sf_dir: _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop("value"), 6).alias("std"))
S["agg_median_std"] = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1"


def agg_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.concat_ws("-", "event_type", F.col("user_id") % 10).alias("fingerprint"), F.col("ts").alias("seen_at"), "event_id")
    old = e.where("event_id % 3 = 0").groupBy("fingerprint").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("seen_count"))
    out = L.upsert_formats(old, e.where("event_id % 3 <> 0").select("fingerprint", "seen_at"))
    return out.select("fingerprint", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "seen_count")


Q["agg_upsert"] = agg_upsert
S["agg_upsert"] = "SELECT event_type || '-' || user_id % 10 AS fingerprint, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS seen_count FROM events GROUP BY 1"


def agg_unknown_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, the first five samples and the set of stages of each key."""
    e = _events(spark, sf_dir)
    rn = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    few = e.withColumn("rn", rn).groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("rn") <= 5, F.col("event_id")))).alias("ids"), F.sort_array(F.collect_set("event_type")).alias("stages"))
    return few.select("user_id", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("samples"), F.array_join("stages", ",").alias("stages"))


Q["agg_unknown_log"] = agg_unknown_log
S["agg_unknown_log"] = "SELECT user_id, count(*) AS n, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (WHERE rn <= 5) AS samples, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS stages FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id"
Q["agg_pattern_count"] = lambda spark, sf_dir: V.txns(spark, sf_dir).groupBy("description").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("account")), "|").alias("accounts"))
S["agg_pattern_count"] = "WITH " + V.TXNS + " SELECT description, count(*) AS n, string_agg(DISTINCT account, '|' ORDER BY account) AS accounts FROM txns GROUP BY 1"

# --- learning and editing
def c_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = categorised(spark, sf_dir).where("description <> ''").select(F.lower("description").alias("merchant"), "category", F.col("seq").alias("ts"))
    return C.learn(t.where("ts % 2 = 0"), t.where("ts % 2 = 1").withColumn("category", F.lit("Utilities")))


Q["c_learn"] = c_learn
S["c_learn"] = _c("SELECT merchant, arg_max(category, ts) AS category, max(ts) AS ts FROM (SELECT lower(description) AS merchant, CASE WHEN seq % 2 = 0 THEN category ELSE 'Utilities' END AS category, seq AS ts FROM categorised WHERE description <> '') GROUP BY 1")
Q["c_apply"] = lambda spark, sf_dir: C.apply_learned(categorised(spark, sf_dir), "hotel", "Rent").select(*KEYS, "category")
S["c_apply"] = _c("SELECT doc_id, seq, CASE WHEN contains(lower(description), 'hotel') THEN 'Rent' ELSE category END AS category FROM categorised")
Q["c_edit"] = lambda spark, sf_dir: C.rename_category(categorised(spark, sf_dir), "Utilities", "Bills").select(*KEYS, "category")
S["c_edit"] = _c("SELECT doc_id, seq, CASE WHEN category = 'Utilities' THEN 'Bills' ELSE category END AS category FROM categorised")
Q["c_batch_ai"] = lambda spark, sf_dir: C.batch_proposals(V.txns(spark, sf_dir).select(*KEYS, "description", F.col("amount").cast("double")), lambda rows: [CATS[len(d) % 5] for d, _ in rows]).select(*KEYS, "proposed")
Q["jn_fuzzy_cat"] = lambda spark, sf_dir: C.fuzzy_names(V.txns(spark, sf_dir).select(*KEYS, F.when(F.col("seq") % 4 == 0, "office expenses").when(F.col("seq") % 4 == 1, "Insurance ").when(F.col("seq") % 4 == 2, "utilitie").otherwise("zzz").alias("said")), "said", CATS, "category").select(*KEYS, "category")
Q["jn_fuzzy_merchant"] = lambda spark, sf_dir: C.fuzzy_names(V.txns(spark, sf_dir), "description", ["Verizon Wireless", "Starbucks", "Payment Thank You"], "merchant", 0.6).select(*KEYS, "merchant")
Q["jn_fuzzy_vendor"] = lambda spark, sf_dir: C.fuzzy_names(V.txns(spark, sf_dir).select(*KEYS, text.vendor(F.col("description")).alias("v")), "v", ["Zelle Payment To Jones", "Qt 442 Fuel", "Office Depot"], "vendor", 0.8).select(*KEYS, "vendor")

QUERIES, ORACLE_SQL = Q, S
