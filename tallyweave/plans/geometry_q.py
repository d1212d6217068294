"""Geometry queries over words with coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import features
from ..operators import geometry as G
from ..sources import ocr
from . import views as V

Q: dict = {}
S: dict[str, str] = {}
PAGE = ["doc_id", "page"]
_W = "WITH " + V.WORDS


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.words(spark, sf_dir)


# words of a line lie within two points of its top, and lines are twelve apart
_PLAIN = _W + " SELECT doc_id, page, word_id, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY true_line) AS line FROM words"
for _name, _op in (("geo_lines", G.lines), ("geo_lines_mean", lambda w: G.lines(w, 2.0, mean=True)), ("geo_lines_dbscan", G.lines_by_gap), ("geo_lines_bucket", G.lines_by_bucket)):
    Q[_name] = lambda spark, sf_dir, op=_op: op(_words(spark, sf_dir)).select(*PAGE, "word_id", F.col("line").cast("long"))
    S[_name] = _PLAIN


def geo_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words cut into characters and merged again."""
    w = _words(spark, sf_dir).where(F.col("text").startswith("ITEM"))
    chars = w.select(*PAGE, F.col("true_line").alias("line"), F.posexplode(F.split("text", "")).alias("i", "char"))
    return G.tokens(chars.select(*PAGE, "line", "char", (F.col("i") * 5.0).alias("x0"), (F.col("i") * 5.0 + 4).alias("x1"))).select(*PAGE, "line", "token", "text", "x0", "x1")


Q["geo_tokens"] = geo_tokens
S["geo_tokens"] = _W + " SELECT doc_id, page, true_line AS line, CAST(1 AS BIGINT) AS token, text, 0.0::DOUBLE AS x0, length(text) * 5.0 - 1 AS x1 FROM words WHERE starts_with(text, 'ITEM')"
_AMT = ", amounts AS (SELECT * FROM words WHERE regexp_matches(regexp_replace(translate(text, '$,()', ''), '^-+|-+$', '', 'g'), '^[0-9]+\\.[0-9]{1,2}$'))"
_CLU = _AMT + ", clusters AS (SELECT doc_id, page, round_even(x1 / 5, 0) * 5 AS bucket, avg(x1) AS center, count(*) AS n FROM amounts GROUP BY ALL), shares AS (SELECT *, max(n) OVER (PARTITION BY doc_id, page) AS top_n FROM clusters), big AS (SELECT * FROM shares WHERE n >= greatest(2, floor(top_n * 0.15)))"
_TWO = _CLU + ", two AS (SELECT * FROM big QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY {order}) <= 2), plan AS (SELECT doc_id, page, min(center) AS amount_x1, CASE WHEN count(*) > 1 THEN max(center) END AS balance_x1, CASE WHEN count(*) > 1 THEN 'multi-col' ELSE 'mode' END AS method FROM two GROUP BY ALL)"
_r = lambda df, *names: df.withColumns({n: F.round(n, 6) for n in names})
Q["geo_columns"] = lambda spark, sf_dir: _r(G.columns(_words(spark, sf_dir)), "amount_x1", "balance_x1")
S["geo_columns"] = _W + _TWO.replace("{order}", "n DESC, center") + " SELECT doc_id, page, round(amount_x1, 6) AS amount_x1, round(balance_x1, 6) AS balance_x1, method FROM plan"
Q["geo_columns_pos"] = lambda spark, sf_dir: _r(G.rightmost_columns(_words(spark, sf_dir)), "amount_x1", "balance_x1")
S["geo_columns_pos"] = _W + _TWO.replace("{order}", "center DESC") + " SELECT doc_id, page, round(amount_x1, 6) AS amount_x1, round(balance_x1, 6) AS balance_x1 FROM plan"
Q["win_cluster_share"] = lambda spark, sf_dir: G.clusters(_words(spark, sf_dir)).select(*PAGE, "bucket", "n", F.round("share", 6).alias("share"))
S["win_cluster_share"] = _W + _CLU + " SELECT doc_id, page, bucket, n, round(n / top_n, 6) AS share FROM shares"


def geo_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    return w.join(G.columns(w), PAGE).select(*PAGE, "word_id", G.classify(F.col("x1"), F.col("amount_x1"), F.col("balance_x1")).alias("kind"))


Q["geo_classify"] = geo_classify
_KIND = "CASE WHEN abs(x1 - amount_x1) <= 4 THEN 'amount' WHEN abs(x1 - balance_x1) <= 4 THEN 'balance' ELSE 'other' END"
S["geo_classify"] = _W + _TWO.replace("{order}", "n DESC, center") + f" SELECT doc_id, page, word_id, {_KIND} AS kind FROM words JOIN plan USING (doc_id, page)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = G.lines(_words(spark, sf_dir))
    return G.raw_rows(w, G.columns(w))


_ROW = _W + _TWO.replace("{order}", "n DESC, center") + f""", kinds AS (SELECT w.*, {_KIND} AS kind, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY true_line) AS line FROM words w JOIN plan USING (doc_id, page)), rows AS (
  SELECT doc_id, page, line, max(text) FILTER (WHERE word_id % 4 = 0) AS date_raw, max(text) FILTER (WHERE word_id % 4 = 1) AS description, CAST(replace(max(text) FILTER (WHERE kind = 'amount' AND word_id % 4 >= 2), ',', '') AS DOUBLE) AS amount, CAST(replace(max(text) FILTER (WHERE kind = 'balance' AND word_id % 4 >= 2), ',', '') AS DOUBLE) AS running_balance,
    count(*) FILTER (WHERE kind = 'amount' AND word_id % 4 >= 2) AS n
  FROM kinds GROUP BY ALL
)"""


def geo_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of all documents, from words alone."""
    r = _rows(spark, sf_dir)
    return r.select(*PAGE, F.col("line").cast("long"), "date_raw", "description", F.col("amount").cast("double"), F.col("running_balance").cast("double"))


Q["geo_doc"] = geo_doc
S["geo_doc"] = _ROW + " SELECT doc_id, page, line, date_raw, description, amount, running_balance FROM rows WHERE n = 1"
for _name, _column in (("geo_amount_pick", "amount"), ("geo_balance", "running_balance"), ("geo_desc", "description"), ("geo_date_fallback", "date_raw")):
    Q[_name] = lambda spark, sf_dir, c=_column: geo_doc(spark, sf_dir).select(*PAGE, "line", c)
    S[_name] = _ROW + f" SELECT doc_id, page, line, {_column} FROM rows WHERE n = 1"


def flt_multi_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of order 1 modulo 3 get their amount twice, so they give no row."""
    w = _words(spark, sf_dir)
    more = w.where((F.col("word_id") % 4 == 2) & (F.col("doc_id") % 3 == 1)).withColumn("word_id", F.col("word_id") + 100_000).withColumn("x0", F.col("x0") + 1)
    lined = G.lines(w.unionByName(more))
    return G.raw_rows(lined, G.columns(w)).select(*PAGE, F.col("line").cast("long"))


Q["flt_multi_amount"] = flt_multi_amount
S["flt_multi_amount"] = _ROW + " SELECT doc_id, page, line FROM rows WHERE n = 1 AND doc_id % 3 <> 1"
Q["flt_no_merchant"] = lambda spark, sf_dir: G.raw_rows(w := G.lines(_words(spark, sf_dir).withColumn("text", F.when((F.col("word_id") % 4 == 1) & (F.col("doc_id") % 3 == 1), "12.00").otherwise(F.col("text")))), G.columns(_words(spark, sf_dir))).select(*PAGE, F.col("line").cast("long"))
S["flt_no_merchant"] = S["flt_multi_amount"]


def geo_sign_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.txns(spark, sf_dir)
    return t.select("doc_id", "seq", G.signed_card(F.abs("amount"), F.col("description")).cast("double").alias("amount"))


Q["geo_sign_card"] = geo_sign_card
S["geo_sign_card"] = "WITH " + V.TXNS + " SELECT doc_id, seq, CAST(CASE WHEN " + " OR ".join(f"contains(upper(description), '{m}')" for m in rules.PAYMENT_MARKERS) + " THEN -abs(amount) ELSE abs(amount) END AS DOUBLE) AS amount FROM txns"


def geo_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account headers found in line texts, carried down the page."""
    t = V.txns(spark, sf_dir).withColumn("text", F.when(F.col("seq") % 10 == 0, F.concat(F.lit("Flagship Checking - 71454"), F.col("seq"))).otherwise(F.col("description")))
    w = W.partitionBy(*PAGE).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return t.withColumn("h", G.account_header(F.col("text"))).withColumn("account", F.last("h", ignorenulls=True).over(w)).where("h is null").select("doc_id", "page", "seq", "account")


Q["geo_account"] = geo_account
S["geo_account"] = "WITH " + V.TXNS + " SELECT doc_id, page, seq, account FROM (SELECT doc_id, page, seq, last_value(CASE WHEN seq % 10 = 0 THEN 'Flagship Checking - 71454' || seq END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY seq ROWS UNBOUNDED PRECEDING) AS account FROM txns) WHERE seq % 10 <> 0"


def geo_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile that fits only even orders; the other pages use their own columns."""
    w = G.lines(_words(spark, sf_dir))
    auto = G.columns(w)
    wrong = auto.withColumn("amount_x1", F.when(F.col("doc_id") % 2 == 0, F.col("amount_x1")).otherwise(F.lit(300.0)))
    return G.with_fallback(w, wrong, auto).groupBy(*PAGE).agg(F.count("*").alias("n_rows"))


Q["geo_fallback"] = geo_fallback
S["geo_fallback"] = _ROW + " SELECT doc_id, page, count(*) AS n_rows FROM rows WHERE n = 1 GROUP BY ALL"
_X1 = _AMT + ", n AS (SELECT doc_id, round_even(x1, 0) AS x1, count(*) AS n FROM amounts WHERE page <= 6 GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM n), edges AS (SELECT doc_id, x1, CAST(total AS BIGINT) AS n_amounts FROM t WHERE total >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n / total * n DESC, x1) = 1)"
Q["geo_detect_x1"] = lambda spark, sf_dir: G.detected_x1(_words(spark, sf_dir))
S["geo_detect_x1"] = _W + _X1 + " SELECT doc_id, x1, n_amounts FROM edges"
Q["geo_layout_match"] = lambda spark, sf_dir: G.nearest_profile(G.detected_x1(_words(spark, sf_dir)))
_PROF = "(VALUES " + ", ".join(f"('{p.bank}', {p.amount_x1}::DOUBLE)" for p in rules.PROFILES) + ") AS p(bank, px)"
S["geo_layout_match"] = _W + _X1 + f" SELECT doc_id, bank, abs(x1 - px) AS distance FROM edges, {_PROF} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(x1 - px), bank) = 1"
Q["jn_nearest"], S["jn_nearest"] = Q["geo_layout_match"], S["geo_layout_match"]
Q["geo_densest_page"] = lambda spark, sf_dir: G.densest_page(_words(spark, sf_dir))
S["geo_densest_page"] = _W + _AMT + " SELECT doc_id, page, n FROM (SELECT doc_id, page, count(*) AS n FROM amounts GROUP BY ALL HAVING count(*) >= 3) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, page) = 1"
Q["top_columns"], S["top_columns"] = Q["geo_columns"], S["geo_columns"]


def geo_profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("Chase",), ("CHASE",), ("citi",), ("Navy Federal Credit Union",), ("nobody",)], "bank string")
    return names.select("bank", G.lookup_profile(F.col("bank")).alias("profile"))


Q["geo_profile_lookup"] = geo_profile_lookup
S["geo_profile_lookup"] = "SELECT b AS bank, p AS profile FROM (VALUES ('Chase', 'Chase'), ('CHASE', 'Chase'), ('citi', 'Citibank'), ('Navy Federal Credit Union', 'Navy Federal'), ('nobody', NULL)) AS v(b, p)"


def geo_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document: those with a date lead, the others continue them."""
    t = V.txns(spark, sf_dir)
    lines = t.select(*PAGE, F.col("seq").alias("line"), F.when(F.col("seq") % 2 == 0, F.concat(F.date_format("txn_date", "MM/dd"), F.lit(" shop 1.00"))).otherwise(F.lit("continued text")).alias("text"), F.lit(30.0).alias("x0"), F.lit(0.0).alias("top"))
    return G.continuations(lines).select(*PAGE, "line", F.col("line_group").cast("long"))


Q["geo_continuation"] = geo_continuation
S["geo_continuation"] = "WITH " + V.TXNS + " SELECT doc_id, page, seq AS line, CAST(sum(CASE WHEN seq % 2 = 0 OR first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY seq) AS BIGINT) AS line_group FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) = 1 AS first FROM txns)"


def x_ml_feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = _words(spark, sf_dir).groupBy(*PAGE, F.col("true_line").alias("line")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    f = features.row_features(lined)
    return f.select(*PAGE, "line", "looks_like_amount", "text_length", "word_count", F.round("uppercase_ratio", 6).alias("uppercase_ratio"), F.round("bbox_width_norm", 6).alias("bbox_width_norm"), "is_right_aligned", "prev_has_amount", "next_has_amount", F.round("relative_position", 6).alias("relative_position"))


Q["x_ml_feats"] = x_ml_feats
S["x_ml_feats"] = _W + """, l AS (SELECT doc_id, page, true_line AS line, string_agg(text, ' ' ORDER BY x0) AS text, min(x0) AS x0, max(x1) AS x1 FROM words GROUP BY ALL)
SELECT doc_id, page, line, regexp_matches(text, '\\$?[0-9]{1,3}(?:,[0-9]{3})*\\.[0-9]{2}')::INT::DOUBLE AS looks_like_amount, length(text) AS text_length, len(string_split(text, ' ')) AS word_count, round(len(regexp_extract_all(text, '[A-Z]')) / length(text), 6) AS uppercase_ratio, round((x1 - x0) / 612.0, 6) AS bbox_width_norm, (x1 > 489.6)::INT::DOUBLE AS is_right_aligned,
  coalesce(lag(true) OVER w, false)::INT::DOUBLE AS prev_has_amount, coalesce(lead(true) OVER w, false)::INT::DOUBLE AS next_has_amount, round((row_number() OVER w - 1) / count(*) OVER (PARTITION BY doc_id, page), 6) AS relative_position FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)"""


# --- optical character recognition boxes
def src_ocr_vision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _words(spark, sf_dir).select(*PAGE, F.concat_ws(" ", "text", F.lit("X")).alias("text"), (F.col("x0") / 1000).alias("norm_x"), F.lit(0.25).alias("norm_y"), F.lit(0.5).alias("norm_w"), F.lit(0.125).alias("norm_h"), F.lit(1000).alias("img_w"), F.lit(2000).alias("img_h"), F.lit(144).alias("dpi"), "word_id")
    return _r(ocr.vision_words(o).select(*PAGE, "word_id", "part", "text", "x0", "x1", "top", "bottom"), "x0", "x1", "top", "bottom")


Q["src_ocr_vision"] = src_ocr_vision
S["src_ocr_vision"] = _W + " SELECT doc_id, page, word_id, part, CASE part WHEN 0 THEN text ELSE 'X' END AS text, round((x0 / 1000 * 1000 + part * 250) * 0.5, 6) AS x0, round((x0 / 1000 * 1000 + (part + 1) * 250) * 0.5, 6) AS x1, round((1 - 0.25 - 0.125) * 2000 * 0.5, 6)::DOUBLE AS top, round((1 - 0.25) * 2000 * 0.5, 6)::DOUBLE AS bottom FROM words, (VALUES (0::INTEGER), (1::INTEGER)) AS p(part)"


def src_ocr_tess(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _words(spark, sf_dir).select(*PAGE, "word_id", "text", (F.col("word_id") % 50 - 1).cast("string").alias("conf"), (F.col("x0") * 2).alias("left"), (F.col("top") * 2).alias("top"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height"), F.lit(144).alias("dpi"))
    return ocr.tesseract_words(o).select(*PAGE, "word_id", "text", "x0", "x1", "top", "bottom")


Q["src_ocr_tess"] = src_ocr_tess
S["src_ocr_tess"] = _W + " SELECT doc_id, page, word_id, text, x0, x0 + 10 AS x1, top, top + 5 AS bottom FROM words WHERE NOT (word_id % 50 - 1 >= 0 AND word_id % 50 - 1 < 30)"

# positions and counts are 32-bit in Spark
S["geo_tokens"], S["x_ml_feats"] = V.ints(S["geo_tokens"], "line"), V.ints(S["x_ml_feats"], "line", "text_length", "word_count")

QUERIES, ORACLE_SQL = Q, S
