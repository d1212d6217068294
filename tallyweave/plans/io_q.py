"""Sources, sinks and streams as queries: what is written is read again and compared."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import features, text
from ..operators import geometry as G
from ..operators import parse_rows as P
from ..operators.reconcile import lines_of
from ..sources import documents, files, ocr
from ..sources.workbook import sheets_of
from ..streaming import ledger as ST
from . import views as V
from .agg_q import CAT, categorised
from .reconcile_q import ORACLE_SQL as REC
from .reconcile_q import reconcile_cascade
from .scalar_q import _DATE, _MONEY, esc

Q: dict = {}
S: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder in the place that all executors share; a temporary one where a single machine has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "tallyweave-scratch")
    return f"{base}/q-{uuid.uuid4().hex}"


def src_csv_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the exports say USD, some amounts are no numbers."""
    path = scratch(spark)
    t = V.txns(spark, sf_dir)
    amount = F.when(t.seq % 9 == 0, "n/a").when(t.seq % 2 == 0, F.concat("amount", F.lit(" USD"))).otherwise(F.col("amount").cast("string"))
    files.write_csv(t.select(F.col("txn_date").cast("string").alias("Transaction Date"), F.col("seq").cast("string").alias("Description"), amount.alias("Amount")), path)
    return files.truth_csv(spark, path).withColumn("amount", F.col("amount").cast("double"))


Q["src_csv_truth"] = src_csv_truth
S["src_csv_truth"] = "WITH " + V.TXNS + " SELECT CAST(txn_date AS VARCHAR) AS date, seq::VARCHAR AS description, CAST(amount AS DOUBLE) AS amount FROM txns WHERE seq % 9 <> 0"


def src_json_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    t = V.txns(spark, sf_dir).select("doc_id", F.struct(F.col("txn_date").cast("string").alias("date"), "description", "amount").alias("r"))
    t.groupBy("doc_id").agg(F.to_json(F.collect_list("r")).alias("value")).select("value").write.text(path)
    return files.labels_json(spark, path, per_line=True).withColumn("amount", F.col("amount").cast("double"))


Q["src_json_labels"] = src_json_labels
S["src_json_labels"] = "WITH " + V.TXNS + " SELECT CAST(txn_date AS VARCHAR) AS date, description, CAST(amount AS DOUBLE) AS amount FROM txns"


def src_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    t = V.txns(spark, sf_dir)
    line = F.when(t.seq % 10 == 0, F.concat(F.lit("# "), F.col("seq"))).when(t.seq % 10 == 1, F.concat_ws("|", F.col("seq"), F.lit("x+"))).otherwise(F.concat_ws("|", F.col("seq"), F.lit("[0-9]+"), F.col("seq") % 7, F.lit("a|b")))
    t.select(line.alias("value")).write.text(path)
    return files.patterns(spark, path)


Q["src_patterns"] = src_patterns
S["src_patterns"] = "WITH " + V.TXNS + " SELECT seq::VARCHAR AS filename, CASE WHEN seq % 10 = 1 THEN 'x+' ELSE '[0-9]+' END AS pattern, CAST(CASE WHEN seq % 10 = 1 THEN 1 ELSE seq % 7 END AS INTEGER) AS success_count, CASE WHEN seq % 10 = 1 THEN '' ELSE 'a|b' END AS metadata FROM txns WHERE seq % 10 <> 0"


def src_json_cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    spark.createDataFrame([(json.dumps({k: list(v) for k, v in rules.CATEGORIES.items()}),)], "value string").coalesce(1).write.text(path)
    return files.categories_json(spark, path)


Q["src_json_cfg"] = src_json_cfg
S["src_json_cfg"] = "SELECT * FROM (VALUES " + ", ".join(f"('{esc(c)}', {i}, '{esc(w)}', {j})" for i, (c, words) in enumerate(rules.CATEGORIES.items()) for j, w in enumerate(words)) + ") AS v(category, cat_rank, keyword, kw_rank)"


def snk_excel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each sheet of each statement's workbook, as written and read again."""
    path = scratch(spark)
    rows = categorised(spark, sf_dir).join(V.txns(spark, sf_dir).select("doc_id", "seq", F.col("txn_date").alias("date")), ["doc_id", "seq"])
    files.workbooks(rows).write.parquet(path)

    def read(frames):
        for f in frames:
            found = [(d, name, len(x) - 1, sum(r[2] for r in x[1:])) for d, b in zip(f.doc_id, f.workbook, strict=True) for name, x in sheets_of(b)]
            yield pd.DataFrame(found, columns=["doc_id", "sheet", "n", "total"])

    return spark.read.parquet(path).mapInPandas(read, "doc_id long, sheet string, n long, total double").withColumn("total", F.round("total", 2))


Q["snk_excel"] = snk_excel
S["snk_excel"] = "WITH " + CAT + r", c AS (SELECT doc_id, substr(regexp_replace(category, '[^\w]', '_', 'g'), 1, 31) AS sheet, count(*) AS n, sum(amount) AS total FROM categorised GROUP BY 1, 2) SELECT doc_id, sheet, n, round(CAST(total AS DOUBLE), 2) AS total FROM c UNION ALL SELECT doc_id, 'All Transactions', CAST(sum(n) AS BIGINT), round(CAST(sum(total) AS DOUBLE), 2) FROM c GROUP BY 1 UNION ALL SELECT doc_id, 'Category Summary', count(*), round(CAST(sum(total) AS DOUBLE), 2) FROM c GROUP BY 1"


def snk_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_by_category(categorised(spark, sf_dir).select("doc_id", "seq", "category"), path)
    return spark.read.parquet(path).groupBy("sheet").agg(F.count("*").alias("n"))


Q["snk_by_category"] = snk_by_category
S["snk_by_category"] = "WITH " + CAT + r" SELECT substr(regexp_replace(category, '[^\w]', '_', 'g'), 1, 31) AS sheet, count(*) AS n FROM categorised GROUP BY 1"


def snk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_json(V.txns(spark, sf_dir).select("doc_id", "seq", "txn_date", F.col("amount").cast("double")), path)
    return spark.read.schema("doc_id long, seq long, txn_date string, amount double").json(path)


Q["snk_json"] = snk_json
S["snk_json"] = "WITH " + V.TXNS + " SELECT doc_id, seq, CAST(txn_date AS VARCHAR) AS txn_date, CAST(amount AS DOUBLE) AS amount FROM txns"


def snk_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_csv(V.txns(spark, sf_dir).select("doc_id", "seq", "description"), path)
    return spark.read.schema("doc_id long, seq long, description string").csv(path, header=True).withColumn("description", F.coalesce("description", F.lit("")))


Q["snk_csv"] = snk_csv
S["snk_csv"] = "WITH " + V.TXNS + " SELECT doc_id, seq, description FROM txns"


def snk_schedc_xlsx(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .agg_q import form_lines

    path = scratch(spark)
    files.write_form_lines(form_lines(spark, sf_dir), path)
    return spark.read.schema("line string, amount string").csv(path, header=True)


Q["snk_schedc_xlsx"] = snk_schedc_xlsx
S["snk_schedc_xlsx"] = "SELECT line, format('{:,.0f}', round_even(amount, 0)) AS amount FROM (" + "{form}" + ")"
from .agg_q import ORACLE_SQL as _AGG  # noqa: E402

S["snk_schedc_xlsx"] = S["snk_schedc_xlsx"].replace("{form}", _AGG["agg_schedule_c"])
from .agg_q import QUERIES as _AGG_Q  # noqa: E402



def snk_pdf_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled form's fields, written as form data and read again."""
    path = scratch(spark)
    files.write_form_data(_AGG_Q["jn_line_field"](spark, sf_dir).select(F.concat_ws(".", "form_line", "field_pattern").alias("name"), "shown"), path)
    return files.read_form_data(spark, path)


Q["snk_pdf_form"] = snk_pdf_form
S["snk_pdf_form"] = "SELECT concat_ws('.', form_line, field_pattern) AS name, shown FROM (" + _AGG["jn_line_field"] + ")"


def snk_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by account, replaced by a table that is made of the old one."""
    path = scratch(spark)
    files.replace_atomically(V.txns(spark, sf_dir).groupBy("account").agg(F.count("*").alias("n")), path, "parquet")
    files.replace_atomically(spark.read.parquet(path).withColumn("n", F.col("n") * 2), path, "parquet")
    return spark.read.parquet(path)


Q["snk_atomic"] = snk_atomic
S["snk_atomic"] = "WITH " + V.TXNS + " SELECT account, count(*) * 2 AS n FROM txns GROUP BY 1"


def snk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of all rows, with the rows of the last day as fresh lines; the newest that fit in half the limit stay."""
    log = V.txns(spark, sf_dir).select(F.col("txn_date").alias("at"), F.concat_ws(" ", F.col("seq").cast("string"), "description").alias("line"))
    done = files.append_capped(log, log.where(F.col("at") == F.lit("1998-08-02").cast("date")), LOG_BYTES)
    return done.select(F.col("at").cast("string").alias("day"), "line")


LOG_BYTES = 1 << 15
Q["snk_log"] = snk_log
S["snk_log"] = "WITH " + V.TXNS + f", l AS (SELECT txn_date AS d, concat_ws(' ', seq::VARCHAR, description) AS line FROM txns), b AS (SELECT d, sum(strlen(line) + 1) AS n FROM l GROUP BY d), k AS (SELECT d, sum(n) OVER (ORDER BY d DESC) AS kept FROM b) SELECT CAST(d AS VARCHAR) AS day, line FROM l WHERE (SELECT sum(n) FROM b) <= {LOG_BYTES} OR d IN (SELECT d FROM k WHERE kept <= {LOG_BYTES // 2}) UNION ALL SELECT CAST(d AS VARCHAR), line FROM l WHERE d = DATE '1998-08-02'"


def _documents(spark: SparkSession, sf_dir: str, projection: str) -> DataFrame:
    """Statement texts as files, two pages each, read by the document source's plain-text decoder."""
    path = scratch(spark)
    t = V.texts(spark, sf_dir).select(F.concat(F.col("text"), F.lit("\f"), F.reverse("text")).alias("value"))
    t.write.option("lineSep", "\f").text(path)
    documents.register(spark)
    return spark.read.format("statement_documents").option("projection", projection).load(path.removeprefix("file:"))


Q["src_pdf_text"] = lambda spark, sf_dir: _documents(spark, sf_dir, "pages").where("text <> ''").select("text")
S["src_pdf_text"] = "WITH " + V.TEXTS + " SELECT text FROM texts UNION ALL SELECT reverse(text) FROM texts"
Q["src_pdf_words"] = lambda spark, sf_dir: _documents(spark, sf_dir, "words").groupBy("text").agg(F.count("*").alias("n"), F.sum("x0").alias("x0"), F.sum("top").alias("top"))
S["src_pdf_words"] = "WITH " + V.TEXTS + r", p AS (SELECT unnest([text, reverse(text)]) AS text FROM texts), l AS (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM p), w AS (SELECT line, pos, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS i FROM l) SELECT word AS text, count(*) AS n, sum(6.0 * CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(string_split(line, ' ')[1:i - 1], ' ')) + 1 END)::DOUBLE AS x0, sum(12.0 * pos)::DOUBLE AS top FROM w WHERE word <> '' GROUP BY 1"


def snk_pdf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of checks of the verification report."""
    return files.report_tables(reconcile_cascade(spark, sf_dir), categorised(spark, sf_dir))["checks"]


Q["snk_pdf_report"] = snk_pdf_report
S["snk_pdf_report"] = "SELECT check_type, reconciled, count(*) AS n FROM (" + REC["reconcile_cascade"] + ") GROUP BY ALL"
Q["snk_template"] = lambda spark, sf_dir: files.label_template(V.txns(spark, sf_dir)).withColumn("amount", F.col("amount").cast("double"))
S["snk_template"] = "WITH " + V.TXNS + " SELECT CAST(txn_date AS VARCHAR) AS date, description, CAST(amount AS DOUBLE) AS amount, '' AS category FROM txns"


def snk_cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.save_config(spark.createDataFrame(list(rules.LEARNED), "merchant string, category string"), path)
    return spark.read.schema("merchant string, category string").json(path)


Q["snk_cfg"] = snk_cfg
S["snk_cfg"] = "SELECT * FROM (VALUES " + ", ".join(f"('{esc(a)}', '{esc(b)}')" for a, b in rules.LEARNED) + ") AS v(merchant, category)"


def src_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part files of a table written by region, with a region in their path."""
    path = scratch(spark)
    V.read(spark, sf_dir, "nation").repartition(1).write.partitionBy("n_regionkey").parquet(path)
    found = files.listing(spark, path, "*.parquet", "n_regionkey=1")
    return found.select(F.regexp_extract("path", r"(n_regionkey=\d+)", 1).alias("folder"), (F.col("size") > 0).alias("has_data"))


Q["src_glob"] = src_glob
S["src_glob"] = "SELECT DISTINCT 'n_regionkey=1' AS folder, true AS has_data FROM nation WHERE n_regionkey = 1"
Q["jn_stem"] = lambda spark, sf_dir: files.match_stems(V.read(spark, sf_dir, "pages").select(F.col("url").alias("path")), spark.createDataFrame([("/fr/8",), ("/en/2",), ("no such stem",)], "stem string"))
S["jn_stem"] = "SELECT stem, min(url) AS path FROM pages, (VALUES ('/fr/8'), ('/en/2'), ('no such stem')) AS v(stem) WHERE contains(url, stem) GROUP BY stem"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.read(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / 4).cast("long").alias("doc_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("page"), "text")


Q["src_ocr_route"] = lambda spark, sf_dir: ocr.route(_pages(spark, sf_dir))
S["src_ocr_route"] = "SELECT CAST(floor(doc_id / 4) AS BIGINT) AS doc_id, CASE WHEN coalesce(max(CASE WHEN doc_id % 4 = 0 THEN length(trim(text, ' ')) END), 0) < 50 THEN 'ocr' ELSE 'text' END AS backend FROM documents GROUP BY 1"
Q["src_text_backend"] = lambda spark, sf_dir: ocr.first_text(V.txns(spark, sf_dir).select("doc_id", "seq", F.nullif("date_raw", F.lit("")).alias("layer"), "description", F.col("account").alias("ocr")), "layer", "description", "ocr").select("doc_id", "seq", "text", "backend")
S["src_text_backend"] = "WITH " + V.TXNS + " SELECT doc_id, seq, CASE WHEN date_raw <> '' THEN date_raw WHEN description <> '' THEN description ELSE account END AS text, CASE WHEN date_raw <> '' THEN 'layer' WHEN description <> '' THEN 'description' ELSE 'ocr' END AS backend FROM txns"


def _banked(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("seq") % len(_SAID) + 1).cast("int"))
    return V.txns(spark, sf_dir).select("doc_id", "seq", said.alias("said"))


_SAID = ("DEBIT CARD PURCHASE  ACME  #A12", "ONLINE PAYMENT - Shop 03/04", "POS PURCHASE - CAFE AUTH 77X", "PYMTAuthDate 22-May #12:", "POS 0972 Transaction 06-24-25 Zelle", "purchase authorized on 11/03 LYFT", "CHECKCARD 12 SHOP #9")
for _bank in rules.BANK_PREFIXES:
    _name = "s_desc_" + _bank.lower().replace(" ", "_")
    _x = "trim(regexp_replace(said, '\\s+', ' ', 'g'))"
    for _p in rules.BANK_PREFIXES[_bank]:
        _x = f"trim(regexp_replace({_x}, '(?i)^{_p}', ''))"
    for _p in rules.BANK_ARTIFACTS[_bank]:
        _x = f"regexp_replace({_x}, '{_p}', '', 'g')"
    Q[_name] = lambda spark, sf_dir, b=_bank: _banked(spark, sf_dir).select("doc_id", "seq", text.for_bank(F.col("said"), b).alias("out"))
    S[_name] = "WITH " + V.TXNS + ", said AS (SELECT doc_id, seq, [" + ", ".join(f"'{s}'" for s in _SAID) + f"][seq % {len(_SAID)} + 1] AS said FROM txns) SELECT doc_id, seq, trim(regexp_replace({_x}, '\\s+', ' ', 'g')) AS out FROM said"


def s_regex_tmpl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the pattern derived from all lines matches, with its text group."""
    lines = lines_of(V.texts(spark, sf_dir)).select("doc_id", F.col("pos").cast("long"), F.col("line").alias("text"))
    pattern = P.derived_pattern(lines)
    return lines.where(F.col("text").rlike(pattern)).select("doc_id", "pos", F.trim(F.regexp_extract("text", pattern, 1)).alias("said"))


Q["s_regex_tmpl"] = s_regex_tmpl
S["s_regex_tmpl"] = "WITH " + V.TEXTS + rf" SELECT doc_id, pos, trim(regexp_extract(line, '^\s*{rules.DATE_PART}(.+?)\s+({rules.MONEY_PART})\s*$', 1)) AS said FROM text_lines WHERE regexp_matches(line, '^\s*{rules.DATE_PART}(.+?)\s+({rules.MONEY_PART})\s*$')"


def geo_date_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = G.lines(V.words(spark, sf_dir))
    return G.date_by_columns(w, (28.0, 300.0)).withColumn("line", F.col("line").cast("long"))


Q["geo_date_cols"] = geo_date_cols
S["geo_date_cols"] = "WITH " + V.WORDS + " SELECT doc_id, page, line, text AS date_raw FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page ORDER BY true_line) AS line FROM words) WHERE word_id % 4 = 0"


def geo_profile_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = V.words(spark, sf_dir)
    labels = w.where("word_id % 4 = 1").select("doc_id", F.col("word_id").alias("rank"), F.element_at(F.array(*[F.lit(x) for x in _TITLES]), (F.col("word_id") % len(_TITLES) + 1).cast("int")).alias("label"))
    return G.profile_from(labels, G.columns(w)).select("doc_id", F.array_join("totals", ",").alias("totals"))


_TITLES = ("Total New Activity", "Total fees", "Interest charged", "Statement balance", "Deposits and credits", "Withdrawals, debits", "Something else")
Q["geo_profile_gen"] = geo_profile_gen
_FIELD = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(l, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules.LABEL_FIELDS) + " WHEN contains(l, 'deposits') AND contains(l, 'credit') THEN 'deposits' WHEN contains(l, 'withdrawals') AND contains(l, 'debit') THEN 'withdrawals' END"
S["geo_profile_gen"] = "WITH " + V.WORDS + ", l AS (SELECT doc_id, word_id, lower([" + ", ".join(f"'{t}'" for t in _TITLES) + f"][word_id % {len(_TITLES)} + 1]) AS l FROM words WHERE word_id % 4 = 1), f AS (SELECT doc_id, {_FIELD} AS field, arg_min(l, word_id) AS label FROM l GROUP BY doc_id, {_FIELD} HAVING field IS NOT NULL), t AS (SELECT doc_id, string_agg(field || '=' || label, ',' ORDER BY field || '=' || label) AS totals FROM f GROUP BY doc_id), a AS (SELECT doc_id, page, round_even(x1 / 5, 0) AS b, count(*) AS n FROM words WHERE word_id % 4 >= 2 GROUP BY ALL), d AS (SELECT DISTINCT doc_id FROM a WHERE n >= 2) SELECT doc_id, totals FROM d LEFT JOIN t USING (doc_id)"


def x_line_feats2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.words(spark, sf_dir).select("doc_id", "page", F.col("true_line").alias("line"), "text", "x0", "x1", (F.col("word_id") % 4 + 8.0).alias("size"))
    f = features.layout_features(t)
    return f.select("doc_id", "page", "line", "len_tokens", F.round("alpha_ratio", 6).alias("alpha_ratio"), "n_digit", "n_punct", "has_money", "n_money", "has_date", F.round("x_span", 6).alias("x_span"), "rightmost_is_money", F.round("size_mean", 6).alias("size_mean"), F.round("size_std", 6).alias("size_std"))


Q["x_line_feats2"] = x_line_feats2
_n = lambda p: f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT)"
S["x_line_feats2"] = "WITH " + V.WORDS + f", g AS (SELECT doc_id, page, true_line AS line, count(*) AS len_tokens, {_n('[A-Za-z]')} / sum(length(text)) AS alpha_ratio, {_n('[0-9]')} AS n_digit, {_n('[^A-Za-z0-9]')} AS n_punct, string_agg(text, ' ' ORDER BY x0) AS t, (max((x0 + x1) / 2) - min((x0 + x1) / 2)) / 612.0 AS x_span, arg_max(text, x1) AS last, avg(word_id % 4 + 8.0) AS size_mean, stddev_pop(word_id % 4 + 8.0) AS size_std FROM words GROUP BY ALL) SELECT doc_id, page, line, len_tokens, round(alpha_ratio, 6) AS alpha_ratio, n_digit, n_punct, regexp_matches(t, '{_MONEY}')::INT AS has_money, len(regexp_extract_all(t, '{_MONEY}')) AS n_money, regexp_matches(t, '{_DATE}')::INT AS has_date, round(x_span, 6) AS x_span, regexp_full_match(last, '{_MONEY}')::INT AS rightmost_is_money, round(size_mean, 6) AS size_mean, round(size_std, 6) AS size_std FROM g"


def p_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more in each document's best cluster that hold an amount; no trained model is needed."""
    lines = lines_of(V.texts(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("line"), F.trim("line").alias("text"))
    return features.best_cluster(features.cluster_lines(lines.where(F.length("text") >= 10))).where(F.col("text").rlike(features.MONEY)).select("doc_id", "line", "cluster")


Q["p_ml"] = p_ml


def srt_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each memory size the best model that fits: quality first, then the larger."""
    models = V.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("model"), (F.col("p_size") / 2.0).alias("size_gb"), (F.col("p_partkey") % 3).alias("quality"))
    hw = spark.createDataFrame([(4.0,), (8.0,), (16.0,)], "avail double")
    fits = models.join(F.broadcast(hw), F.col("size_gb") + 1.5 <= F.col("avail"))
    return fits.groupBy("avail").agg(F.min_by("model", F.struct("quality", -F.col("size_gb"), "model")).alias("model"))


Q["srt_model"] = srt_model
S["srt_model"] = "SELECT avail, p_partkey AS model FROM part, (VALUES (4.0::DOUBLE), (8.0), (16.0)) AS h(avail) WHERE p_size / 2.0 + 1.5 <= avail QUALIFY row_number() OVER (PARTITION BY avail ORDER BY p_partkey % 3, p_size DESC, p_partkey) = 1"


def hook_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two plugged-in parsers and the order between them."""
    parsers = {
        "dated": (lambda t: t.contains("CITI"), lambda pages: lines_of(pages).where(F.col("line").rlike("^[0-9]{2}/[0-9]{2}")).select("doc_id", F.col("pos").cast("long"))),
        "any": (lambda t: F.lit(True), lambda pages: lines_of(pages).select("doc_id", F.col("pos").cast("long"))),
    }
    return P.parse_registered(V.texts(spark, sf_dir), parsers).groupBy("parser").agg(F.count("*").alias("n"))


Q["hook_parsers"] = hook_parsers
S["hook_parsers"] = "WITH " + V.TEXTS + " SELECT CASE WHEN contains(text, 'CITI') THEN 'dated' ELSE 'any' END AS parser, count(*) AS n FROM text_lines JOIN texts USING (doc_id) WHERE NOT contains(text, 'CITI') OR regexp_matches(line, '^[0-9]{2}/[0-9]{2}') GROUP BY 1"


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals of events by type, by a stream over the events file that ends when it is read."""
    path = scratch(spark)
    events = V.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{path}/in")
    s = ST.windowed_totals(ST.file_drop(spark, f"{path}/in", events.schema), "ts", "value", "event_type")
    out = s.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "total", "n")
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("day string, event_type string, total double, n long").parquet(f"{path}/out").withColumn("total", F.round("total", 4))


Q["stream_windows"] = stream_windows
# a window is final once the watermark, an hour behind the latest event, has passed its end
S["stream_windows"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2"

# positions and counts are 32-bit in Spark
S["x_line_feats2"] = V.ints(S["x_line_feats2"], "line", "n_money")

QUERIES, ORACLE_SQL = Q, S
