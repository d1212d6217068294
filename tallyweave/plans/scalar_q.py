"""Scalar functions over whole tables: descriptions, money dialects, date dialects, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import dates, features, money, text
from ..operators import parse_rows as P
from ..operators.reconcile import lines_of
from . import views as V

Q: dict = {}
S: dict[str, str] = {}


def esc(s: str) -> str:
    return s.replace("'", "''")


def _g(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, '{esc(pattern)}', '{to}', 'g')"


# --- descriptions
_PREFIX = "(?i)^(?:" + "|".join(rules.LEADING) + ")+"


def _strip_prefix(x: str) -> str:
    return f"regexp_replace({x}, '{esc(_PREFIX)}', '')"


def _strip_refs(x: str) -> str:
    return _g(_g(x, rules.LONG_DIGITS, " "), rules.PHONE, " ")


def _split_state(x: str) -> str:
    tidy = f"trim({_g(x, '[ \t\n\r]+', ' ')})"
    last = f"string_split({tidy}, ' ')[-1]"
    return f"CASE WHEN regexp_matches({last}, '[A-Z]{{4}}$') AND length({last}) > 4 THEN regexp_replace({tidy}, '([A-Z]{{2}})([A-Z]{{2}})$', '\\1 \\2') ELSE {x} END"


def _peel_once(x: str) -> str:
    return "rtrim(" + f"regexp_replace(regexp_replace(regexp_replace({x}, '{rules.TRAILING_DIGITS}', ''), '{rules.TRAILING_PHONE}', ''), '{rules.TRAILING_STATE}', '')" + ")"


def _drop_refs(x: str) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: NOT regexp_matches(w, '{rules.REFERENCE_TOKEN}')), ' ')"


def _title(x: str) -> str:
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''), lambda w: CASE WHEN (upper(w) = w AND lower(w) <> w AND length(w) BETWEEN 2 AND 5) OR starts_with(w, '#') THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ')"


def _sub(inner: str, name: str) -> str:
    """A scalar subquery that names an intermediate text, so that it is written once."""
    return f"(SELECT {name} FROM (SELECT {inner} AS {name}))"


_peeled = "p0"
for _ in range(6):
    _peeled = _peel_once(_peeled)
#: SQL of the normalised ``description``.
NORMALIZED = (
    "(SELECT CASE WHEN r = '' THEN '' ELSE coalesce(nullif(" + _title("s3") + ", ''), r) END FROM (SELECT r, trim(" + _g(_drop_refs("s2"), r"\s+", " ") + ") AS s3 FROM (SELECT r, " + _peeled + " AS s2 FROM (SELECT r, "
    + _split_state("s1") + " AS p0 FROM (SELECT r, " + _strip_refs(_strip_prefix("r")) + " AS s1 FROM (SELECT trim(description) AS r))))))"
)
_vendor = "description"
for _p in (r"\s+\d{10,}.*$", r"\s+[A-Z]{2}\s*$", r"\s+\d{5}\s*$", r"\*+"):
    _vendor = _g(_vendor, _p)


def _strings(name: str, column, sql: str) -> None:
    Q[name] = lambda spark, sf_dir: V.txns(spark, sf_dir).select("doc_id", "seq", column(F.col("description")).alias("out"))
    S[name] = "WITH " + V.TXNS + f" SELECT doc_id, seq, {sql} AS out FROM txns"


_strings("s_strip_prefix", text.strip_prefix, _strip_prefix("description"))
_strings("s_strip_refs", text.strip_references, _strip_refs("description"))
_strings("s_split_state", text.split_state, _split_state("description"))
_strings("s_peel_trailing", text.peel_trailing, _peeled.replace("p0", "description"))
_strings("s_drop_refs", text.drop_references, _drop_refs("description"))
_strings("s_titlecase", text.title, _title("description"))
_strings("s_normalize", text.normalized, NORMALIZED)
_strings("s_clean_cat", text.for_categories, f"lower({NORMALIZED})")
_strings("s_vendor_clean", text.vendor, f"array_to_string(list_transform(string_split(trim({_vendor}), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")
_strings("s_sheet_name", text.sheet_name, r"substr(regexp_replace(description, '[^\w]', '_', 'g'), 1, 31)")
Q["s_fmt_money"] = lambda spark, sf_dir: V.txns(spark, sf_dir).select("doc_id", "seq", money.shown(F.col("amount")).alias("shown"), money.form_value(F.col("amount") * 1000).alias("whole"), F.date_format("txn_date", "MM/dd/yyyy").alias("us_date"))
S["s_fmt_money"] = "WITH " + V.TXNS + " SELECT doc_id, seq, CASE WHEN amount < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', CAST(abs(amount) AS DOUBLE)) AS shown, format('{:,.0f}', CAST(amount * 1000 AS DOUBLE)) AS whole, strftime(txn_date, '%m/%d/%Y') AS us_date FROM txns"
Q["x_mask"] = lambda spark, sf_dir: V.txns(spark, sf_dir).select("doc_id", "seq", money.mask(F.lpad(F.col("seq").cast("string"), 10, "0")).alias("masked"))
S["x_mask"] = "WITH " + V.TXNS + " SELECT doc_id, seq, '****' || right(lpad(seq::VARCHAR, 10, '0'), 4) AS masked FROM txns"
Q["x_hash"] = lambda spark, sf_dir: V.txns(spark, sf_dir).select("doc_id", "seq", F.substring(F.sha1(F.col("description").cast("binary")), 1, 16).alias("h"))
S["x_hash"] = "WITH " + V.TXNS + " SELECT doc_id, seq, substr(sha1(description), 1, 16) AS h FROM txns"

# --- money: the same amount in eight shapes, one of them no number
_SHAPES = ("$A", "(A)", "A-", "-A", "+A", " A ", "x A", "$ -A", "")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.txns(spark, sf_dir)
    shape = F.element_at(F.array(*[F.lit(x) for x in _SHAPES]), (F.col("seq") % len(_SHAPES) + 1).cast("int"))
    return t.select("doc_id", "seq", F.replace(shape, F.lit("A"), F.format_number(F.abs("amount") * 100, 2)).alias("token"))


_TOK = V.TXNS + ", tokens AS (SELECT doc_id, seq, replace([" + ", ".join(f"'{x}'" for x in _SHAPES) + f"][seq % {len(_SHAPES)} + 1], 'A', format('{{:,.2f}}', CAST(abs(amount) * 100 AS DOUBLE))) AS token FROM txns)"
_NUM = "CASE WHEN regexp_matches({n}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN CAST({n} AS DOUBLE) END"


def _money(name: str, column, sql: str) -> None:
    """``sql``: value, from columns neg (BOOLEAN) and n (the plain number's text)."""
    Q[name] = lambda spark, sf_dir: _tokens(spark, sf_dir).select("doc_id", "seq", column(F.col("token")).cast("double").alias("value"))
    S[name] = "WITH " + _TOK + f", parts AS ({sql}) SELECT doc_id, seq, CASE WHEN neg THEN -1 ELSE 1 END * {_NUM.format(n='n')} AS value FROM parts"


_PAREN = "SELECT doc_id, seq, starts_with(t, '(') AND ends_with(t, ')') AS p, CASE WHEN starts_with(t, '(') AND ends_with(t, ')') THEN t[2:-2] ELSE t END AS t FROM (SELECT doc_id, seq, {t} AS t FROM tokens)"
_money("m_stated", money.stated, "SELECT doc_id, seq, p OR starts_with(t, '-') AS neg, trim(translate(CASE WHEN starts_with(t, '-') THEN t[2:] ELSE t END, '$,=', '')) AS n FROM (SELECT doc_id, seq, p, CASE WHEN starts_with(t, '+') THEN t[2:] ELSE t END AS t FROM (" + _PAREN.format(t="trim(token)") + "))")
_money("m_geo", money.word, "SELECT doc_id, seq, p OR starts_with(t, '-') AS neg, trim(translate(CASE WHEN starts_with(t, '-') THEN t[2:] ELSE t END, '$,', '')) AS n FROM (SELECT doc_id, seq, p OR ends_with(t, '-') AS p, CASE WHEN ends_with(t, '-') THEN t[:-2] ELSE t END AS t FROM (" + _PAREN.format(t="trim(token)") + "))")
_money("m_base", money.row, "SELECT doc_id, seq, p AS neg, t AS n FROM (" + _PAREN.format(t=_g("token", r"[$,\s]")) + ")")
_money("m_valid", money.validated, "SELECT doc_id, seq, p AS neg, t AS n FROM (" + _PAREN.format(t="trim(translate(token, '$,', ''))") + ")")
_money("m_ml", money.in_line, "SELECT doc_id, seq, contains(token, '-') AS neg, replace(coalesce(regexp_extract_all(token, '([0-9]{1,3}(?:,[0-9]{3})*\\.[0-9]{2})', 1)[-1], ''), ',', '') AS n FROM tokens")
Q["flt_amount_tok"] = lambda spark, sf_dir: _tokens(spark, sf_dir).where(money.looks_like_amount(F.col("token"))).select("doc_id", "seq")
S["flt_amount_tok"] = "WITH " + _TOK + " SELECT doc_id, seq FROM tokens WHERE regexp_matches(regexp_replace(translate(token, '$,()', ''), '^-+|-+$', '', 'g'), '^[0-9]+\\.[0-9]{1,2}$')"

# --- dates: the row's date in twelve shapes
_DATES = (("MM/dd/yyyy", "%m/%d/%Y"), ("MM/dd/yy", "%m/%d/%y"), ("yyyy-MM-dd", "%Y-%m-%d"), ("MM-dd-yyyy", "%m-%d-%Y"), ("MM/dd", "%m/%d"), ("dd/MM/yyyy", "%d/%m/%Y"), ("yyyy/MM/dd", "%Y/%m/%d"), ("MMM d", "%b %-d"), ("MMM d, yyyy", "%b %-d, %Y"), ("MM-dd", "%m-%d"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.lit("none")
    for i, (f, _) in enumerate(_DATES):
        shape = F.when(F.col("seq") % 11 == i, F.date_format("txn_date", f)).otherwise(shape)
    return V.txns(spark, sf_dir).select("doc_id", "seq", shape.alias("raw"))


_RAW = V.TXNS + ", raws AS (SELECT doc_id, seq, txn_date, CASE seq % 11 " + " ".join(f"WHEN {i} THEN strftime(txn_date, '{f}')" for i, (_, f) in enumerate(_DATES)) + " ELSE 'none' END AS raw, strftime(txn_date, '-%m-%d') AS md FROM txns)"
_swap = "CASE WHEN day(txn_date) <= 12 THEN strftime(txn_date, '%Y-%d-%m') ELSE strftime(txn_date, '%Y-%m-%d') END"


def _date(name: str, column, cases: dict[int, str]) -> None:
    Q[name] = lambda spark, sf_dir: _dated(spark, sf_dir).select("doc_id", "seq", column(F.col("raw")).cast("string").alias("parsed"))
    S[name] = "WITH " + _RAW + " SELECT doc_id, seq, CASE seq % 11 " + " ".join(f"WHEN {i} THEN {x}" for i, x in cases.items()) + " END AS parsed FROM raws"


_iso = "strftime(txn_date, '%Y-%m-%d')"
_in_1990 = "CASE WHEN md = '-02-29' THEN NULL ELSE '1990' || md END"
_date("d_base", lambda c: dates.base(c, F.lit(1990)), {0: _iso, 1: _iso, 2: _iso, 3: _iso, 4: _in_1990, 5: _swap})
_date("d_valid", dates.validated, {0: _iso, 1: _iso, 2: _iso, 3: _iso, 5: _swap, 6: _iso})
_date("d_capone", lambda c: dates.month_day(c, F.lit(1990)), {7: _in_1990, 8: _iso})
_date("d_navy", lambda c: dates.statement(c, F.lit(1990)), {0: _iso, 1: "CASE WHEN md = '-02-29' AND year(txn_date) % 100 <> 0 THEN strftime(txn_date, '20%y-%m-%d') ELSE strftime(txn_date, '20%y-%m-%d') END", 3: _iso, 5: "CASE WHEN day(txn_date) <= 12 THEN strftime(txn_date, '%Y-%d-%m') END", 9: _in_1990})
_date("d_add_year", lambda c: dates.add_year(c, F.lit(1990)), {**{i: "raw" for i in range(11)}, 4: "raw || '/1990'"})
Q["d_ml"] = lambda spark, sf_dir: _dated(spark, sf_dir).select("doc_id", "seq", dates.in_line(F.concat(F.lit("on "), F.col("raw"), F.lit(" paid"))).cast("string").alias("parsed"))
# the first pattern also matches inside a year that comes first: 2001-07-13 reads as month 01, day 07, year 13
S["d_ml"] = "WITH " + _RAW + f" SELECT doc_id, seq, CASE WHEN seq % 11 IN (2, 6) AND year(txn_date) % 100 BETWEEN 1 AND 12 THEN '20' || strftime(txn_date, '%d-%y-%m') WHEN seq % 11 IN (0, 1, 2, 3, 6) THEN {_iso} WHEN seq % 11 = 5 AND day(txn_date) <= 12 THEN strftime(txn_date, '%Y-%d-%m') END AS parsed FROM raws"
Q["d_year_hint"] = lambda spark, sf_dir: V.texts(spark, sf_dir).select("doc_id", dates.year_hint(F.col("text"), 1990).alias("year"))
S["d_year_hint"] = "WITH " + V.TEXTS + " SELECT doc_id, CAST(coalesce(nullif(regexp_extract(text, '[0-9]{1,2}/[0-9]{1,2}/(20[0-9]{2})', 1), ''), '1990') AS INTEGER) AS year FROM texts"
Q["flt_date_tok"] = lambda spark, sf_dir: _dated(spark, sf_dir).where(_is_date(F.col("raw"))).select("doc_id", "seq")


def _is_date(c: Column) -> Column:
    from ..operators.geometry import is_date

    return is_date(c)


S["flt_date_tok"] = "WITH " + _RAW + " SELECT doc_id, seq FROM raws WHERE regexp_matches(raw, '" + "|".join(rules.DATE_TOKENS) + "|" + rules.DAY_TOKEN + "') OR lower(raw) IN (" + ", ".join(f"'{m}'" for m in rules.MONTHS) + ")"

# --- lines of statement texts
_DATE, _MONEY = r"[0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?", r"\$?[0-9,]+\.[0-9]{2}"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(V.texts(spark, sf_dir))


def flt_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with three amounts, two dates and five lines at least."""
    t = V.texts(spark, sf_dir)
    n = lambda p: F.regexp_count("text", F.lit(p))
    return t.where((n(_MONEY) >= 3) & (n(_DATE) >= 2) & (F.size(F.split("text", "\n")) >= 5)).select("doc_id")


Q["flt_indicators"] = flt_indicators
S["flt_indicators"] = "WITH " + V.TEXTS + f" SELECT doc_id FROM texts WHERE len(regexp_extract_all(text, '{_MONEY}')) >= 3 AND len(regexp_extract_all(text, '{_DATE}')) >= 2 AND len(string_split(text, chr(10))) >= 5"
Q["flt_prefilter"] = lambda spark, sf_dir: _lines(spark, sf_dir).where((F.col("pos") < 10_000) & (F.length("line") <= 500) & F.col("line").rlike(r"\d{1,2}/\d{1,2}") & F.col("line").rlike(rules.MONEY2)).select("doc_id", "pos")
S["flt_prefilter"] = "WITH " + V.TEXTS + f" SELECT doc_id, pos FROM text_lines WHERE pos < 10000 AND length(line) <= 500 AND regexp_matches(line, '[0-9]{{1,2}}/[0-9]{{1,2}}') AND regexp_matches(line, '{rules.MONEY2}')"
Q["flt_skip_lists"] = lambda spark, sf_dir: _lines(spark, sf_dir).where(~F.col("line").rlike("(?i)" + "|".join(rules.ROW_SKIP["Citibank"]))).select("doc_id", "pos")
S["flt_skip_lists"] = "WITH " + V.TEXTS + " SELECT doc_id, pos FROM text_lines WHERE NOT regexp_matches(line, '(?i)" + "|".join(rules.ROW_SKIP["Citibank"]) + "')"
Q["flt_postcluster"] = lambda spark, sf_dir: _lines(spark, sf_dir).where(~text.is_summary(F.col("line")) & (F.col("line").rlike(_DATE) | (F.length(F.trim("line")) > 3))).select("doc_id", "pos")
_d = "lower(trim(line))"
S["flt_postcluster"] = "WITH " + V.TEXTS + f" SELECT doc_id, pos FROM text_lines WHERE NOT ({_d} = '' OR " + " OR ".join(f"contains({_d}, '{p}')" for p in rules.SUMMARY_FILTER) + f" OR {_d} IN ({', '.join(repr(x) for x in rules.BARE_FILTER)}) OR regexp_matches({_d}, '{rules.PERCENT}')) AND (regexp_matches(line, '{_DATE}') OR length(trim(line)) > 3)"
_W = ["CASE WHEN regexp_matches(line, '{d}') AND regexp_matches(line, '{m}') THEN 1 ELSE 0 END", "CASE WHEN regexp_matches(line, '{m}') AND length(regexp_replace(line, '^.*{m}', '')) < 10 THEN 1 ELSE 0 END", "CASE WHEN regexp_matches(line, '^\\s*\\*+[0-9]{{4}}') THEN 1 ELSE 0 END", "CASE WHEN " + " OR ".join(f"contains(lower(line), '{w}')" for w in rules.MERCHANT_TERMS) + " THEN 1 ELSE 0 END", "CASE WHEN length(line) BETWEEN 20 AND 200 THEN 1 ELSE 0 END", "CASE WHEN " + " OR ".join(f"contains(lower(line), '{w}')" for w in rules.SUMMARY_TERMS) + " THEN 0 ELSE 1 END"]
_WEAK = "CASE WHEN (" + " + ".join(w.format(d=_DATE, m=_MONEY) if "{d}" in w or "{m}" in w or "{{" in w else w for w in _W) + ") / 6.0 > 0.5 THEN 1 ELSE 0 END"
Q["x_weak_label"] = lambda spark, sf_dir: _lines(spark, sf_dir).select("doc_id", "pos", features.weak_label(F.col("line")).alias("label"))
S["x_weak_label"] = "WITH " + V.TEXTS + f" SELECT doc_id, pos, {_WEAK} AS label FROM text_lines"
Q["x_line_feats"] = lambda spark, sf_dir: features.line_features(_lines(spark, sf_dir).select("doc_id", "pos", F.col("line").alias("text"), F.lit(30.0).alias("x0"), F.lit(336.0).alias("x1"))).select("doc_id", "pos", "n_tokens", "n_chars", "n_digits", "n_letters", "has_money", "n_money", "has_date", "n_dates", F.round("center_ratio", 6).alias("center_ratio"), F.round("digit_ratio", 6).alias("digit_ratio"))
S["x_line_feats"] = "WITH " + V.TEXTS + f", l AS (SELECT *, len(regexp_extract_all(line, '[0-9]')) AS dg FROM text_lines) SELECT doc_id, pos, CASE WHEN trim(line) = '' THEN 0 ELSE len(regexp_split_to_array(trim(line), '\\s+')) END AS n_tokens, length(line) AS n_chars, dg AS n_digits, len(regexp_extract_all(line, '[A-Za-z]')) AS n_letters, regexp_matches(line, '{_MONEY}')::INT AS has_money, len(regexp_extract_all(line, '{_MONEY}')) AS n_money, regexp_matches(line, '{_DATE}')::INT AS has_date, len(regexp_extract_all(line, '{_DATE}')) AS n_dates, round((30.0 + 336.0) / 2 / 612.0, 6)::DOUBLE AS center_ratio, round(dg / greatest(length(line), 1), 6) AS digit_ratio FROM l"


def x_cluster_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of given clusters: here the lines of a document by their place."""
    lines = _lines(spark, sf_dir).select((F.col("pos") % 12).alias("cluster"), F.col("line").alias("text"))
    return features.cluster_scores(lines).withColumn("score", F.round("score", 6))


Q["x_cluster_score"] = x_cluster_score
S["x_cluster_score"] = "WITH " + V.TEXTS + f", f AS (SELECT pos % 12 AS cluster, regexp_matches(line, '{_MONEY}')::INT AS m, regexp_matches(line, '{_DATE}')::INT AS d, CASE WHEN trim(line) = '' THEN 0 ELSE len(regexp_split_to_array(trim(line), '\\s+')) END AS k, length(line) AS c, ({' OR '.join(f'contains(lower(line), {w!r})' for w in rules.SUMMARY_TERMS)})::INT AS s, {_WEAK} AS w FROM text_lines) SELECT cluster, round((avg(m) * 0.3 + avg(d) * 0.2 + least(avg(k) / 10, 1) * 0.1 + least(avg(c) / 50, 1) * 0.1 + (1 - avg(s)) * 0.1) * 0.6 + avg(w) * 0.4, 6) AS score, count(*) AS n_lines FROM f GROUP BY 1"


def x_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights after a history of successes: each type of event is a parser, its success drifts."""
    e = V.read(spark, sf_dir, "events")
    history = e.select(F.col("event_type").alias("parser"), F.col("event_id").alias("at"), (F.floor(F.col("event_id") / 60) % 5 / 4.0).alias("success"))
    out = features.adapted_weights(history)
    return out.select("parser", *[F.round(c, 6).alias(c) for c in out.columns if c != "parser"])


Q["x_weights"] = x_weights
_LOW, _HIGH = rules.PARSER_STEPS["confidence"], rules.PARSER_GOOD_STEP
_MOVED = {k: f"least({most}, {rules.PARSER_WEIGHTS[k]} + poor * {step})" for k, (step, most) in rules.PARSER_STEPS.items() if k != "confidence"}
_NOW = {**{k: str(v) for k, v in rules.PARSER_WEIGHTS.items()}, **_MOVED, "ai_plain": f"1 - {_MOVED['ai_weak']}", "confidence": f"list_reduce([{rules.PARSER_WEIGHTS['confidence']}::DOUBLE] || vs, lambda x, v: CASE WHEN v < 0 THEN greatest({_LOW[1]}, x + v) WHEN v > 0 THEN least({_HIGH[1]}, x + v) ELSE x END)"}
S["x_weights"] = f"WITH h AS (SELECT event_type AS parser, event_id AS t, floor(event_id / 60) % 5 / 4.0 AS success FROM events), r AS (SELECT parser, t, avg(success) OVER w AS recent, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY parser ORDER BY t, success ROWS {rules.PARSER_RECENT - 1} PRECEDING)), v AS (SELECT parser, t, CASE WHEN n < {rules.PARSER_RECENT} THEN 0 WHEN recent < {rules.PARSER_POOR} THEN {_LOW[0]} WHEN recent > {rules.PARSER_GOOD} THEN {_HIGH[0]} ELSE 0 END::DOUBLE AS v FROM r), g AS (SELECT parser, list(v ORDER BY t) AS vs, sum((v < 0)::INT) AS poor FROM v GROUP BY 1) SELECT parser, " + ", ".join(f"round(({v})::DOUBLE, 6) AS {k}" for k, v in _NOW.items()) + " FROM g"
Q["x_strategy"] = lambda spark, sf_dir: V.read(spark, sf_dir, "documents").select("doc_id", P.strategy(F.length("text")).alias("strategy"))
S["x_strategy"] = "SELECT doc_id, CASE WHEN length(text) < 1000 THEN 'pattern_based' WHEN length(text) < 3000 THEN 'light_clustering' WHEN length(text) < 8000 THEN 'adaptive_clustering' ELSE 'full_clustering' END AS strategy FROM documents"
Q["s_fingerprint"] = lambda spark, sf_dir: V.texts(spark, sf_dir).select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))
_head = "array_to_string(list_transform(list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:3], lambda x: regexp_replace(upper(x), '[^A-Z]', '', 'g')), lambda x: length(x) >= 3), lambda x: substr(x, 1, 24)), '|')"
S["s_fingerprint"] = "WITH " + V.TEXTS + f", c AS (SELECT doc_id, {_head} AS head, len(regexp_extract_all(text, '\\b[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}\\b')) AS a, len(regexp_extract_all(text, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b')) AS b, len(regexp_extract_all(text, '\\b[0-9]{{1,2}}\\s[A-Z][a-z]{{2}}\\b')) AS d FROM texts) SELECT doc_id, substr(sha1('{{\"dominant_date_format\": \"' || CASE WHEN greatest(a, b, d) = 0 THEN 'none' WHEN a = greatest(a, b, d) THEN 'mdy' WHEN b = greatest(a, b, d) THEN 'ymd' ELSE 'dmon' END || '\", \"header\": \"' || head || '\"}}'), 1, 16) AS fingerprint FROM c"
Q["x_json"] = lambda spark, sf_dir: V.read(spark, sf_dir, "events").select("event_id", loose_json(F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))).alias("v")).select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"))


def loose_json(said: Column) -> Column:
    """JSON inside a reply: the whole text, else what a fence holds, else the outermost braces or brackets."""
    fenced = F.regexp_extract(said, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(F.try_parse_json(F.trim(said)), F.try_parse_json(F.nullif(fenced, F.lit(""))), F.try_parse_json(F.nullif(F.regexp_extract(said, r"(?s)(\{.*\})", 1), F.lit(""))), F.try_parse_json(F.nullif(F.regexp_extract(said, r"(?s)(\[.*\])", 1), F.lit(""))))


S["x_json"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"

# positions and counts are 32-bit in Spark
for _n, _c in (("flt_prefilter", ("pos",)), ("flt_skip_lists", ("pos",)), ("flt_postcluster", ("pos",)), ("x_weak_label", ("pos",)), ("x_cluster_score", ("cluster",)), ("x_line_feats", ("pos", "n_tokens", "n_chars", "n_digits", "n_letters", "n_money", "n_dates"))):
    S[_n] = V.ints(S[_n], *_c)

QUERIES, ORACLE_SQL = Q, S
