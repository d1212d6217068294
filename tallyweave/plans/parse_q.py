"""Row parsers, bank detection and layout fingerprints over statement texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..functions import money
from ..operators import detect as D
from ..operators import parse_rows as P
from ..operators.reconcile import lines_of
from . import views as V

Q: dict = {}
S: dict[str, str] = {}
YEAR = 2025


def _esc(s: str) -> str:
    return s.replace("'", "''")


def _parse(bank: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = P.parse(V.texts(spark, sf_dir), bank, YEAR)
        return rows.select("doc_id", F.col("pos").cast("long"), "kind", F.col("txn_date").cast("string"), "description", F.col("amount").cast("double"), "type")

    return run


#: SQL of each kind's date (from group d), by bank; the texts state the year 2025.
_DAY = {
    "card_state": "strptime({d}, '%m/%d/%y')", "card": "strptime({d}, '%m/%d/%y')", "checking": "try_strptime('2025-' || {d}, '%Y-%m-%d')",
    "two_dates_text": "try_strptime({d} || ' 2025', '%b %d %Y')", "md": "try_strptime('2025/' || {d}, '%Y/%m/%d')",
}


def _sql(bank: str) -> str:
    skip = rules.ROW_SKIP[bank]
    where = "line <> '' AND " + "length(line) <= 500 AND " * (bank == "Citibank") + "regexp_matches(line, '[0-9]')" + (f" AND NOT regexp_matches(line, '(?i){'|'.join(f'(?:{_esc(x)})' for x in skip)}')" if skip else "")
    cases = {"kind": [], "txn_date": [], "description": [], "amount": [], "keep": [], "type": []}
    for p in rules.ROW_PATTERNS[bank]:
        rx = ("" if bank == "Chase" and not p.date else "(?i)") + p.regex
        hit = f"regexp_matches(line, '{_esc(rx)}')"
        g = lambda i, rx=rx: f"regexp_extract(line, '{_esc(rx)}', {i})"
        d, said, a = g(p.date), f"trim({g(p.text)})", g(p.amount)
        number = "TRY_CAST(regexp_replace({a}, '[$,\\s]', '', 'g') AS DOUBLE)"
        amount, keep, side = number.format(a=a), "true", "'debit'"
        if bank == "Navy Federal":
            day = _DAY[p.kind].format(d=d)
            amount = number.format(a=f"rtrim({a}, '-')")
            if p.kind == "card_state":
                said = f"{said} || ' ' || {g(p.more)}"
            side = "'debit'" if p.kind != "checking" else f"CASE WHEN ends_with({a}, '-') THEN 'debit' ELSE 'credit' END"
        elif bank == "Capital One":
            day = _DAY["md"].format(d=d) if p.kind == "numeric" else _DAY["two_dates_text"].format(d=d)
            keep = f"NOT (contains({said}, ' - ') OR ends_with({said}, ' -'))"
        elif bank == "Citibank":
            day = f"CASE WHEN regexp_matches({d}, '^[0-9]+/[0-9]+$') THEN {_DAY['md'].format(d=d)} ELSE coalesce(try_strptime({d}, '%m/%d/%y'), try_strptime({d}, '%m/%d/%Y')) END"
            if p.kind == "autopay":
                said = f"'AUTOPAY ' || {said}"
            keep, amount = f"{amount} <> 0", f"abs({amount})"
        elif bank == "Bank of America":
            day = f"coalesce(try_strptime(CASE WHEN regexp_matches({d}, '/[0-9]{{2}}$') THEN {d} END, '%m/%d/%y'), try_strptime({d}, '%m/%d/%Y'))"
            keep, amount = f"{amount} <= 0", f"abs({amount})"
        else:
            day = _DAY["md"].format(d=d) if p.date else "TIMESTAMP '2025-01-01'"
            keep = f"{amount} >= 0"
        for k, v in (("kind", f"'{p.kind}'"), ("txn_date", f"strftime({day}, '%Y-%m-%d')"), ("description", said), ("amount", amount), ("keep", keep), ("type", side)):
            cases[k].append(f"WHEN {hit} THEN {v}")
    columns = ", ".join(f"CASE {' '.join(v)} END AS {k}" for k, v in cases.items())
    return "WITH " + V.TEXTS + f", cleaned AS (SELECT doc_id, pos, trim(line) AS line FROM text_lines), picked AS (SELECT * FROM cleaned WHERE {where}), parsed AS (SELECT doc_id, pos, {columns} FROM picked) SELECT doc_id, pos, kind, txn_date, description, amount, type FROM parsed WHERE keep AND txn_date IS NOT NULL AND amount IS NOT NULL"


for _short, _bank in (("navy", "Navy Federal"), ("capone", "Capital One"), ("citi", "Citibank"), ("bofa", "Bank of America"), ("chase", "Chase")):
    Q[f"p_{_short}"] = _parse(_bank)
    S[f"p_{_short}"] = _sql(_bank)
Q["p_generic"] = lambda spark, sf_dir: P.generic(V.texts(spark, sf_dir)).select("doc_id", "pos", F.col("txn_date").cast("string"), "description", F.col("amount").cast("double"))
Q["jn_range_orphan"] = lambda spark, sf_dir: P.orphans(_orphan_lines(spark, sf_dir)).select("doc_id", "line_at", "said", "money_at", F.col("amount").cast("double"))


def _orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ledger documents where some amounts stand on a later line."""
    t = V.txns(spark, sf_dir)
    line = F.when(F.col("seq") % 3 == 0, F.concat(F.date_format("txn_date", "MM/dd"), F.lit(" SHOP"))).when(F.col("seq") % 3 == 1, F.concat(F.lit("$"), F.format_number(F.abs("amount"), 2))).otherwise(F.lit("page header"))
    return t.select("doc_id", F.col("seq").alias("pos"), line.alias("line"))


S["jn_range_orphan"] = "WITH " + V.TXNS + """, w AS (SELECT doc_id, seq AS line_at, strftime(txn_date, '%m/%d') || ' SHOP' AS said FROM txns WHERE seq % 3 = 0), h AS (SELECT doc_id, seq AS money_at, CAST(abs(amount) AS DOUBLE) AS amount FROM txns WHERE seq % 3 = 1)
SELECT doc_id, line_at, said, money_at, amount FROM w JOIN h USING (doc_id) WHERE abs(money_at - line_at) <= 10 QUALIFY row_number() OVER (PARTITION BY doc_id, line_at ORDER BY abs(money_at - line_at), money_at) = 1"""

# --- detection
_UP = "upper(text)"
_some = lambda words: "(" + " OR ".join(f"contains({_UP}, '{_esc(w)}')".replace("\n", "' || chr(10) || '") for w in words) + ")" if words else "false"
_BRAND = "CASE " + " ".join(f"WHEN {_some(b.sure)} OR ({_some(b.maybe)} AND NOT {_some(b.unless)}) THEN '{b.bank}'" for b in rules.BRANDS) + " END"
Q["jn_registry"] = lambda spark, sf_dir: V.texts(spark, sf_dir).select("doc_id", D.by_brand(F.col("text")).alias("bank"))
S["jn_registry"] = "WITH " + V.TEXTS + f" SELECT doc_id, {_BRAND} AS bank FROM texts"


def p_detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand predicate of every text."""
    return V.texts(spark, sf_dir).select("doc_id", *[D.brand_matches(F.col("text"), b).alias("is_" + b.bank.lower().replace(" ", "_")) for b in rules.BRANDS])


Q["p_detect_all"] = p_detect_all
S["p_detect_all"] = "WITH " + V.TEXTS + " SELECT doc_id, " + ", ".join(f"({_some(b.sure)} OR ({_some(b.maybe)} AND NOT {_some(b.unless)})) AS is_{b.bank.lower().replace(' ', '_')}" for b in rules.BRANDS) + " FROM texts"
_points = lambda heads, date: " + ".join(f"CASE WHEN regexp_matches(text, '(?i){_esc(h)}') THEN 20 ELSE 0 END" for h in heads) + (f" + CASE WHEN len(regexp_extract_all(text, '{date}')) > 5 THEN 20 ELSE 0 END" if date else "")
_SCORED = "WITH " + V.TEXTS + ", scored AS (" + " UNION ALL ".join(f"SELECT doc_id, '{bank}' AS bank, {i} AS ord, ({_points(heads, date)}) / {20.0 * (len(heads) + bool(date))} * 100 AS score FROM texts" for i, (bank, heads, date) in enumerate(rules.LAYOUT_SIGNATURES)) + "), layout AS (SELECT doc_id, bank, score FROM scored WHERE score > 60 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) = 1)"
Q["x_layout_score"] = lambda spark, sf_dir: V.texts(spark, sf_dir).select("doc_id", F.array_max(D.layout_scores(F.col("text"))).alias("b")).where("b is not null").select("doc_id", "b.bank", F.round("b.score", 6).alias("score"))
S["x_layout_score"] = _SCORED + " SELECT doc_id, bank, round(score, 6) AS score FROM layout"


def _proposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.texts(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 == 4, "Wells Fargo").otherwise("Capital One").alias("ai_bank"), F.when(F.col("doc_id") % 2 == 0, 80.0).otherwise(40.0).alias("ai_confidence"))


Q["p_detect"] = lambda spark, sf_dir: D.detect(V.texts(spark, sf_dir), _proposed(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))
S["p_detect"] = _SCORED + f""", r AS (SELECT doc_id, {_BRAND} AS r_bank, CASE WHEN doc_id % 5 = 4 THEN 'Wells Fargo' ELSE 'Capital One' END AS a_bank, CASE WHEN doc_id % 2 = 0 THEN 80.0 ELSE 40.0 END::DOUBLE AS a_conf FROM texts), x AS (
  SELECT r.*, CASE WHEN r_bank IN ('Navy Federal', 'Chase', 'Citibank') THEN 90.0 WHEN r_bank IS NOT NULL THEN 75.0 END::DOUBLE AS r_conf, l.bank AS l_bank, l.score AS l_conf FROM r LEFT JOIN layout l USING (doc_id)
), votes AS (SELECT doc_id, bank, sum(w) AS w FROM (SELECT doc_id, r_bank AS bank, r_conf AS w FROM x UNION ALL SELECT doc_id, l_bank, l_conf * 0.8 FROM x UNION ALL SELECT doc_id, a_bank, a_conf * 0.9 FROM x) WHERE bank IS NOT NULL GROUP BY ALL),
c AS (SELECT doc_id, bank, w FROM votes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, bank DESC) = 1)
SELECT x.doc_id, CASE WHEN r_conf >= 80 THEN r_bank WHEN l_conf >= 70 THEN l_bank WHEN a_conf >= 75 THEN a_bank ELSE c.bank END AS bank,
  round(CASE WHEN r_conf >= 80 THEN r_conf WHEN l_conf >= 70 THEN l_conf WHEN a_conf >= 75 THEN a_conf ELSE least(c.w / 2.7, 65.0) END, 6) AS confidence,
  CASE WHEN r_conf >= 80 THEN 'regex' WHEN l_conf >= 70 THEN 'layout' WHEN a_conf >= 75 THEN 'ai' ELSE 'combined' END AS stage FROM x JOIN c USING (doc_id)"""


def x_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage-weighted votes of given results (doc_id, stage, bank, confidence): the best bank, at most 65."""
    weight = F.create_map(*[F.lit(x) for pair in rules.STAGE_WEIGHTS for x in pair])
    t = V.txns(spark, sf_dir).select("doc_id", F.element_at(F.array(F.lit("regex"), F.lit("layout"), F.lit("ai")), (F.col("seq") % 3 + 1).cast("int")).alias("stage"), F.concat(F.lit("Bank "), F.col("seq") % 4).alias("bank"), (F.col("seq") % 7).cast("double").alias("confidence"))
    total = t.groupBy("doc_id", "bank").agg(F.sum(F.col("confidence") * F.try_element_at(weight, F.col("stage"))).alias("w"))
    best = total.groupBy("doc_id").agg(F.max(F.struct(F.round("w", 6).alias("w"), "bank")).alias("b"))
    return best.select("doc_id", "b.bank", F.round(F.least(F.col("b.w") / 2.7, F.lit(65.0)), 5).alias("confidence"))


Q["x_combine"] = x_combine
S["x_combine"] = "WITH " + V.TXNS + " SELECT doc_id, bank, round(least(w / 2.7, 65.0), 5) AS confidence FROM (SELECT doc_id, 'Bank ' || seq % 4 AS bank, round(sum((seq % 7)::DOUBLE * [1.0, 0.8, 0.9][seq % 3 + 1]::DOUBLE), 6) AS w FROM txns GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, bank DESC) = 1"
Q["src_scanned_flag"] = lambda spark, sf_dir: D.is_scanned(V.read(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 4)).cast("long").alias("doc_id"), (F.col("doc_id") % 4 + 1).cast("int").alias("page"), "text"))
S["src_scanned_flag"] = "SELECT doc_id, n_chars, n_chars < 100 AS scanned FROM (SELECT CAST(floor(doc_id / 4) AS BIGINT) AS doc_id, CAST(sum(CASE WHEN doc_id % 4 < 3 THEN length(trim(text, ' ')) ELSE 0 END) AS BIGINT) AS n_chars FROM documents GROUP BY 1)"


def x_acct_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked account number and type of each statement."""
    t = V.texts(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\nAccount number: 12345"), F.col("doc_id"), F.lit("\nsavings")))
    number = F.nullif(F.regexp_extract("text", r"(?i)account\s+number:?\s*(\d{4,})", 1), F.lit(""))
    low = F.lower("text")
    kind = F.when(low.contains("credit card"), "credit").when(low.contains("checking"), "checking").when(low.contains("savings"), "savings").otherwise("unknown")
    return t.select("doc_id", money.mask(number).alias("account"), kind.alias("account_type"))


Q["x_acct_info"] = x_acct_info
S["x_acct_info"] = "WITH " + V.TEXTS + " SELECT doc_id, '****' || right('12345' || doc_id, 4) AS account, 'savings' AS account_type FROM texts"
Q["rec_lines"] = lambda spark, sf_dir: lines_of(V.texts(spark, sf_dir)).select("doc_id", F.col("pos").cast("long"), "line")
S["rec_lines"] = "WITH " + V.TEXTS + " SELECT doc_id, pos, line FROM text_lines"

QUERIES, ORACLE_SQL = Q, S
