"""Ledger tables derived from the driver's tables: rows, stated totals, words and statement texts.

Each view is given twice, as a DataFrame and as the SQL of a common table expression, so that a query
and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DESCRIPTIONS = (
    "CHECKCARD 0412 UBER TRIP 8005928996 CA", "POS Debit- Debit Card 0972 STARBUCKS #0387 SEATTLEWA", "PAYMENT THANK YOU", "Previous Balance",
    "AMAZON WEB SERVICES AWS.AMAZON.CO 80155432864", "12/27 SHELL OIL 57442 ATLANTA GA", "Zelle payment to JONES", "VERIZON WIRELESS 800-922-0204 NJ",
    "", "OFFICE DEPOT #1127 8005551234567890", "STAPLES 00112233445566 TX", "Recurring Payment GITHUB INC", "Interest charged on purchases",
    "T42*ABCDEFGHIJKL9 HOTEL MARRIOTT MIAMIFL", "qt 442 fuel", "McDonald's F1234 null", "purchase authorized on 11/03 LYFT RIDE 42", "new balance", "20.49% purchase rate", "ab",
)


def ints(sql: str, *names: str) -> str:
    """``sql`` with the named columns as 32-bit integers, as Spark's lengths and sizes are."""
    return "SELECT * REPLACE (" + ", ".join(f"CAST({n} AS INTEGER) AS {n}" for n in names) + f") FROM ({sql})"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of documents of five customers each."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    raw = F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(day, "MM/dd/yyyy")).when(k % 4 == 2, F.date_format(day, "MM/dd")).otherwise(F.lit(""))
    cents = (k % 23 * 5).cast("decimal(18,2)") + F.lit("0.25").cast("decimal(18,2)")
    return o.select(
        F.floor(F.col("o_custkey") / 5).cast("long").alias("doc_id"), k.alias("seq"), day.alias("txn_date"), raw.alias("date_raw"),
        F.element_at(F.array(*[F.lit(d) for d in DESCRIPTIONS]), (k % len(DESCRIPTIONS) + 1).cast("int")).alias("description"),
        F.when(F.col("o_orderstatus") == "F", -cents).otherwise(cents).cast("decimal(18,2)").alias("amount"),
        (k % 3 + 1).cast("int").alias("page"), k.cast("double").alias("line_top"),
        F.when(F.col("o_custkey") % 2 == 0, "checking").otherwise("savings").alias("account"),
    )


_LIST = "[" + ", ".join("'" + d.replace("'", "''") + "'" for d in DESCRIPTIONS) + "]"
TXNS = f"""
txns AS (
  SELECT CAST(floor(o_custkey / 5) AS BIGINT) AS doc_id, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS txn_date,
    CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%d') ELSE '' END AS date_raw,
    {_LIST}[o_orderkey % {len(DESCRIPTIONS)} + 1] AS description,
    CAST((CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) * (CAST(o_orderkey % 23 * 5 AS DECIMAL(15,2)) + CAST(0.25 AS DECIMAL(15,2))) AS DECIMAL(18,2)) AS amount,
    CAST(o_orderkey % 3 + 1 AS INTEGER) AS page, CAST(o_orderkey AS DOUBLE) AS line_top,
    CASE WHEN o_custkey % 2 = 0 THEN 'checking' ELSE 'savings' END AS account
  FROM orders
)"""


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``txns`` with running balances; some are off by two cents, and some documents have none."""
    w = W.partitionBy("doc_id", "account").orderBy("page", "line_top", "seq").rowsBetween(W.unboundedPreceding, 0)
    off = F.when(F.col("seq") % 97 == 0, F.lit("0.02")).otherwise(F.lit("0.00")).cast("decimal(18,2)")
    total = (F.sum("amount").over(w) + F.lit("1000.00").cast("decimal(18,2)") + off).cast("decimal(18,2)")
    return txns(spark, sf_dir).withColumn("running_balance", F.when(F.col("doc_id") % 6 < 4, total))


BALANCED = (
    TXNS
    + """, balanced AS (
  SELECT *, CASE WHEN doc_id % 6 < 4 THEN CAST(sum(amount) OVER (PARTITION BY doc_id, account ORDER BY page, line_top, seq ROWS UNBOUNDED PRECEDING) + 1000 + CASE WHEN seq % 97 = 0 THEN 0.02 ELSE 0.00 END AS DECIMAL(18,2)) END AS running_balance FROM txns
)"""
)


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated totals by document: which are stated, and how far off, goes by the document's number."""
    a, d = F.col("amount"), F.col("doc_id")
    cents = "decimal(18,2)"
    s = txns(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.when(a > 0, a).otherwise(0)).cast(cents).alias("up"), F.sum(F.when(a < 0, -a).otherwise(0)).cast(cents).alias("down"))
    off = F.when(d % 7 == 0, F.lit("0.01")).when(d % 7 == 1, F.lit("0.02")).otherwise(F.lit("0.00")).cast(cents)
    kind, none = d % 6, F.lit(None).cast(cents)
    at = lambda k, v: F.when(kind == k, v).otherwise(none).cast(cents)
    return s.select(
        "doc_id", at(0, F.col("up") + off).alias("charges"), at(2, F.lit("3.00").cast(cents)).alias("fees"), at(2, F.lit("1.50").cast(cents)).alias("interest"),
        at(2, F.lit("100.00").cast(cents)).alias("previous_balance"), at(2, F.col("up") - F.col("down") + F.lit("104.50").cast(cents) + off).alias("new_balance"),
        at(4, F.lit("50.00").cast(cents)).alias("ending_balance"), none.alias("beginning_balance"),
        at(1, F.col("up") + off).alias("deposits"), at(1, -F.col("down")).alias("withdrawals"),
    )


STATED = """, stated AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN up + off END AS charges, CASE doc_id % 6 WHEN 2 THEN 3.00 END AS fees, CASE doc_id % 6 WHEN 2 THEN 1.50 END AS interest,
    CASE doc_id % 6 WHEN 2 THEN 100.00 END AS previous_balance, CASE doc_id % 6 WHEN 2 THEN up - down + 104.50 + off END AS new_balance, CASE doc_id % 6 WHEN 4 THEN 50.00 END AS ending_balance,
    CASE doc_id % 6 WHEN 1 THEN up + off END AS deposits, CASE doc_id % 6 WHEN 1 THEN -down END AS withdrawals
  FROM (SELECT doc_id, sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS up, sum(CASE WHEN amount < 0 THEN -amount ELSE 0 END) AS down,
          CASE doc_id % 7 WHEN 0 THEN 0.01 WHEN 1 THEN 0.02 ELSE 0.00 END AS off FROM txns GROUP BY doc_id)
)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of an order's lines: a date, a name, an amount and, on even orders, a balance."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rn = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")).alias("rn")
    base = li.select(F.col("l_orderkey").alias("doc_id"), rn, "l_partkey", "l_extendedprice", "l_shipdate")
    page, top = (F.floor((F.col("rn") - 1) / 4) + 1).cast("int"), F.col("rn") * 12.0
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    box = lambda i, t, x0, x1, dy, keep=F.lit(True): F.when(keep, F.struct((F.col("rn") * 4 + i).cast("long").alias("word_id"), t.alias("text"), F.lit(x0).cast("double").alias("x0"), (F.lit(x1) + F.col("rn") % 3 * 0.5).cast("double").alias("x1"), (top + dy).alias("top"), (top + dy + 8).alias("bottom")))
    all_ = F.array_compact(F.array(
        box(0, F.date_format("l_shipdate", "MM/dd"), 30.0, 55.0, 0.0), box(1, F.concat(F.lit("ITEM"), F.col("l_partkey")), 80.0, 150.0, 1.0),
        box(2, F.format_number(amount, 2), 420.0, 473.0, 2.0), box(3, F.format_number(amount * 2, 2), 540.0, 594.0, 0.5, F.col("doc_id") % 2 == 0),
    ))
    return base.select("doc_id", page.alias("page"), F.col("rn").alias("true_line"), F.explode(all_).alias("w")).select("doc_id", "page", "w.*", "true_line")


WORDS = """
lines0 AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_shipdate FROM lineitem
), words AS (
  SELECT doc_id, CAST(floor((rn - 1) / 4) + 1 AS INTEGER) AS page, rn * 4 + i AS word_id, text, x0, x1 + rn % 3 * 0.5 AS x1, rn * 12.0 + dy AS top, rn * 12.0 + dy + 8 AS bottom, rn AS true_line
  FROM (
    SELECT doc_id, rn, 0 AS i, strftime(l_shipdate, '%m/%d') AS text, 30.0::DOUBLE AS x0, 55.0::DOUBLE AS x1, 0.0::DOUBLE AS dy FROM lines0
    UNION ALL SELECT doc_id, rn, 1, 'ITEM' || l_partkey, 80.0, 150.0, 1.0 FROM lines0
    UNION ALL SELECT doc_id, rn, 2, format('{:,.2f}', CAST(amount AS DOUBLE)), 420.0, 473.0, 2.0 FROM lines0
    UNION ALL SELECT doc_id, rn, 3, format('{:,.2f}', CAST(amount * 2 AS DOUBLE)), 540.0, 594.0, 0.5 FROM lines0 WHERE doc_id % 2 = 0
  )
)"""

SHAPES = ("{d} {n} {a}", "{d} {n} -${a}", "Total fees for this period ${a}", "New Balance ... ${a}", "Total interest charged in 2025 ${a}", "previous balance ({a})", "{n} continued", "Total deposits {n} = +${a}", "08/24/24 08/26/24 24269794238500664550107 {n} SC ${a}", "Jun 2 Jun 3 {n} ${a}", "07-11 {n} {a}- 314.26", "{d} {d} {n} ${a}", "{f} {n} -${a}")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement texts (doc_id, text) of five customers each, one line for each order."""
    t = txns(spark, sf_dir).withColumn("n", F.upper(F.concat(F.lit("Shop "), F.col("seq") % 7)))
    line = F.lit(None).cast("string")
    for i, shape in enumerate(SHAPES):
        made = F.replace(F.replace(F.replace(F.replace(F.lit(shape), F.lit("{f}"), F.date_format("txn_date", "MM/dd/yyyy")), F.lit("{d}"), F.date_format("txn_date", "MM/dd")), F.lit("{n}"), F.col("n")), F.lit("{a}"), F.format_number(F.abs("amount"), 2))
        line = F.when(F.col("seq") % len(SHAPES) == i, made).otherwise(line)
    grouped = t.withColumn("line", line).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("ls"))
    head = F.concat(F.when(F.col("doc_id") % 5 == 0, "Chase Bank").when(F.col("doc_id") % 5 == 1, "CITIBANK, N.A. online.citi.com").when(F.col("doc_id") % 5 == 2, "Navy Federal Credit Union").when(F.col("doc_id") % 5 == 3, "Capital One").otherwise("Statement"), F.lit("\nStatement 01/15/2025\n"))
    return grouped.select("doc_id", F.concat(head, F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"))


def _sql_shape(shape: str) -> str:
    out = "'" + shape + "'"
    return f"replace(replace(replace(replace({out}, '{{f}}', strftime(txn_date, '%m/%d/%Y')), '{{d}}', strftime(txn_date, '%m/%d')), '{{n}}', 'SHOP ' || seq % 7), '{{a}}', format('{{:,.2f}}', CAST(abs(amount) AS DOUBLE)))"


TEXTS = (
    TXNS
    + ", lines1 AS (SELECT doc_id, seq, CASE seq % "
    + str(len(SHAPES))
    + " ".join(f" WHEN {i} THEN {_sql_shape(s)}" for i, s in enumerate(SHAPES))
    + """ END AS line FROM txns), texts AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Chase Bank' WHEN 1 THEN 'CITIBANK, N.A. online.citi.com' WHEN 2 THEN 'Navy Federal Credit Union' WHEN 3 THEN 'Capital One' ELSE 'Statement' END
    || chr(10) || 'Statement 01/15/2025' || chr(10) || string_agg(line, chr(10) ORDER BY seq) AS text FROM lines1 GROUP BY doc_id
), text_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM texts)"""
)
