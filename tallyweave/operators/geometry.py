"""Words with coordinates to lines, columns and raw rows.

Words: doc_id, page, word_id, text, x0, x1, top, bottom in points from the top left. A page is the unit
of the folds (its words fit in one row); documents and pages are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import money, text

PAGE = ("doc_id", "page")


def _numbered(sorted_tops: Column, tolerance: float, mean: bool) -> Column:
    """Line number of each of a page's tops, by a fold: a new line where a top is further than
    ``tolerance`` from the line's first top (or from the running mean)."""
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, top: Column) -> Column:
        new = acc["at"].isNull() | (F.abs(top - acc["at"]) > tolerance)
        line = acc["line"] + new.cast("int")
        n = F.when(new, 1).otherwise(acc["n"] + 1)
        moved = (acc["at"] * acc["n"] + top) / (acc["n"] + 1) if mean else acc["at"]
        return F.struct(F.when(new, top).otherwise(moved).alias("at"), n.alias("n"), line.alias("line"), F.array_append(acc["out"], line).alias("out"))

    return F.aggregate(sorted_tops, start, step, lambda acc: acc["out"])


def lines(words: DataFrame, tolerance: float = 3.0, mean: bool = False) -> DataFrame:
    """``words`` with line, from 1 on each page, by (top, x0)."""
    fields = [c for c in words.columns if c not in PAGE]
    w = F.sort_array(F.collect_list(F.struct("top", "x0", F.struct(*fields).alias("w")))).alias("ws")
    pages = words.groupBy(*PAGE).agg(w)
    numbered = pages.select(*PAGE, F.arrays_zip("ws", _numbered(F.transform("ws", lambda x: x["top"]), tolerance, mean).alias("line")).alias("z"))
    return numbered.select(*PAGE, F.explode("z").alias("z")).select(*PAGE, "z.ws.w.*", F.col("z.line").alias("line"))


def lines_by_gap(words: DataFrame, eps: float = 3.0) -> DataFrame:
    """One-dimensional density grouping of middles: a gap above ``eps`` starts a line, singletons go."""
    y = (F.col("top") + F.col("bottom")) / 2
    w = W.partitionBy(*PAGE).orderBy("_y", "x0", "word_id")
    gaps = words.withColumn("_y", y).withColumn("_new", F.coalesce(F.col("_y") - F.lag("_y").over(w) > eps, F.lit(True)).cast("int"))
    grouped = gaps.withColumn("line", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    many = grouped.withColumn("_n", F.count("*").over(W.partitionBy(*PAGE, "line"))).where("_n >= 2")
    return many.drop("_y", "_new", "_n")


def lines_by_bucket(words: DataFrame, reach: float = 2.0) -> DataFrame:
    """Each word joins the first line already there whose y is within ``reach``; words by word_id."""
    fields = [c for c in words.columns if c not in PAGE]
    w = F.struct("word_id", ((F.col("top") + F.col("bottom")) / 2).alias("y"), F.struct(*fields).alias("w"))
    pages = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(w)).alias("ws"))
    start = F.struct(F.array().cast("array<double>").alias("ys"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        near = F.array_position(F.transform(acc["ys"], lambda y: F.abs(y - w["y"]) <= reach), F.lit(True)).cast("int")
        line = F.when(near > 0, near).otherwise(F.size(acc["ys"]) + 1)
        return F.struct(F.when(near > 0, acc["ys"]).otherwise(F.array_append(acc["ys"], w["y"])).alias("ys"), F.array_append(acc["out"], line).alias("out"))

    # the words go through the fold: joined back, their numbers look small enough to broadcast and are not
    numbered = pages.select(*PAGE, F.explode(F.arrays_zip("ws", F.aggregate("ws", start, step, lambda acc: acc["out"]).alias("line"))).alias("z"))
    return numbered.select(*PAGE, "z.ws.w.*", F.col("z.line").alias("line"))


def tokens(chars: DataFrame, gap: float = 3.0) -> DataFrame:
    """Characters (doc_id, page, line, char, x0, x1) to tokens: a gap above ``gap`` starts one."""
    w = W.partitionBy(*PAGE, "line").orderBy("x0")
    cut = F.coalesce(F.col("x0") - F.lag("x1").over(w) > gap, F.lit(True)).cast("int")
    marked = chars.withColumn("_c", cut).withColumn("token", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "char"))), lambda c: c["char"]), "")
    return marked.groupBy(*PAGE, "line", "token").agg(joined.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def clusters(words: DataFrame, width: float = 5.0) -> DataFrame:
    """Right edges of amount words in buckets of ``width``: center, n and share of the page's largest."""
    amounts = words.where(money.looks_like_amount(F.col("text")))
    found = amounts.groupBy(*PAGE, (F.bround(F.col("x1") / width) * width).alias("bucket")).agg(F.avg("x1").alias("center"), F.count("*").alias("n"))
    top = F.max("n").over(W.partitionBy(*PAGE))
    return found.withColumn("top_n", top).withColumn("share", F.col("n") / top)


def columns(words: DataFrame) -> DataFrame:
    """amount_x1, balance_x1 and method of each page with amounts.

    Clusters of two or more and 15 % of the largest count; of several the two with the most words,
    the left one is the amount.
    """
    big = clusters(words).where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("top_n") * 0.15)))
    rn = F.row_number().over(W.partitionBy(*PAGE).orderBy(F.desc("n"), "center"))
    two = big.withColumn("rn", rn).where("rn <= 2").groupBy(*PAGE).agg(F.min("center").alias("amount_x1"), F.max("center").alias("hi"), F.count("*").alias("k"))
    return two.select(*PAGE, "amount_x1", F.when(F.col("k") > 1, F.col("hi")).alias("balance_x1"), F.when(F.col("k") > 1, "multi-col").otherwise("mode").alias("method"))


def rightmost_columns(words: DataFrame) -> DataFrame:
    """The variant by position: the two right-most significant clusters."""
    big = clusters(words).where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("top_n") * 0.15)))
    rn = F.row_number().over(W.partitionBy(*PAGE).orderBy(F.desc("center")))
    two = big.withColumn("rn", rn).where("rn <= 2").groupBy(*PAGE).agg(F.min("center").alias("amount_x1"), F.max("center").alias("hi"), F.count("*").alias("k"))
    return two.select(*PAGE, "amount_x1", F.when(F.col("k") > 1, F.col("hi")).alias("balance_x1"))


def classify(x1: Column, amount_x1: Column, balance_x1: Column, tolerance: float = 4.0) -> Column:
    near = lambda c: F.coalesce(F.abs(x1 - c) <= tolerance, F.lit(False))
    return F.when(near(amount_x1), "amount").when(near(balance_x1), "balance").otherwise("other")


def is_date(token: Column) -> Column:
    t = F.trim(token)
    hit = F.lower(t).isin(*rules.MONTHS) | t.rlike(rules.DAY_TOKEN)
    for p in rules.DATE_TOKENS:
        hit = hit | t.rlike(p)
    return F.coalesce(hit, F.lit(False))


def signed_card(amount: Column, line_text: Column, bank_type: str = "credit") -> Column:
    """Payments on a card turn negative."""
    if bank_type != "credit":
        return amount
    return F.when(text.any_of(F.upper(line_text), rules.PAYMENT_MARKERS) & (amount > 0), -amount).otherwise(amount)


def account_header(line_text: Column) -> Column:
    """The account name of a header line, else null."""
    return F.when(line_text.rlike(rules.ACCOUNT_WORD) & line_text.rlike(rules.ACCOUNT_NUMBER), F.substring(F.trim(line_text), 1, 50))


def raw_rows(words: DataFrame, plan: DataFrame, bank_type: str = "credit", date_limit: float = 200.0, run_gap: float = 20.0) -> DataFrame:
    """Rows of lines with one amount in the amount column, a date run at the left and a description.

    ``words`` have line; ``plan`` is that of ``columns``. Account headers tag the rows below them on
    the page and give no row. Lines with several amounts, without a date, without description words,
    and summary lines give none.
    """
    w = words.join(plan.select(*PAGE, "amount_x1", "balance_x1"), list(PAGE))
    w = w.withColumn("kind", classify(F.col("x1"), F.col("amount_x1"), F.col("balance_x1"))).withColumn("is_amount", money.looks_like_amount(F.col("text"))).withColumn("is_date", is_date(F.col("text")))
    box = F.struct("x0", "x1", "text", "kind", "is_amount", "is_date")
    by_line = w.groupBy(*PAGE, "line").agg(F.sort_array(F.collect_list(box)).alias("ws"), F.min("top").alias("line_top"))
    whole = F.array_join(F.transform("ws", lambda x: x["text"]), " ")
    by_line = by_line.withColumn("raw_text", whole).withColumn("_head", account_header(F.col("raw_text")))
    by_line = by_line.withColumn("account", F.last("_head", ignorenulls=True).over(W.partitionBy(*PAGE).orderBy("line").rowsBetween(W.unboundedPreceding, 0))).where("_head is null")
    in_column = F.filter("ws", lambda x: x["is_amount"] & (x["kind"] == "amount"))
    one = by_line.withColumn("_a", in_column).where(F.size("_a") == 1).withColumn("_a", F.get("_a", F.lit(0)))
    left = one.withColumn("_left", F.filter("ws", lambda x: x["x0"] < F.col("_a.x0")))
    dated = F.filter("_left", lambda x: x["is_date"] & (x["x0"] < date_limit))
    start = F.struct(F.lit(None).cast("double").alias("end"), F.array().cast("array<struct<x0:double,text:string>>").alias("run"), F.lit(False).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        over = acc["done"] | F.coalesce(x["x0"] - acc["end"] > run_gap, F.lit(False))
        return F.struct(F.when(over, acc["end"]).otherwise(x["x1"]).alias("end"), F.when(over, acc["run"]).otherwise(F.array_append(acc["run"], F.struct(x["x0"], x["text"]))).alias("run"), over.alias("done"))

    run = left.withColumn("_run", F.aggregate(dated, start, step, lambda acc: acc["run"]))
    rest = F.filter("_left", lambda x: ~(x["is_date"] & (x["x0"] < date_limit)) & (x["kind"] != "balance") & ~x["text"].isin("+", "-"))
    described = run.withColumn("_rest", rest).withColumn("_bal", F.get(F.filter("ws", lambda x: x["is_amount"] & (x["kind"] == "balance")), F.lit(0)))
    kept = described.where((F.size("_run") > 0) & ((F.size("_rest") == 0) | F.exists("_rest", lambda x: ~x["is_date"] & ~x["is_amount"])))
    description = F.regexp_replace(F.trim(F.array_join(F.transform("_rest", lambda x: x["text"]), " ")), r"\s+", " ")
    rows = kept.select(
        *PAGE, "line", "line_top", "account", "raw_text",
        F.array_join(F.transform("_run", lambda x: x["text"]), " ").alias("date_raw"),
        F.when(description == "", "(no description)").otherwise(description).alias("description"),
        signed_card(money.word(F.col("_a.text")), F.col("raw_text"), bank_type).alias("amount"),
        F.abs(money.word(F.col("_bal.text"))).alias("running_balance"),
    )
    return rows.where(F.col("amount").isNotNull() & ~text.is_summary(F.col("description"), rules.SUMMARY_GEOMETRY, rules.BARE_GEOMETRY))


def with_fallback(words: DataFrame, profile_plan: DataFrame, auto_plan: DataFrame, apart: float = 5.0) -> DataFrame:
    """Rows by the profile's columns; pages without any get those of their own columns, if these differ."""
    first = raw_rows(words, profile_plan)
    pages = auto_plan.join(first.select(*PAGE).distinct(), list(PAGE), "left_anti").join(profile_plan.select(*PAGE, F.col("amount_x1").alias("_p")), list(PAGE), "left")
    return first.unionByName(raw_rows(words, pages.where(F.col("_p").isNull() | (F.abs(F.col("amount_x1") - F.col("_p")) > apart)).drop("_p")).withColumn("account", F.lit(None).cast("string")))


def detected_x1(words: DataFrame, pages: int = 6, least: int = 5) -> DataFrame:
    """x1 of each document: the rounded right edge with the largest share times count on its first pages."""
    amounts = words.where((F.col("page") <= pages) & money.looks_like_amount(F.col("text")))
    counted = amounts.groupBy("doc_id", F.bround("x1").alias("x1")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy("doc_id"))
    scored = counted.withColumn("total", total).where(F.col("total") >= least).withColumn("score", F.col("n") / F.col("total") * F.col("n"))
    return scored.groupBy("doc_id").agg(F.max_by("x1", F.struct("score", -F.col("x1"))).alias("x1"), F.max("total").alias("n_amounts"))


def nearest_profile(edges: DataFrame, profiles: tuple[rules.Profile, ...] = rules.PROFILES) -> DataFrame:
    """The profile whose amount column is nearest to each document's edge; ties by name."""
    far = [F.struct(F.abs(F.col("x1") - p.amount_x1).alias("distance"), F.lit(p.bank).alias("bank")) for p in profiles]
    return edges.withColumn("_b", F.array_min(F.array(*far))).select("doc_id", "_b.bank", "_b.distance")


def profiles_table(spark) -> DataFrame:
    """The layouts of ``rules.PROFILES``."""
    rows = [(p.bank, p.amount_x1, p.balance_x1, list(p.dates), p.bank_type) for p in rules.PROFILES]
    return spark.createDataFrame(rows, "bank string, amount_column_x1 double, balance_column_x1 double, date_columns array<double>, bank_type string")


def lookup_profile(bank: Column, profiles: tuple[rules.Profile, ...] = rules.PROFILES) -> Column:
    """The profile of a name: the exact one, else any case, else one name inside the other; ties by name."""
    a, ranked = F.lower(bank), []
    for p in profiles:
        b = F.lit(p.bank.lower())
        rank = F.when(bank == p.bank, 0).when(a == b, 1).when(F.contains(a, b) | F.contains(b, a), 2)
        ranked.append(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.lit(p.bank).alias("profile"))))
    return F.array_min(F.array_compact(F.array(*ranked))).getField("profile")


def densest_page(words: DataFrame, least: int = 3) -> DataFrame:
    """The page of each document with the most amounts, the first on ties."""
    n = words.where(money.looks_like_amount(F.col("text"))).groupBy("doc_id", "page").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.groupBy("doc_id").agg(F.max_by("page", F.struct("n", -F.col("page"))).alias("page"), F.max("n").alias("n"))


def continuations(lines_: DataFrame) -> DataFrame:
    """Groups of lines: a line without date or money, indented and spaced like the main line above, joins it."""
    start = F.struct(F.lit(0).alias("g"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        joins = (F.abs(w["x"] - acc["x"]) < 20) & ~w["has"] & (F.abs(w["y"] - acc["y"]) < 15) & (F.length(w["text"]) > 5)
        g = acc["g"] + (~F.coalesce(joins, F.lit(False))).cast("int")
        new = ~F.coalesce(joins, F.lit(False))
        return F.struct(g.alias("g"), F.when(new, w["x"]).otherwise(acc["x"]).alias("x"), F.when(new, w["y"]).otherwise(acc["y"]).alias("y"), F.array_append(acc["out"], g).alias("out"))

    has = F.col("text").rlike(r"\d{1,2}[/\-]\d{1,2}") | F.col("text").rlike(r"\$?[0-9,]+\.[0-9]{2}")
    pages = lines_.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line", F.col("x0").alias("x"), F.col("top").alias("y"), "text", has.alias("has")))).alias("ws"))
    zipped = pages.select(*PAGE, F.explode(F.arrays_zip("ws", F.aggregate("ws", start, step, lambda acc: acc["out"]).alias("g"))).alias("z"))
    return zipped.select(*PAGE, F.col("z.ws.line").alias("line"), F.col("z.g").alias("line_group"), F.col("z.ws.text").alias("text"))


def date_by_columns(words: DataFrame, date_columns: tuple[float, ...], reach: float = 30.0, gap: float = 12.0) -> DataFrame:
    """doc_id, page, line and date_raw: date tokens near a profile's first date column, with those that follow closely.

    Tokens near the later date columns are used up by them. ``words`` have line.
    """
    dated = words.where(is_date(F.col("text")) & ~money.looks_like_amount(F.col("text")))
    near = F.lit(False)
    for x in date_columns[1:]:
        near = near | (F.abs(F.col("x0") - x) <= reach)
    ws = dated.groupBy(*PAGE, "line").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "text", near.alias("later")))).alias("ws"))
    start = F.struct(F.lit(None).cast("double").alias("end"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        first = acc["end"].isNull() & (F.abs(w["x0"] - date_columns[0]) <= reach)
        joins = first | (F.coalesce(w["x0"] - acc["end"] <= gap, F.lit(False)) & ~w["later"])
        return F.struct(F.when(joins, w["x1"]).otherwise(acc["end"]).alias("end"), F.when(joins, F.array_append(acc["out"], w["text"])).otherwise(acc["out"]).alias("out"))

    return ws.select(*PAGE, "line", F.array_join(F.aggregate("ws", start, step, lambda acc: acc["out"]), " ").alias("date_raw")).where("date_raw <> ''")


def profile_from(labels: DataFrame, columns_: DataFrame) -> DataFrame:
    """A generated profile for each document: the most frequent columns of its pages, and for each field the
    first label (doc_id, rank, label) that names it."""
    plan = columns_.groupBy("doc_id").agg(F.mode(F.round("amount_x1", 1), True).alias("amount_x1"), F.mode(F.round("balance_x1", 1), True).alias("balance_x1"))
    named = labels.withColumn("field", text.label_field(F.col("label"))).where("field is not null")
    fields = named.groupBy("doc_id", "field").agg(F.min_by(F.lower("label"), "rank").alias("label")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", "field", "label"))).alias("totals"))
    return plan.join(fields, "doc_id", "left")
