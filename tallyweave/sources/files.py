"""Files: listings, truth tables, labels, rule files; and the reports written from ledgers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import money, text
from .workbook import workbook

CENTS = "decimal(18,2)"


def listing(spark: SparkSession, folder: str, pattern: str = "*", contains: str | None = None, recursive: bool = True, limit: int | None = None) -> DataFrame:
    """path and size of files by name pattern; ``contains`` filters paths in any case, ``limit`` is the first by path."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder).select("path", F.col("length").alias("size"))
    if contains:
        files = files.where(F.contains(F.lower("path"), F.lit(contains.lower())))
    return files.orderBy("path").limit(limit) if limit is not None else files


def truth_csv(spark: SparkSession, path: str) -> DataFrame:
    """date, description and amount of a bank's own export; rows whose amount does not parse are dropped."""
    raw = spark.read.csv(path, header=True)
    named = {c.lstrip("﻿"): F.col(f"`{c}`") for c in raw.columns}
    either = lambda *names: F.coalesce(*[F.nullif(named[n], F.lit("")) for n in names if n in named], F.lit(None).cast("string"))
    amount = F.trim(F.replace(either("Transaction Amount", "Amount"), F.lit("USD"), F.lit(""))).try_cast(CENTS)
    rows = raw.select(either("Transaction Date", "Date").alias("date"), F.coalesce(named.get("Description", F.lit(None).cast("string")), F.lit("")).alias("description"), amount.alias("amount"))
    return rows.where("amount is not null")


def labels_json(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """date, description and amount of hand-made labels: one JSON array a file, or a line."""
    kind = "date string, description string, amount decimal(18,2)"
    if per_line:
        rows = spark.read.text(path).select(F.explode(F.from_json("value", f"array<struct<{kind.replace(' string', ':string').replace(' decimal', ':decimal')}>>")).alias("r")).select("r.*")
    else:
        rows = spark.read.schema(kind).json(path, multiLine=True)
    return rows.select("date", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("amount", F.lit(0).cast(CENTS)).alias("amount"))


def patterns(spark: SparkSession, path: str) -> DataFrame:
    """filename, pattern, success_count and metadata of lines split at their first three pipes."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#') and contains(v, '|')")
    parts = lines.select(F.split("v", r"\|", 4).alias("p"))
    count = F.coalesce(F.when(F.get("p", F.lit(2)).rlike(r"^\d+$"), F.get("p", F.lit(2))).try_cast("int"), F.lit(1))
    return parts.select(F.get("p", F.lit(0)).alias("filename"), F.get("p", F.lit(1)).alias("pattern"), count.alias("success_count"), F.coalesce(F.get("p", F.lit(3)), F.lit("")).alias("metadata"))


def categories_json(spark: SparkSession, path: str | None = None) -> DataFrame:
    """category, cat_rank, keyword, kw_rank: a JSON object of keyword lists, or the default rules."""
    if path is None:
        rows = [(c, i, w, j) for i, (c, words) in enumerate(rules.CATEGORIES.items()) for j, w in enumerate(words)]
        return spark.createDataFrame(rows, "category string, cat_rank int, keyword string, kw_rank int")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    each = whole.select(F.posexplode(F.map_entries("m")).alias("cat_rank", "e")).select(F.col("e.key").alias("category"), "cat_rank", F.posexplode("e.value").alias("kw_rank", "keyword"))
    return each.select("category", "cat_rank", "keyword", "kw_rank")


def match_stems(files: DataFrame, stems: DataFrame) -> DataFrame:
    """stem and path: the first path that holds each stem. ``stems`` is a short list."""
    hit = files.join(F.broadcast(stems), F.contains("path", "stem"))
    return hit.groupBy("stem").agg(F.min("path").alias("path"))


# --- writers: Spark's commit protocol makes each of them whole or absent
def write_by_category(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """One folder for each category, by its sheet name."""
    rows.withColumn("sheet", text.sheet_name(F.coalesce("category", F.lit("Uncategorized")))).write.mode("overwrite").partitionBy("sheet").format(form).save(path)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON rows with ISO dates."""
    rows.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("emptyValue", "").csv(path, header=True)


def write_form_lines(lines: DataFrame, path: str) -> None:
    """Line and amount, whole dollars."""
    write_csv(lines.select("line", money.form_value(F.col("amount")).alias("amount")), path)


def label_template(rows: DataFrame) -> DataFrame:
    """date, description, amount and an empty category of each row, to be filled in."""
    return rows.select(F.col("txn_date").cast("string").alias("date"), "description", "amount", F.lit("").alias("category"))


def report_tables(verdicts: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of a verification report: verdicts by kind, and rows by category."""
    return {
        "checks": verdicts.groupBy("check_type", "reconciled").agg(F.count("*").alias("n")),
        "categories": rows.groupBy("category").agg(F.count("*").alias("n"), F.sum("amount").alias("total")),
    }


def save_config(table: DataFrame, path: str) -> None:
    """Overwrite a small settings table."""
    table.coalesce(1).write.mode("overwrite").json(path)


def replace_atomically(table: DataFrame, path: str, form: str = "json") -> None:
    """Write beside ``path`` and rename: readers find the old folder or the new one, never a part.

    ``table`` may be read from ``path`` itself. A writer that fails leaves the old folder alone. Renames are
    those of the path's own file system; where it renames no folders at once, neither does this.
    """
    spark, mark = table.sparkSession, uuid.uuid4().hex
    jvm = spark._jvm
    new, old, at = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.{mark}.new", f"{path}.{mark}.old", path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        table.write.format(form).save(new.toString())
        there = fs.exists(at)
        if there and not fs.rename(at, old):
            raise OSError(f"cannot move {path} away")
        if not fs.rename(new, at):
            if there:
                fs.rename(old, at)
            raise OSError(f"cannot move the new folder to {path}")
    finally:
        fs.delete(new, True)
    fs.delete(old, True)


def append_capped(log: DataFrame, fresh: DataFrame, max_bytes: int) -> DataFrame:
    """``log`` (at, line) with the ``fresh`` lines after it; once the old lines take more than ``max_bytes``
    (UTF-8, with line ends), only the newest of them that fit in half of that stay.

    Sizes are summed by moment first, so the log is never sorted in one place; lines of one moment stay or
    go together. ``replace_atomically`` writes the result back. Null lines are empty.
    """
    size = F.octet_length(F.coalesce("line", F.lit(""))) + 1
    by = log.groupBy("at").agg(F.sum(size).alias("n"))
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if total > max_bytes:
        newer = F.sum("n").over(W.orderBy(F.col("at").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
        first = by.withColumn("kept", newer).where(F.col("kept") <= max_bytes // 2).agg(F.min("at").alias("at")).first()["at"]
        log = log.where(F.col("at") >= F.lit(first)) if first is not None else log.limit(0)
    return log.select("at", "line").unionByName(fresh.select("at", "line"))


def write_form_data(fields: DataFrame, path: str) -> None:
    """A form's fields (name, shown) as one file of form data (FDF), which viewers merge into the form.

    A form has few fields, so one task writes them, in order of their names.
    """
    quoted = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\()])", r"\\$1")
    line = F.concat(F.lit("<< /T ("), quoted(F.col("name")), F.lit(") /V ("), quoted(F.col("shown")), F.lit(") >>"))
    whole = fields.select("name", line.alias("line")).groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "line"))), lambda x: x["line"]), "\n").alias("all"))
    whole.select(F.concat(F.lit("%FDF-1.2\n1 0 obj\n<< /FDF << /Fields [\n"), "all", F.lit("\n] >> >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF")).alias("value")).write.mode("overwrite").text(path)


def read_form_data(spark: SparkSession, path: str) -> DataFrame:
    """name and shown of the fields in files of form data."""
    quoted = r"\(((?:[^()\\]|\\.)*)\)"
    plain = lambda i: F.regexp_replace(F.regexp_extract("value", rf"^<< /T {quoted} /V {quoted} >>$", i), r"\\(.)", "$1")
    return spark.read.text(path).where(F.col("value").startswith("<< /T ")).select(plain(1).alias("name"), plain(2).alias("shown"))


def workbooks(rows: DataFrame, by: str = "doc_id", columns: tuple[str, ...] = ("date", "description", "amount")) -> DataFrame:
    """``by`` and workbook (the bytes of an .xlsx file) of each statement: all rows, a summary by category,
    and a sheet for each category, under its sheet name. ``rows`` also has category.

    A statement's rows are one group and must fit in a sheet, which has 1,048,576 lines; more are an error.
    """
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(columns), kind="stable")
        named = group.category.fillna("Uncategorized")
        cell = lambda f: [[None if pd.isna(v) else v for v in r] for r in f[list(columns)].itertuples(index=False, name=None)]
        sums = group.assign(category=named).groupby("category").amount.agg(["size", "sum"]).sort_index()
        sheets = [("All Transactions", [list(columns), *cell(group)]), ("Category Summary", [["category", "count", "total"], *([c, int(n), float(t)] for c, n, t in sums.itertuples(name=None))])]
        sheets += [(re.sub(r"[^\w]", "_", c)[:31], [list(columns), *cell(group[named == c])]) for c in sums.index]
        return pd.DataFrame({by: [group[by].iloc[0]], "workbook": [workbook(sheets)]})

    kind = dict(rows.dtypes)[by]
    picked = rows.select(by, "category", *[F.col(c).cast("double" if c == "amount" else "string").alias(c) for c in columns])
    return picked.groupBy(by).applyInPandas(run, f"{by} {kind}, workbook binary")
