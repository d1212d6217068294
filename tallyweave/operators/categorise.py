"""Categories by ordered rules: junk, learned merchants, keywords, proposals, default."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text


def keyword_category(cleaned: Column, categories: dict[str, tuple[str, ...]] = rules.CATEGORIES) -> Column:
    """The first category, most keywords first, with a keyword in the text: one generated CASE."""
    out = F.lit(None).cast("string")
    for category, words in reversed(sorted(categories.items(), key=lambda kv: -len(kv[1]))):
        if words:
            hit = F.lit(False)
            for w in words:
                hit = hit | cleaned.contains(w.lower())
            out = F.when(hit, category).otherwise(out)
    return out


def learned_category(cleaned: Column, learned: tuple[tuple[str, str], ...] = rules.LEARNED, categories: dict[str, tuple[str, ...]] = rules.CATEGORIES) -> Column:
    """The category of the first learned merchant in the text whose category is known."""
    out = F.lit(None).cast("string")
    for merchant, category in reversed(learned):
        if category in categories:
            out = F.when(cleaned.contains(merchant), category).otherwise(out)
    return out


def categorise(rows: DataFrame, proposed: str | None = None) -> DataFrame:
    """category and source (default for junk, learned, keyword, proposed, default) of every row."""
    cleaned = rows.withColumn("_t", text.for_categories(F.col("description"))).withColumn("_junk", text.is_junk(F.col("description")))
    found = cleaned.withColumn("_l", learned_category(F.col("_t"))).withColumn("_k", keyword_category(F.col("_t")))
    said = F.col(proposed) if proposed else F.lit(None).cast("string")
    source = F.when(F.col("_junk"), "default").when(F.col("_l").isNotNull(), "learned").when(F.col("_k").isNotNull(), "keyword").when(said.isNotNull(), "proposed").otherwise("default")
    category = F.when(F.col("_junk"), rules.DEFAULT_CATEGORY).otherwise(F.coalesce("_l", "_k", said, F.lit(rules.DEFAULT_CATEGORY)))
    return found.withColumn("category", category).withColumn("source", source).drop("_t", "_junk", "_l", "_k")


def _stretches(name: str, n: int) -> Column:
    """All stretches of ``n`` characters of a column of at least as many."""
    return F.transform(F.sequence(F.lit(1), F.length(name) - F.lit(n - 1)), lambda i: F.substring(F.col(name), i, F.lit(n)))


def keyword_join(rows: DataFrame, keywords: DataFrame, gram: int = 3) -> DataFrame:
    """``rows`` and keyword_category, by a table of rules (category, cat_rank, keyword, kw_rank) of any size.

    Each distinct description is cleaned once and posted under its stretches of ``gram`` characters (and
    under single ones, for shorter keywords); a keyword waits under its first stretch, so both meet in an
    equal join, whose size Spark knows when it picks broadcast or shuffle. The best rule of a description is
    an aggregate that combines before its shuffle. Null descriptions and null or empty keywords match
    nothing.
    """
    said = rows.select(F.col("description").alias("_d")).where("_d is not null").distinct().withColumn("_t", text.for_categories(F.col("_d")))
    size = F.length("keyword")
    hits = None
    for n, some in ((gram, size >= gram), (1, size.between(1, gram - 1))):
        posted = said.where(F.length("_t") >= n).select("_d", "_t", F.explode(F.array_distinct(_stretches("_t", n))).alias("_g"))
        found = posted.join(keywords.where(some).withColumn("_g", F.substring("keyword", 1, n)), "_g").where(F.contains("_t", "keyword"))
        hits = found if hits is None else hits.unionByName(found)
    order = F.struct(F.col("cat_rank").isNull(), "cat_rank", "kw_rank", "category")
    best = hits.groupBy("_d").agg(F.min_by("category", order).alias("keyword_category"))
    return rows.join(best, F.col("description") == F.col("_d"), "left").select(*[rows[c] for c in rows.columns], "keyword_category")


def suspect(description: Column, category: Column) -> tuple[Column, Column]:
    """The category that a gas station, restaurant or office name suggests instead, and the reason."""
    low = F.lower(F.coalesce(description, F.lit("")))
    gas = text.any_of(low, rules.GAS_TOKENS) & (category != rules.TRAVEL)
    food = text.any_of(low, rules.RESTAURANT_TOKENS) & ~category.isin(rules.MEALS, rules.TRAVEL)
    office = text.any_of(low, rules.OFFICE_TOKENS) & (category != rules.OFFICE)
    return (
        F.when(gas, rules.TRAVEL).when(food, rules.MEALS).when(office, rules.OFFICE),
        F.when(gas, "gas-station name").when(food, "restaurant name").when(office, "office-supply name"),
    )


def learn(learned: DataFrame, edits: DataFrame) -> DataFrame:
    """Learned merchants after edits (merchant, category, ts): the latest category of each."""
    return learned.unionByName(edits).groupBy("merchant").agg(F.max_by("category", "ts").alias("category"), F.max("ts").alias("ts"))


def apply_learned(rows: DataFrame, merchant: str, category: str) -> DataFrame:
    """Rows whose raw description holds the merchant get the category."""
    return rows.withColumn("category", F.when(F.lower("description").contains(merchant.lower()), category).otherwise(F.col("category")))


def rename_category(rows: DataFrame, old: str, new: str) -> DataFrame:
    return rows.withColumn("category", F.when(F.col("category") == old, new).otherwise(F.col("category")))


def batch_proposals(rows: DataFrame, client, size: int = 20) -> DataFrame:
    """Categories proposed by an injected callable for batches of (description, amount); null without one."""
    if client is None:
        return rows.withColumn("proposed", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said: list[str | None] = []
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                said += list(client(list(zip(part.description.str.slice(0, 60), part.amount, strict=True))))
            yield frame.assign(proposed=said)

    return rows.mapInPandas(run, rows.withColumn("proposed", F.lit("")).schema)


def closest(candidate: str | None, names: list[str], least: float = 0.9) -> str | None:
    """Exact, then case-insensitive, then the closest by character sequence, if close enough."""
    said = (candidate or "").strip()
    if not said:
        return None
    if said in names:
        return said
    folded = {n.lower(): n for n in names}
    if said.lower() in folded:
        return folded[said.lower()]
    scored = [(difflib.SequenceMatcher(None, said.lower(), n.lower()).ratio(), -i) for i, n in enumerate(names)]
    best = max(scored, default=(0.0, 0))
    return names[-best[1]] if best[0] >= least else None


def fuzzy_names(rows: DataFrame, column: str, names: list[str], out: str, least: float = 0.9) -> DataFrame:
    """``out``: the closest of a list of names. Only distinct values are compared, in Arrow batches."""

    @F.pandas_udf("string")
    def match(values: pd.Series) -> pd.Series:
        return values.map(lambda v: closest(v, names, least))

    distinct = rows.select(column).distinct().withColumn(out, match(F.col(column)))
    return rows.join(distinct, rows[column].eqNullSafe(distinct[column]), "left").drop(distinct[column])
