"""Bank detection: brand predicates in order, layout scores, weighted combination."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules


def brand_matches(text: Column, brand: rules.Brand) -> Column:
    up = F.upper(text)
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(up, w)) if words else F.lit(False)
    return some(brand.sure) | (some(brand.maybe) & ~some(brand.unless))


def by_brand(text: Column) -> Column:
    """The first bank in order whose predicate holds, else null."""
    out = F.lit(None).cast("string")
    for brand in reversed(rules.BRANDS):
        out = F.when(brand_matches(text, brand), brand.bank).otherwise(out)
    return out


def layout_scores(text: Column) -> Column:
    """array of struct(bank, score) over 60: 20 points for each header pattern and for more than five dates."""
    found = []
    for rank, (bank, heads, date) in enumerate(rules.LAYOUT_SIGNATURES):
        points = F.lit(0)
        for h in heads:
            points = points + F.when(text.rlike("(?i)" + h), 20).otherwise(0)
        most = 20 * len(heads)
        if date:
            points = points + F.when(F.size(F.regexp_extract_all(text, F.lit(f"({date})"), F.lit(1))) > 5, 20).otherwise(0)
            most += 20
        share = points / most * 100
        found.append(F.when(share > 60, F.struct(share.alias("score"), F.lit(-rank).alias("order"), F.lit(bank).alias("bank"))))
    return F.array_compact(F.array(*found))


def detect(pages: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """doc_id, bank, confidence and stage of each text.

    Brand (90 for priority banks, 75 for others) if 80 or more, layout if 70 or more, a proposal
    (doc_id, ai_bank, ai_confidence) if 75 or more, else the bank of the largest weighted sum, at most
    65, else Unknown.
    """
    t = F.col("text")
    d = pages.withColumn("r_bank", by_brand(t)).withColumn("_l", F.array_max(layout_scores(t)))
    d = d.withColumn("r_conf", F.when(F.col("r_bank").isin(*rules.PRIORITY_BANKS), 90.0).when(F.col("r_bank").isNotNull(), 75.0))
    d = d.withColumn("l_bank", F.col("_l.bank")).withColumn("l_conf", F.col("_l.score"))
    d = d.join(proposed.withColumnsRenamed({"ai_bank": "a_bank", "ai_confidence": "a_conf"}), "doc_id", "left") if proposed is not None else d.withColumn("a_bank", F.lit(None).cast("string")).withColumn("a_conf", F.lit(None).cast("double"))
    weight, least = dict(rules.STAGE_WEIGHTS), dict(rules.STAGE_THRESHOLDS)
    votes = F.array_compact(F.array(*[F.when(F.col(f"{k}_bank").isNotNull() & (F.col(f"{k}_bank") != "Unknown"), F.struct(F.col(f"{k}_bank").alias("bank"), (F.col(f"{k}_conf") * weight[name]).alias("w"))) for k, name in (("r", "regex"), ("l", "layout"), ("a", "ai"))]))
    d = d.withColumn("_v", votes)
    total = F.transform("_v", lambda v: F.struct(F.aggregate(F.filter("_v", lambda x: x["bank"] == v["bank"]), F.lit(0.0).cast("double"), lambda s, x: s + x["w"]).alias("w"), v["bank"].alias("bank")))
    d = d.withColumn("_c", F.array_max(total))
    combined = F.least(F.col("_c.w") / sum(weight.values()), F.lit(65.0))
    stage = F.when(F.col("r_conf") >= least["regex"], "regex").when(F.col("l_conf") >= least["layout"], "layout").when(F.col("a_conf") >= least["ai"], "ai").when(F.col("_c").isNotNull(), "combined").otherwise("unknown")
    d = d.withColumn("stage", stage)
    pick = lambda suffix, last, none: F.when(F.col("stage") == "regex", F.col(f"r_{suffix}")).when(F.col("stage") == "layout", F.col(f"l_{suffix}")).when(F.col("stage") == "ai", F.col(f"a_{suffix}")).when(F.col("stage") == "combined", last).otherwise(none)
    return d.select("doc_id", pick("bank", F.col("_c.bank"), F.lit("Unknown")).alias("bank"), pick("conf", combined, F.lit(0.0)).alias("confidence"), "stage")


def proposed_banks(pages: DataFrame, client) -> DataFrame:
    """doc_id, ai_bank and ai_confidence that an injected callable (text to {"bank", "confidence"}) answers.

    Answers are checked: a bank that is not known, a confidence that is no number from 0 to 100, anything
    that is no dictionary and any failure of the callable is no proposal. Null texts are not asked about.
    """
    known = {b.bank.lower(): b.bank for b in rules.BRANDS}

    def run(frames):
        for frame in frames:
            found = []
            for doc_id, text in zip(frame.doc_id, frame.text, strict=True):
                try:
                    said = client(text)
                    bank, sure = known.get(str(said["bank"]).strip().lower()), float(said["confidence"])
                except Exception:  # noqa: BLE001  the plugin is foreign code, and a proposal is optional
                    continue
                if bank and 0 <= sure <= 100:
                    found.append((doc_id, bank, sure))
            yield pd.DataFrame(found, columns=["doc_id", "ai_bank", "ai_confidence"])

    asked = pages.where("text is not null").select("doc_id", "text")
    return asked.mapInPandas(run, f"doc_id {dict(pages.dtypes)['doc_id']}, ai_bank string, ai_confidence double")


def proposed_rows(pages: DataFrame, client) -> DataFrame:
    """doc_id, page, date, description and amount (cents) of rows that an injected callable (text to a list
    of {"date", "description", "amount"}, or one of them) finds on a page.

    Rows without a date, a description or a number as amount are dropped, and so are repeated ones.
    """

    def run(frames):
        for frame in frames:
            found = []
            for doc_id, page, text in zip(frame.doc_id, frame.page, frame.text, strict=True):
                try:
                    said = client(text)
                except Exception:  # noqa: BLE001  see above
                    continue
                for r in said if isinstance(said, list) else [said]:
                    if isinstance(r, dict) and r.get("date") and r.get("description"):
                        amount = str(r.get("amount", "")).replace("$", "").replace(",", "").strip()
                        found.append((doc_id, page, str(r["date"]), str(r["description"]).strip(), amount))
            yield pd.DataFrame(found, columns=["doc_id", "page", "date", "description", "amount"])

    kinds = dict(pages.dtypes)
    asked = pages.where("text is not null").select("doc_id", "page", "text")
    rows = asked.mapInPandas(run, f"doc_id {kinds['doc_id']}, page {kinds['page']}, date string, description string, amount string")
    return rows.withColumn("amount", F.col("amount").try_cast("decimal(18,2)")).where("amount is not null and description <> ''").distinct()


def is_scanned(pages: DataFrame, first: int = 3, few: int = 100) -> DataFrame:
    """doc_id, n_chars and scanned: less than ``few`` characters on the first pages."""
    n = F.sum(F.when(F.col("page") <= first, F.length(F.trim(F.coalesce("text", F.lit(""))))).otherwise(0))
    return pages.groupBy("doc_id").agg(n.alias("n_chars")).withColumn("scanned", F.col("n_chars") < few)
