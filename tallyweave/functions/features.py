"""Line features, weak labels and cluster scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from .text import any_of

DATE = r"\d{1,2}/\d{1,2}(?:/\d{2,4})?"
MONEY = r"\$?[0-9,]+\.[0-9]{2}"


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_features(lines: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Thirteen features of a line (text, x0, x1)."""
    t, n = F.col("text"), F.greatest(F.length("text"), F.lit(1))
    digits, letters = _n(t, "[0-9]"), _n(t, "[A-Za-z]")
    return lines.select(
        "*", F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+"))).alias("n_tokens"), F.length(t).alias("n_chars"), digits.alias("n_digits"), letters.alias("n_letters"),
        t.rlike(MONEY).cast("int").alias("has_money"), _n(t, MONEY).alias("n_money"), t.rlike(DATE).cast("int").alias("has_date"), _n(t, DATE).alias("n_dates"),
        (F.col("x0") / page_width).alias("left_ratio"), ((F.col("x0") + F.col("x1")) / 2 / page_width).alias("center_ratio"), ((F.col("x1") - F.col("x0")) / page_width).alias("span_ratio"),
        (digits / n).alias("digit_ratio"), (letters / n).alias("letter_ratio"),
    )


def row_features(lines: DataFrame, page_width: float = 612.0, page_height: float = 792.0) -> DataFrame:
    """Text, geometry and context features of a line (doc_id, page, line, text, x0, x1, top, bottom)."""
    t, n, low = F.col("text"), F.greatest(F.length("text"), F.lit(1)), F.lower("text")
    flag = lambda c: c.cast("double")
    count = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    w = W.partitionBy("doc_id", "page").orderBy("line")
    dated, paid = t.rlike(r"\d{1,2}/\d{1,2}/\d{2,4}"), t.rlike(r"\$?\d+\.\d{2}")
    wide, high = F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top")
    near = lambda c, step: flag(F.coalesce(F.lag(c, step).over(w) if step > 0 else F.lead(c, -step).over(w), F.lit(False)))
    return lines.select(
        "doc_id", "page", "line", flag(dated).alias("looks_like_date"), flag(t.rlike(r"\$?\d{1,3}(?:,\d{3})*\.\d{2}")).alias("looks_like_amount"),
        flag(t.rlike(r"-\$?\d+\.\d{2}")).alias("has_negative_amount"), flag(low.rlike(r"balance|bal\b")).alias("has_balance"), flag(t.rlike(r"\b\d{6,}\b")).alias("has_transaction_id"),
        F.length(t).alias("text_length"), F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+"))).alias("word_count"),
        (_n(t, "[A-Z]") / n).alias("uppercase_ratio"), (_n(t, "[0-9]") / n).alias("digit_ratio"), (_n(t, r"[^A-Za-z0-9\s]") / n).alias("special_char_ratio"),
        count(rules.BANKING_TERMS).alias("banking_keyword_count"), count(rules.SHOP_TERMS).alias("merchant_indicator_count"),
        (F.col("x0") / page_width).alias("bbox_x0_norm"), (F.col("top") / page_height).alias("bbox_y0_norm"), (wide / page_width).alias("bbox_width_norm"), (high / page_height).alias("bbox_height_norm"),
        (wide * high / (page_width * page_height)).alias("bbox_area_norm"), (wide / F.greatest(high, F.lit(1.0))).alias("bbox_aspect_ratio"),
        flag(F.col("x0") < page_width * 0.2).alias("is_left_aligned"), flag(F.col("x1") > page_width * 0.8).alias("is_right_aligned"), flag(F.abs((F.col("x0") + F.col("x1")) / 2 - page_width / 2) < page_width * 0.1).alias("is_centered"),
        flag(F.col("top") < page_height * 0.33).alias("is_top_third"), flag(F.col("bottom") > page_height * 0.67).alias("is_bottom_third"),
        near(dated, 1).alias("prev_has_date"), near(paid, 1).alias("prev_has_amount"), near(dated, -1).alias("next_has_date"), near(paid, -1).alias("next_has_amount"),
        ((F.row_number().over(w) - 1) / F.count("*").over(W.partitionBy("doc_id", "page"))).alias("relative_position"),
    )


def weak_votes(text: Column) -> list[Column]:
    """Six votes, 0 or 1 each, on whether a line is a transaction."""
    low, last = F.lower(text), F.regexp_replace(text, rf"^.*{MONEY}", "")
    return [
        (text.rlike(DATE) & text.rlike(MONEY)).cast("int"), (text.rlike(MONEY) & (F.length(last) < 10)).cast("int"), text.rlike(r"^\s*\*+\d{4}").cast("int"),
        any_of(low, rules.MERCHANT_TERMS).cast("int"), F.length(text).between(20, 200).cast("int"), (~any_of(low, rules.SUMMARY_TERMS)).cast("int"),
    ]


def weak_label(text: Column) -> Column:
    """1 if more than half of the six votes say so."""
    return (sum(weak_votes(text), F.lit(0)) / 6 > 0.5).cast("int")


def cluster_scores(lines: DataFrame, cluster: str = "cluster", weights: dict[str, float] = rules.PARSER_WEIGHTS, client: bool = False) -> DataFrame:
    """Score of each cluster of lines (text): money, dates, tokens, length, summaries, and weak labels.

    ``weights``: those of ``rules.PARSER_WEIGHTS``, or a row of ``adapted_weights``; ``client``: weigh the weak labels
    as those of an injected client.
    """
    t = F.col("text")
    tokens = F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+")))
    mean = lines.groupBy(cluster).agg(F.avg(t.rlike(MONEY).cast("int")).alias("m"), F.avg(t.rlike(DATE).cast("int")).alias("d"), F.avg(tokens).alias("k"), F.avg(F.length(t)).alias("c"), F.avg(any_of(F.lower(t), rules.SUMMARY_TERMS).cast("int")).alias("s"), F.avg(weak_label(t)).alias("w"), F.count("*").alias("n_lines"))
    g, kind = weights, "ai_" if client else ""
    plain = F.col("m") * g["money_rate"] + F.col("d") * g["date_rate"] + F.least(F.col("k") / 10, F.lit(1)) * g["tokens"] + F.least(F.col("c") / 50, F.lit(1)) * g["chars"] + (1 - F.col("s")) * g["summary"]
    return mean.select(cluster, (plain * g[kind + "plain"] + F.col("w") * g[kind + "weak"]).alias("score"), "n_lines")


#: Records of a history that are folded in one array.
FOLD = 1024


def adapted_weights(history: DataFrame) -> DataFrame:
    """parser and the weights that its ``history`` (parser, at, success) has led to, one column each.

    After each record but the first nine the mean of the last ten decides: a poor one raises the shares of money, dates
    and weak labels and lowers the confidence asked for, a good one raises it, each up to its limit. A null success counts
    as 0; ties in ``at`` go by success. A history of any length is folded in blocks: steps with limits are
    functions min(hi, max(lo, x + d)), and two of these in a row are one again.
    """
    by = W.partitionBy("parser").orderBy("at", "success")
    h = history.select("parser", "at", F.coalesce("success", F.lit(0.0)).alias("success")).withColumn("i", F.row_number().over(by))
    recent = F.avg("success").over(by.rowsBetween(1 - rules.PARSER_RECENT, 0))
    verdict = F.when(F.col("i") < rules.PARSER_RECENT, 0).when(recent < rules.PARSER_POOR, -1).when(recent > rules.PARSER_GOOD, 1).otherwise(0)
    (down, floor), (up, top) = rules.PARSER_STEPS["confidence"], rules.PARSER_GOOD_STEP
    blank = F.struct(F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))

    def step(acc: Column, x: Column) -> Column:
        move = F.when(x["v"] < 0, down).otherwise(up)
        lo, hi = acc["lo"] + move, acc["hi"] + move
        lowered = F.struct((acc["d"] + move).alias("d"), F.greatest(F.lit(floor), lo).alias("lo"), F.greatest(F.lit(floor), hi).alias("hi"))
        raised = F.struct((acc["d"] + move).alias("d"), lo.alias("lo"), F.least(F.lit(top), hi).alias("hi"))
        return F.when(x["v"] < 0, lowered).when(x["v"] > 0, raised).otherwise(acc)

    marked = h.select("parser", "i", verdict.alias("v"), F.floor((F.col("i") - 1) / FOLD).alias("block"))
    moves = F.sort_array(F.collect_list(F.struct("i", "v")))
    blocks = marked.groupBy("parser", "block").agg(F.sum((F.col("v") < 0).cast("long")).alias("poor"), F.aggregate(moves, blank, step).alias("f"))
    whole = blocks.groupBy("parser").agg(F.sum("poor").alias("poor"), F.sort_array(F.collect_list(F.struct("block", "f"))).alias("fs"))
    first = rules.PARSER_WEIGHTS
    raised = {k: F.least(F.lit(most), F.lit(first[k]) + F.col("poor") * by_one) for k, (by_one, most) in rules.PARSER_STEPS.items() if k != "confidence"}
    sure = F.aggregate("fs", F.lit(first["confidence"]), lambda x, b: F.least(b["f"]["hi"], F.greatest(b["f"]["lo"], x + b["f"]["d"])))
    now = {**{k: F.lit(v) for k, v in first.items()}, **raised, "ai_plain": 1 - raised["ai_weak"], "confidence": sure}
    return whole.select("parser", *[v.alias(k) for k, v in now.items()])


def best_cluster(lines: DataFrame) -> DataFrame:
    """The ``lines`` (doc_id, cluster, text) of each document's cluster of the highest score, the first on ties."""
    scored = cluster_scores(lines.withColumn("_c", F.struct("doc_id", "cluster")), "_c")
    best = scored.groupBy(F.col("_c.doc_id").alias("doc_id")).agg(F.max(F.struct("score", (-F.col("_c.cluster")).alias("c"))).alias("b"))
    return lines.join(best.select("doc_id", (-F.col("b.c")).alias("cluster")), ["doc_id", "cluster"], "left_semi")


def layout_features(tokens: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Features of each line (doc_id, page, line) from its tokens (text, x0, x1, size)."""
    t, all_ = F.col("text"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    center = (F.col("x0") + F.col("x1")) / 2
    letters, digits, signs, total = (F.sum(_n(t, p)) for p in ("[A-Za-z]", "[0-9]", r"[^A-Za-z0-9\s]", r"(?s)."))
    by = tokens.groupBy("doc_id", "page", "line").agg(
        F.count("*").alias("len_tokens"), (letters / F.greatest(total, F.lit(1))).alias("alpha_ratio"), digits.alias("n_digit"), signs.alias("n_punct"), all_.alias("_t"),
        ((F.max(center) - F.min(center)) / page_width).alias("x_span"), F.max_by("text", "x1").alias("_last"), F.avg("size").alias("size_mean"), F.stddev_pop("size").alias("size_std"),
    )
    return by.select("doc_id", "page", "line", "len_tokens", "alpha_ratio", "n_digit", "n_punct", F.col("_t").rlike(MONEY).cast("int").alias("has_money"), _n(F.col("_t"), MONEY).alias("n_money"), F.col("_t").rlike(DATE).cast("int").alias("has_date"), "x_span", F.trim("_last").rlike(f"^{MONEY}$").cast("int").alias("rightmost_is_money"), "size_mean", "size_std")


def cluster_lines(lines: DataFrame, k: int | None = None, seed: int = 7) -> DataFrame:
    """cluster of each line of a document by k-means on its features; k is a fifth of the lines, 2 to 8.

    A document's lines are one group, clustered within it in one task: memory grows with a document's lines, at 8 x 8
    bytes a line for the distances. Null texts count as empty.
    """
    import numpy as np
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x = group.sort_values("line").reset_index(drop=True)
        x["text"] = x.text.fillna("")
        f = np.stack([x.text.str.count(MONEY), x.text.str.count(DATE), x.text.str.len() / 50, x.text.str.count("[0-9]") / x.text.str.len().clip(lower=1)], 1).astype(float)
        f = (f - f.mean(0)) / np.where(f.std(0) > 0, f.std(0), 1)
        n = min(len(x), k or min(max(2, len(x) // 5), 8))
        rng = np.random.default_rng(seed)
        at = f[rng.choice(len(f), n, replace=False)]
        for _ in range(25):
            label = ((f[:, None] - at[None]) ** 2).sum(2).argmin(1)
            at = np.stack([f[label == i].mean(0) if (label == i).any() else at[i] for i in range(n)])
        return pd.DataFrame({"doc_id": x.doc_id, "line": x.line, "cluster": label.astype("int32"), "text": x.text})

    return lines.select("doc_id", "line", "text").groupBy("doc_id").applyInPandas(run, "doc_id long, line long, cluster int, text string")
