"""Quality rules with risk-controlled thresholds.

Every text gets a few plain measures (symbols, repeated lines, repeated word windows, ...). A path of
ever stricter rules is fixed beforehand: each step lowers one measure's cutoff by one notch of its grid,
the lax notches of all measures first, and the rule of a step rejects what any measure's cutoff so far
rejects. For each stratum, steps that reject no badly labelled row that earlier ones leave are skipped.
Then the good rows of a labelled holdout test the whole rule of each step in order: its rate of falsely
rejected good texts is at most ``alpha`` if the exact binomial (Clopper-Pearson) bound says so. The last
step before the first failure is the stratum's rule. The bound is on the joint verdict, not on single
cutoffs; a fixed sequence needs no correction along the path, and ``delta`` is shared over the strata by
their good rows (weighted Bonferroni), so with confidence ``1 - delta`` no stratum rejects more than
``alpha`` of its good texts that pass the base rule. Without a certified step nothing is rejected.

Everything is DataFrame functions; no Python runs on the executors.

Defined cases: null text has no words and fails the base rule; a null or unlisted stratum value is
in stratum ``other``; repeated rows are scored each on its own; an empty table gives an empty
result; without labels no cutoff is certified and only the base rule rejects. Input columns are
never carried, so clashing names cannot occur. A window of eight words is held as a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, let, read_table, words_column

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: measure -> grid of cutoffs (reject when the measure is above), least strict first.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "upper_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3),
    "repeat_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "same_word_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35),
    "bang_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
}


@dataclass(frozen=True)
class RiskSpec:
    """alpha: bound on the share of good texts a stratum may reject; delta: chance that any bound fails."""

    alpha: float = 0.02
    delta: float = 0.05
    strata: tuple[str, ...] = ("de", "en", "es", "fr")


def path() -> list[tuple[str, float]]:
    """The steps (measure, cutoff), from the laxest notch of all grids to the strictest."""
    return [(m, c) for _, m, c in sorted(((i / len(grid), m, c) for m, grid in GRIDS.items() for i, c in enumerate(grid)), key=lambda x: x[0])]


def _windows(hashes: Column) -> Column:
    def at(i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])

    return F.when(F.size(hashes) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    marked = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]))

    def total(places: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])

    return let(let(marked, repeated), lambda r: total(F.sort_array(F.transform(r, lambda e: e["i"]))))


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``keep`` and the measures of its whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    held = docs.select(*keep, t.alias("_t"), words_column(F.col(text)).alias("_w"))

    def lines(parts: Column) -> Column:
        return F.size(parts) - F.size(F.array_distinct(parts))

    def used(x: Column) -> Column:
        return F.length(F.translate(x, " " + SPACES, "")) > 0

    def repeats(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))

    def by_hash(h: Column) -> Column:
        return F.struct(F.size(F.array_distinct(h)).cast("long").alias("distinct"), let(_windows(h), repeats).cast("long").alias("repeats"))

    kept_lines = F.filter(F.split("_t", "\n", -1), used)
    counted = held.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " " + SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", upper, ""))).cast("long").alias("n_upper"),
        (F.length("_t") - F.length(F.translate("_t", "!", ""))).cast("long").alias("n_bangs"),
        let(kept_lines, lambda p: F.struct(lines(p).cast("long").alias("dup"), F.size(p).alias("all"))).alias("_l"),
        let(F.transform("_w", lambda x: F.xxhash64(x)), by_hash).alias("_h"),
    ).select("*", F.col("_h.distinct").alias("n_distinct"), F.col("_h.repeats").alias("n_repeat_words"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.select(
        *keep, "n_words", "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"), "n_repeat_words",
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_ratio"),
        (F.col("_l.dup") / F.greatest(F.col("_l.all"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"),
        F.when(F.col("n_words") < 100, 1.0 - F.col("n_distinct") / n).otherwise(F.lit(0.0)).alias("same_word_ratio"),
        (F.col("n_bangs") / n).alias("bang_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def certified(k: Column, n: Column, alpha: float, level: float | Column) -> Column:
    """Whether the exact upper bound on a rate with ``k`` of ``n`` events is at most ``alpha``.

    The bound at ``1 - level`` is at most ``alpha`` exactly if Bin(n, alpha) has at most ``level`` of
    its mass at 0..k. The mass is summed in logarithms, term by term, so large ``n`` is exact too.
    """
    odds = F.lit(alpha / (1 - alpha))
    first = n * F.log(F.lit(1 - alpha))
    start = F.struct(first.alias("term"), first.alias("all"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j * odds)
        return F.struct(term.alias("term"), (F.greatest(acc["all"], term) + F.log1p(F.exp(-F.abs(acc["all"] - term)))).alias("all"))

    mass = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["all"])
    return (n > 0) & (k < n * alpha) & (mass <= F.log(level if isinstance(level, Column) else F.lit(level)))


def stratum(column: Column, spec: RiskSpec) -> Column:
    return F.when(column.isin(*spec.strata), column).otherwise(F.lit("other"))


def first_step(steps: list[tuple[str, float]], use: Column) -> Column:
    """The first step of those in ``use`` (an array of step numbers) that rejects a row; null if none does."""
    hits = [F.when((F.col(m) > c) & F.array_contains(use, i), i) for i, (m, c) in enumerate(steps)]
    return F.array_min(F.array_compact(F.array(*hits)))


def choose_cutoffs(holdout: DataFrame, spec: RiskSpec) -> list[tuple[str, str, float]]:
    """(stratum, measure, cutoff) from a labelled holdout: quality (0 or 1), stratum and the measures.

    Three aggregations; the driver gets at most one row for each step and stratum of the fixed lists.
    """
    steps = path()
    every = F.sequence(F.lit(0), F.lit(len(steps) - 1))
    bad = holdout.where("quality = 0").select("stratum", first_step(steps, every).alias("t")).where("t is not null").distinct().collect()
    useful: dict[str, list[int]] = {}
    for row in sorted(bad):
        useful.setdefault(row["stratum"], []).append(row["t"])
    good = holdout.where("quality = 1")
    sizes = {r["stratum"]: r["count"] for r in good.groupBy("stratum").count().collect()}
    tested = [(x, t, sizes[x]) for x, ts in useful.items() if x in sizes for t in ts]
    if not tested:
        return []
    use = F.lit(None).cast("array<int>")
    for x, ts in useful.items():
        use = F.when(F.col("stratum") == x, F.array(*map(F.lit, ts))).otherwise(use)
    lost = good.select("stratum", first_step(steps, use).alias("t")).where("t is not null").groupBy("stratum", "t").agg(F.count("*").alias("k"))
    spark, total = holdout.sparkSession, sum(sizes.values())
    asked = spark.createDataFrame(tested, "stratum string, step int, n long").join(F.broadcast(lost), "stratum", "left")  # a row for each step and stratum at most
    upto = asked.groupBy("stratum", "step", "n").agg(F.coalesce(F.sum(F.when(F.col("t") <= F.col("step"), F.col("k"))), F.lit(0)).alias("k"))
    ok = upto.select("stratum", "step", certified(F.col("k"), F.col("n"), spec.alpha, F.col("n") * spec.delta / total).alias("ok")).orderBy("stratum", "step").collect()
    chosen: dict[tuple[str, str], float] = {}
    stopped: set[str] = set()
    for row in ok:
        if not row["ok"]:
            stopped.add(row["stratum"])
        if row["stratum"] not in stopped:
            m, c = steps[row["step"]]
            chosen[row["stratum"], m] = min(c, chosen.get((row["stratum"], m), c))
    return [(x, m, c) for (x, m), c in sorted(chosen.items())]


def rejected(cutoffs: list[tuple[str, str, float]]) -> Column:
    verdict = F.lit(False)
    for x, m, c in cutoffs:
        verdict = verdict | ((F.col("stratum") == x) & (F.col(m) > c))
    return verdict


def quality_rules(docs: DataFrame, labels: DataFrame, spec: RiskSpec = RiskSpec(), text: str = "text", stratum_column: str = "lang") -> DataFrame:
    """``docs``: doc_id, text and the stratum column; ``labels``: doc_id and quality (1 is good).

    Returns doc_id, the counts, the ratios, stratum, base_failed and kept, one row per input row.
    The measures are computed once and checkpointed (about 100 bytes a document); the holdout is
    the labelled rows that pass the base rule. A document labelled both ways counts as good.
    """
    d = docs.select("doc_id", F.col(text).alias("text"), F.col(stratum_column).cast("string").alias("_s"))
    m = cut(measures(d, keep=("doc_id", "_s")).withColumn("stratum", stratum(F.col("_s"), spec)).drop("_s").withColumn("base_failed", base_failed()))
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    cutoffs = choose_cutoffs(cut(m.where(~F.col("base_failed")).join(known, "doc_id")), spec)
    return m.withColumn("kept", ~F.col("base_failed") & ~rejected(cutoffs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_rules(docs, labels)


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE_SQL: dict[str, str] = {}
