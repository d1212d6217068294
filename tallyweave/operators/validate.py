"""Row validation and quality scores, relative to an explicit day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text
from .ledger import flag_duplicates


def date_errors(d: Column, as_of: Column) -> Column:
    return F.array_compact(F.array(
        F.when(d.isNull(), "missing_date"), F.when(d > F.date_add(as_of, rules.FUTURE_DAYS), "future_date"),
        F.when(d < F.date_sub(as_of, 365 * rules.PAST_YEARS), "ancient_date"),
    ))


def description_errors(t: Column) -> Column:
    missing = t.isNull() | (t == "")
    return F.array_compact(F.array(F.when(missing, "missing_description"), F.when(~missing & (F.length(F.trim(t)) < rules.MIN_DESCRIPTION), "short_description")))


def amount_errors(a: Column) -> Column:
    return F.array_compact(F.array(F.when(a.isNull(), "missing_amount"), F.when(F.abs(a) < rules.MIN_AMOUNT, "zero_amount"), F.when(F.abs(a) > rules.MAX_AMOUNT, "huge_amount")))


def score(d: Column, t: Column, a: Column, n_errors: Column, n_warnings: Column, as_of: Column) -> Column:
    """0 to 100: completeness 40, date 20, description 20, amount 20, less 10 for errors and 5 for warnings."""
    size, days, size_a = F.length(F.trim(F.coalesce(t, F.lit("")))), F.abs(F.datediff(d, as_of)), F.abs(a)
    points = (
        F.when(d.isNotNull(), 15).otherwise(0) + F.when(size >= 5, 15).otherwise(0) + F.when(a.isNotNull(), 10).otherwise(0)
        + F.when(days < 365, 20).when(days < 730, 10).when(days.isNotNull(), 5).otherwise(0)
        + F.when(size >= 20, 20).when(size >= 10, 15).when(size >= 5, 10).otherwise(0)
        + F.when(size_a.between(rules.MIN_AMOUNT, 10_000), 20).when((size_a > 0) & (size_a <= 100_000), 10).when(size_a > 0, 5).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), points - 10 * n_errors - 5 * n_warnings)).cast("double")


def validate(rows: DataFrame, as_of: str) -> DataFrame:
    """``rows`` with errors, n_warnings, is_valid and quality_score. Repeats are errors, not critical ones."""
    day, t = F.lit(as_of).cast("date"), F.col("description")
    d_err, t_err, a_err = date_errors(F.col("txn_date"), day), description_errors(t), amount_errors(F.col("amount"))
    warn = lambda e, silent: F.size(F.filter(e, lambda x: x != silent))
    warnings = warn(d_err, "missing_date") + warn(t_err, "missing_description") + warn(a_err, "missing_amount") + F.coalesce(text.any_of(F.lower(t), rules.SUSPICIOUS), F.lit(False)).cast("int")
    marked = flag_duplicates(rows)
    errors = F.concat(d_err, t_err, a_err, F.when(F.col("is_duplicate"), F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>")))
    done = marked.withColumn("errors", errors).withColumn("n_warnings", warnings)
    valid = F.size(F.array_intersect("errors", F.array(*[F.lit(x) for x in rules.CRITICAL]))) == 0
    return done.withColumn("is_valid", valid).withColumn("quality_score", score(F.col("txn_date"), t, F.col("amount"), F.size("errors"), F.col("n_warnings"), day)).drop("is_duplicate")


def accepted(validated: DataFrame, least: float = 30.0) -> DataFrame:
    return validated.where(F.col("is_valid") & (F.col("quality_score") >= least))


def rejected(validated: DataFrame, least: float = 30.0) -> DataFrame:
    return validated.where(~(F.col("is_valid") & (F.col("quality_score") >= least)))
