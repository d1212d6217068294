"""Structured streaming over ledger rows. An extension: batch ledgers need none of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import upsert_formats


def file_drop(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def without_reuploads(rows: DataFrame, key: str = "fingerprint", time: str = "seen_at", delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_totals(rows: DataFrame, time: str, value: str, key: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Sum and count by key and window, final once the watermark has passed."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, size), key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def remember_formats(seen: DataFrame, path: str, checkpoint: str):
    """Fold each micro-batch into the format memory at ``path``; a batch that is run again changes nothing.

    Each batch writes the whole memory beside the last one, under its number.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], "fingerprint string, first_seen timestamp, last_seen timestamp, seen_count long")
        known = spark.read.parquet(f"{path}/batch={number - 1}") if number else empty
        upsert_formats(known, batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return seen.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_chain(rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Chain check of (account, amount, running_balance) rows as they arrive: checked and matched so far."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, checked, matched = state.get if state.exists else (None, 0, 0)
        for frame in frames:
            for r in frame.sort_values("seq").itertuples():
                if last is not None:
                    checked += 1
                    matched += abs(round(last + float(r.amount) - float(r.running_balance), 2)) <= tolerance
                last = float(r.running_balance)
        state.update((last, checked, matched))
        yield pd.DataFrame({"account": [key[0]], "checked": [checked], "matched": [matched]})

    return rows.groupBy("account").applyInPandasWithState(step, "account string, checked long, matched long", "last double, checked long, matched long", "update", GroupStateTimeout.NoTimeout)
