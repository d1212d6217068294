"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The five ASCII white-space controls that, with the blank, separate words.
SPACES = "\t\n\x0b\x0c\r"


#: Rows in one Arrow batch to a Python worker: whole texts make large rows, and a batch is held at once.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` rows; smaller settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's own setting. Where none is set, one machine may
    use its own temporary folder; a cluster may not."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = os.path.join(tempfile.gettempdir(), "tallyweave-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder: later reads survive the loss of any executor."""
    bounded_batches(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bits of the bitmaps that keep unwanted texts out of shuffles (2 MB at any size of the data).
BITMAP_BITS = 24


def spot(*keys: str) -> Column:
    """Where the keys fall in a bitmap, from 1."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << BITMAP_BITS)) + 1


def bitmap(wanted: DataFrame, *keys: str) -> np.ndarray:
    """A bitmap of fixed size over the hashed keys of ``wanted``. It lets some other keys through, never
    fewer; whoever uses it joins afterwards."""
    return bitmap_of(wanted, spot(*keys))


def bitmap_of(wanted: DataFrame, where: Column) -> np.ndarray:
    """The same for places from 1 to 2 ** ``BITMAP_BITS`` that the caller computes."""
    at = wanted.select(where.alias("at"))
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map")).collect()
    width = 4096  # bytes of one of Spark's bitmap buckets, which count from 1
    table = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in rows:
        start = (r["bucket"] - 1) * width
        table[start : start + width] = np.frombuffer(bytes(r["map"]).ljust(width, b"\0"), np.uint8)
    return table


def lit_up(table: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Whether each spot's bit is set."""
    i = spots - 1
    return (table[i >> 3] >> (i & 7).astype(np.uint8) & 1).astype(bool)


def free_name(base: str, taken: list[str]) -> str:
    """``base``, with underscores before it as long as a column has that name (in any case)."""
    names = {c.lower() for c in taken}
    while base.lower() in names:
        base = "_" + base
    return base


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``: the folds of the labelled rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def words_column(text: Column) -> Column:
    """Maximal runs of characters other than blanks and the ASCII white-space controls."""
    blanked = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(blanked, " "), lambda w: w != F.lit(""))
