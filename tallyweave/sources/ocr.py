"""Recognised boxes to words in points from the top left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vision_words(boxes: DataFrame) -> DataFrame:
    """Boxes normalised from the bottom left (norm_x, norm_y, norm_w, norm_h, img_w, img_h, dpi) to words.

    A box of several words is split evenly; part is the word's place in it.
    """
    scale = 72.0 / F.col("dpi")
    split = boxes.select("*", F.split(F.trim("text"), r"\s+").alias("_ws")).select("*", F.posexplode("_ws").alias("part", "_w"))
    wide = F.col("norm_w") * F.col("img_w") / F.size("_ws")
    left = F.col("norm_x") * F.col("img_w") + F.col("part") * wide
    top = (1 - F.col("norm_y") - F.col("norm_h")) * F.col("img_h")
    words = split.withColumns({"x0": left * scale, "x1": (left + wide) * scale, "top": top * scale, "bottom": (1 - F.col("norm_y")) * F.col("img_h") * scale})
    return words.drop("text").withColumnRenamed("_w", "text").drop("_ws", "norm_x", "norm_y", "norm_w", "norm_h", "img_w", "img_h", "dpi")


def tesseract_words(rows: DataFrame, least: float = 30.0) -> DataFrame:
    """Pixel rows (text, conf, left, top, width, height, dpi) to words; a confidence from 0 to ``least`` drops one."""
    scale, conf = 72.0 / F.col("dpi"), F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    kept = rows.where(~((conf >= 0) & (conf < least)) & (F.trim("text") != ""))
    return kept.withColumns({"x0": F.col("left") * scale, "x1": (F.col("left") + F.col("width")) * scale, "_t": F.col("top") * scale, "bottom": (F.col("top") + F.col("height")) * scale}).drop("top", "left", "width", "height", "dpi", "conf").withColumnRenamed("_t", "top")


def route(pages: DataFrame, least: int = 50) -> DataFrame:
    """doc_id and backend: all pages are recognised where the first page's text is short."""
    first = F.max(F.when(F.col("page") == 1, F.length(F.trim(F.coalesce("text", F.lit(""))))))
    return pages.groupBy("doc_id").agg(F.when(F.coalesce(first, F.lit(0)) < least, "ocr").otherwise("text").alias("backend"))


def first_text(pages: DataFrame, *candidates: str) -> DataFrame:
    """The first candidate column with any text, in order, and its name."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    text, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(candidates):
        text, name = F.when(has(F.col(c)), F.col(c)).otherwise(text), F.when(has(F.col(c)), c).otherwise(name)
    return pages.withColumn("text", text).withColumn("backend", name)
