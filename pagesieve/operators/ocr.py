"""Recognised text lines to page text. All lines of an image sit in one nested value, so the
work is done inside the row and needs no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagesieve import constants as C
from pagesieve.functions.gates import ocr_text_gate, vision_text_gate
from pagesieve.functions.text import collapse_newlines, strip


def assemble_ocr(df: DataFrame, pages: str = "pages") -> DataFrame:
    """Adds text from pages: array<struct<text_lines: array<struct<text, confidence>>>>. Lines
    below the confidence bound are dropped (an unknown confidence is kept), blank lines too;
    a text that is too short becomes null."""
    lines = F.flatten(F.transform(F.col(pages), lambda p: p["text_lines"]))
    sure = F.filter(lines, lambda n: ~F.coalesce(n["confidence"] < C.OCR_MIN_CONFIDENCE, F.lit(False)))
    texts = F.filter(F.transform(sure, lambda n: strip(n["text"])), lambda t: t != "")
    return df.withColumn("text", ocr_text_gate(strip(collapse_newlines(F.array_join(texts, "\n"))))).drop(pages)


def ocr_fallback(local: DataFrame, vision: DataFrame, mode: str, key: str = "doc_id") -> DataFrame:
    """The text of the engine the mode asks for, with its label; `both` uses the second engine
    where the first gave nothing. Inputs hold one row per key."""
    first = local.select(key, F.col("text").alias("a"))
    second = vision.select(key, vision_text_gate(strip(F.col("text"))).alias("b"))
    if mode == "surya":
        out = first.select(key, F.lit("playwright_surya").alias("method"), F.col("a").alias("text"))
    elif mode == "claude":
        out = second.select(key, F.lit("playwright_claude").alias("method"), F.col("b").alias("text"))
    elif mode == "both":
        label = F.when(F.col("a").isNotNull(), "playwright_surya").otherwise("playwright_claude_fallback")
        out = first.join(second, key, "left").select(key, label.alias("method"), F.coalesce("a", "b").alias("text"))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return out.filter(F.col("text").isNotNull())
