"""Removal of lines repeated across the pages of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagesieve.functions.common import let
from pagesieve.operators.skew import skewable_join


def _line_key(line: Column) -> Column:
    """The line itself while it is short, else its SHA-256 in hex. Digests are longer than any
    line kept as it is, so the two never meet; long paragraphs do not travel."""
    return F.when(F.octet_length(line) < 64, line).otherwise(F.sha2(line, 256))


def repeated_segments(docs: DataFrame, min_pages: int) -> DataFrame:
    """(host, line_key) on at least min_pages pages of docs(host, text). A page's own
    repetitions are removed inside its row, so counting rows counts pages, and the count of a
    line that is everywhere is already reduced on the map side."""
    lines = docs.select("host", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    keys = lines.filter(F.col("line") != "").select("host", _line_key(F.col("line")).alias("line_key"))
    counted = keys.groupBy("host", "line_key").agg(F.count("*").alias("pages"))
    return counted.filter(F.col("pages") >= min_pages).select("host", "line_key")


def drop_repeated_segments(docs: DataFrame, key: str, min_pages: int = 3) -> DataFrame:
    """docs with repeated lines removed from text; empty lines stay, and so do pages that lose
    every line. `key` identifies a page.

    Only line keys travel: the join yields (page, position) of the lines to remove, which are
    collected per page (never more than the page has lines) and applied to the text in its row.
    docs is read three times, so pass a stored table rather than the output of costly work.
    """
    repeated = repeated_segments(docs, min_pages)
    lines = docs.select(key, "host", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.filter(F.col("line") != "").select(key, "host", "pos", _line_key(F.col("line")).alias("line_key"))
    hits = skewable_join(keyed, repeated, ["host", "line_key"], "left_semi")
    per_page = hits.groupBy(key).agg(F.collect_set("pos").alias("hits"))
    text = let(F.split("text", "\n"), lambda rows: F.array_join(
        F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), F.col("hits")), lambda i: F.get(rows, i)
        ), "\n"))
    text = F.when(F.col("hits").isNull(), F.col("text")).otherwise(text)
    return docs.join(per_page, key, "left").withColumn("text", text).drop("hits")
