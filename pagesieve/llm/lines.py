"""Removal of lines that many documents share (numbered operator 6). Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagesieve.functions.common import let
from pagesieve.llm.util import ascii_lower, hash128
from pagesieve.operators.skew import skewable_join
from pagesieve.session import materialize

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, version, dropped: positions (from 0) of the lines to drop; only documents that lose
    lines. version is a hash of the text, which keeps rows apart that share a doc_id.

    Lines travel as two 64-bit hashes with document and position, the text does not; these narrow
    rows are written once, since they are read twice. The count
    of distinct documents per key is reduced before each shuffle, so a line of a third of all
    documents is no hot group; the join back splits at hot keys.
    """
    version = F.xxhash64("text").alias("version")
    lines = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", version, F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = materialize(lines.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= min_chars).select(
        "doc_id", "version", "pos", *hash128(F.col("line"))), "linekeys")
    shared = (
        keyed.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    lost = skewable_join(keyed, shared, ["h1", "h2"], "inner").filter(F.col("doc_id") != F.col("keeper"))
    return lost.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("dropped"))


def drop_shared_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """docs with text less its shared lines, plus the numbers of lines before and of lines dropped,
    under the names in `counts`; columns that have these names already are replaced.

    A line's key is the line without blanks at both ends, A-Z lower-cased. A key of at least
    `min_chars` code points in at least `min_docs` documents loses all its lines, except in the
    document with the largest doc_id that holds it. The other lines stay as they were, in
    order. A null or empty text is one empty line; a row with a null doc_id is left as it is
    and not counted; rows that share doc_id and text are treated alike. Other columns are kept.
    """
    drops = dropped_positions(docs, min_chars, min_docs).withColumnsRenamed({"doc_id": "drop_id", "version": "drop_version"})
    text, dropped = docs["text"], drops["dropped"]
    joined = docs.join(drops, (docs["doc_id"] == drops["drop_id"]) & (F.xxhash64(text) == drops["drop_version"]), "left")
    # Interpreted lambdas would split the text again for each line, so it is split once per row.
    lines = _lines(text)
    kept = let(F.struct(lines.alias("lines"), dropped.alias("dropped")), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["dropped"]), lambda p: F.get(x["lines"], p)), "\n"))
    return joined.select(
        *[F.when(dropped.isNull(), text).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns if c not in counts],
        F.size(lines).cast("bigint").alias(counts[0]),
        F.coalesce(F.size(dropped), F.lit(0)).cast("bigint").alias(counts[1]),
    )
