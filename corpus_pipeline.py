"""The corpus pipeline: each stage takes documents and returns the documents that it keeps.

Stages work on whole tables, return the columns of documents (the last adds how often and where in the
mixture a document is read) and pass on through Parquet. Null ids, null texts, repeated rows
and empty tables are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagesieve.llm.decontaminate import drop_contaminated
from pagesieve.llm.langid import keep_identified
from pagesieve.llm.lines import drop_shared_lines
from pagesieve.llm.mixing import mix_documents
from pagesieve.llm.simhash import drop_near_duplicates
from pagesieve.llm.util import table
from pagesieve.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for one copy; n_chars follows the text. A document
    stays even if it has lost all its lines."""
    out = drop_shared_lines(docs, counts=("stage_lines", "stage_dropped"))
    n_chars = F.when(F.col("stage_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of SimHash fingerprints (three words, two bits) stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get their target weights; n_copies and slots say how a document is read."""
    return mix_documents(docs)


STAGES = [
    ("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("mixing", mixing),
]
# Language profiles and fingerprint classes are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
