"""Ranked word search over extracted text, and hit lists as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagesieve import constants as C
from pagesieve.operators.skew import skewable_join

_WORDS = r"[^\p{L}\p{N}]+"
HIT_SCHEMA = "array<struct<title:string,href:string,body:string>>"


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), _WORDS), lambda w: w != "")


def search_top_k(pages: DataFrame, queries: DataFrame, k: int = C.SEARCH_MAX_RESULTS) -> DataFrame:
    """Top k pages(page_id, text) per queries(query_id, query): score is the number of words of
    the page that are words of the query; ties go to the lower page_id.

    Equal queries are ranked once and joined back. The semi join keeps only words some query
    asks for, so with a query list small enough to broadcast a page's other words never leave
    its task; beyond that a word on most pages is a hot left key that AQE splits. The rank
    limit is applied per task before the shuffle by query.
    """
    asked = queries.select(F.lower("query").alias("wanted")).distinct()
    terms = asked.select("wanted", F.explode(F.array_distinct(words(F.col("wanted")))).alias("word"))
    found = pages.select("page_id", F.explode(words(F.col("text"))).alias("word"))
    wanted = skewable_join(found, terms.select("word").distinct(), ["word"], "left_semi")
    per_page = wanted.groupBy("page_id", "word").agg(F.count("*").alias("n"))
    scored = skewable_join(per_page, terms, ["word"], "inner").groupBy("wanted", "page_id").agg(F.sum("n").alias("score"))
    order = Window.partitionBy("wanted").orderBy(F.desc("score"), F.asc("page_id"))
    top = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return skewable_join(queries.withColumn("wanted", F.lower("query")), top, ["wanted"], "inner").select(
        "query_id", "query", F.col("rank").cast("bigint").alias("rank"), "page_id", "score"
    )


def to_search_json(hits: DataFrame) -> DataFrame:
    """One JSON array per query from hits(query_id, rank, title, href, body), in rank order. The
    hit lists are limited to the top k before, so a group holds at most k rows."""
    item = F.struct("rank", F.struct("title", "href", "body").alias("hit"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda i: i["hit"])
    return hits.groupBy("query_id").agg(F.to_json(ordered).alias("results"))
