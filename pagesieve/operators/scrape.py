"""The whole way of a request, from stored responses to the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagesieve import constants as C
from pagesieve.functions.gates import passes_min_length, passes_page_gate
from pagesieve.operators.attempts import scrape_result
from pagesieve.operators.extract import extract
from pagesieve.operators.report import to_response
from pagesieve.operators.skew import skewable_join
from pagesieve.operators.validate import plan_tiers, validate_request, validate_urls_once
from pagesieve.session import materialize

_PAGE = ["url", "tier", "mode"]


def accept_requests(requests: DataFrame, dns: DataFrame) -> DataFrame:
    """Checked requests(request_id, url, mode, tier) with the cleaned url and mode, force_tier,
    host, error (refused with a text) and safe (the URL guard lets the URL pass)."""
    checked = validate_request(requests.drop("force_tier")).drop("url", "mode", "tier").withColumnsRenamed(
        {"clean_url": "url", "clean_mode": "mode"})
    guarded = validate_urls_once(checked.select("request_id", "url"), dns)
    safe = guarded.select("request_id", "host", F.col("error").isNull().alias("safe"))
    return checked.join(safe, "request_id")


def stored_attempts(accepted: DataFrame, responses: DataFrame, allow_tier3: bool = False) -> DataFrame:
    """One attempt per planned tier of each request, from responses(url, tier, status, html,
    elapsed_ms), one row per URL and tier, elapsed_ms counted from the start of the request.

    A page asked for by many requests is gated and extracted once per tier and mode; the text
    then joins the plan, whose popular URLs are a hot left key AQE may split.
    """
    runnable = accepted.filter(F.col("error").isNull() & (F.col("force_tier").isNull() | F.col("force_tier").between(1, 3)))
    plan = plan_tiers(runnable, allow_tier3).filter(F.col("planned_tier").isNotNull()).select(
        "request_id", F.col("position").cast("bigint").alias("attempt_id"), "url", F.col("planned_tier").alias("tier"), "mode", "safe")
    plan = materialize(plan, "plan")
    wanted = plan.filter("safe").select(*_PAGE).distinct()
    pages = responses.filter(passes_page_gate(F.col("tier"), F.col("status"), F.col("html"))).select("url", "tier", "html")
    offered = pages.join(wanted, ["url", "tier"])
    texts = extract(offered, min_pages=None, mode_column="mode").select(*_PAGE, "text")
    kept = texts.filter(passes_min_length(F.col("tier"), F.col("text")))
    timed = skewable_join(plan, responses.select("url", "tier", "elapsed_ms"), ["url", "tier"])
    joined = skewable_join(timed, kept, _PAGE)
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    text = F.when(F.col("safe"), F.col("text"))
    return joined.select(
        "request_id", "attempt_id", "tier", (text.isNotNull() & (chars > 0)).alias("success"), text.alias("content"),
        F.when(text.isNull(), F.lit(0)).otherwise(chars).cast("bigint").alias("content_length"),
        F.coalesce("elapsed_ms", F.lit(0)).cast("bigint").alias("elapsed_ms"),
        F.when(text.isNull(), F.lit(C.NO_RESULT)).alias("error"),
    )


def scrape_stored(
    requests: DataFrame, responses: DataFrame, dns: DataFrame, allow_relays: bool = False, allow_tier3: bool = False
) -> DataFrame:
    """One response record per request; refused requests carry the reason."""
    accepted = materialize(accept_requests(requests, dns), "accepted")
    attempts = materialize(stored_attempts(accepted, responses, allow_tier3), "attempts")
    results = scrape_result(accepted.filter(F.col("error").isNull()), attempts, allow_relays, allow_tier3)
    refused = accepted.filter(F.col("error").isNotNull()).select(
        "request_id", F.lit(False).alias("success"), F.col("error"), F.lit(0).cast("bigint").alias("char_count"),
        F.lit(0.0).alias("elapsed_time"))
    return to_response(results).unionByName(refused, allowMissingColumns=True)
