"""The staged way of a request: site handlers, then tiers, each only for requests that nothing before has solved.

What a stage offers is told by tables of stored answers, each with its latency; when a stage starts follows
from how those before it went. A page is parsed only if the request that asks for it is still
open when its answer arrives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagesieve import constants as C
from pagesieve.functions.gates import passes_min_length, passes_page_gate
from pagesieve.functions.urls import is_medium, is_twitter
from pagesieve.operators.attempts import scrape_result, union_attempts
from pagesieve.operators.extract import extract
from pagesieve.operators.fallbacks import latest_snapshot
from pagesieve.operators.redirects import resolve_redirects
from pagesieve.operators.report import to_response
from pagesieve.operators.scrape import accept_requests
from pagesieve.operators.skew import skewable_join
from pagesieve.operators.validate import plan_tiers
from pagesieve.session import materialize

TWITTER, MIRROR, ARCHIVE = C.HANDLER_CAPS_MS
TIERS = list(C.TIER_CAPS_MS)
_MIN_COPY = max(C.SOURCE_MIN_CHARS["archive"])
_LOG = ["request_id", "attempt_id", "tier", "success", "content", "content_length", "started_ms", "elapsed_ms", "error"]


def _logged(df: DataFrame, text: Column, took: Column) -> DataFrame:
    """Attempts with the text they brought, if any, and the time they took from started_ms on."""
    chars = F.coalesce(F.length(text), F.lit(0)).cast("bigint")
    return df.withColumns({
        "content": text, "content_length": chars, "success": chars > 0, "error": F.when(text.isNull(), F.lit(C.NO_RESULT)),
        "elapsed_ms": (F.col("started_ms") + took).cast("bigint"),
    })


def _texts(pages: DataFrame) -> DataFrame:
    """Extract once per row, and once only: what follows reads the stored texts."""
    return materialize(extract(pages, min_pages=None, mode_column="mode"), "texts")


def mirror_answers(pending: DataFrame, mirrors: DataFrame) -> DataFrame:
    """(url, mode, text, latency_ms) of the first mirror, by priority, whose page is long enough; the mirrors
    before it take their time too, and all of them when none is."""
    asked = pending.select("url", "mode").distinct()
    offered = mirrors.filter((F.col("status") == 200) & (F.length("html") > C.MIN_RESPONSE_CHARS))
    texts = _texts(offered.select("url", "priority", "html").join(asked, "url"))
    first = texts.filter(F.length("text") > _MIN_COPY).groupBy("url", "mode").agg(
        F.min("priority").alias("used"), F.min_by("text", "priority").alias("text"))
    spent = mirrors.select("url", "priority", "latency_ms").join(asked, "url").join(first.select("url", "mode", "used"), ["url", "mode"], "left").filter(
        F.col("used").isNull() | (F.col("priority") <= F.col("used"))).groupBy("url", "mode").agg(F.sum("latency_ms").alias("latency_ms"))
    return spent.join(first.drop("used"), ["url", "mode"], "left")


def archive_answers(pending: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(url, mode, text, latency_ms) of the newest capture; text is null unless that capture is good and long."""
    asked = pending.select("url", "mode").distinct()
    good = latest_snapshot(asked, snapshots).select("url", "html").join(asked, "url")
    texts = _texts(good).filter(F.length("text") > _MIN_COPY).select("url", "mode", "text")
    spent = snapshots.groupBy("url").agg(F.max_by("latency_ms", "captured_at").alias("latency_ms"))
    return asked.join(spent, "url").join(texts, ["url", "mode"], "left")


def _handle(state: DataFrame, applies: Column, answers: DataFrame, keys: list[str], tier: str, number: int) -> tuple[DataFrame, DataFrame]:
    """One handler for the open requests it applies to: (attempts, requests still open). A request that it does
    not solve goes on when the handler has ended, at its limit at the latest."""
    mine = skewable_join(state.filter(applies), answers, keys).withColumn("started_ms", F.col("begin"))
    took = F.coalesce("latency_ms", F.lit(0))
    tried = _logged(mine.withColumn("tier", F.lit(tier)), F.col("text"), took)
    in_time = (took <= C.HANDLER_CAPS_MS[tier]) & (F.col("elapsed_ms") <= C.GLOBAL_DEADLINE_MS)
    tried = materialize(tried.withColumn("solved", in_time & (F.col("content_length") > C.SPARSE_CHARS)).withColumn(
        "attempt_id", F.lit(number - 3).cast("bigint")), "handled")
    # A short answer is no answer, so it is no attempt that could win later.
    short = ~F.col("solved") & (took <= C.HANDLER_CAPS_MS[tier])
    log = tried.withColumns({
        "content": F.when(~short, F.col("content")), "success": F.col("success") & ~short,
        "content_length": F.when(short, F.lit(0)).otherwise(F.col("content_length")).cast("bigint"),
        "error": F.when(short, F.lit(C.NO_RESULT)).otherwise(F.col("error")),
    }).select(*_LOG)
    later = tried.filter(~F.col("solved")).withColumn("begin", (F.col("started_ms") + F.least(took, F.lit(C.HANDLER_CAPS_MS[tier]))).cast("bigint"))
    return log, state.filter(~F.coalesce(applies, F.lit(False))).unionByName(later.select(*state.columns))


def final_urls(state: DataFrame, responses: DataFrame, hops: DataFrame | None, dns: DataFrame) -> DataFrame:
    """Adds final_url, where the request's redirects end, each hop checked by the guard; null if they do not end well.
    A URL with a stored response and no hop is an end."""
    if hops is None:
        return state.withColumn("final_url", F.when(F.col("safe"), F.col("url")))
    ends = responses.select("url").distinct().join(hops.select("url"), "url", "left_anti").select(
        "url", F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"))
    chains = resolve_redirects(state.select("url").distinct(), hops.select("url", "status", "location").unionByName(ends), dns)
    return skewable_join(state, chains.select("url", "final_url"), ["url"])


def tier_attempts(state: DataFrame, responses: DataFrame, allow_tier3: bool) -> DataFrame:
    """The race of the tiers: the first one starts at `begin`, the others after the stagger, or when the first has
    failed if that is the HTTP tier. A request's attempts end in an order that is known beforehand, so round k takes the
    k-th of each open request, and a request with a good result takes part in no later round.
    """
    plan = plan_tiers(state, allow_tier3).filter(F.col("planned_tier").isNotNull()).select(
        "request_id", F.col("position").cast("bigint").alias("attempt_id"), "final_url", F.col("planned_tier").alias("tier"), "mode", "cap_ms", "begin")
    answered = responses.select(F.col("url").alias("final_url"), "tier", "latency_ms")
    timed = skewable_join(plan, answered, ["final_url", "tier"]).withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0)).cast("bigint"))
    stagger = F.when(F.col("attempt_id") == 0, F.lit(0)).otherwise(F.lit(C.STAGGER_MS))
    timed = timed.withColumn("started_ms", (F.col("begin") + stagger).cast("bigint"))
    # a request has at most one row per tier
    order = Window.partitionBy("request_id").orderBy(F.col("started_ms") + F.least("latency_ms", "cap_ms"), "attempt_id")
    timed = materialize(timed.withColumn("round", F.row_number().over(order)), "plan")
    gated = responses.filter(passes_page_gate(F.col("tier"), F.col("status"), F.col("html"))).select(F.col("url").alias("final_url"), "tier", "html")
    logs: list[DataFrame] = []
    todo = timed.filter("round = 1")
    for number in range(1, len(TIERS) + 1):
        end = F.col("started_ms") + F.col("latency_ms")
        heard = (F.col("latency_ms") <= F.col("cap_ms")) & (end <= C.GLOBAL_DEADLINE_MS)
        wanted = todo.filter(heard & F.col("final_url").isNotNull()).select("final_url", "tier", "mode").distinct()
        texts = _texts(gated.join(wanted, ["final_url", "tier"]).withColumn("url", F.col("final_url")))
        kept = texts.filter(passes_min_length(F.col("tier"), F.col("text"))).select("final_url", "tier", "mode", "text")
        tried = skewable_join(todo, kept, ["final_url", "tier", "mode"])
        logs.append(materialize(_logged(tried, F.when(heard, F.col("text")), F.col("latency_ms")).select(*_LOG), "round"))
        if number == len(TIERS):
            break
        good = F.col("success") & (F.col("content_length") >= C.GOOD_CHARS)
        solved = union_attempts(*logs).filter(good).select("request_id")
        # the HTTP tier, when it fails before the stagger is over, lets the others start at once
        early = logs[0].filter((F.col("tier") == TIERS[0]) & (F.col("attempt_id") == 0) & ~F.col("success")).select(
            "request_id", F.col("elapsed_ms").alias("failed_ms"))
        rest = timed.filter(F.col("round") == number + 1).join(solved, "request_id", "left_anti").join(early, "request_id", "left")
        todo = rest.withColumn("started_ms", F.least("started_ms", "failed_ms")).drop("failed_ms")
    return union_attempts(*logs)


def route_attempts(
    accepted: DataFrame, responses: DataFrame, dns: DataFrame, hops: DataFrame | None = None, tweets: DataFrame | None = None,
    mirrors: DataFrame | None = None, snapshots: DataFrame | None = None, allow_relays: bool = False, allow_tier3: bool = False,
) -> DataFrame:
    """The attempts of all stages. A forced tier skips the handlers."""
    runnable = accepted.filter(F.col("error").isNull() & (F.col("force_tier").isNull() | F.col("force_tier").between(1, 3)))
    state = runnable.select("request_id", "url", "host", "mode", "force_tier", "safe", F.lit(0).cast("bigint").alias("begin"))
    logs: list[DataFrame] = []
    free = F.col("force_tier").isNull()
    if tweets is not None:
        mine = free & is_twitter(F.col("host"))
        log, state = _handle(state, mine, tweets.select("url", F.col("content").alias("text"), "latency_ms"), ["url"], TWITTER, 0)
        logs.append(log)
    for number, (table, answer, tier) in enumerate([(mirrors, mirror_answers, MIRROR), (snapshots, archive_answers, ARCHIVE)], 1):
        if allow_relays and table is not None:
            mine = free & is_medium(F.col("host"))
            log, state = _handle(state, mine, answer(state.filter(mine), table), ["url", "mode"], tier, number)
            logs.append(log)
    left = materialize(final_urls(state, responses, hops, dns), "open")
    return union_attempts(*logs, tier_attempts(left, responses, allow_tier3))


def scrape_route(
    requests: DataFrame, responses: DataFrame, dns: DataFrame, hops: DataFrame | None = None, tweets: DataFrame | None = None,
    mirrors: DataFrame | None = None, snapshots: DataFrame | None = None, allow_relays: bool = False, allow_tier3: bool = False,
) -> DataFrame:
    """One response record per request(request_id, url, mode, tier); refused requests carry the reason.

    responses(url, tier, status, html, latency_ms): one row per URL and tier; hops(url, status, location); tweets(url,
    content, latency_ms); mirrors(url, priority, status, html, latency_ms); snapshots(url, captured_at,
    status, html, latency_ms). Latencies count from the start of the attempt they belong to. A handler
    without a table is not asked.
    """
    accepted = materialize(accept_requests(requests, dns), "accepted")
    attempts = materialize(route_attempts(accepted, responses, dns, hops, tweets, mirrors, snapshots, allow_relays, allow_tier3), "attempts")
    results = scrape_result(accepted.filter(F.col("error").isNull()), attempts, allow_relays, allow_tier3)
    refused = accepted.filter(F.col("error").isNotNull()).select(
        "request_id", F.lit(False).alias("success"), F.col("error"), F.lit(0).cast("bigint").alias("char_count"),
        F.lit(0.0).alias("elapsed_time"))
    return to_response(results).unionByName(refused, allowMissingColumns=True)
