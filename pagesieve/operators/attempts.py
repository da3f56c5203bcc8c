"""Winner selection over logs of competing extraction attempts.

An attempts table has request_id, attempt_id, tier, success, content_length, elapsed_ms (time of
completion since the request began) and error; content and started_ms are optional. All
per-request logic is written as aggregates, which Spark reduces on the map side, plus joins AQE
may split, so that one request with very many logged attempts does not land in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from pagesieve import constants as C
from pagesieve.functions.gates import access_restriction, sparse_warning
from pagesieve.operators.skew import skewable_join
from pagesieve.session import materialize

ATTEMPT_FIELDS = ["attempt_id", "tier", "success", "content_length", "elapsed_ms", "error"]


def _order() -> Column:
    return F.struct("elapsed_ms", "attempt_id")


def _by_handler(tier: str = "tier") -> Column:
    return F.coalesce(F.col(tier).isin(list(C.HANDLER_CAPS_MS)), F.lit(False))


def _good() -> Column:
    """Results that end a request: long ones, and those of a site handler above its bound."""
    bound = F.when(_by_handler(), F.lit(C.SPARSE_CHARS + 1)).otherwise(F.lit(C.GOOD_CHARS))
    return F.col("success") & (F.col("content_length") >= bound)


def _listed() -> Column:
    """Attempts a report shows: all of the tiers, and errors of the handler that logs them."""
    error = F.coalesce(F.col("error"), F.lit(C.NO_RESULT)) != C.NO_RESULT
    return ~_by_handler() | ((F.col("tier") == C.LOGGED_HANDLER) & ~F.col("success") & error)


def union_attempts(*logs: DataFrame) -> DataFrame:
    """The attempts of all tiers and special handlers as one log."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def _apply_caps(attempts: DataFrame, keep_silent: bool = False) -> DataFrame:
    """keep_silent: a handler's timeout that no report shows stays as a failed attempt."""
    started = F.col("started_ms") if "started_ms" in attempts.columns else F.lit(0)
    cap = F.when(F.lit(False), F.lit(0))
    text = F.when(F.lit(False), F.lit(""))
    for tier, ms in {**C.TIER_CAPS_MS, **C.HANDLER_CAPS_MS}.items():
        cap = cap.when(F.col("tier") == tier, F.lit(ms))
        text = text.when(F.col("tier") == tier, F.lit(f"Timeout after {ms / 1000:.1f}s"))
    late = F.coalesce(F.col("elapsed_ms") - started > cap, F.lit(False))
    changes = {
        "success": F.col("success") & ~late,
        "content_length": F.when(late, F.lit(0)).otherwise(F.col("content_length")).cast("bigint"),
        "elapsed_ms": F.when(late, started + cap).otherwise(F.col("elapsed_ms")).cast("bigint"),
        "error": F.when(late, text).otherwise(F.col("error")),
    }
    if "content" in attempts.columns:
        changes["content"] = F.when(~late, F.col("content"))
    silent = late & _by_handler() & (F.col("tier") != C.LOGGED_HANDLER)
    return (attempts if keep_silent else attempts.filter(~silent)).withColumns(changes)


def _in_time(attempts: DataFrame) -> DataFrame:
    return attempts.filter(F.col("elapsed_ms") <= C.GLOBAL_DEADLINE_MS)


def apply_deadlines(attempts: DataFrame) -> DataFrame:
    """Turn attempts over their tier's cap into timeouts; drop those past the global deadline."""
    return _in_time(_apply_caps(attempts))


def fail_late(attempts: DataFrame) -> DataFrame:
    """The same, with the attempts past the global deadline kept as failed ones, so that a request
    whose attempts all end late is still there."""
    in_time = F.col("elapsed_ms") <= C.GLOBAL_DEADLINE_MS
    return _apply_caps(attempts, keep_silent=True).withColumn("success", F.col("success") & in_time)


def global_timeouts(attempts: DataFrame) -> DataFrame:
    """request_ids still waiting at the global deadline: some attempt ended later and no good
    result had ended the race before. Takes the log before apply_deadlines."""
    late = F.col("elapsed_ms") > C.GLOBAL_DEADLINE_MS
    waiting = _apply_caps(attempts).groupBy("request_id").agg(
        F.max(late).alias("late"), F.max(_good() & ~late).alias("won")
    )
    return waiting.filter(F.col("late") & ~F.col("won")).select("request_id", _global_text().alias("warning"))


def _global_text() -> Column:
    return F.lit(f"Global timeout ({C.GLOBAL_DEADLINE_MS / 1000:.1f}s) reached")


def _summary(attempts: DataFrame) -> DataFrame:
    """Of each request the first good result, the longest success and whether an attempt ended late,
    in one aggregate over the log as it is."""
    in_time = F.col("elapsed_ms") <= C.GLOBAL_DEADLINE_MS
    capped = _apply_caps(attempts).withColumn("success", F.col("success") & in_time)
    return capped.groupBy("request_id").agg(*winner_aggregates(), F.max(~in_time).alias("late"))


def _hit() -> Column:
    """Earliest good result of a request, as (elapsed_ms, attempt_id)."""
    return F.min(F.when(_good(), _order()))


def winner_aggregates() -> list[Column]:
    """The earliest good result and the longest success of a group, as good and long."""
    fields = F.struct("attempt_id", "tier", "content_length", "elapsed_ms")
    first_good = F.min(F.when(_good(), F.struct("elapsed_ms", "attempt_id", fields.alias("row"))))
    longest = F.max(F.when(
        F.col("success") & (F.col("content_length") > 0) & ~_by_handler(),
        F.struct("content_length", (-F.col("elapsed_ms")).alias("e"), (-F.col("attempt_id")).alias("a"), fields.alias("row")),
    ))
    return [first_good.alias("good"), longest.alias("long")]


def winner_columns() -> list[Column]:
    row = F.coalesce(F.col("good.row"), F.col("long.row"))
    return [
        F.col("request_id"), row["attempt_id"].alias("attempt_id"), row["tier"].alias("winning_tier"),
        F.coalesce(row["content_length"], F.lit(0)).alias("content_length"), row["elapsed_ms"].alias("elapsed_ms"),
        row.isNotNull().alias("success"),
    ]


def pick_winner(attempts: DataFrame) -> DataFrame:
    """One row per request: the first success of at least the good length, else the longest
    success, the earliest on ties. Requests without a success keep a null winner. A site
    handler's result counts above its own bound only, and then ends the request."""
    return attempts.groupBy("request_id").agg(*winner_aggregates()).select(*winner_columns())


def truncate_after_winner(attempts: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Keep each request's attempts up to and including its first good result. hits(request_id, hit) is
    found in the attempts if it is not given."""
    if hits is None:
        hits = attempts.groupBy("request_id").agg(_hit().alias("hit")).filter(F.col("hit").isNotNull())
    joined = skewable_join(attempts, hits, ["request_id"])
    return joined.filter(F.col("hit").isNull() | (_order() <= F.col("hit"))).drop("hit")


def _number_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by request: `rank` counts from 1 within a request, across batches."""
    last, before = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("request_id"), run_end_type=pa.int64())
        ends, values = runs.run_ends.to_numpy(), runs.values
        starts = np.concatenate(([0], ends[:-1]))
        rank = np.arange(1, batch.num_rows + 1) - np.repeat(starts, ends - starts)
        if before and values[0].as_py() == last:
            rank[:ends[0]] += before
        last, before = values[-1].as_py(), int(rank[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rank)], batch.schema.names)


def completion_order(attempts: DataFrame) -> DataFrame:
    """Adds position, the 1-based rank by completion time within a request.

    The log is cut by sampled ranges of (request, millisecond, attempt id), sorted and numbered within them, and written
    once. So a request of any size lies in as many parts of equal size as it needs, whatever its attempt
    ids are. A part goes on with one request of those before it at most, so the offsets to add are no more than
    there are parts. Rows alike in all three columns keep positions of their own, in any order.
    """
    key = ["request_id", "elapsed_ms", "attempt_id"]
    columns = attempts.columns
    sliced = attempts.repartitionByRange(*key).sortWithinPartitions(*key).select(
        "*", F.spark_partition_id().cast("bigint").alias("_part"), F.lit(0).cast("bigint").alias("_rank"))
    parts = materialize(sliced.mapInArrow(_number_runs, sliced.schema), "ranges")
    held = parts.groupBy("request_id", "_part").agg(F.max("_rank").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("request_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.select(F.col("request_id").alias("_request"), F.col("_part").alias("_of"), earlier.alias("_earlier")).filter(F.col("_earlier") > 0)
    same = F.col("request_id").eqNullSafe(F.col("_request")) & (F.col("_part") == F.col("_of"))
    joined = parts.join(F.broadcast(offsets), same, "left")
    return joined.select(*columns, (F.col("_rank") + F.coalesce("_earlier", F.lit(0))).alias("position"))


def _ordered_attempts() -> Column:
    packed = F.struct("elapsed_ms", "attempt_id", F.struct(*ATTEMPT_FIELDS).alias("row"))
    return F.transform(F.array_sort(F.collect_list(packed)), lambda a: a["row"])


def collect_attempts(attempts: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """request_id and its attempts in completion order, ending with an early winner. A request
    becomes one cell here by definition, so this is the report's shape, not an intermediate."""
    shown = truncate_after_winner(_in_time(attempts), hits).filter(_listed())
    return shown.groupBy("request_id").agg(_ordered_attempts().alias("attempts"))


def failed_tiers(attempts: DataFrame) -> DataFrame:
    """The failure text of each request without a success. Which requests those are is found first; only
    their tiers are listed."""
    won = F.max(_good() | (F.col("success") & ~_by_handler()))
    lost = attempts.groupBy("request_id").agg(won.alias("won")).filter(~F.coalesce("won", F.lit(False))).select("request_id")
    shown = F.when(_listed(), F.struct("elapsed_ms", "attempt_id", "tier"))  # nulls are not collected
    names = F.transform(F.array_sort(F.collect_list(shown)), lambda a: a["tier"])
    failed = skewable_join(attempts.select("request_id", "attempt_id", "tier", "success", "elapsed_ms", "error"), lost, ["request_id"], "left_semi")
    return failed.groupBy("request_id").agg(names.alias("tiers")).select("request_id", _failure_text(F.col("tiers")).alias("warning"))


def _failure_text(tiers: Column) -> Column:
    empty = F.size(F.coalesce(tiers, F.array().cast("array<string>"))) == 0
    return F.when(empty, F.lit("All tiers failed")).otherwise(
        F.concat(F.lit("All tiers failed: "), F.array_join(tiers, ", "))
    )


def scrape_result(
    requests: DataFrame, attempts: DataFrame, allow_relays: bool = False, allow_tier3: bool = False
) -> DataFrame:
    """The full result per request(request_id, url, mode, force_tier) from the raw attempts log
    (with content): winner, attempts, warnings and suggestions in their fixed order."""
    slim = attempts.drop("content")
    summary = _summary(slim)
    hits = summary.filter(F.col("good").isNotNull()).select(
        "request_id", F.struct("good.elapsed_ms", "good.attempt_id").alias("hit"))
    waited = F.col("late") & F.col("good").isNull()
    winner = summary.select(*winner_columns(), F.when(waited, _global_text()).alias("timeout")).withColumnRenamed("elapsed_ms", "won_at_ms")
    listed = collect_attempts(apply_deadlines(slim), hits)
    # Contents are looked up for winners only, by keys as narrow as can be.
    won = winner.filter(F.col("attempt_id").isNotNull()).select("request_id", "attempt_id")
    content = attempts.select("request_id", "attempt_id", "content").join(won, ["request_id", "attempt_id"]).drop("attempt_id")
    joined = (
        requests.join(winner.drop("attempt_id"), "request_id", "left").join(content, "request_id", "left")
        .join(listed, "request_id", "left")
    )
    success = F.coalesce("success", F.lit(False)) & (F.coalesce("content", F.lit("")) != "")
    # A handler's result is returned as it is, without the assessment.
    handled = _by_handler("winning_tier")
    joined = joined.withColumn("success", success).withColumn(
        "restriction", access_restriction(F.when(success & ~handled, F.col("content")))
    )
    restricted = F.col("restriction.flag")
    failed = ~F.col("success")
    tiers = F.transform("attempts", lambda a: a["tier"])
    # A forced tier that is not allowed leaves nothing to run.
    barred = failed & F.col("attempts").isNull() & F.coalesce(F.col("force_tier") == 3, F.lit(False)) & F.lit(not allow_tier3)
    failed_run = failed & ~barred
    warnings = F.array_compact(F.array(
        F.col("timeout"),
        F.when(F.col("success"), sparse_warning(F.col("content_length"))),
        F.when(restricted, F.concat(F.lit("Access restriction detected: "), F.array_join("restriction.signals", ", "))),
        F.when(barred, F.lit(C.NO_TIERS)).otherwise(F.when(failed, _failure_text(tiers))),
    ))
    suggestions = F.array_compact(F.array(
        F.when(restricted, F.lit(f"Try external relays ({C.RELAY_SWITCH}=1)")),
        F.when(restricted, F.lit("Try archive fallback for paywalled content")),
        F.when(barred, F.lit(C.ENABLE_TIER3)),
        F.when(failed_run & F.lit(not allow_relays), F.lit(f"Enable external relays: {C.RELAY_SWITCH}=1")),
        F.when(failed_run & F.lit(not allow_tier3), F.lit(f"Enable Tier 3 browser: {C.TIER3_SWITCH}=1")),
        F.when(failed_run & F.col("force_tier").isNotNull(), F.lit("Try without force_tier to allow auto-escalation")),
    ))
    last_ms = F.array_max(F.transform("attempts", lambda a: a["elapsed_ms"]))
    total = F.when(F.col("timeout").isNotNull(), F.lit(C.GLOBAL_DEADLINE_MS).cast("bigint")).otherwise(
        F.when(handled, F.col("won_at_ms")).otherwise(last_ms))
    empty = F.array().cast(listed.schema["attempts"].dataType)
    return joined.select(
        "request_id", "url", "mode", "success",
        F.when(F.col("success"), F.col("content")).alias("content"),
        F.when(F.col("success"), F.col("content_length")).otherwise(F.lit(0)).cast("bigint").alias("content_length"),
        F.when(F.col("success"), F.col("winning_tier")).alias("winning_tier"),
        F.coalesce(total, F.lit(0)).cast("bigint").alias("total_elapsed_ms"),
        F.coalesce("attempts", empty).alias("tier_attempts"),
        warnings.alias("warnings"), suggestions.alias("suggestions"),
        restricted.alias("access_restriction_detected"),
        (F.col("success") & (F.col("content_length") < C.SPARSE_CHARS)).alias("sparse_content"),
    )


def tier_benchmark(attempts: DataFrame) -> DataFrame:
    """Attempts, successes, characters and completion times per tier and site type. The exact
    percentiles are over whole milliseconds below the deadline, so their state is bounded."""
    ms = F.col("elapsed_ms")
    return _in_time(attempts).groupBy("tier", "site_type").agg(
        F.count("*").alias("attempts"),
        F.count_if("success").alias("successes"),
        F.sum("content_length").alias("chars"),
        F.sum(ms).alias("total_ms"),
        F.percentile(ms, F.lit(0.5)).alias("p50_ms"),
        F.percentile(ms, F.lit(0.95)).alias("p95_ms"),
        F.max(ms).alias("max_ms"),
    )
