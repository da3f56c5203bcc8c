"""The batch rules on unbounded input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pagesieve import constants as C
from pagesieve.functions.gates import has_js_wall
from pagesieve.functions.urls import url_scheme_port
from pagesieve.operators.attempts import fail_late, winner_aggregates, winner_columns
from pagesieve.operators.extract import extract
from pagesieve.operators.validate import validate_url_syntax
from pagesieve.session import new_folder


def stream_extract(pages: DataFrame, mode: str = "precision") -> DataFrame:
    """Gate and extract each page as it comes; no state, no shuffle."""
    passed = pages.filter((F.length("html") > C.MIN_RESPONSE_CHARS) & ~has_js_wall(F.col("html")))
    return extract(passed, mode, min_pages=None)


def stream_validate_once(urls: DataFrame, event_time: str = "seen_at", keep: str = "1 hour", parts: int = 256) -> DataFrame:
    """The first URL of each (host, scheme, port) within the watermark: the ones to look up.
    Memory is bounded by time. Duplicates go in two steps: first within `parts` parts that the rows of a
    host fall into by their time, so one URL that is everywhere is thinned out by as many tasks; then among
    the parts' first ones."""
    port = url_scheme_port(F.col("url"))["port"]
    keyed = validate_url_syntax(urls).filter(F.col("error").isNull()).withColumn("port", port)
    part = F.pmod(F.xxhash64(F.unix_micros(event_time), "url"), F.lit(parts))
    salted = keyed.withColumn("salt", part).withWatermark(event_time, keep)
    thinned = salted.dropDuplicatesWithinWatermark(["host", "scheme", "port", "salt"]).drop("salt")
    return thinned.dropDuplicatesWithinWatermark(["host", "scheme", "port"])


def count_in_time(rows: DataFrame, event_time: str, lateness: str, width: str, *keys: str) -> DataFrame:
    """n rows per window of `width` and keys, given when the watermark has passed it (append mode).
    Rows of a window that had ended `lateness` before the newest row are dropped."""
    return rows.withWatermark(event_time, lateness).groupBy(F.window(event_time, width), *keys).agg(
        F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def _started(attempts: DataFrame) -> Column:
    if "started_at" in attempts.columns:
        return F.unix_millis("started_at")
    return F.unix_millis("finished_at") - F.col("elapsed_ms")


def _race(attempts: DataFrame, lateness_ms: int) -> DataFrame:
    delay = f"{C.GLOBAL_DEADLINE_MS + lateness_ms} milliseconds"
    deadline = F.timestamp_millis(_started(attempts) + C.GLOBAL_DEADLINE_MS)
    timed = fail_late(attempts.withColumn("deadline", deadline).withWatermark("deadline", delay))
    return timed.groupBy("request_id", "deadline").agg(*winner_aggregates())


def stream_race(attempts: DataFrame, lateness_ms: int = 5_000) -> DataFrame:
    """One winner per request when its deadline has passed (append mode): the batch aggregates,
    reduced on the map side, so a request with very many attempts stays cheap. Tier caps hold as
    in batch. Attempts that end after the deadline count as failed, so a request
    whose attempts all do has a row without a winner; those that come later than the watermark are dropped.

    attempts also has started_at, the time at which its request began, the same in all its attempts, whatever
    the clocks say that timed their ends. Without that column it is finished_at less elapsed_ms,
    and attempts of a request whose clocks disagree are then raced apart.
    The watermark runs on the deadline, which lies up to one deadline ahead of an attempt's end.
    """
    return _race(attempts, lateness_ms).select(*winner_columns())


def stream_race_early(attempts: DataFrame, lateness_ms: int = 5_000) -> DataFrame:
    """The requests already decided (update mode): a first result of the good length is given in
    the batch it arrives in, without waiting for the deadline. A later batch repeats the row if
    more attempts of the request come in; the newest row counts."""
    return _race(attempts, lateness_ms).filter(F.col("good").isNotNull()).select(*winner_columns())


def run_available(stream: DataFrame, label: str, out: str | None = None, progress: str | None = None) -> DataFrame:
    """Process what is there now and return all results so far. With the same folders for results
    (`out`) and progress, a later call continues where the last one stopped, also after a failure, and
    adds no row twice. Without them, fresh ones in the shared folder are used, and all is read."""
    spark = stream.sparkSession
    out, progress = out or new_folder(spark, label), progress or new_folder(spark, label + "-progress")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_updates(stream: DataFrame, label: str, key: str, out: str | None = None, progress: str | None = None) -> DataFrame:
    """As run_available for an update-mode stream: the newest row per key. A batch run again
    after a failure overwrites its own folder."""
    spark = stream.sparkSession
    out, progress = out or new_folder(spark, label), progress or new_folder(spark, label + "-progress")
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")  # there may be no batch at all
    rows = spark.read.schema(schema).parquet(out)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("row"))
    return newest.select("row.*")
