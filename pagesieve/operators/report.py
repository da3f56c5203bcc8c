"""Responses, reports, file names and file bodies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from pagesieve import constants as C
from pagesieve.functions.text import char_count, line_count, seconds_text, thousands
from pagesieve.functions.urls import normalize_mode, url_host

EXHAUSTED = "All scraping tiers exhausted. Could not extract content."


def safe_host(url: Column) -> Column:
    """The host with everything but letters, digits, `_`, `.` and `-` replaced."""
    host = url_host(url)
    return F.regexp_replace(F.when(host == "", F.lit("output")).otherwise(host), r"[^\p{L}\p{N}_.-]", "_")


def _time(ts: datetime | Column) -> Column:
    return ts if isinstance(ts, Column) else F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")


def with_output_name(df: DataFrame, ts: datetime | Column, ocr: bool = False) -> DataFrame:
    """Adds file_name from url, label, mode and the time of the scrape, a timestamp column or one time for
    all rows; OCR results are always .txt."""
    full = F.lit(False) if ocr else F.coalesce(normalize_mode(F.col("mode")) == "full", F.lit(False))
    stamp = F.date_format(_time(ts), "yyyyMMdd_HHmmss")
    extension = F.when(full, ".md").otherwise(".txt")
    name = F.concat(safe_host(F.col("url")), F.lit("_"), F.col("label"), F.lit("_"), stamp, extension)
    return df.withColumn("file_name", name)


def with_file_header(df: DataFrame, ts: datetime | Column, ocr: bool = False) -> DataFrame:
    """Adds body: a header with the facts about the result and the time of its scrape, a rule and the content."""
    line = [F.concat(F.lit("URL     : "), F.col("url")), F.concat(F.lit("Method  : "), F.col("label"))]
    micros = F.date_format(_time(ts), ".SSSSSS")
    scraped = F.concat(F.lit("Scraped : "), F.date_format(_time(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != ".000000", micros).otherwise(""))
    if ocr:
        line += [scraped, F.lit("─" * 60)]
    else:
        chars = F.concat(F.lit("Chars   : "), thousands(F.length("content")))
        line += [F.concat(F.lit("Mode    : "), F.col("mode")), scraped, chars, F.lit("-" * 60)]
    return df.withColumn("body", F.concat(F.concat_ws("\n", *line), F.lit("\n\n"), F.col("content")))


def to_response(results: DataFrame) -> DataFrame:
    """The API record; results has content, winning_tier and total_elapsed_ms."""
    ok = F.coalesce(F.col("content"), F.lit("")) != ""
    return results.select(
        "request_id", ok.alias("success"), F.when(ok, F.col("winning_tier")).alias("tier_used"),
        F.when(ok, F.col("content")).alias("content"),
        F.when(ok, char_count(F.col("content"))).otherwise(F.lit(0)).cast("bigint").alias("char_count"),
        F.bround(F.col("total_elapsed_ms") / 1000, 2).alias("elapsed_time"),
        F.when(~ok, F.lit(EXHAUSTED)).alias("error"),
    )


def truncate_output(df: DataFrame, n: int = C.MAX_RETURN_CHARS) -> DataFrame:
    """Cuts text to n characters; adds truncated and output, the cut text with its trailer."""
    cut = F.length("text") > n
    head = F.substring("text", 1, n)
    trailer = F.concat(head, F.lit(f"\n\n[TRUNCATED] Output capped at {n:,} characters."))
    return df.withColumns({"output": F.when(cut, trailer).otherwise(F.col("text")), "truncated": cut, "text": head})


def content_stats(df: DataFrame) -> DataFrame:
    """Adds char_count and line_count of content."""
    content = F.coalesce(F.col("content"), F.lit(""))
    return df.withColumn("char_count", char_count(content)).withColumn("line_count", line_count(content))


def _section(title: str, items: Column, leading: str = "", trailing: bool = False) -> Column:
    """A titled list as lines, or no lines for an empty list."""
    lines = F.concat(F.array(F.lit(leading + title)), F.transform(items, lambda i: F.concat(F.lit("  - "), i)))
    if trailing:
        lines = F.concat(lines, F.array(F.lit("")))
    return F.when(F.size(items) > 0, lines).otherwise(F.array().cast("array<string>"))


def _success_report() -> Column:
    content, attempts = F.col("content"), F.col("tier_attempts")
    chars = F.col("content_length")
    others = F.transform(
        F.filter(attempts, lambda a: a["tier"] != F.col("winning_tier")),
        lambda a: F.concat(
            a["tier"], F.when(a["success"], F.lit(" (ok: ")).otherwise(F.lit(" (fail: ")),
            a["content_length"].cast("string"), F.lit(" chars)"),
        ),
    )
    method = F.concat(F.lit("METHOD: "), F.col("winning_tier"), F.lit(" ("), seconds_text(F.col("total_elapsed_ms")), F.lit("s)"))
    other = F.when(F.size(others) > 0, F.concat(F.lit(" | other: "), F.array_join(others, ", "))).otherwise(F.lit(""))
    returned = F.least(F.length(content), F.lit(C.MAX_RETURN_CHARS))
    flags = F.concat_ws(
        ", ", F.when(F.col("sparse_content"), F.lit("SPARSE_CONTENT")),
        F.when(F.col("access_restriction_detected"), F.lit("ACCESS_RESTRICTED")),
    )
    header = F.concat_ws(
        "\n", F.concat(F.lit("SOURCE: "), F.col("url")), F.concat(method, other),
        F.concat(F.lit("MODE: "), F.col("mode")),
        F.concat(F.lit("CHARS: original="), thousands(chars), F.lit("; returned="), thousands(returned)),
        F.when(flags != "", F.concat(F.lit("STATUS: "), flags)),
    )
    trailer = F.when(
        F.length(content) > C.MAX_RETURN_CHARS,
        F.lit(f"\n\n[TRUNCATED] Output capped at {C.MAX_RETURN_CHARS:,} characters."),
    ).otherwise(F.lit(""))
    footer = F.array_join(F.concat(
        _section("WARNINGS:", F.col("warnings"), leading="\n"), _section("SUGGESTIONS:", F.col("suggestions"), leading="\n")
    ), "\n")
    body = F.concat(header, F.lit("\n\n"), F.substring(content, 1, C.MAX_RETURN_CHARS), trailer)
    return F.when(footer != "", F.concat(body, F.lit("\n"), footer)).otherwise(body)


def _failure_report() -> Column:
    tiers = F.transform("tier_attempts", lambda a: F.concat(
        a["tier"], F.when(a["success"], F.lit(": OK")).otherwise(F.lit(": FAILED")),
        F.when(a["error"] != "", F.concat(F.lit(" ("), a["error"], F.lit(")"))).otherwise(F.lit("")),
        F.when(a["success"], F.concat(F.lit(", "), a["content_length"].cast("string"), F.lit(" chars"))).otherwise(F.lit("")),
    ))
    return F.array_join(F.concat(
        F.array(F.concat(F.lit("ERROR: Failed to fetch "), F.col("url")), F.lit("")),
        _section("Tier Results:", tiers, trailing=True),
        _section("Warnings:", F.col("warnings"), trailing=True),
        _section("Suggestions:", F.col("suggestions")),
    ), "\n")


def format_result(results: DataFrame) -> DataFrame:
    """Adds report to the rows of scrape_result."""
    ok = F.col("success") & (F.coalesce(F.col("content"), F.lit("")) != "")
    return results.withColumn("report", F.when(ok, _success_report()).otherwise(_failure_report()))
