"""Posts as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def format_tweet(tweets: DataFrame) -> DataFrame:
    """Adds content from user, created_at, full_text, text, the three counts and media."""
    user, media = F.col("user"), F.col("media")
    counts = [("favorite_count", "Likes"), ("retweet_count", "Retweets"), ("reply_count", "Replies")]
    stats = F.concat_ws("  ", *[F.concat(F.lit(f"{label}: "), F.col(name).cast("string")) for name, label in counts])
    sources = F.transform(media, lambda m: F.coalesce(_filled(m["media_url_https"]), _filled(m["url"])))
    links = F.transform(F.array_compact(sources), lambda s: F.concat(F.lit("  "), s))
    title = F.concat(F.lit("\nMedia ("), F.size(media).cast("string"), F.lit(" item(s)):"))
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array(
            F.when(user.isNotNull(), F.concat(F.lit("@"), user["screen_name"], F.lit(" - "), user["name"])),
            F.concat(F.lit("Posted: "), _filled(F.col("created_at"))),
            F.lit(""),
            F.coalesce(_filled(F.col("full_text")), F.col("text"), F.lit("")),
            F.lit(""),
            _filled(stats),
        ),
        F.when(F.size(media) > 0, F.concat(F.array(title), links)).otherwise(none),
    )
    return tweets.withColumn("content", F.array_join(F.array_compact(lines), "\n"))
