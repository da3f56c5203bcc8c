"""Alternative copies of a page, and the hand-over between tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagesieve import constants as C
from pagesieve.operators.extract import extract
from pagesieve.session import materialize

_MIN_TEXT = max(C.SOURCE_MIN_CHARS["archive"])


def latest_snapshot(urls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The newest capture of each asked URL, if that very capture has status 200 and a long
    enough body; an older good copy does not step in. (url, captured_at) is unique.

    The newest capture is found on narrow columns with a map-side maximum, before the asked
    URLs are looked up, so a URL with very many captures shrinks first; the page bodies are
    read only in the join that follows, which spreads a URL's captures by their time.
    """
    newest = snapshots.groupBy("url").agg(
        F.max("captured_at").alias("captured_at"), F.max_by("status", "captured_at").alias("newest_status")
    )
    asked = newest.join(urls.select("url").distinct(), "url", "left_semi")
    good = asked.filter(F.col("newest_status") == 200).select("url", "captured_at")
    bodies = snapshots.filter((F.col("status") == 200) & (F.length("html") > C.MIN_RESPONSE_CHARS))
    return bodies.join(good, ["url", "captured_at"])


def latest_snapshot_text(urls: DataFrame, snapshots: DataFrame, mode: str = "precision") -> DataFrame:
    """The extracted text of the newest capture where it is long enough for an archived copy."""
    texts = extract(latest_snapshot(urls, snapshots), mode, min_pages=None)
    # A filter on text would be moved below the extraction, which would then be computed twice.
    long = F.filter(F.array("text"), lambda t: F.length(t) > _MIN_TEXT)
    return texts.select("url", "captured_at", F.explode(long).alias("text"))


def first_passing_mirror(mirrors: DataFrame) -> DataFrame:
    """Per URL the text of the first mirror, by priority, that passes status and length."""
    passing = mirrors.filter((F.col("status") == 200) & (F.length("text") > _MIN_TEXT))
    if "html" in mirrors.columns:
        passing = passing.filter(F.length("html") > C.MIN_RESPONSE_CHARS)
    best = passing.groupBy("url").agg(F.min_by(F.struct("priority", "text"), "priority").alias("best"))
    return best.select("url", "best.priority", "best.text")


def escalate(pending: DataFrame, solved: DataFrame, key: str = "request_id") -> DataFrame:
    """The requests the next tier has to take.

    They are written to the shared folder: as a plan, what is pending holds that of every tier
    before it twice, and all those joins by one key would run and take memory in one task.
    `solved` is best written too if it was derived from `pending` and is used again.
    """
    return materialize(pending.join(solved.select(key), key, "left_anti"), "pending")
