"""Winner selection against a plain loop, on random and on skewed logs."""

import random

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import attempts as AT
from pagesieve.operators import skew
from pagesieve.streaming import jobs as ST

SCHEMA = "request_id long, attempt_id long, tier string, success boolean, content_length long, elapsed_ms long, error string"
TIERS = ["tier1_curl", "tier2_camoufox", "tier3_nodriver"]


def log(seed: int, requests: int, hot: int = 0):
    rng, rows = random.Random(seed), []
    sizes = [hot] + [rng.randint(1, 4) for _ in range(requests - 1)] if hot else [rng.randint(1, 4) for _ in range(requests)]
    for request, size in enumerate(sizes):
        for _ in range(size):
            n = rng.choice([0, 1, 499, 500, 4999, 4999, 5000, 7000])
            rows.append((request, len(rows), rng.choice(TIERS), n > 0, n, rng.choice([100, 2000, 7000, 7001, 10001, 12000, 12001, 13000]), None))
    return rows


def race(rows):
    """The rule as a loop over completion order: the first good result ends the race."""
    best, seen = None, []
    for row in sorted(rows, key=lambda r: (r[5], r[1])):
        seen.append(row[1])
        if row[3] and row[4] >= 5000:
            return row, seen
        if row[3] and (best is None or row[4] > best[4]):
            best = row
    return best, seen


def by_request(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 0), (3, 400)])
def test_winner_and_truncation(spark, seed, hot):
    rows = log(seed, 200, hot)
    df = spark.createDataFrame(rows, SCHEMA)
    won = {r.request_id: r for r in AT.pick_winner(df).collect()}
    kept, expected_kept = {r.attempt_id for r in AT.truncate_after_winner(df).collect()}, set()
    for request, group in by_request(rows).items():
        best, seen = race(group)
        expected_kept.update(seen)
        assert won[request].attempt_id == (best[1] if best else None)
        assert won[request].success == (best is not None)
    assert kept == expected_kept


def test_completion_order_with_a_hot_request(spark):
    rows = log(4, 50, hot=500)
    got = {r.attempt_id: r.position for r in AT.completion_order(spark.createDataFrame(rows, SCHEMA)).collect()}
    for group in by_request(rows).values():
        for position, row in enumerate(sorted(group, key=lambda r: (r[5], r[1])), 1):
            assert got[row[1]] == position


def test_deadlines(spark):
    rows = [(1, 1, "tier1_curl", True, 9, 7000, None), (1, 2, "tier1_curl", True, 9, 7001, None),
            (1, 3, "tier2_camoufox", True, 9, 10001, None), (1, 4, "tier3_nodriver", True, 9, 12000, None),
            (1, 5, "twitter_twikit", True, 9, 7001, None), (1, 6, "medium_archive", True, 9, 7001, None), (1, 7, "other", True, 9, 12001, None)]
    out = {r.attempt_id: (r.success, r.content_length, r.elapsed_ms, r.error) for r in AT.apply_deadlines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: (True, 9, 7000, None), 2: (False, 0, 7000, "Timeout after 7.0s"), 3: (False, 0, 10000, "Timeout after 10.0s"),
                   4: (True, 9, 12000, None), 5: (False, 0, 7000, "Timeout after 7.0s")}


def test_global_timeout_needs_an_open_race(spark):
    rows = [(1, 1, "x", True, 9, 12001, None), (2, 2, "x", True, 5000, 100, None), (2, 3, "x", True, 9, 13000, None),
            (3, 4, "x", True, 9, 12000, None), (4, 5, "x", True, 4999, 1, None), (4, 6, "x", False, 0, 12500, None)]
    assert {r.request_id for r in AT.global_timeouts(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 4}


def test_site_handlers(spark):
    """A handler wins at 501 characters, its shorter results do not count, and of its failures
    only logged errors are listed."""
    rows = [(1, 1, "twitter_twikit", True, 501, 900, None), (1, 2, "tier2_camoufox", True, 9000, 1000, None),
            (2, 3, "twitter_twikit", True, 500, 900, None), (2, 4, "tier2_camoufox", True, 10, 1000, None),
            (3, 5, "twitter_twikit", False, 0, 900, "boom"), (3, 6, "tier2_camoufox", False, 0, 1000, "No content returned"),
            (4, 7, "medium_freedium", False, 0, 900, "boom")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.request_id: r.attempt_id for r in AT.pick_winner(df).collect()} == {1: 1, 2: 4, 3: None, 4: None}
    assert {r.request_id: r.warning for r in AT.failed_tiers(df).collect()} == {
        3: "All tiers failed: twitter_twikit, tier2_camoufox", 4: "All tiers failed"}
    requests = spark.createDataFrame([(i, "http://h/", "precision", None) for i in (1, 2, 3, 4)], "request_id long, url string, mode string, force_tier int")
    content = df.withColumn("content", F.when(F.col("success"), F.lit("please log in")))
    got = {r.request_id: r for r in AT.scrape_result(requests, content).collect()}
    assert (got[1].winning_tier, got[1].tier_attempts, got[1].warnings, got[1].total_elapsed_ms) == ("twitter_twikit", [], [], 900)
    assert got[2].access_restriction_detected and [a.tier for a in got[2].tier_attempts] == ["tier2_camoufox"]
    assert [a.tier for a in got[3].tier_attempts] == ["twitter_twikit", "tier2_camoufox"]


def test_result_of_request_without_attempts(spark):
    requests = spark.createDataFrame([(1, "http://h/", "precision", 2)], "request_id long, url string, mode string, force_tier int")
    attempts = spark.createDataFrame([], SCHEMA + ", content string")
    row = AT.scrape_result(requests, attempts).first()
    assert (row.success, row.content, row.tier_attempts, row.warnings) == (False, None, [], ["All tiers failed"])
    assert len(row.suggestions) == 3


def test_aqe_splits_a_hot_key(spark):
    """A third of the rows share a key, and the right side is an aggregate by that key."""
    saved = {k: spark.conf.get(k, None) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "100KB")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50KB")
    try:
        left = spark.range(0, 300_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        right = left.groupBy("k").agg(F.count("*").alias("n"))
        joined = skew.skewable_join(left, right, ["k"])
        assert joined.filter("k = 7").count() == 100_001
        spread = joined.groupBy("k").agg(F.count("v").alias("c"))
        spread.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in saved.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stream_of(spark, tmp_path, rows, jitter=0):
    """jitter: milliseconds by which the clock of an attempt's end may be off."""
    start = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("request_id") * 20_000)
    off = F.pmod(F.xxhash64("attempt_id"), F.lit(2 * jitter + 1)) - jitter
    df = spark.createDataFrame(rows + [(10_000, -1, "end", False, 0, 0, None)], SCHEMA).withColumns(
        {"started_at": start, "finished_at": F.timestamp_millis(F.unix_millis(start) + F.col("elapsed_ms") + off)})
    df.write.parquet(str(tmp_path / "log"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))


@pytest.mark.parametrize("jitter", [0, 50])
def test_stream_race_equals_batch(spark, tmp_path, jitter):
    rows = log(5, 60)
    got = {tuple(r) for r in ST.run_available(ST.stream_race(stream_of(spark, tmp_path, rows, jitter)), "race").collect()}
    expected = {tuple(r) for r in AT.pick_winner(AT.fail_late(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == expected


def test_stream_keeps_requests_that_end_late(spark, tmp_path):
    rows = [(1, 1, "a", True, 9000, 12_001, None), (1, 2, "a", True, 9000, 13_000, None), (2, 3, "tier1_curl", True, 9000, 9000, None)]
    got = {r.request_id: (r.attempt_id, r.success) for r in ST.run_available(ST.stream_race(stream_of(spark, tmp_path, rows)), "late").collect()}
    assert got == {1: (None, False), 2: (None, False)}  # the second is over its tier's cap


def test_stream_continues_in_given_folders(spark, tmp_path):
    from pagesieve.sources import readers as R

    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows = spark.createDataFrame([(i, f"http://h/{i}", "<p>x</p>") for i in range(6)], R.PAGES)
    for part, total in (("page_id < 2", 2), ("page_id >= 2", 6), ("false", 6)):
        rows.filter(part).write.mode("append").parquet(source)
        stream = R.stream_pages(spark, source).select("page_id")
        assert ST.run_available(stream, "again", out, progress).count() == total


def test_order_of_many_ties(spark):
    """A third of all attempts time out in one millisecond of one request: they share no window."""
    rows = [(0 if i % 3 == 0 else i, i, "a", False, 0, 7000 if i % 3 == 0 else i, None) for i in range(9000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.attempt_id: r.position for r in AT.completion_order(df).filter("request_id = 0").collect()}
    assert got == {i: n + 1 for n, i in enumerate(range(0, 9000, 3))}


@pytest.mark.parametrize("where", ["first", "middle", "last"])
def test_a_hot_request_with_random_ids_is_cut_into_equal_parts(spark, monkeypatch, where):
    """A third of the log, in few milliseconds, with attempt ids from all over the 64 bits; also a null request."""
    rng = random.Random(8)
    hot = {"first": -1, "middle": 3000, "last": 10**6}[where]
    rows = [(hot if i % 3 == 0 else None if i % 50 == 1 else i, rng.randrange(-2**63, 2**63), "a", False, 0, rng.randrange(3), None) for i in range(12_000)]
    seen = []
    plain = AT.materialize
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a log would be one part
    monkeypatch.setattr(AT, "materialize", lambda df, label: seen.append(plain(df, label)) or seen[-1])
    got = sorted(((r.request_id, r.elapsed_ms, r.attempt_id, r.position) for r in AT.completion_order(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    expected = []
    for request in {r[0] for r in rows}:
        own = sorted((r[5], r[1]) for r in rows if r[0] == request)
        expected += [(request, ms, i, n) for n, (ms, i) in enumerate(own, 1)]
    assert got == sorted(expected, key=str)
    sizes = sorted(r["count"] for r in seen[0].groupBy("_part").count().collect())
    assert len(sizes) >= 6 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert seen[0].filter(F.col("request_id") == hot).select("_part").distinct().count() >= 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_completion_order_of_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, 5, "a", False, 0, 7, None)] * 3 + [(1, 6, "a", False, 0, 6, None)], SCHEMA)
    assert sorted((r.attempt_id, r.position) for r in AT.completion_order(df).collect()) == [(5, 2), (5, 3), (5, 4), (6, 1)]
    assert AT.completion_order(df.limit(0)).count() == 0


def test_barred_tier(spark):
    jobs = spark.createDataFrame([(1, "u", "full", 3), (2, "u", "full", 1), (3, "u", "full", None)], "request_id long, url string, mode string, force_tier int")
    log_ = spark.createDataFrame([], SCHEMA).withColumn("content", F.lit(""))
    got = {r.request_id: (r.warnings, len(r.suggestions)) for r in AT.scrape_result(jobs, log_).collect()}
    assert got == {1: (["No tiers available to run"], 1), 2: (["All tiers failed"], 3), 3: (["All tiers failed"], 2)}
    allowed = {r.request_id: r.warnings for r in AT.scrape_result(jobs, log_, allow_tier3=True).collect()}
    assert allowed[1] == ["All tiers failed"]


def test_early_winner_does_not_wait(spark, tmp_path):
    """Without a closing row the early job gives the decided request, the other job none."""
    rows = [(1, 1, "a", True, 6000, 10, None), (2, 2, "a", True, 600, 10, None)]
    finished = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("elapsed_ms"))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("finished_at", finished)
    df.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    assert [r.request_id for r in ST.run_updates(ST.stream_race_early(stream), "early", "request_id").collect()] == [1]
    assert ST.run_available(ST.stream_race(stream), "end").count() == 0
