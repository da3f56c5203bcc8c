"""Operators over several tables: redirects, guard, segments, fallbacks, search, files."""

import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagesieve.operators import fallbacks as FB, ocr as OC, redirects as RD, report as RP, search as SE, segments as SG
from pagesieve.operators import tweets as TW, validate as V
from pagesieve.sources import readers as R, writers as W
from pagesieve.streaming import jobs as ST

HOPS = "url string, status int, location string"


def walk(start, hops, limit=8):
    at, seen = start, set()
    for asked in range(limit):
        if at in seen:
            return None, asked, "loop"
        seen.add(at)
        if at not in hops:
            return None, asked + 1, "missing"
        status, location = hops[at]
        if status not in (301, 302, 303, 307, 308) or not location:
            return at, asked + 1, "resolved"
        at = location
    return None, limit, "exhausted"


def resolved(spark, urls, hops, **kw):
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    table = spark.createDataFrame([(u, s, loc) for u, (s, loc) in hops.items()], HOPS)
    return {r.url: (r.final_url, r.requests, r.outcome) for r in RD.resolve_redirects(df, table, **kw).collect()}


def chain(name, redirects):
    urls = [f"http://{name}/{i}" for i in range(redirects + 1)]
    return urls[0], {**{a: (302, b) for a, b in zip(urls, urls[1:])}, urls[-1]: (200, None)}


def test_redirect_bounds(spark):
    seven, hops7 = chain("seven", 7)
    eight, hops8 = chain("eight", 8)
    hops = {**hops7, **hops8, "http://self/": (301, "http://self/"), "http://rel/a": (307, "b"), "http://rel/b": (404, None),
            "http://nowhere/": (302, None), "http://empty/": (302, ""), "http://ok/": (300, "http://self/")}
    starts = [seven, eight, "http://self/", "http://rel/a", "http://nowhere/", "http://empty/", "http://ok/", "http://gone/"]
    assert resolved(spark, starts, hops) == {
        seven: ("http://seven/7", 8, "resolved"), eight: (None, 8, "exhausted"), "http://self/": (None, 1, "loop"),
        "http://rel/a": ("http://rel/b", 2, "resolved"), "http://nowhere/": ("http://nowhere/", 1, "resolved"),
        "http://empty/": ("http://empty/", 1, "resolved"), "http://ok/": ("http://ok/", 1, "resolved"), "http://gone/": (None, 1, "missing")}


def test_redirects_random_with_a_popular_target(spark):
    rng = random.Random(3)
    urls = [f"http://h/{i}" for i in range(120)]
    hops = {u: (200, None) if rng.random() < 0.2 else (302, urls[5] if rng.random() < 0.35 else rng.choice(urls)) for u in urls[:-3]}
    assert resolved(spark, urls, hops) == {u: walk(u, hops) for u in urls}


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 8, 9])
def test_redirects_by_any_number_of_requests(spark, limit, monkeypatch):
    """Random graphs with cycles, chains that merge, missing and blocked hops; few tables are written."""
    rng = random.Random(limit)
    urls = [f"http://h/{i}" for i in range(150)]
    hops = {u: (200, None) if rng.random() < 0.06 else (302, urls[i + 1] if rng.random() < 0.8 else rng.choice([*urls, "http://10.0.0.1/", "http://gone/"]))
            for i, u in enumerate(urls[:-4])}
    hops |= {"http://l/a": (302, "http://l/b"), "http://l/b": (302, "http://l/a")}
    dns = spark.createDataFrame([("h", 0, "8.8.8.8"), ("l", 0, "8.8.8.8"), ("gone", 0, "8.8.8.8")], "host string, ord int, ip string")
    written = []
    plain = RD.materialize
    monkeypatch.setattr(RD, "materialize", lambda df, label: written.append(label) or plain(df, label))
    got = resolved(spark, [*urls, "http://l/a", "http://gone/", "http://127.0.0.1/"], hops, dns=dns, max_requests=limit)

    def guarded(start):
        at, seen = start, set()
        if start == "http://127.0.0.1/":
            return None, 0, "blocked"
        for asked in range(limit):
            if at in seen:
                return None, asked, "loop"
            seen.add(at)
            if at not in hops:
                return None, asked + 1, "missing"
            status, location = hops[at]
            if status != 302:
                return at, asked + 1, "resolved"
            if location == "http://10.0.0.1/":
                return None, asked + 1, "blocked"
            at = location
        return None, limit, "exhausted"

    assert got == {u: guarded(u) for u in got} and len(got) == 153
    assert len(written) <= 4 and {o[2] for o in got.values()} >= ({"blocked", "exhausted", "resolved", "missing"} | ({"loop"} if limit > 2 else set()))


def test_guarded_redirects(spark):
    hops = {"http://a.org/": (302, "http://10.0.0.1/"), "http://b.org/": (302, "http://c.org/"), "http://c.org/": (200, None)}
    dns = spark.createDataFrame([("a.org", 0, "8.8.8.8"), ("b.org", 0, "8.8.4.4"), ("c.org", 0, "9.9.9.9")], "host string, ord int, ip string")
    got = resolved(spark, [*hops, "http://localhost/"], hops, dns=dns)
    assert {u: o[2] for u, o in got.items()} == {
        "http://a.org/": "blocked", "http://b.org/": "resolved", "http://c.org/": "resolved", "http://localhost/": "blocked"}


def test_guard_names_the_first_bad_address(spark):
    dns = spark.createDataFrame([
        ("x.org", 0, "8.8.8.8"), ("x.org", 1, "127.0.0.1"), ("x.org", 2, "10.0.0.1"), ("v6.org", 0, "fe80::1"), ("junk.org", 0, "not-an-ip")],
        "host string, ord int, ip string")
    urls = ["http://x.org./p", "https://v6.org/", "http://none.org/", "http://junk.org/", "http://8.8.8.8/", "http://[::1]/", "http://x.org:99999/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    block = "ERROR: URL host '{}' resolves to non-public IP '{}' and is not allowed."
    expected = [block.format("x.org", "127.0.0.1"), block.format("v6.org", "fe80::1"),
                "ERROR: Could not resolve host 'none.org' to an IP address.", "ERROR: Could not resolve host 'junk.org' to an IP address.",
                None, block.format("::1", "::1")]
    once = {r.url: r.error for r in V.validate_urls_once(df, dns).collect()}
    assert [once[u] for u in urls] == expected + ["Port out of range 0-65535"]
    plain = {r.url: r.error for r in V.validate_urls(df, dns).collect()}
    assert [plain[u] for u in urls[:-1]] == expected


def test_repeated_segments_brute_force(spark):
    rng = random.Random(11)
    docs = [(i, "hot" if rng.random() < 0.4 else f"h{i % 9}", "\n".join(rng.choice(["nav", "foot", "", f"own{i}", f"l{rng.randint(0, 30)}"]) for _ in range(rng.randint(1, 12))))
            for i in range(300)] + [(300, "hot", None), (301, "hot", "nav")]
    pages = defaultdict(set)
    for i, host, text in docs:
        for line in (text or "").split("\n"):
            pages[host, line].add(i)
    expected = {i: None if text is None else "\n".join(ln for ln in text.split("\n") if ln == "" or len(pages[host, ln]) < 3) for i, host, text in docs}
    got = SG.drop_repeated_segments(spark.createDataFrame(docs, "page_id long, host string, text string"), "page_id", 3)
    assert {r.page_id: r.text for r in got.collect()} == expected


def test_search_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["the", "the", "the", "der", "Que", "é", "x1"]
    pages = [(i, ", ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    queries = [(0, "the"), (1, "THE"), (2, "que é"), (3, "zzz"), (4, "the the der")]
    got = SE.search_top_k(spark.createDataFrame(pages, "page_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"))
    expected = set()
    for q, text in queries:
        wanted = set(text.lower().split())
        scores = [(-sum(w in wanted for w in p.lower().split(", ")), i) for i, p in pages]
        expected |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(x for x in scores if x[0])[:10], 1)}
    assert {(r.query_id, r["rank"], r.page_id, r.score) for r in got.collect()} == expected


def test_snapshot_newest_decides_alone(spark):
    snaps = spark.createDataFrame([("a", 1, 200, "x" * 600), ("a", 2, 404, "x" * 600), ("b", 1, 404, ""), ("b", 2, 200, "y" * 501), ("c", 1, 200, "z" * 500)],
                                  "url string, captured_at long, status int, html string")
    urls = snaps.select("url").distinct()
    assert [(r.url, r.captured_at) for r in FB.latest_snapshot(urls, snaps).collect()] == [("b", 2)]


def test_mirrors_in_order(spark):
    rows = [("a", 0, 500, "x" * 400), ("a", 1, 200, "y" * 301), ("b", 0, 200, "x" * 300), ("c", 0, 200, "p" * 301), ("c", 1, 200, "q" * 999)]
    got = FB.first_passing_mirror(spark.createDataFrame(rows, "url string, priority int, status int, text string")).collect()
    assert {(r.url, r.priority) for r in got} == {("a", 1), ("c", 0)}


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_escalation_keeps_no_plan_of_earlier_tiers(spark):
    """Repeated and null requests; what is pending after six tiers joins no more than after one."""
    rng = random.Random(6)
    asked = [None, None, *range(300), 7, 7]
    solves = [[rng.choice([None, *range(300)]) for _ in range(60)] for _ in range(6)]
    pending, left = spark.createDataFrame([(i,) for i in asked], "request_id long"), Counter(asked)
    for ids in solves:
        good = spark.createDataFrame([(i,) for i in ids], "request_id long")
        pending = FB.escalate(pending, pending.join(good, "request_id", "left_semi"))
        left = Counter({i: n for i, n in left.items() if i is None or i not in ids})
        assert joins(pending) <= 1
    assert Counter(r.request_id for r in pending.collect()) == left


def test_escalate_query_joins_tier_by_tier(spark, tmp_path):
    """A third of the log belongs to one request; events come twice."""
    from pagesieve.plans.catalog import QUERIES

    rng = random.Random(7)
    rows = [(1 if i % 3 == 0 else i, datetime(2024, 1, 1), i, rng.choice(["error", "click", "view"]), rng.choice([0.0, 0.001, 5.0, None]), None) for i in range(900)]
    events = spark.createDataFrame(rows + rows[:50], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    tiers = ["tier1_curl", "tier2_camoufox", "tier3_nodriver"]
    expected = {r[0] // 3: None for r in rows}
    for event_id, _, _, kind, value, _ in rows:
        if kind != "error" and value and value * 100 >= 1:
            request, tier = event_id // 3, tiers[event_id % 3]
            expected[request] = min(expected[request] or tier, tier)
    got = QUERIES["j6_escalate"](spark, str(tmp_path))
    assert sorted(got.collect(), key=str) == sorted(expected.items(), key=lambda r: f"Row(request_id={r[0]}, solved_by={r[1]!r})")
    assert joins(got) <= 1


def test_ocr_confidence_and_modes(spark):
    lines = [("low" * 30, 0.39), (" kept " + "k" * 50, 0.40), ("none" * 5, None), ("  ", 0.9)]
    df = spark.createDataFrame([(1, [([tuple(x) for x in lines],)])], "doc_id long, pages array<struct<text_lines: array<struct<text: string, confidence: double>>>>")
    text = OC.assemble_ocr(df).first().text
    assert text == "kept " + "k" * 50 + "\n" + "none" * 5
    a = spark.createDataFrame([(1, None), (2, "t" * 60)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "v" * 51), (2, "v" * 50)], "doc_id long, text string")
    pick = lambda mode: {(r.doc_id, r.method) for r in OC.ocr_fallback(a, b, mode).collect()}
    assert pick("surya") == {(2, "playwright_surya")}
    assert pick("claude") == {(1, "playwright_claude")}
    assert pick("both") == {(1, "playwright_claude_fallback"), (2, "playwright_surya")}
    with pytest.raises(ValueError):
        OC.ocr_fallback(a, b, "other")


def test_tweet_without_optional_parts(spark):
    schema = """user struct<screen_name: string, name: string>, created_at string, full_text string, text string, favorite_count long,
        retweet_count long, reply_count long, media array<struct<media_url_https: string, url: string>>"""
    rows = [(None, None, None, None, None, None, None, None), (("u", "N"), "d", "", "short", 1, 2, 3, [("", "b"), (None, None)])]
    got = [r.content for r in TW.format_tweet(spark.createDataFrame(rows, schema).coalesce(1)).collect()]
    assert got == ["\n\n", "@u - N\nPosted: d\n\nshort\n\nLikes: 1  Retweets: 2  Replies: 3\n\nMedia (2 item(s)):\n  b"]


def test_request_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"url": "http://a/"}\n{"url": "http://b/", "mode": "full", "tier": "2"}\n')
    (tmp_path / "r.csv").write_text("url,mode,tier\nhttp://a/,,\nhttp://b/,full,2\n")
    expected = {("http://a/", "precision", "Auto"), ("http://b/", "full", "2")}
    for fmt in ("json", "csv"):
        assert {tuple(r) for r in R.read_requests(spark, str(tmp_path / f"r.{fmt}"), fmt).collect()} == expected


def test_text_files(spark, tmp_path):
    df = spark.createDataFrame([(f"http://h{i % 2}_x.org/{i}", "tier1_curl", "full", "body") for i in range(10)], "url string, label string, mode string, content string")
    ts = datetime(2024, 1, 2, 3, 4, 5)
    named = RP.with_file_header(RP.with_output_name(df, ts), ts)
    W.write_text(named, str(tmp_path / "out"), by_host=True)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.host_safe for r in back.collect()) == {"h0_x.org": 5, "h1_x.org": 5}
    assert back.first().file_name.endswith("_tier1_curl_20240102_030405.md")
    assert "Scraped : 2024-01-02T03:04:05\nChars   : 4\n" + "-" * 60 + "\n\nbody" in back.first().body


def test_pages_are_read_as_planned(spark, tmp_path):
    spark.createDataFrame([(1, "u", "h")], R.PAGES).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert "Exchange" not in R.read_pages(spark, str(tmp_path / "p"))._jdf.queryExecution().executedPlan().toString()
    assert R.read_pages(spark, str(tmp_path / "p"), tasks=3).rdd.getNumPartitions() == 3


def test_large_host_is_written_by_many_tasks(spark, tmp_path):
    """A third of the rows share a host; none of its files holds all of them."""
    saved = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        n = 3000
        df = spark.range(0, n, 1, 6).select(
            F.concat(F.lit("http://h"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string"), F.lit(".org/")).alias("url"),
            F.lit("same.md").alias("file_name"), F.sha2(F.col("id").cast("string"), 512).alias("body"))
        W.write_text(df, str(tmp_path / "hot"), by_host=True)
        files = list((tmp_path / "hot" / "host_safe=h0.org").glob("*.parquet"))
        assert len(files) > 1 and spark.read.parquet(str(tmp_path / "hot")).count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes") if saved is None else spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", saved)


def test_truncation_bound(spark):
    df = spark.createDataFrame([(1, "x" * 10), (2, "x" * 11)], "i int, text string")
    got = {r.i: (r.truncated, r.output) for r in RP.truncate_output(df, 10).collect()}
    assert got == {1: (False, "x" * 10), 2: (True, "x" * 10 + "\n\n[TRUNCATED] Output capped at 10 characters.")}


def test_stream_extract_files_in_steps(spark, tmp_path):
    """Two batches of files give what one batch job gives; gated pages are left out."""
    pages = [(i, f"http://h/{i}", f"<body><p>{'word ' * 120}{i}</p></body>" if i % 3 else "short") for i in range(12)]
    df = spark.createDataFrame(pages, R.PAGES)
    df.filter("page_id < 6").write.parquet(str(tmp_path / "in"))
    df.filter("page_id >= 6").write.mode("append").parquet(str(tmp_path / "in"))
    stream = R.stream_pages(spark, str(tmp_path / "in"), files_per_batch=3)
    got = ST.run_available(ST.stream_extract(stream).select("page_id", "text"), "steps")
    assert {r.page_id for r in got.collect()} == {i for i, _, h in pages if len(h) > 500}


def test_json_hits_round_trip(spark):
    hits = spark.createDataFrame([(1, 2, "b", "u2", 'say "x"'), (1, 1, "a", "u1", "é")], "query_id long, rank long, title string, href string, body string")
    packed = SE.to_search_json(hits)
    back = R.parse_search_results(packed, "results")
    assert {(r["rank"], r.title, r.body) for r in back.collect()} == {(1, "a", "é"), (2, "b", 'say "x"')}
    assert R.parse_search_results(packed.withColumn("results", F.lit("not json")), "results").count() == 0
