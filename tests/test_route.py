"""The staged way of a request against a simulation of one request at a time."""

import random

import pytest
from pyspark.sql import functions as F

from pagesieve import constants as C
from pagesieve.operators import route as RO
from pagesieve.operators.report import EXHAUSTED

TIERS = list(C.TIER_CAPS_MS)


def page(n, kind="a"):
    """A page whose main content has n characters."""
    return f"<html><body><article>{kind * n}</article></body>{' ' * 600}</html>"


def simulate(req, answers, tweets, mirrors, snaps, hops, relays, tier3):
    """(tier, text, ms, parsed pages) as an event loop would have it."""
    url, forced, parsed, now = req["url"], req["tier"], 0, 0
    if forced is None and "x.com" in url:
        text, ms = tweets.get(url, (None, 0))
        if ms <= 7000 and text and len(text) > 500:
            return "twitter_twikit", text, ms, parsed
        now += min(ms, 7000)
    if forced is None and "medium.com" in url and relays:
        ms, found = 0, None
        for status, n, took in mirrors.get(url, []):
            parsed += status == 200
            if found is None:
                ms += took
                if status == 200 and n > 300:
                    found = "a" * n
        if ms <= 7000 and found and len(found) > 500:
            return "medium_freedium", found, ms, parsed
        now += min(ms, 7000)
        status, n, ms = snaps.get(url, (404, 0, 0))
        parsed += status == 200
        if status == 200 and ms <= 7000 and n > 500 and now + ms <= 12000:
            return "medium_archive", "a" * n, now + ms, parsed
        now += min(ms, 7000)
    seen, at = set(), url
    while at in hops:
        if at in seen or len(seen) == 8:
            at = None
            break
        seen.add(at)
        at = hops[at]
    plan = [t for i, t in enumerate(TIERS, 1) if (forced == i or forced is None and not (i == 1 and "x.com" in url)) and (i < 3 or tier3)]
    if not plan:
        return None, None, 0, parsed
    running = {plan[0]: now}
    others_at, last, best, open_ = now + C.STAGGER_MS, 0, None, plan[1:]

    def end(tier):
        return running[tier] + min(answers.get((at, tier), (0, None))[0], C.TIER_CAPS_MS[tier])

    while running or open_:
        first = min(running, key=lambda t: (end(t), plan.index(t)), default=None)
        if open_ and (first is None or end(first) > others_at):
            running |= dict.fromkeys(open_, others_at)
            open_ = []
            continue
        ends = end(first)
        if ends > C.GLOBAL_DEADLINE_MS:
            last = C.GLOBAL_DEADLINE_MS
            break
        ms, n = answers.get((at, first), (0, None))
        del running[first]
        last = ends
        text = None
        if n is not None and ms <= C.TIER_CAPS_MS[first]:
            parsed += 1
            text = ("a" * n, first)
            if best is None or n > len(best[0]):
                best = text
            if n >= C.GOOD_CHARS:
                best = text
                break
        if first == "tier1_curl" and text is None and open_:
            running |= dict.fromkeys(open_, ends)
            open_ = []
    return (best[1], best[0], last, parsed) if best else (None, None, last, parsed)


@pytest.mark.parametrize("relays, tier3, moved", [(True, True, True), (False, False, False)])
def test_by_simulation(spark, monkeypatch, relays, tier3, moved):
    draw = random.Random(11 + relays)
    sizes = lambda: draw.choice([None, 120, 450, 900, 6000])
    reqs, answers, tweets, mirrors, snaps, hops = [], {}, {}, {}, {}, {}
    for i in range(240):
        host = draw.choice(["x.com", "medium.com", "e.org", "e.org"])
        url = f"https://{host}/{i}"
        reqs.append({"id": i, "url": url, "tier": draw.choice([None, None, None, None, 1, 2, 3])})
        for tier in TIERS:
            if draw.random() < 0.9:
                answers[url, tier] = (draw.choice([draw.randrange(1500), 1500, draw.randrange(14_000)]), sizes())
        if host == "x.com" and draw.random() < 0.8:
            tweets[url] = (draw.choice([None, "t" * 400, "t" * 501]), draw.randrange(9000))
        if host == "medium.com":
            mirrors[url] = [(draw.choice([200, 500]), draw.choice([200, 400, 700]), draw.randrange(5000)) for _ in range(2)]
            if draw.random() < 0.8:
                snaps[url] = (draw.choice([200, 200, 404]), draw.choice([200, 400, 700]), draw.randrange(9000))
        if moved and host == "e.org" and draw.random() < 0.4:
            hops[url] = draw.choice(reqs)["url"]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    requests = frame([(r["id"], r["url"], "precision", str(r["tier"]) if r["tier"] else "Auto") for r in reqs], "request_id long, url string, mode string, tier string")
    responses = frame([(u, t, 200 if n else 403, page(n) if n else None, ms) for (u, t), (ms, n) in answers.items()], "url string, tier string, status int, html string, latency_ms long")
    dns = frame([(h, 0, "8.8.8.8") for h in ("x.com", "medium.com", "e.org")], "host string, ord int, ip string")
    tables = [
        frame([(u, 302, v) for u, v in hops.items()], "url string, status int, location string") if moved else None,
        frame([(u, t, ms) for u, (t, ms) in tweets.items()], "url string, content string, latency_ms long"),
        frame([(u, k, s, page(n), ms) for u, ms_ in mirrors.items() for k, (s, n, ms) in enumerate(ms_)], "url string, priority int, status int, html string, latency_ms long"),
        frame([(u, 3, s, page(n), ms) for u, (s, n, ms) in snaps.items()] + [(u, 1, 200, page(900), 1) for u in snaps], "url string, captured_at int, status int, html string, latency_ms long"),
    ]
    parsed = []
    plain = RO.extract
    monkeypatch.setattr(RO, "extract", lambda pages, **kw: parsed.append(pages.count()) or plain(pages, **kw))
    got = {r["request_id"]: r for r in RO.scrape_route(requests, responses, dns, *tables, allow_relays=relays, allow_tier3=tier3).collect()}
    assert len(got) == len(reqs)
    pages, kinds = 0, set()
    for r in reqs:
        tier, text, ms, n = simulate(r, answers, tweets, mirrors, snaps, hops, relays, tier3)
        row = got[r["id"]]
        pages += n
        kinds.add(tier)
        assert (row["tier_used"], row["content"], row["success"]) == (tier, text, tier is not None), (r, tier, ms)
        assert abs(row["elapsed_time"] - ms / 1000) <= 0.0051, (r, tier, ms, row["elapsed_time"])
        assert row["error"] == (None if tier else EXHAUSTED)
    assert kinds >= {None, "tier1_curl", "tier2_camoufox", "twitter_twikit"} | ({"tier3_nodriver", "medium_freedium", "medium_archive"} if relays else set())
    # nothing is parsed for a request that is solved; without redirects no page is shared between requests
    assert sum(parsed) == pages if not moved else sum(parsed) <= pages
    stored = sum(n is not None for _, n in answers.values()) + sum(s == 200 for v in mirrors.values() for s, _, _ in v) + sum(s == 200 for s, _, _ in snaps.values())
    assert sum(parsed) < 0.7 * stored


def test_empty_and_refused(spark):
    requests = spark.createDataFrame([(1, "ftp://x", "precision", "Auto"), (2, "https://e.org/", "bad", None), (3, "https://none.org/", "full", "Auto")],
                                     "request_id long, url string, mode string, tier string")
    responses = spark.createDataFrame([], "url string, tier string, status int, html string, latency_ms long")
    dns = spark.createDataFrame([("e.org", 0, "8.8.8.8")], "host string, ord int, ip string")
    got = {r["request_id"]: r for r in RO.scrape_route(requests, responses, dns).collect()}
    assert len(got) == 3 and not any(r["success"] for r in got.values()) and got[3]["error"] == EXHAUSTED
    assert RO.scrape_route(requests.filter(F.lit(False)), responses, dns).count() == 0
