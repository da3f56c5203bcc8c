"""Inputs derived from the given tables. One SQL text serves Spark and the checking engine, so
it keeps to what both read alike; names in braces are relations."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagesieve.functions.text import strip_tags_regex

# name: (relations used, SQL)
FIXTURES: dict[str, tuple[list[str], str]] = {
    "attempts": (["events"], """
        SELECT CAST((event_id - event_id % 3) / 3 AS BIGINT) AS request_id, event_id AS attempt_id,
               CASE event_id % 3 WHEN 0 THEN 'tier1_curl' WHEN 1 THEN 'tier2_camoufox' ELSE 'tier3_nodriver' END AS tier,
               event_type <> 'error' AS success,
               CAST(CASE WHEN event_type <> 'error' THEN floor(value * 100) ELSE 0 END AS BIGINT) AS content_length,
               (event_id * 7919) % 14000 AS elapsed_ms,
               CASE WHEN event_type = 'error' THEN 'No content returned' END AS error
        FROM {events}"""),
    "attempts_content": (["attempts"], """
        SELECT *, CASE WHEN success THEN
                 CASE attempt_id % 7 WHEN 0 THEN 'Please LOG IN. Premium content.' WHEN 1 THEN 'Subscribe now'
                 ELSE concat('text of attempt ', CAST(attempt_id AS VARCHAR(20))) END END AS content
        FROM {attempts}"""),
    "jobs": (["attempts"], """
        SELECT DISTINCT request_id, concat('https://example.org/r/', CAST(request_id AS VARCHAR(20))) AS url,
               CASE WHEN request_id % 2 = 0 THEN 'precision' ELSE 'full' END AS mode,
               CASE WHEN request_id % 5 = 0 THEN 1 END AS force_tier
        FROM {attempts}
        UNION ALL
        SELECT DISTINCT -1 - request_id AS request_id, 'https://example.org/barred' AS url, 'full' AS mode, CASE WHEN request_id % 2 = 0 THEN 3 END AS force_tier
        FROM {attempts} WHERE request_id % 7 = 0"""),
    "targets": (["pages"], """
        SELECT page_id, url, (page_id * 3 + 1) % (SELECT count(*) FROM {pages}) AS target FROM {pages}"""),
    "hops": (["targets"], """
        SELECT p.url AS url, CASE WHEN p.page_id % 4 = 0 THEN 200 ELSE 302 END AS status,
               CASE WHEN p.page_id % 4 = 0 OR p.page_id % 7 = 3 THEN NULL ELSE q.url END AS location
        FROM {targets} p JOIN {targets} q ON q.page_id = p.target"""),
    "hosts": (["pages"], """
        SELECT regexp_extract(url, '://([^/:?#]*)', 1) AS host, min(page_id) AS m FROM {pages} GROUP BY 1"""),
    "first_ips": (["hosts"], """
        SELECT host, m, CASE WHEN m % 11 = 5 THEN 'no address' ELSE concat(
                 CASE m % 8 WHEN 0 THEN '8' WHEN 1 THEN '10' WHEN 2 THEN '93' WHEN 3 THEN '127' WHEN 4 THEN '172'
                 WHEN 5 THEN '192' WHEN 6 THEN '224' ELSE '100' END,
                 '.', CAST((m * 13) % 256 AS VARCHAR(20)), '.', CAST((m * 7) % 256 AS VARCHAR(20)),
                 '.', CAST(1 + m % 250 AS VARCHAR(20))) END AS ip
        FROM {hosts}"""),
    "dns": (["first_ips"], """
        SELECT host, 0 AS ord, ip FROM {first_ips}
        UNION ALL
        SELECT host, 1 AS ord, CASE WHEN m % 3 = 0 AND m % 11 <> 5 THEN concat('9.9.9.', CAST(1 + m % 250 AS VARCHAR(20))) ELSE ip END AS ip
        FROM {first_ips}"""),
    "odd_urls": (["pages"], """
        SELECT page_id, CASE page_id % 23
            WHEN 1 THEN concat('HTTP://', upper(host), ':8080/a b')
            WHEN 2 THEN concat('http://[::1]:80/', id)
            WHEN 3 THEN concat('http://u:p@', host, './x')
            WHEN 4 THEN concat('ftp://', host)
            WHEN 5 THEN host
            WHEN 6 THEN ''
            WHEN 7 THEN concat('https://', host, '/a|b')
            WHEN 8 THEN concat('https://münchen', id, '.de/x')
            WHEN 9 THEN concat('http://localhost/', id)
            WHEN 10 THEN concat('http://a', id, '.local')
            WHEN 11 THEN concat('http://10.', CAST(page_id % 256 AS VARCHAR(20)), '.0.1/')
            WHEN 12 THEN concat('http://224.0.0.', CAST(page_id % 256 AS VARCHAR(20)))
            WHEN 13 THEN concat('http://100.64.0.1/', id)
            WHEN 14 THEN concat('http://192.0.0.', CAST(page_id % 12 AS VARCHAR(20)), '/')
            WHEN 15 THEN concat('https://x.com/u/status/', id, '?s=1')
            WHEN 16 THEN concat('https://me.medium.com/p', id)
            WHEN 17 THEN concat('https://reddit.com/r/', id)
            WHEN 18 THEN concat('https://notmedium.com/', id)
            WHEN 19 THEN concat('http://', host, ':', CAST(page_id * 971 % 90000 AS VARCHAR(20)), '/')
            WHEN 20 THEN concat('  ', url, ' ')
            WHEN 21 THEN concat('http://Ex_ample.com/', id)
            WHEN 22 THEN concat('https://user@', host, ':/q?u=http://other/')
            ELSE url END AS url
        FROM (SELECT page_id, url, regexp_extract(url, '://([^/:?#]*)', 1) AS host,
                     CAST(page_id AS VARCHAR(20)) AS id FROM {pages}) AS p"""),
    "requests": (["pages"], """
        SELECT page_id,
               CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat(' example.org/a', CAST(page_id AS VARCHAR(20))) ELSE '  ' END AS url,
               CASE page_id % 5 WHEN 0 THEN 'precision' WHEN 1 THEN ' FULL ' WHEN 3 THEN 'bad' WHEN 4 THEN 'full' END AS mode,
               CASE page_id % 7 WHEN 0 THEN 'Auto' WHEN 1 THEN '1' WHEN 2 THEN ' 2 ' WHEN 3 THEN '3' WHEN 4 THEN '4'
               WHEN 5 THEN 'x' END AS tier
        FROM {pages}"""),
    "walled": (["pages"], """
        SELECT page_id, url, CASE WHEN page_id % 9 = 8 THEN 403 ELSE 200 END AS status,
               CASE page_id % 8
               WHEN 0 THEN html
               WHEN 1 THEN concat('Please LOG IN to continue. ', html)
               WHEN 2 THEN concat('JavaScript is disabled. ', html)
               WHEN 3 THEN concat('Subscribe now! Become a member. ', html)
               WHEN 4 THEN concat('<div id="root">', html, repeat(' ', CAST(greatest(0, 9984 + page_id % 3 - length(html)) AS INT)))
               WHEN 5 THEN concat(repeat('x', 3000), 'access denied', html)
               WHEN 6 THEN concat('Access denied. Please sign in. Premium content. Paywall. ', html)
               ELSE '' END AS html
        FROM {pages}"""),
    "region_pages": (["pages"], """
        SELECT page_id, url, CASE page_id % 4
               WHEN 1 THEN replace(replace(html, '<article', '<main'), '</article', '</main')
               WHEN 2 THEN replace(replace(html, '<article', '<section'), '</article', '</section')
               WHEN 3 THEN replace(replace(replace(replace(html, '<article', '<section'), '</article', '</section'), '<body', '<span'), '</body', '</span')
               ELSE html END AS html
        FROM {pages}"""),
    "noisy_pages": (["pages"], """
        SELECT page_id, url, replace(html, '<div class="ad">', CASE page_id % 4
               WHEN 0 THEN '<div class="x ad-container">' WHEN 1 THEN '<div id="nav">' WHEN 2 THEN '<div class=modal>'
               ELSE '<div class="ad">' END) AS html
        FROM {pages}"""),
    "snapshots": (["pages"], """
        SELECT url, (page_id * 37) % 365 AS captured_at, CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END AS status, html FROM {pages}
        UNION ALL
        SELECT url, (page_id * 37 + 11) % 365 AS captured_at, CASE WHEN (page_id + 1) % 5 = 0 THEN 404 ELSE 200 END AS status, html FROM {pages}
        UNION ALL
        SELECT url, (page_id * 37 + 22) % 365 AS captured_at, CASE WHEN (page_id + 2) % 5 = 0 THEN 404 ELSE 200 END AS status, html FROM {pages}"""),
    "mirrors": (["plain"], """
        SELECT url, priority, CASE WHEN (page_id + priority) % 3 = 0 THEN 500 ELSE 200 END AS status,
               text
        FROM (SELECT *, 0 AS priority FROM {plain} UNION ALL SELECT *, 1 AS priority FROM {plain}) AS m"""),
    "markdown_docs": (["pages"], """
        SELECT page_id, CASE page_id % 5
               WHEN 0 THEN NULL WHEN 1 THEN concat('[](x', id, ')') WHEN 2 THEN concat('[a', id, '](b(c)d)')
               ELSE concat('# T', id, '\n\n\n\n![img](http://i/', id, '.png) see [text ', id, '](', url, ') end\n\n\n') END AS md
        FROM (SELECT page_id, url, CAST(page_id AS VARCHAR(20)) AS id FROM {pages}) AS p"""),
    "hit_lists": (["pages"], """
        SELECT page_id, concat('[', concat_ws(',', h1, CASE WHEN page_id % 3 >= 1 THEN h2 END, CASE WHEN page_id % 3 = 2 THEN h3 END), ']') AS results
        FROM (SELECT page_id,
                concat('{{"title":"A', CAST(page_id AS VARCHAR(20)), '","href":"', url, '","body":"one"}}') AS h1,
                concat('{{"title":"B', CAST(page_id AS VARCHAR(20)), '","href":"', url, '","body":"two"}}') AS h2,
                concat('{{"title":"C', CAST(page_id AS VARCHAR(20)), '","href":"', url, '","body":"three"}}') AS h3
              FROM {pages}) AS p"""),
    "asked": (["pages"], """
        SELECT page_id AS request_id, CASE WHEN page_id % 13 = 12 THEN 'ftp://old.example.org/' ELSE concat(' ', url) END AS url,
               CASE page_id % 3 WHEN 0 THEN 'precision' WHEN 1 THEN ' FULL ' ELSE CASE WHEN page_id % 17 = 16 THEN 'bad' ELSE 'precision' END END AS mode,
               CASE page_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' ELSE 'Auto' END AS tier
        FROM {pages}"""),
    "responses": (["pages"], """
        SELECT url, 'tier1_curl' AS tier, CASE WHEN page_id % 9 = 8 THEN 403 ELSE 200 END AS status,
               CASE page_id % 8 WHEN 2 THEN concat('JavaScript is disabled. ', html) WHEN 7 THEN '' ELSE html END AS html,
               (page_id * 37) % 9000 AS elapsed_ms FROM {pages}
        UNION ALL
        SELECT url, 'tier2_camoufox' AS tier, 200 AS status,
               CASE WHEN page_id % 10 = 3 THEN concat('Enable JavaScript ', html) ELSE html END AS html,
               1500 + (page_id * 53) % 11000 AS elapsed_ms FROM {pages}
        UNION ALL
        SELECT url, 'tier3_nodriver' AS tier, 200 AS status, CASE WHEN page_id % 6 <> 1 THEN html END AS html,
               1500 + (page_id * 71) % 12000 AS elapsed_ms FROM {pages}"""),
    "route_urls": (["pages"], """
        SELECT page_id, html, CASE page_id % 5 WHEN 1 THEN concat('https://x.com/u/status/', CAST(page_id AS VARCHAR(20)))
               WHEN 2 THEN concat('https://medium.com/p', CAST(page_id AS VARCHAR(20))) ELSE url END AS url FROM {pages}"""),
    "route_asked": (["route_urls"], """
        SELECT page_id AS request_id, url, CASE page_id % 3 WHEN 1 THEN 'full' ELSE 'precision' END AS mode,
               CASE page_id % 11 WHEN 3 THEN '1' WHEN 4 THEN '2' WHEN 5 THEN '3' ELSE 'Auto' END AS tier FROM {route_urls}"""),
    "route_responses": (["route_urls"], """
        SELECT url, 'tier1_curl' AS tier, CASE WHEN page_id % 9 = 8 THEN 403 ELSE 200 END AS status,
               CASE page_id % 8 WHEN 2 THEN concat('JavaScript is disabled. ', html) WHEN 7 THEN '' ELSE html END AS html,
               CASE WHEN page_id % 2 = 0 THEN (page_id * 37) % 1600 ELSE (page_id * 37) % 9000 END AS latency_ms FROM {route_urls}
        UNION ALL
        SELECT url, 'tier2_camoufox' AS tier, 200 AS status,
               CASE WHEN page_id % 10 = 3 THEN concat('Enable JavaScript ', html) ELSE html END AS html, (page_id * 53) % 12000 AS latency_ms FROM {route_urls}
        UNION ALL
        SELECT url, 'tier3_nodriver' AS tier, 200 AS status, CASE WHEN page_id % 6 <> 1 THEN html END AS html, (page_id * 71) % 13000 AS latency_ms FROM {route_urls}"""),
    "route_hops": (["route_urls"], """
        SELECT p.url AS url, 302 AS status, CASE p.page_id % 16 WHEN 15 THEN 'http://10.0.0.1/' WHEN 11 THEN p.url ELSE q.url END AS location
        FROM {route_urls} p JOIN {route_urls} q ON q.page_id = p.page_id - 1 WHERE p.page_id % 4 = 3"""),
    "route_dns": (["dns"], """
        SELECT host, ord, ip FROM {dns} UNION ALL SELECT 'x.com' AS host, 0 AS ord, '8.8.8.8' AS ip UNION ALL SELECT 'medium.com' AS host, 0 AS ord, '8.8.4.4' AS ip"""),
    "route_tweets": (["route_urls"], """
        SELECT url, CASE WHEN page_id % 15 <> 1 THEN substr(html, 1, CAST(300 + (page_id * 37) % 500 AS INT)) END AS content, (page_id * 91) % 9000 AS latency_ms
        FROM {route_urls} WHERE page_id % 5 = 1"""),
    "route_mirrors": (["route_urls"], """
        SELECT url, 0 AS priority, CASE WHEN page_id % 3 = 0 THEN 500 ELSE 200 END AS status, html, (page_id * 41) % 4000 AS latency_ms FROM {route_urls} WHERE page_id % 5 = 2
        UNION ALL
        SELECT url, 1 AS priority, CASE WHEN page_id % 2 = 0 THEN 404 ELSE 200 END AS status, html, (page_id * 59) % 6000 AS latency_ms FROM {route_urls} WHERE page_id % 5 = 2"""),
    "route_snapshots": (["route_urls"], """
        SELECT url, 1 AS captured_at, 200 AS status, html, CAST(5 AS BIGINT) AS latency_ms FROM {route_urls} WHERE page_id % 5 = 2
        UNION ALL
        SELECT url, 2 AS captured_at, CASE WHEN page_id % 4 = 0 THEN 404 ELSE 200 END AS status, html, (page_id * 29) % 9000 AS latency_ms
        FROM {route_urls} WHERE page_id % 5 = 2 AND page_id % 7 <> 0"""),
    "search_queries": (["documents"], """
        SELECT min(doc_id) AS query_id,
               concat(min(regexp_extract(text, '^([^ .,]+)', 1)), ' ', max(regexp_extract(text, '^([^ .,]+)', 1))) AS query
        FROM {documents} GROUP BY source, lang"""),
}
_BASE = {
    "pages": "page_id bigint, url string, html string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
_PLANS: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table or a derived input as a DataFrame. Plans, not data, are kept for reuse."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _PLANS:
        _PLANS[key] = _build(spark, sf, name)
    return _PLANS[key]


def _build(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in _BASE:
        base = spark.read.schema(_BASE[name]).parquet(f"{sf}/{name}.parquet")
        # A local run may ask for more tasks than a single small file is split into.
        tasks = spark.conf.get("spark.pagesieve.tasks", None)
        return base.repartition(int(tasks)) if tasks else base
    if name == "plain":
        pages = table(spark, sf, "pages")
        return pages.withColumn("text", strip_tags_regex(F.col("html")))
    uses, sql = FIXTURES[name]
    return spark.sql(sql, **{u: table(spark, sf, u) for u in uses})


@cache
def _needs(name: str) -> tuple[str, ...]:
    """Derived relations in the order a WITH list has to define them."""
    if name in _BASE:
        return ()
    uses = ["pages"] if name == "plain" else FIXTURES[name][0]
    out: list[str] = []
    for u in uses:
        out += [n for n in _needs(u) if n not in out]
    return (*out, name)


def with_ctes(names: list[str], query: str, extra: dict[str, str] | None = None) -> str:
    """The checking SQL: derived inputs and helper relations as a WITH list before the query."""
    from pagesieve.plans.duck import strip_tags

    order: list[str] = []
    for n in names:
        order += [d for d in _needs(n) if d not in order]
    parts = []
    for n in order:
        if n == "plain":
            body = f"SELECT *, {strip_tags('html')} AS text FROM pages"
        else:
            uses, sql = FIXTURES[n]
            body = sql.format(**{u: u for u in uses})
        parts.append(f"{n} AS ({body})")
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    keyword = "WITH RECURSIVE" if "walk" in (extra or {}) else "WITH"
    return (f"{keyword} {', '.join(parts)} " if parts else "") + query
