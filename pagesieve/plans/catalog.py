"""The registry: name -> query over the given tables, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagesieve import constants as C
from pagesieve.functions import addresses as A, gates as G, text as X, urls as U
from pagesieve.operators import attempts as AT, extract as EX, fallbacks as FB, ocr as OC, redirects as RD, report as RP
from pagesieve.operators import route as RO, scrape as SC, search as SE, segments as SG, tweets as TW, validate as V
from pagesieve.plans import duck as D
from pagesieve.plans.fixtures import table, with_ctes
from pagesieve.session import configure, materialize, new_folder
from pagesieve.sources import readers as R, writers as W
from pagesieve.streaming import jobs as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TS = datetime(2024, 3, 5, 14, 7, 9, 120034)


def query(name: str, oracle: str | None = None, ctes: list[str] | None = None, extra: dict[str, str] | None = None):
    """Register a query; `oracle` may use the derived inputs named in `ctes`."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_ctes(ctes or [], oracle, extra)
        return fn

    return add


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


# ---------------------------------------------------------------------------- sources
@query("s1_read_pages", "SELECT page_id, url, length(html) AS html_len FROM pages")
def _(spark, sf):
    stored = R.read_pages(spark, f"{sf}/pages.parquet")
    return stored.select("page_id", "url", X.char_count(F.col("html")).alias("html_len"))


@query("s2_stream_pages", "SELECT page_id, url, length(html) AS html_len FROM pages")
def _(spark, sf):
    stream = R.stream_pages(spark, sf, "pages.parquet")
    return ST.run_available(stream.select("page_id", "url", X.char_count(F.col("html")).alias("html_len")), "pages")


@query("s3_read_requests", "SELECT url, coalesce(mode, 'precision') AS mode, coalesce(tier, 'Auto') AS tier FROM requests", ["requests"])
def _(spark, sf):
    folder = new_folder(spark, "requests")
    table(spark, sf, "requests").select("url", "mode", "tier").write.json(folder)
    return R.read_requests(spark, folder)


@query("s4_parse_search_results", """
    SELECT page_id, CAST(k + 1 AS BIGINT) AS rank, chr(65 + CAST(k AS INT)) || page_id AS title, url AS href,
           ['one', 'two', 'three'][k + 1] AS body
    FROM (SELECT page_id, url, unnest(range(page_id % 3 + 1)) AS k FROM pages)""")
def _(spark, sf):
    return R.parse_search_results(table(spark, sf, "hit_lists"), "results")


def ocr_pages(spark: SparkSession, sf: str, factor: int = 31) -> DataFrame:
    """Documents as recognised pages: one line per text line with a derived confidence."""
    percent = lambda i: (F.col("doc_id") * factor + i * 17) % 100
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(
        t.alias("text"), F.when(i % 13 != 12, percent(i) / 100).alias("confidence")))
    return table(spark, sf, "documents").select("doc_id", F.array(F.struct(lines.alias("text_lines"))).alias("pages"))


def ocr_lines_sql(factor: int = 31) -> str:
    return f"""SELECT doc_id, CAST(i AS BIGINT) AS line_no, lines[i + 1] AS text,
        CASE WHEN i % 13 <> 12 THEN ((doc_id * {factor} + i * 17) % 100) / 100.0 END AS confidence
        FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))"""


@query("s5_read_ocr_lines", "SELECT doc_id, CAST(0 AS BIGINT) AS page_no, line_no, text, CAST(confidence AS DOUBLE) AS confidence FROM lines",
       extra={"lines": ocr_lines_sql()})
def _(spark, sf):
    return R.read_ocr_lines(ocr_pages(spark, sf))


# ---------------------------------------------------------------------------- sinks and report
_LABELLED = "SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'full' ELSE 'precision' END AS mode, 'tier1_curl' AS label, text AS content FROM plain"


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    mode = F.when(F.col("page_id") % 2 == 0, "full").otherwise("precision")
    return table(spark, sf, "plain").select(
        "page_id", "url", mode.alias("mode"), F.lit("tier1_curl").alias("label"), F.col("text").alias("content")
    )


def _safe_host_sql(url: str) -> str:
    host = D.host(url)
    return D.replace_all(f"CASE WHEN {host} = '' THEN 'output' ELSE {host} END", r"[^\p{L}\p{N}_.-]", "'_'")


_NAME_SQL = f"{_safe_host_sql('url')} || '_' || label || '_20240305_140709' || CASE WHEN mode = 'full' THEN '.md' ELSE '.txt' END"
_BODY_SQL = """'URL     : ' || url || chr(10) || 'Method  : ' || label || chr(10) || 'Mode    : ' || mode || chr(10)
    || 'Scraped : 2024-03-05T14:07:09.120034' || chr(10) || 'Chars   : ' || format('{:,}', length(content)) || chr(10)
    || repeat('-', 60) || chr(10) || chr(10) || content"""


@query("k1_output_name", f"SELECT page_id, {_NAME_SQL} AS file_name FROM (SELECT page_id, url, 'tier1_curl' AS label, CASE WHEN page_id % 2 = 0 THEN 'full' END AS mode FROM odd_urls)", ["odd_urls"])
def _(spark, sf):
    mode = F.when(F.col("page_id") % 2 == 0, " FULL ")
    odd = table(spark, sf, "odd_urls").withColumn("label", F.lit("tier1_curl")).withColumn("mode", mode)
    return RP.with_output_name(odd, TS).select("page_id", "file_name")


@query("k2_file_header", f"SELECT page_id, {_BODY_SQL} AS body FROM labelled", ["plain"], {"labelled": _LABELLED})
def _(spark, sf):
    return RP.with_file_header(labelled(spark, sf), TS).select("page_id", "body")


@query("k2_file_header_ocr", """
    SELECT doc_id, 'URL     : https://scan.example.org/' || doc_id || chr(10) || 'Method  : playwright_surya' || chr(10)
        || 'Scraped : 2024-03-05T14:07:09.120034' || chr(10) || repeat('─', 60) || chr(10) || chr(10) || text AS body FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("https://scan.example.org/"), "doc_id").alias("url"),
        F.lit("playwright_surya").alias("label"), F.col("text").alias("content"))
    return RP.with_file_header(docs, TS, ocr=True).select("doc_id", "body")


@query("k3_write_text", f"SELECT {_safe_host_sql('url')} AS host_safe, {_NAME_SQL} AS file_name, {_BODY_SQL} AS body FROM labelled", ["plain"], {"labelled": _LABELLED})
def _(spark, sf):
    out = new_folder(spark, "texts")
    W.write_text(RP.with_file_header(RP.with_output_name(labelled(spark, sf), TS), TS), out)
    return spark.read.schema("host_safe string, file_name string, body string").parquet(out)


@query("k3_write_text_by_host", f"SELECT {_safe_host_sql('url')} AS host_safe, {_NAME_SQL} AS file_name, {_BODY_SQL} AS body FROM labelled", ["plain"], {"labelled": _LABELLED})
def _(spark, sf):
    out = new_folder(spark, "texts-by-host")
    W.write_text(RP.with_file_header(RP.with_output_name(labelled(spark, sf), TS), TS), out, by_host=True)
    return spark.read.schema("host_safe string, file_name string, body string").parquet(out)


# ---------------------------------------------------------------------------- URLs
@query("u1_url_host", f"SELECT page_id, {D.host('url')} AS host FROM odd_urls", ["odd_urls"])
def _(spark, sf):
    return table(spark, sf, "odd_urls").select("page_id", U.url_host(F.col("url")).alias("host"))


@query("u2_url_scheme_port", f"SELECT page_id, {D.scheme('url')} AS scheme, {D.port('url')} AS port FROM odd_urls", ["odd_urls"])
def _(spark, sf):
    parsed = U.url_scheme_port(F.col("url"))
    return table(spark, sf, "odd_urls").select("page_id", parsed["scheme"].alias("scheme"), parsed["port"].alias("port"))


@query("u3_normalize_url_scheme", f"""
    SELECT page_id, CASE WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') THEN u ELSE 'https://' || u END AS url
    FROM (SELECT page_id, {D.strip('url')} AS u FROM odd_urls)""", ["odd_urls"])
def _(spark, sf):
    return table(spark, sf, "odd_urls").select("page_id", U.normalize_url_scheme(F.col("url")).alias("url"))


@query("u4_normalize_mode", f"SELECT page_id, CASE WHEN m IN ('precision', 'full') THEN m END AS mode FROM (SELECT page_id, lower({D.strip('mode')}) AS m FROM requests)", ["requests"])
def _(spark, sf):
    return table(spark, sf, "requests").select("page_id", U.normalize_mode(F.col("mode")).alias("mode"))


@query("u5_coerce_force_tier", f"""
    SELECT page_id, CASE WHEN t IN ('1', '2', '3') THEN CAST(t AS INT) END AS tier,
           CASE WHEN tier IS NOT NULL AND t NOT IN ('1', '2', '3') THEN 'ERROR: Invalid force_tier ''' || tier || '''. Valid values are 1, 2, or 3.' END AS error
    FROM (SELECT page_id, tier, {D.strip('tier')} AS t FROM requests)""".replace("END AS tier,", "END AS forced,"), ["requests"])
def _(spark, sf):
    forced = U.coerce_force_tier(F.col("tier"))
    return table(spark, sf, "requests").select("page_id", forced["tier"].alias("forced"), forced["error"].alias("error"))


_REQUEST_SQL = f"""
    SELECT page_id, u AS clean_url, m AS clean_mode, CASE WHEN tier <> 'Auto' THEN TRY_CAST({D.strip('tier')} AS INT) END AS force_tier,
        CASE WHEN NOT (starts_with(u, 'http://') OR starts_with(u, 'https://')) THEN 'Invalid URL. Must start with http:// or https://'
             WHEN m NOT IN ('precision', 'full') THEN 'Invalid mode. Must be ''precision'' or ''full''.'
             WHEN tier <> 'Auto' AND TRY_CAST({D.strip('tier')} AS INT) IS NULL THEN 'invalid literal for int() with base 10: ''' || tier || '''' END AS error
    FROM (SELECT page_id, {D.strip('url')} AS u, lower({D.strip("coalesce(mode, 'precision')")}) AS m, coalesce(tier, 'Auto') AS tier FROM requests)"""


@query("u6_validate_request", _REQUEST_SQL, ["requests"])
def _(spark, sf):
    asked = table(spark, sf, "requests").withColumns(
        {"mode": F.coalesce("mode", F.lit("precision")), "tier": F.coalesce("tier", F.lit("Auto"))})
    return V.validate_request(asked).select("page_id", "clean_url", "clean_mode", "force_tier", "error")


def _syntax_sql(p: str = "") -> str:
    return f"""CASE WHEN {p}scheme NOT IN ('http', 'https') THEN 'ERROR: Invalid URL: ' || {p}url || '. URL must start with http:// or https://'
    WHEN {p}host = '' THEN 'ERROR: Invalid URL: ' || {p}url || '. URL host is missing.'
    WHEN {p}host = 'localhost' OR ends_with({p}host, '.localhost') OR ends_with({p}host, '.local') THEN 'ERROR: URL host ''' || {p}host || ''' is not allowed.' END"""


_PARSED = f"SELECT page_id, url, {D.scheme('url')} AS scheme, {D.guard_host('url')} AS host, {D.port('url')} AS port FROM odd_urls"


@query("u7_validate_url_syntax", f"SELECT page_id, scheme, host, {_syntax_sql()} AS error FROM parsed", ["odd_urls"], {"parsed": _PARSED})
def _(spark, sf):
    return V.validate_url_syntax(table(spark, sf, "odd_urls")).select("page_id", "scheme", "host", "error")


@query("u8_is_public_ip", f"SELECT host, ord, ip, {D.public_ipv4('ip')} AS public FROM dns", ["dns"])
def _(spark, sf):
    return table(spark, sf, "dns").select("host", "ord", "ip", A.is_public_ip(F.col("ip")).alias("public"))


_V6_TEXT = "CASE page_id % 6 WHEN 0 THEN concat('::ffff:10.0.0.', CAST(page_id % 256 AS VARCHAR(20))) WHEN 1 THEN concat('::ffff:8.8.8.', CAST(page_id % 256 AS VARCHAR(20))) WHEN 2 THEN concat('2001:db8::', CAST(page_id % 1000 AS VARCHAR(20))) WHEN 3 THEN concat('2606:4700::', CAST(page_id % 1000 AS VARCHAR(20))) WHEN 4 THEN concat('fe80::1:', CAST(page_id % 1000 AS VARCHAR(20))) ELSE concat('64:ff9b::', CAST(page_id % 1000 AS VARCHAR(20))) END"


@query("u8_is_public_ipv6", f"SELECT page_id, {_V6_TEXT} AS ip, page_id % 6 IN (1, 3, 5) AS public FROM pages")
def _(spark, sf):
    ips = table(spark, sf, "pages").select("page_id", F.expr(_V6_TEXT).alias("ip"))
    return ips.withColumn("public", A.is_public_ip(F.col("ip")))


_VERDICTS = f"""SELECT host, count(*) AS n, arg_min(ip, ord) FILTER (WHERE NOT {D.public_ipv4('ip')}) AS bad FROM dns GROUP BY host
    HAVING bool_or({D.is_ipv4('ip')})"""


def _guard_sql(first: str) -> str:
    blocked = "'ERROR: URL host ''' || p.host || ''' resolves to non-public IP ''' || {ip} || ''' and is not allowed.'"
    return f"""SELECT p.page_id, CASE WHEN {first} WHEN {_syntax_sql('p.')} IS NOT NULL THEN {_syntax_sql('p.')}
        WHEN p.host = '::1' THEN {blocked.replace('{ip}', 'p.host')}
        WHEN {D.is_ipv4('p.host')} THEN CASE WHEN NOT {D.public_ipv4('p.host')} THEN {blocked.replace('{ip}', 'p.host')} END
        WHEN p.port IS NULL THEN 'Port out of range 0-65535'
        WHEN v.n IS NULL THEN 'ERROR: Could not resolve host ''' || p.host || ''' to an IP address.'
        WHEN v.bad IS NOT NULL THEN {blocked.replace('{ip}', 'v.bad')} END AS error
        FROM parsed p LEFT JOIN verdicts v ON v.host = p.host"""


@query("u9_validate_urls", _guard_sql("FALSE THEN ''"), ["odd_urls", "dns"], {"parsed": _PARSED, "verdicts": _VERDICTS})
def _(spark, sf):
    return V.validate_urls(table(spark, sf, "odd_urls"), table(spark, sf, "dns")).select("page_id", "error")


_PORT_ERROR = f"({_syntax_sql('p.')}) IS NULL AND port IS NULL THEN 'Port out of range 0-65535'"


@query("u10_validate_urls_once", _guard_sql(_PORT_ERROR), ["odd_urls", "dns"], {"parsed": _PARSED, "verdicts": _VERDICTS})
def _(spark, sf):
    return V.validate_urls_once(table(spark, sf, "odd_urls"), table(spark, sf, "dns")).select("page_id", "error")


@query("u11_site_flags", f"""SELECT page_id, {D.one_of('h', C.TWITTER_HOSTS)} AS twitter, {D.is_medium('h')} AS medium, {D.one_of('h', C.JS_HOSTS)} AS js
    FROM (SELECT page_id, {D.host('url')} AS h FROM odd_urls)""", ["odd_urls"])
def _(spark, sf):
    host = U.url_host(F.col("url"))
    return table(spark, sf, "odd_urls").select(
        "page_id", U.is_twitter(host).alias("twitter"), U.is_medium(host).alias("medium"), U.needs_js(host).alias("js"))


@query("u12_site_type", f"SELECT page_id, {D.site_type('h')} AS site_type FROM (SELECT page_id, {D.host('url')} AS h FROM odd_urls)", ["odd_urls"])
def _(spark, sf):
    return table(spark, sf, "odd_urls").select("page_id", U.site_type(U.url_host(F.col("url"))).alias("site_type"))


@query("u14_tweet_id", "SELECT page_id, nullif(regexp_extract(url, '/status/(\\d+)', 1), '') AS tweet_id FROM odd_urls", ["odd_urls"])
def _(spark, sf):
    return table(spark, sf, "odd_urls").select("page_id", U.tweet_id(F.col("url")).alias("tweet_id"))


_LOCATIONS = "CASE page_id % 6 WHEN 0 THEN '/moved/here' WHEN 1 THEN 'next' WHEN 2 THEN '?page=9' WHEN 3 THEN '#end' WHEN 4 THEN '//cdn.example.org/a' ELSE 'https://other.example.org/b' END"


@query("u16_resolve_location", f"""
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN site || '/moved/here' WHEN 1 THEN site || regexp_replace(path, '[^/]*$', '') || 'next'
        WHEN 2 THEN site || path || '?page=9' WHEN 3 THEN regexp_replace(url, '#.*$', '') || '#end'
        WHEN 4 THEN regexp_extract(url, '^[a-z]+:') || '//cdn.example.org/a' ELSE 'https://other.example.org/b' END AS target
    FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def _(spark, sf):
    return pages(spark, sf).select("page_id", U.resolve_location(F.col("url"), F.expr(_LOCATIONS)).alias("target"))


def _plan_sql(tier3: bool) -> str:
    return f"""WITH parsed AS (SELECT page_id, CASE WHEN page_id % 4 > 0 THEN page_id % 4 END AS forced, {D.one_of(D.host('url'), C.JS_HOSTS)} AS js FROM odd_urls),
      offered AS (SELECT * FROM parsed, (VALUES (1, 'tier1_curl', 7000), (2, 'tier2_camoufox', 10000), (3, 'tier3_nodriver', 12000)) t(no, tier, cap)),
      run AS (SELECT * FROM offered WHERE (no = 1 AND (forced = 1 OR (forced IS NULL AND NOT js))) OR (no = 2 AND (forced IS NULL OR forced = 2)) OR (no = 3 AND {tier3} AND (forced IS NULL OR forced = 3)))
      SELECT p.page_id, CAST(row_number() OVER (PARTITION BY p.page_id ORDER BY no) - 1 AS BIGINT) AS position, r.tier AS planned_tier, r.cap AS cap_ms,
        CASE WHEN r.tier IS NULL THEN 'No tiers available to run' END AS warning,
        CASE WHEN r.tier IS NULL THEN 'Set {C.TIER3_SWITCH}=1 to enable Tier 3 browser' END AS suggestion
      FROM parsed p LEFT JOIN run r ON r.page_id = p.page_id"""


def _planned(tier3: bool) -> Query:
    def run(spark, sf):
        forced = F.when(F.col("page_id") % 4 > 0, (F.col("page_id") % 4).cast("int"))
        asked = table(spark, sf, "odd_urls").select("page_id", U.url_host(F.col("url")).alias("host"), forced.alias("force_tier"))
        out = V.plan_tiers(asked, tier3)
        return out.select("page_id", F.coalesce("position", F.lit(0)).cast("bigint").alias("position"), "planned_tier", "cap_ms", "warning", "suggestion")
    return run


def _nested(sql: str) -> str:
    """A query that brings its own WITH list, as a derived table."""
    return f"SELECT * FROM ({sql}) AS q"


query("u17_plan_tiers", _nested(_plan_sql(True)), ["odd_urls"])(_planned(True))
query("u17_plan_tiers_no_tier3", _nested(_plan_sql(False)), ["odd_urls"])(_planned(False))


# ---------------------------------------------------------------------------- gates
@query("g1_has_js_wall", f"SELECT page_id, {D.js_wall('html')} AS wall FROM walled", ["walled"])
def _(spark, sf):
    return table(spark, sf, "walled").select("page_id", G.has_js_wall(F.col("html")).alias("wall"))


@query("g2_is_js_skeleton", f"""
    SELECT page_id, length(html) >= 10000 AND (length(text) / greatest(length(html), 1) < 0.04
        OR ({D.any_phrase('lower(substr(html, 1, 5000))', C.SPA_MARKERS)} AND length(text) < 500)) AS skeleton
    FROM (SELECT page_id, html, {D.strip_tags('html')} AS text FROM walled)""", ["walled"])
def _(spark, sf):
    text = X.strip_tags_regex(F.col("html"))
    return table(spark, sf, "walled").select("page_id", G.is_js_skeleton(F.col("html"), text).alias("skeleton"))


@query("g3_access_restriction", f"SELECT page_id, len(s) > 0 AS flag, array_to_string(s, '|') AS signals FROM (SELECT page_id, {D.signals('text')} AS s FROM (SELECT page_id, {D.strip_tags('html')} AS text FROM walled))", ["walled"])
def _(spark, sf):
    found = G.access_restriction(X.strip_tags_regex(F.col("html")))
    out = table(spark, sf, "walled").select("page_id", found.alias("r"))
    return out.select("page_id", "r.flag", F.array_join("r.signals", "|").alias("signals"))


@query("g4_response_gate", f"SELECT page_id, url FROM walled WHERE status = 200 AND length(html) > 500 AND NOT {D.js_wall('html')}", ["walled"])
def _(spark, sf):
    return table(spark, sf, "walled").filter(G.passes_response_gate(F.col("status"), F.col("html"))).select("page_id", "url")


@query("g4_page_gate_by_tier", f"""
    SELECT page_id, tier, coalesce(CASE tier WHEN 'tier1_curl' THEN status = 200 AND length(html) > 500 AND NOT wall WHEN 'tier2_camoufox' THEN NOT wall
        ELSE NOT wall AND html <> '' END, FALSE) AS passes
    FROM (SELECT page_id, ['tier1_curl', 'tier2_camoufox', 'tier3_nodriver'][page_id % 3 + 1] AS tier, status, html, {D.js_wall('html')} AS wall FROM walled)""", ["walled"])
def _(spark, sf):
    tier = F.element_at(F.array(*[F.lit(t) for t in C.TIER_CAPS_MS]), (F.col("page_id") % 3 + 1).cast("int"))
    offered = table(spark, sf, "walled").withColumn("tier", tier)
    return offered.select("page_id", "tier", G.passes_page_gate(F.col("tier"), F.col("status"), F.col("html")).alias("passes"))


_SOURCES = "CASE page_id % 8 WHEN 0 THEN 'tier1_curl' WHEN 1 THEN 'tier2_camoufox' WHEN 2 THEN 'tier1_5_jina' WHEN 3 THEN 'mirror' WHEN 4 THEN 'archive' WHEN 5 THEN 'twitter_twikit' WHEN 6 THEN 'medium_freedium' ELSE 'tier3_nodriver' END"
@query("g5_min_length_gate", f"""
    SELECT page_id, source, length(text) AS chars FROM (SELECT page_id, {_SOURCES} AS source, text FROM plain)
    WHERE length(text) > CASE source WHEN 'tier2_camoufox' THEN 100 WHEN 'tier1_5_jina' THEN 200 WHEN 'mirror' THEN 300 WHEN 'archive' THEN 300
        WHEN 'twitter_twikit' THEN 500 WHEN 'medium_freedium' THEN 500 ELSE -1 END""", ["plain"])
def _(spark, sf):
    sourced = table(spark, sf, "plain").select("page_id", F.expr(_SOURCES).alias("source"), "text")
    kept = sourced.filter(G.passes_min_length(F.col("source"), F.col("text")))
    return kept.select("page_id", "source", X.char_count(F.col("text")).alias("chars"))


@query("g6_sparse_flag", "SELECT page_id, n < 500 AS sparse, CASE WHEN n < 500 THEN 'Sparse content extracted (' || n || ' chars < 500)' END AS warning FROM (SELECT page_id, least(length(text), 498 + page_id % 4) AS n FROM plain)", ["plain"])
def _(spark, sf):
    chars = F.least(X.char_count(F.col("text")), 498 + F.col("page_id") % 4)
    sized = table(spark, sf, "plain").select("page_id", chars.alias("n"))
    return sized.select("page_id", G.is_sparse(F.col("n")).alias("sparse"), G.sparse_warning(F.col("n")).alias("warning"))


@query("g7_ocr_text_gate", "SELECT doc_id, CASE WHEN length(t) >= 50 THEN t END AS ocr, CASE WHEN length(t) > 50 THEN t END AS vision FROM (SELECT doc_id, text AS t FROM documents)")
def _(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", G.ocr_text_gate(text).alias("ocr"), G.vision_text_gate(text).alias("vision"))


@query("g8_redirect_status", "SELECT page_id, status, status IN (301, 302, 303, 307, 308) AS redirect FROM (SELECT page_id, CAST(299 + page_id % 11 AS INT) AS status FROM pages)")
def _(spark, sf):
    status = (299 + F.col("page_id") % 11).cast("int")
    return pages(spark, sf).select("page_id", status.alias("status")).withColumn("redirect", U.is_redirect(F.col("status")))


# ---------------------------------------------------------------------------- extraction
@query("x1_extract_markdown", f"SELECT page_id, CASE WHEN length(t) > 100 THEN t END AS text FROM (SELECT page_id, {D.markdown('html')} AS t FROM pages)")
def _(spark, sf):
    return EX.extract_markdown(pages(spark, sf)).select("page_id", "text")


@query("x1_deep_pages", f"SELECT page_id, CASE WHEN length(t) > 100 THEN t END AS text FROM (SELECT page_id, {D.markdown('html')} AS t FROM pages)")
def _(spark, sf):
    """All pages within 60 elements that print nothing, by the SQL for the pages as they are."""
    wrapped = F.concat(F.repeat(F.lit("<div>"), F.lit(60)), "html", F.repeat(F.lit("</div>"), F.lit(60)))
    return EX.extract_markdown(pages(spark, sf).withColumn("html", wrapped)).select("page_id", "text")


@query("x2_extract_stripped", f"SELECT page_id, {D.stripped('html')} AS text FROM pages")
def _(spark, sf):
    return EX.extract_stripped(pages(spark, sf)).select("page_id", "text")


def _dedup_sql(docs: str, key: str, least: int) -> dict[str, str]:
    """Helper relations: docs(key, host, text) without lines repeated on at least `least` pages."""
    return {
        "docs": docs,
        "lines": f"SELECT {key}, host, i, ls[i + 1] AS line FROM (SELECT {key}, host, ls, unnest(range(len(ls))) AS i FROM (SELECT {key}, host, string_split(text, chr(10)) AS ls FROM docs))",
        "repeated": f"SELECT host, line FROM lines WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT {key}) >= {least}",
        "rebuilt": f"SELECT {key}, string_agg(line, chr(10) ORDER BY i) AS text FROM lines l WHERE NOT EXISTS (SELECT 1 FROM repeated r WHERE r.host = l.host AND r.line = l.line) GROUP BY {key}",
        "deduped": f"SELECT d.{key}, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text FROM docs d LEFT JOIN rebuilt r ON r.{key} = d.{key}",
    }


_MAIN_DOCS = f"SELECT page_id, {D.host('url')} AS host, {D.article('html')} AS text FROM pages"
_TRIMMED = f"(SELECT page_id, {D.strip('text')} AS t FROM deduped)"


@query("x3_extract_main", f"SELECT page_id, CASE WHEN length(t) > 100 THEN t END AS text FROM {_TRIMMED}", extra=_dedup_sql(_MAIN_DOCS, "page_id", 3))
def _(spark, sf):
    return EX.extract_main(pages(spark, sf)).select("page_id", "text")


@query("x4_strip_tags_regex", f"SELECT page_id, {D.strip_tags('html')} AS text FROM pages")
def _(spark, sf):
    return pages(spark, sf).select("page_id", X.strip_tags_regex(F.col("html")).alias("text"))


@query("x5_extract_article", f"SELECT page_id, coalesce({D.article('html')}, 'Could not find main content.') AS text FROM region_pages", ["region_pages"])
def _(spark, sf):
    return EX.extract_article(table(spark, sf, "region_pages")).select("page_id", "text")


_NOISELESS = D.replace_all(D.without("html", C.NOISE_TAGS_LONG), r'(?s)<div (?:class="x ad-container"|id="nav"|class=modal)>.*?</div>', "'<x>'")


@query("x6_drop_noise", f"SELECT page_id, {D.strip(D.collapse(D.nodes_joined(_NOISELESS)))} AS text FROM noisy_pages", ["noisy_pages"])
def _(spark, sf):
    return EX.drop_noise(table(spark, sf, "noisy_pages")).select("page_id", "text")


_CLEAN_MD = D.strip(D.collapse(D.replace_all(D.replace_all("coalesce(md, '')", r"!\[.*?\]\(.*?\)"), r"\[([^\]]*)\]\(.*?\)", r"'\1'")))


@query("x6_noise_free_markdown", f"SELECT page_id, {_CLEAN_MD} AS text FROM (SELECT page_id, {D.markdown(_NOISELESS)} AS md FROM noisy_pages)", ["noisy_pages"])
def _(spark, sf):
    return EX.noise_free_markdown(table(spark, sf, "noisy_pages"), C.NOISE_TAGS_LONG, C.NOISE_SELECTORS_LONG).select("page_id", "text")


@query("x7_clean_markdown", f"SELECT page_id, {_CLEAN_MD} AS text FROM markdown_docs", ["markdown_docs"])
def _(spark, sf):
    return table(spark, sf, "markdown_docs").select("page_id", X.clean_markdown(F.col("md")).alias("text"))


@query("x8_dedup_segments", "SELECT doc_id, text FROM deduped", extra=_dedup_sql("SELECT doc_id, source AS host, text FROM documents", "doc_id", 3))
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("host"), "text")
    return SG.drop_repeated_segments(docs, "doc_id", 3).select("doc_id", "text")


def _ladder_sql(first: str) -> str:
    rest = D.stripped("html")
    return f"""SELECT page_id, CASE {first} WHEN length(m) > 100 THEN 'main' ELSE 'stripped' END AS method,
        CASE {first.replace("'markdown'", 'md')} WHEN length(m) > 100 THEN m ELSE {rest} END AS text"""


@query("x9_extract_precision", f"{_ladder_sql('')} FROM pages JOIN (SELECT page_id, t AS m FROM {_TRIMMED}) USING (page_id)", extra=_dedup_sql(_MAIN_DOCS, "page_id", 3))
def _(spark, sf):
    return EX.extract(pages(spark, sf), "precision").select("page_id", "method", "text")


@query("x9_extract_full", f"{_ladder_sql(_FULL := '''WHEN length(md) > 100 THEN 'markdown' ''')} FROM (SELECT page_id, html, {D.markdown('html')} AS md, {D.strip(D.article('html'))} AS m FROM pages)")
def _(spark, sf):
    return EX.extract(pages(spark, sf), "full", min_pages=None).select("page_id", "method", "text")


@query("x9_extract_full_deduped", f"{_ladder_sql(_FULL)} FROM (SELECT page_id, html, t AS m, {D.markdown('html')} AS md FROM pages JOIN (SELECT page_id, t FROM {_TRIMMED}) USING (page_id))", extra=_dedup_sql(_MAIN_DOCS, "page_id", 3))
def _(spark, sf):
    return EX.extract(pages(spark, sf), "full").select("page_id", "method", "text")


@query("x10_collapse_newlines", f"SELECT doc_id, {D.collapse('t')} AS text FROM (SELECT doc_id, replace(text, '. ', '.' || repeat(chr(10), CAST(doc_id % 5 AS INT))) AS t FROM documents)")
def _(spark, sf):
    spread = table(spark, sf, "documents").select("doc_id", F.expr("replace(text, '. ', concat('.', repeat('\n', CAST(doc_id % 5 AS INT))))").alias("t"))
    return spread.select("doc_id", X.collapse_newlines(F.col("t")).alias("text"))


@query("x11_normalize_chunks", f"SELECT doc_id, {D.chunks('t')} AS text FROM (SELECT doc_id, replace(text, '. ', CASE doc_id % 3 WHEN 0 THEN '.  ' WHEN 1 THEN '.' || chr(13) || chr(10) ELSE ' . ' END) AS t FROM documents)")
def _(spark, sf):
    spread = table(spark, sf, "documents").select("doc_id", F.expr("replace(text, '. ', CASE doc_id % 3 WHEN 0 THEN '.  ' WHEN 1 THEN '.\r\n' ELSE ' . ' END)").alias("t"))
    return spread.select("doc_id", X.normalize_chunks(F.col("t")).alias("text"))


def _ocr_sql(factor: int) -> dict[str, str]:
    name = "lines" if factor == 31 else "lines2"
    texts = "texts" if factor == 31 else "texts2"
    joined = D.strip(D.collapse("t"))
    return {
        name: ocr_lines_sql(factor),
        texts: f"""SELECT doc_id, CASE WHEN length(t2) >= 50 THEN t2 END AS text FROM (SELECT doc_id, {joined} AS t2 FROM (
            SELECT d.doc_id, coalesce(k.t, '') AS t FROM documents d LEFT JOIN (
                SELECT doc_id, string_agg({D.strip('text')}, chr(10) ORDER BY line_no) AS t FROM {name}
                WHERE (confidence IS NULL OR confidence >= 0.4) AND {D.strip('text')} <> '' GROUP BY doc_id) k USING (doc_id)))""",
    }


@query("x12_assemble_ocr", "SELECT doc_id, text FROM texts", extra=_ocr_sql(31))
def _(spark, sf):
    return OC.assemble_ocr(ocr_pages(spark, sf)).select("doc_id", "text")


@query("x13_ocr_fallback", """
    SELECT a.doc_id, CASE WHEN a.text IS NOT NULL THEN 'playwright_surya' ELSE 'playwright_claude_fallback' END AS method, coalesce(a.text, b.text) AS text
    FROM texts a LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(text) > 50 THEN text END AS text FROM texts2) b ON b.doc_id = a.doc_id
    WHERE coalesce(a.text, b.text) IS NOT NULL""", extra={**_ocr_sql(31), **_ocr_sql(7)})
def _(spark, sf):
    second = OC.assemble_ocr(ocr_pages(spark, sf, 7)).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    return OC.ocr_fallback(OC.assemble_ocr(ocr_pages(spark, sf)), second, "both")


@query("x15_format_tweet", """
    SELECT conv_id, turn, '@user' || conv_id || ' - ' || role || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Posted: day ' || turn || chr(10) ELSE '' END
        || chr(10) || text || chr(10) || chr(10) || 'Likes: ' || length(text) % 97 || '  Retweets: ' || turn * 3 || '  Replies: ' || conv_id % 5
        || CASE WHEN turn % 3 >= 1 THEN chr(10) || chr(10) || 'Media (' || turn % 3 || ' item(s)):' || chr(10) || '  https://img/a' || turn ELSE '' END
        || CASE WHEN turn % 3 = 2 THEN chr(10) || '  http://img/b' || turn ELSE '' END AS content
    FROM conversations""")
def _(spark, sf):
    turn = F.col("turn").cast("string")
    first = F.struct(F.concat(F.lit("https://img/a"), turn).alias("media_url_https"), F.concat(F.lit("http://img/a"), turn).alias("url"))
    second = F.struct(F.lit(None).cast("string").alias("media_url_https"), F.concat(F.lit("http://img/b"), turn).alias("url"))
    posts = table(spark, sf, "conversations").select(
        "conv_id", "turn", "text",
        F.struct(F.concat(F.lit("user"), "conv_id").alias("screen_name"), F.col("role").alias("name")).alias("user"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("day "), turn)).alias("created_at"),
        F.when(F.col("turn") % 4 != 3, F.col("text")).alias("full_text"),
        (F.length("text") % 97).alias("favorite_count"), (F.col("turn") * 3).alias("retweet_count"),
        (F.col("conv_id") % 5).alias("reply_count"),
        F.slice(F.array(first, second), 1, (F.col("turn") % 3).cast("int")).alias("media"))
    return TW.format_tweet(posts).select("conv_id", "turn", "content")


# ---------------------------------------------------------------------------- joins
_WALK = """
    SELECT url, cur, seen, requests, outcome FROM (SELECT url, url AS cur, [] ::VARCHAR[] AS seen, 0 AS requests, NULL ::VARCHAR AS outcome FROM pages)
    UNION ALL
    SELECT w.url, CASE WHEN list_contains(w.seen, w.cur) OR h.location IS NULL THEN w.cur ELSE h.location END,
           list_append(w.seen, w.cur), w.requests + CASE WHEN list_contains(w.seen, w.cur) THEN 0 ELSE 1 END,
           CASE WHEN list_contains(w.seen, w.cur) THEN 'loop' WHEN h.url IS NULL THEN 'missing' WHEN h.status = 200 OR h.location IS NULL THEN 'resolved'
                WHEN w.requests = 7 THEN 'exhausted' END
    FROM walk w LEFT JOIN hops h ON h.url = w.cur WHERE w.outcome IS NULL"""


@query("rd1_resolve_redirects", "SELECT url, CASE WHEN outcome = 'resolved' THEN cur END AS final_url, CAST(requests AS BIGINT) AS requests, outcome FROM walk WHERE outcome IS NOT NULL", ["hops"], {"walk": _WALK})
def _(spark, sf):
    return RD.resolve_redirects(pages(spark, sf), table(spark, sf, "hops"))


_SAFE_WALK = _WALK.replace("NULL ::VARCHAR AS outcome FROM pages", "CASE WHEN bad THEN 'blocked' END AS outcome FROM judged").replace(
    "WHEN w.requests = 7", "WHEN j.bad THEN 'blocked' WHEN w.requests = 7").replace(
    "ON h.url = w.cur", "ON h.url = w.cur LEFT JOIN judged j ON j.url = h.location").replace(
    "OR h.location IS NULL THEN w.cur", "OR h.location IS NULL OR j.bad THEN w.cur")


@query("rd1_resolve_redirects_guarded", "SELECT url, CASE WHEN outcome = 'resolved' THEN cur END AS final_url, CAST(requests AS BIGINT) AS requests, outcome FROM walk WHERE outcome IS NOT NULL", ["hops", "dns"], {
    "verdicts": _VERDICTS,
    "judged": f"SELECT p.url, v.n IS NULL OR v.bad IS NOT NULL AS bad FROM pages p LEFT JOIN verdicts v ON v.host = {D.guard_host('p.url')}",
    "walk": _SAFE_WALK})
def _(spark, sf):
    return RD.resolve_redirects(pages(spark, sf), table(spark, sf, "hops"), table(spark, sf, "dns"))


@query("j4_latest_snapshot", f"""
    SELECT url, captured_at, text FROM (SELECT url, captured_at, CASE WHEN length(m) > 100 THEN m ELSE {D.stripped('html')} END AS text
        FROM (SELECT *, {D.strip(D.article('html'))} AS m FROM snapshots
            WHERE (url, captured_at) IN (SELECT url, max(captured_at) FROM snapshots GROUP BY url) AND status = 200 AND length(html) > 500))
    WHERE length(text) > 300""", ["snapshots"])
def _(spark, sf):
    return FB.latest_snapshot_text(pages(spark, sf), table(spark, sf, "snapshots"))


@query("j5_first_passing_mirror", "SELECT url, min(priority) AS priority, arg_min(text, priority) AS text FROM mirrors WHERE status = 200 AND length(text) > 300 GROUP BY url", ["mirrors"])
def _(spark, sf):
    return FB.first_passing_mirror(table(spark, sf, "mirrors"))


@query("j6_escalate", """
    SELECT request_id, min(tier) AS solved_by FROM attempts WHERE success AND content_length > 0 GROUP BY request_id
    UNION ALL
    SELECT request_id, NULL AS solved_by FROM attempts GROUP BY request_id HAVING NOT bool_or(success AND content_length > 0)""", ["attempts"])
def _(spark, sf):
    log = table(spark, sf, "attempts")
    pending = materialize(log.select("request_id").distinct(), "pending")
    stages = []
    for tier in C.TIER_CAPS_MS:
        good = log.filter((F.col("tier") == tier) & F.col("success") & (F.col("content_length") > 0)).select("request_id").distinct()
        solved = materialize(pending.join(good, "request_id", "left_semi"), "solved")
        stages.append(solved.withColumn("solved_by", F.lit(tier)))
        pending = FB.escalate(pending, solved)
    return stages[0].unionByName(stages[1]).unionByName(stages[2]).unionByName(
        pending.withColumn("solved_by", F.lit(None).cast("string")))


# ---------------------------------------------------------------------------- attempts
_CAPS = "CASE tier WHEN 'tier1_curl' THEN 7000 WHEN 'tier2_camoufox' THEN 10000 ELSE 12000 END"
_CAPPED = f"""SELECT request_id, attempt_id, tier, success AND elapsed_ms <= {_CAPS} AS success,
    CASE WHEN elapsed_ms > {_CAPS} THEN 0 ELSE content_length END AS content_length, least(elapsed_ms, {_CAPS}) AS elapsed_ms,
    CASE WHEN elapsed_ms > {_CAPS} THEN CASE tier WHEN 'tier1_curl' THEN 'Timeout after 7.0s' WHEN 'tier2_camoufox' THEN 'Timeout after 10.0s' ELSE 'Timeout after 12.0s' END ELSE error END AS error
    FROM attempts"""
_TIMED = {"timed": f"SELECT * FROM ({_CAPPED}) WHERE elapsed_ms <= 12000"}
_WINNERS = """SELECT request_id, arg_min(attempt_id, (elapsed_ms, attempt_id)) FILTER (WHERE success AND content_length >= 5000) AS good,
        arg_max(attempt_id, (content_length, -elapsed_ms, -attempt_id)) FILTER (WHERE success AND content_length > 0) AS longest
    FROM timed GROUP BY request_id"""
_WIN = {**_TIMED, "winners": _WINNERS}
_WINNER_SQL = """SELECT w.request_id, a.attempt_id, a.tier AS winning_tier, coalesce(a.content_length, 0) AS content_length, a.elapsed_ms, a.attempt_id IS NOT NULL AS success
    FROM winners w LEFT JOIN timed a ON a.attempt_id = coalesce(w.good, w.longest)"""
_LISTED = """SELECT t.*, row_number() OVER (PARTITION BY t.request_id ORDER BY t.elapsed_ms, t.attempt_id) AS seq FROM timed t
    JOIN winners w USING (request_id) LEFT JOIN timed g ON g.attempt_id = w.good
    WHERE w.good IS NULL OR (t.elapsed_ms, t.attempt_id) <= (g.elapsed_ms, g.attempt_id)"""


def timed(spark: SparkSession, sf: str) -> DataFrame:
    return AT.apply_deadlines(table(spark, sf, "attempts"))


@query("a1_pick_winner", _WINNER_SQL, ["attempts"], _WIN)
def _(spark, sf):
    return AT.pick_winner(timed(spark, sf))


@query("a2_collect_attempts", """SELECT request_id, CAST(count(*) AS INT) AS n, string_agg(tier || ':' || content_length || ':' || coalesce(error, ''), ',' ORDER BY seq) AS attempts
    FROM listed GROUP BY request_id""", ["attempts"], {**_WIN, "listed": _LISTED})
def _(spark, sf):
    listed = AT.collect_attempts(timed(spark, sf))
    shown = F.transform("attempts", lambda a: F.concat_ws(":", a["tier"], a["content_length"].cast("string"), F.coalesce(a["error"], F.lit(""))))
    return listed.select("request_id", F.size("attempts").alias("n"), F.array_join(shown, ",").alias("attempts"))


_FAILED = """SELECT request_id, CASE WHEN count(tier) = 0 THEN 'All tiers failed' ELSE 'All tiers failed: ' || string_agg(tier, ', ' ORDER BY elapsed_ms, attempt_id) END AS warning"""


@query("a4_failed_tiers", f"{_FAILED} FROM timed GROUP BY request_id HAVING NOT bool_or(success)", ["attempts"], _TIMED)
def _(spark, sf):
    return AT.failed_tiers(timed(spark, sf))


_GLOBAL = {**_WIN, "late": f"""SELECT request_id FROM ({_CAPPED}) GROUP BY request_id
    HAVING bool_or(elapsed_ms > 12000) AND NOT bool_or(success AND content_length >= 5000 AND elapsed_ms <= 12000)"""}
_RESULT = {
    **_GLOBAL, "listed": _LISTED,
    "listing": """SELECT request_id, list({'tier': tier, 'success': success, 'n': content_length, 'error': error} ORDER BY seq) AS ts, max(elapsed_ms) AS last_ms FROM listed GROUP BY request_id""",
    "won": f"SELECT x.*, c.content FROM ({_WINNER_SQL}) x LEFT JOIN attempts_content c USING (attempt_id)",
    "facts": f"""SELECT j.request_id, j.url, j.mode, j.force_tier, coalesce(w.success AND w.content <> '', FALSE) AS ok, w.content, w.content_length, w.winning_tier, l.ts,
        late.request_id IS NOT NULL AS timed_out, coalesce(CASE WHEN late.request_id IS NOT NULL THEN 12000 ELSE l.last_ms END, 0) AS total_ms
        FROM jobs j LEFT JOIN won w USING (request_id) LEFT JOIN listing l USING (request_id) LEFT JOIN late USING (request_id)""",
    "judged": f"SELECT *, CASE WHEN ok THEN {D.signals('content')} ELSE [] END AS sig, coalesce(NOT ok AND ts IS NULL AND force_tier = 3, FALSE) AS barred FROM facts",
    "result": f"""SELECT *, len(sig) > 0 AS restricted, ok AND content_length < 500 AS sparse,
        list_filter([CASE WHEN timed_out THEN 'Global timeout (12.0s) reached' END,
            CASE WHEN ok AND content_length < 500 THEN 'Sparse content extracted (' || content_length || ' chars < 500)' END,
            CASE WHEN len(sig) > 0 THEN 'Access restriction detected: ' || array_to_string(sig, ', ') END,
            CASE WHEN NOT ok AND ts IS NULL AND force_tier = 3 THEN '{C.NO_TIERS}' WHEN NOT ok AND ts IS NULL THEN 'All tiers failed' WHEN NOT ok THEN 'All tiers failed: ' || array_to_string(list_transform(ts, lambda t: t.tier), ', ') END], lambda x: x IS NOT NULL) AS warnings,
        list_filter([CASE WHEN len(sig) > 0 THEN 'Try external relays ({C.RELAY_SWITCH}=1)' END,
            CASE WHEN len(sig) > 0 THEN 'Try archive fallback for paywalled content' END,
            CASE WHEN barred THEN '{C.ENABLE_TIER3}' END,
            CASE WHEN NOT ok AND NOT barred THEN 'Enable external relays: {C.RELAY_SWITCH}=1' END,
            CASE WHEN NOT ok AND NOT barred THEN 'Enable Tier 3 browser: {C.TIER3_SWITCH}=1' END,
            CASE WHEN NOT ok AND NOT barred AND force_tier IS NOT NULL THEN 'Try without force_tier to allow auto-escalation' END], lambda x: x IS NOT NULL) AS suggestions
        FROM judged""",
}


def results(spark: SparkSession, sf: str) -> DataFrame:
    return AT.scrape_result(table(spark, sf, "jobs"), table(spark, sf, "attempts_content"))


@query("a3_scrape_result", """
    SELECT request_id, url, mode, ok AS success, CASE WHEN ok THEN content END AS content, CASE WHEN ok THEN content_length ELSE 0 END AS content_length,
        CASE WHEN ok THEN winning_tier END AS winning_tier, total_ms AS total_elapsed_ms, coalesce(len(ts), 0) AS n_attempts, array_to_string(warnings, '|') AS warnings,
        array_to_string(suggestions, '|') AS suggestions, restricted AS access_restriction_detected, sparse AS sparse_content FROM result""", ["attempts_content", "jobs"], _RESULT)
def _(spark, sf):
    return results(spark, sf).withColumns({
        "n_attempts": F.size("tier_attempts").cast("bigint"), "warnings": F.array_join("warnings", "|"),
        "suggestions": F.array_join("suggestions", "|")}).drop("tier_attempts")


@query("a5_tier_benchmark", f"""
    SELECT tier, site_type, count(*) AS attempts, count(*) FILTER (WHERE success) AS successes, CAST(sum(content_length) AS BIGINT) AS chars, CAST(sum(elapsed_ms) AS BIGINT) AS total_ms,
        quantile_cont(elapsed_ms, 0.5) AS p50_ms, quantile_cont(elapsed_ms, 0.95) AS p95_ms, max(elapsed_ms) AS max_ms
    FROM (SELECT t.*, CASE t.request_id % 4 WHEN 0 THEN 'twitter' WHEN 1 THEN 'medium' WHEN 2 THEN 'js-spa' ELSE 'general' END AS site_type FROM timed t) GROUP BY 1, 2""", ["attempts"], _TIMED)
def _(spark, sf):
    site = F.expr("CASE request_id % 4 WHEN 0 THEN 'twitter' WHEN 1 THEN 'medium' WHEN 2 THEN 'js-spa' ELSE 'general' END")
    return AT.tier_benchmark(timed(spark, sf).withColumn("site_type", site))


@query("w1_truncate_after_winner", "SELECT request_id, attempt_id FROM listed", ["attempts"], {**_WIN, "listed": _LISTED})
def _(spark, sf):
    return AT.truncate_after_winner(timed(spark, sf)).select("request_id", "attempt_id")


@query("w2_completion_order", "SELECT request_id, attempt_id, row_number() OVER (PARTITION BY request_id ORDER BY elapsed_ms, attempt_id) AS position FROM attempts", ["attempts"])
def _(spark, sf):
    return AT.completion_order(table(spark, sf, "attempts")).select("request_id", "attempt_id", "position")


@query("w3_apply_deadlines", "SELECT request_id, attempt_id, tier, success, CAST(content_length AS BIGINT) AS content_length, CAST(elapsed_ms AS BIGINT) AS elapsed_ms, error FROM timed", ["attempts"], _TIMED)
def _(spark, sf):
    return timed(spark, sf).select("request_id", "attempt_id", "tier", "success", "content_length", "elapsed_ms", "error")


@query("w3_global_timeouts", """SELECT request_id, 'Global timeout (12.0s) reached' AS warning FROM attempts GROUP BY request_id
    HAVING bool_or(elapsed_ms > 12000 AND started_cap > 12000) AND NOT bool_or(success AND content_length >= 5000 AND elapsed_ms <= 12000 AND elapsed_ms <= own_cap)""".replace(
        "FROM attempts", f"FROM (SELECT *, {_CAPS} AS own_cap, CASE WHEN tier = 'tier3_nodriver' THEN 13500 ELSE {_CAPS} END AS started_cap FROM attempts)"), ["attempts"])
def _(spark, sf):
    started = F.when(F.col("tier") == "tier3_nodriver", C.STAGGER_MS).otherwise(0)
    log = table(spark, sf, "attempts").withColumn("started_ms", started)
    return AT.global_timeouts(log)


@query("o1_union_attempts", """SELECT request_id, attempt_id, tier, success, content_length FROM attempts
    UNION ALL SELECT conv_id AS request_id, -1 - (conv_id * 100 + turn) AS attempt_id, 'twitter_twikit' AS tier, length(text) > 500 AS success, length(text) AS content_length FROM conversations""", ["attempts"])
def _(spark, sf):
    special = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("request_id"), (-1 - (F.col("conv_id") * 100 + F.col("turn"))).alias("attempt_id"),
        F.lit("twitter_twikit").alias("tier"), (F.length("text") > 500).alias("success"),
        X.char_count(F.col("text")).alias("content_length"))
    return AT.union_attempts(table(spark, sf, "attempts"), special).select(
        "request_id", "attempt_id", "tier", "success", "content_length")


# ---------------------------------------------------------------------------- reports
@query("k4_to_response", f"""SELECT request_id, ok AS success, CASE WHEN ok THEN winning_tier END AS tier_used, CASE WHEN ok THEN content END AS content,
        CASE WHEN ok THEN length(content) ELSE 0 END AS char_count, CAST(total_ms // 10 + CASE WHEN total_ms % 10 > 5 OR (total_ms % 10 = 5 AND (total_ms // 10) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100 AS elapsed_time,
        CASE WHEN NOT ok THEN {D.quote(RP.EXHAUSTED)} END AS error FROM result""", ["attempts_content", "jobs"], _RESULT)
def _(spark, sf):
    return RP.to_response(results(spark, sf))


_REPORT_LISTS = "CASE WHEN len({0}) > 0 THEN {2} || {1} || list_aggregate(list_transform({0}, lambda x: chr(10) || '  - ' || x), 'string_agg', '') ELSE '' END"


@query("f1_format_result", f"""SELECT request_id, CASE WHEN ok THEN 'SOURCE: ' || url || chr(10) || 'METHOD: ' || winning_tier || ' (' || {D.seconds('total_ms')} || 's)'
        || CASE WHEN len(others) > 0 THEN ' | other: ' || array_to_string(list_transform(others, lambda t: t.tier || CASE WHEN t.success THEN ' (ok: ' ELSE ' (fail: ' END || t.n || ' chars)'), ', ') ELSE '' END
        || chr(10) || 'MODE: ' || mode || chr(10) || 'CHARS: original=' || format('{{:,}}', content_length) || '; returned=' || format('{{:,}}', length(content))
        || CASE WHEN sparse AND restricted THEN chr(10) || 'STATUS: SPARSE_CONTENT, ACCESS_RESTRICTED' WHEN sparse THEN chr(10) || 'STATUS: SPARSE_CONTENT' WHEN restricted THEN chr(10) || 'STATUS: ACCESS_RESTRICTED' ELSE '' END
        || chr(10) || chr(10) || content || {_REPORT_LISTS.format('warnings', "'WARNINGS:'", 'chr(10) || chr(10)')} || {_REPORT_LISTS.format('suggestions', "'SUGGESTIONS:'", 'chr(10) || chr(10)')}
      ELSE 'ERROR: Failed to fetch ' || url || chr(10)
        || CASE WHEN ts IS NOT NULL THEN chr(10) || 'Tier Results:' || list_aggregate(list_transform(ts, lambda t: chr(10) || '  - ' || t.tier || CASE WHEN t.success THEN ': OK' ELSE ': FAILED' END
            || CASE WHEN t.error IS NOT NULL THEN ' (' || t.error || ')' ELSE '' END || CASE WHEN t.success THEN ', ' || t.n || ' chars' ELSE '' END), 'string_agg', '') || chr(10) ELSE '' END
        || {_REPORT_LISTS.format('warnings', "'Warnings:'", 'chr(10)')} || chr(10) || {_REPORT_LISTS.format('suggestions', "'Suggestions:'", 'chr(10)')} END AS report
    FROM (SELECT *, list_filter(ts, lambda t: t.tier <> winning_tier) AS others FROM result)""", ["attempts_content", "jobs"], _RESULT)
def _(spark, sf):
    return RP.format_result(results(spark, sf)).select("request_id", "report")


@query("f2_content_stats", f"SELECT doc_id, length(text) AS char_count, {D.newlines('text')} + CASE WHEN text = '' THEN 0 ELSE 1 END AS line_count FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("text", "content")
    return RP.content_stats(docs).select("doc_id", "char_count", "line_count")


@query("t2_truncate_output", """SELECT doc_id, length(t) > 95000 AS truncated, substr(t, 1, 95000) || CASE WHEN length(t) > 95000 THEN chr(10) || chr(10) || '[TRUNCATED] Output capped at 95,000 characters.' ELSE '' END AS output
    FROM (SELECT doc_id, repeat(text, CAST(1 + 20 * (doc_id % 2) AS INT)) AS t FROM documents)""")
def _(spark, sf):
    long = table(spark, sf, "documents").select("doc_id", F.expr("repeat(text, CAST(1 + 20 * (doc_id % 2) AS INT))").alias("text"))
    return RP.truncate_output(long).select("doc_id", "truncated", "output")


@query("t3_preview_lines", f"""SELECT doc_id, array_to_string(list_slice(regexp_split_to_array({D.replace_all('t', '(?:' + X.LINE_BREAK + r')\z')}, {D.quote(X.LINE_BREAK)}), 1, 35), chr(10))
        || CASE WHEN {D.newlines('t')} > 35 THEN chr(10) || chr(10) || '... (' || ({D.newlines('t')} - 35) || ' more lines)' ELSE '' END AS preview
    FROM (SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS t FROM documents)""")
def _(spark, sf):
    spread = table(spark, sf, "documents").select("doc_id", F.expr("replace(text, '. ', '.\n')").alias("t"))
    return spread.select("doc_id", X.preview_lines(F.col("t")).alias("preview"))


_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_SEARCH = {
    "terms": f"SELECT query_id, query, unnest(list_distinct({_WORDS.format('query')})) AS word FROM search_queries",
    "found": f"SELECT page_id, unnest({_WORDS.format('text')}) AS word FROM plain",
    "scored": "SELECT query_id, query, page_id, count(*) AS score FROM found JOIN terms USING (word) GROUP BY ALL",
    "top": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM scored QUALIFY rank <= 10",
}


def top_hits(spark: SparkSession, sf: str) -> DataFrame:
    return SE.search_top_k(table(spark, sf, "plain"), table(spark, sf, "search_queries"))


@query("t1_search_top_k", "SELECT query_id, query, rank, page_id, score FROM top", ["plain", "search_queries"], _SEARCH)
def _(spark, sf):
    return top_hits(spark, sf)


@query("k6_to_search_json", """SELECT query_id, '[' || string_agg('{"title":"P' || page_id || '","href":"' || url || '","body":"' || score || ' hits"}', ',' ORDER BY rank) || ']' AS results
    FROM top JOIN pages USING (page_id) GROUP BY query_id""", ["plain", "search_queries"], _SEARCH)
def _(spark, sf):
    hits = top_hits(spark, sf).join(pages(spark, sf).select("page_id", F.col("url").alias("href")), "page_id")
    shown = hits.select("query_id", "rank", F.concat(F.lit("P"), "page_id").alias("title"), "href",
                        F.concat(F.col("score").cast("string"), F.lit(" hits")).alias("body"))
    return SE.to_search_json(shown)


# ---------------------------------------------------------------------------- streaming and user code
@query("st1_stream_extract", f"{_ladder_sql('')} FROM (SELECT page_id, html, {D.strip(D.article('html'))} AS m FROM pages) WHERE length(html) > 500 AND NOT {D.js_wall('html')}")
def _(spark, sf):
    done = ST.stream_extract(R.stream_pages(spark, sf, "pages.parquet"))
    return ST.run_available(done.select("page_id", "method", "text"), "extracted")


def attempt_log(spark: SparkSession, sf: str) -> DataFrame:
    finished = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("request_id") * 20_000 + F.col("elapsed_ms"))
    started = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("request_id") * 20_000)
    return table(spark, sf, "attempts").withColumns({"finished_at": finished, "started_at": started})


def attempt_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The attempts log as a stream of files, closed by one row that ends after every deadline."""
    log = attempt_log(spark, sf)
    folder = new_folder(spark, "attempt-log")
    log.write.parquet(folder)
    end = log.agg(F.max("finished_at").alias("end")).select(
        F.lit(-1).cast("bigint").alias("request_id"), F.lit(-1).cast("bigint").alias("attempt_id"), F.lit("").alias("tier"),
        F.lit(False).alias("success"), F.lit(0).cast("bigint").alias("content_length"),
        F.lit(0).cast("bigint").alias("elapsed_ms"), F.lit(None).cast("string").alias("error"),
        (F.col("end") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"), (F.col("end") + F.expr("INTERVAL 1 HOUR")).alias("started_at"))
    end.write.mode("append").parquet(folder)
    return spark.readStream.schema(log.schema).parquet(folder)


@query("st2_stream_race", _WINNER_SQL, ["attempts"], _WIN)
def _(spark, sf):
    return ST.run_available(ST.stream_race(attempt_stream(spark, sf)), "race")


@query("st2_stream_race_early", _WINNER_SQL, ["attempts"], _WIN)
def _(spark, sf):
    log = attempt_stream(spark, sf)
    early = ST.run_updates(ST.stream_race_early(log), "race-early", "request_id")
    at_deadline = ST.run_available(ST.stream_race(log), "race-end")
    return early.unionByName(at_deadline.join(early.select("request_id"), "request_id", "left_anti"))


@query("st3_stream_validate_once", f"SELECT DISTINCT host, scheme, port FROM parsed WHERE ({_syntax_sql()}) IS NULL", ["odd_urls"], {"parsed": _PARSED})
def _(spark, sf):
    folder = new_folder(spark, "url-log")
    seen_at = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("page_id") * 10)
    odd = table(spark, sf, "odd_urls").select("url", seen_at.alias("seen_at"))
    odd.write.parquet(folder)
    stream = ST.stream_validate_once(spark.readStream.schema(odd.schema).parquet(folder), keep="30 days")
    return ST.run_available(stream.select("host", "scheme", "port"), "verdict-keys")


_LATE_SPLIT = "(SELECT CAST(max(request_id) AS BIGINT) // 2 FROM attempts) AS half"


@query("st4_late_attempts", f"""SELECT tier, count(*) AS kept FROM (SELECT *, {_LATE_SPLIT} FROM attempts)
    WHERE request_id % 2 = 0 AND request_id <= half
        OR ((1704067200000 + request_id * 20000 + elapsed_ms) // 60000 + 1) * 60000 > (SELECT max(1704067200000 + request_id * 20000 + elapsed_ms) FROM (SELECT *, {_LATE_SPLIT} FROM attempts)
            WHERE request_id % 2 = 0 AND request_id <= half) - 600000
    GROUP BY tier""", ["attempts"])
def _(spark, sf):
    """Even requests of the first half arrive in order; the others later, in files of their own. Those
    in minutes that ended ten minutes before the newest row are late, and dropped by the watermark."""
    log = attempt_log(spark, sf).filter("request_id >= 0")
    half = log.agg(F.floor(F.max("request_id") / 2).alias("half")).first()["half"]
    on_time = (F.col("request_id") % 2 == 0) & (F.col("request_id") <= half)
    newest = log.filter(on_time).agg(F.max("finished_at").alias("end")).first()["end"]
    tick = log.filter(on_time & (F.col("finished_at") == F.lit(newest))).limit(1).withColumn("tier", F.lit(""))
    close = tick.withColumn("finished_at", F.col("finished_at") + F.expr("INTERVAL 3650 DAYS"))
    folder = new_folder(spark, "late-log")
    for part in (log.filter(on_time), tick, log.filter(~on_time), close):  # one file and one batch each
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    counted = ST.count_in_time(stream, "finished_at", "10 minutes", "1 minute", "tier")
    kept = ST.run_available(counted, "late")
    return kept.filter("tier <> ''").groupBy("tier").agg(F.sum("n").alias("kept"))


def _user_extractor(html: str, mode: str) -> str | None:
    """A caller's function for the harness: no result for some pages, an error for others."""
    if len(html) % 7 == 0:
        return None
    if len(html) % 7 == 1:
        raise ValueError("bad page " * 40)
    return html.replace("<p>", "\n")


@query("d1_apply_extractor", """SELECT page_id, 'custom' AS tier, length(html) % 7 > 1 AS success, CASE WHEN length(html) % 7 > 1 THEN replace(html, '<p>', chr(10)) END AS content,
        CASE WHEN length(html) % 7 > 1 THEN length(replace(html, '<p>', chr(10))) ELSE 0 END AS content_length,
        CASE length(html) % 7 WHEN 0 THEN 'No content returned' WHEN 1 THEN substr(repeat('bad page ', 40), 1, 200) END AS error FROM pages""")
def _(spark, sf):
    return EX.apply_extractor(pages(spark, sf), _user_extractor, "custom").drop("url", "elapsed_ms")


def _slow_extractor(html: str, mode: str) -> str | None:
    """Never ends for some pages."""
    while len(html) % 50 == 0:
        pass
    return html[:200]


@query("d1_extractor_limits", """SELECT page_id, length(html) % 50 <> 0 AS success, CASE WHEN length(html) % 50 <> 0 THEN substr(html, 1, 200) END AS content,
        CASE WHEN length(html) % 50 = 0 THEN 'Timeout after 0.1s' END AS error FROM pages""")
def _(spark, sf):
    return EX.apply_extractor(pages(spark, sf), _slow_extractor, "custom", limit_ms=100).select("page_id", "success", "content", "error")


# ---------------------------------------------------------------------------- end to end
_SCRAPE = {
    "verdicts": _VERDICTS,
    "checked": f"""SELECT request_id, u AS url, m AS mode, {D.guard_host('u')} AS host, CASE WHEN t <> 'Auto' THEN CAST(t AS INT) END AS forced,
        CASE WHEN NOT starts_with(u, 'http') THEN 'Invalid URL. Must start with http:// or https://'
             WHEN m NOT IN ('precision', 'full') THEN 'Invalid mode. Must be \'\'precision\'\' or \'\'full\'\'.' END AS refused
        FROM (SELECT request_id, {D.strip('url')} AS u, lower({D.strip('mode')}) AS m, tier AS t FROM asked)""".replace("\\'", "'"),
    "planned": f"""SELECT c.*, o.tier, o.no - row_number() OVER (PARTITION BY request_id ORDER BY o.no) AS gap, row_number() OVER (PARTITION BY request_id ORDER BY o.no) - 1 AS attempt_id,
        v.n IS NOT NULL AND v.bad IS NULL AS safe
        FROM checked c JOIN (VALUES (1, 'tier1_curl'), (2, 'tier2_camoufox'), (3, 'tier3_nodriver')) o(no, tier) ON c.forced IS NULL OR c.forced = o.no
        LEFT JOIN verdicts v ON v.host = c.host WHERE c.refused IS NULL""",
    "tried": f"""SELECT p.request_id, p.attempt_id, p.tier, coalesce(r.elapsed_ms, 0) AS elapsed_ms,
        CASE WHEN p.safe AND CASE p.tier WHEN 'tier1_curl' THEN r.status = 200 AND length(r.html) > 500 AND NOT {D.js_wall('r.html')} ELSE NOT {D.js_wall('r.html')} AND r.html <> '' END
             THEN CASE WHEN p.mode = 'full' AND length(x.md) > 100 THEN x.md WHEN length(x.m) > 100 THEN x.m ELSE x.st END END AS text
        FROM planned p LEFT JOIN responses r ON r.url = p.url AND r.tier = p.tier
        LEFT JOIN (SELECT url, {D.markdown('html')} AS md, {D.strip(D.article('html'))} AS m, {D.stripped('html')} AS st FROM pages) x ON x.url = p.url""",
    "logged": f"""SELECT request_id, attempt_id, tier, text IS NOT NULL AND elapsed_ms <= {_CAPS} AS success, CASE WHEN elapsed_ms > {_CAPS} THEN 0 ELSE length(text) END AS n,
        least(elapsed_ms, {_CAPS}) AS elapsed_ms, text FROM (SELECT request_id, attempt_id, tier, elapsed_ms, CASE WHEN tier = 'tier2_camoufox' AND length(text) <= 100 THEN NULL ELSE text END AS text FROM tried)""",
    "valid": "SELECT * FROM logged WHERE elapsed_ms <= 12000",
    "best": """SELECT request_id, coalesce(arg_min(attempt_id, (elapsed_ms, attempt_id)) FILTER (WHERE success AND n >= 5000),
        arg_max(attempt_id, (n, -elapsed_ms, -attempt_id)) FILTER (WHERE success AND n > 0)) AS attempt_id,
        min((elapsed_ms, attempt_id)) FILTER (WHERE success AND n >= 5000) AS hit FROM valid GROUP BY request_id""",
    "ends": "SELECT v.request_id, max(v.elapsed_ms) AS ms FROM valid v JOIN best b USING (request_id) WHERE b.hit IS NULL OR (v.elapsed_ms, v.attempt_id) <= b.hit GROUP BY v.request_id",
    "timeouts": "SELECT request_id FROM logged GROUP BY request_id HAVING bool_or(elapsed_ms > 12000) AND NOT bool_or(success AND n >= 5000 AND elapsed_ms <= 12000)",
}


@query("scrape_stored", f"""SELECT c.request_id, w.text IS NOT NULL AS success, w.tier AS tier_used, w.text AS content, coalesce(length(w.text), 0) AS char_count,
        CAST(CASE WHEN c.refused IS NOT NULL THEN 0 WHEN t.request_id IS NOT NULL THEN 1200 ELSE coalesce(e.ms // 10 + CASE WHEN e.ms % 10 > 5 OR (e.ms % 10 = 5 AND (e.ms // 10) % 2 = 1) THEN 1 ELSE 0 END, 0) END AS DOUBLE) / 100 AS elapsed_time,
        CASE WHEN c.refused IS NOT NULL THEN c.refused WHEN w.text IS NULL THEN {D.quote(RP.EXHAUSTED)} END AS error
    FROM checked c LEFT JOIN best b USING (request_id) LEFT JOIN valid w ON w.request_id = b.request_id AND w.attempt_id = b.attempt_id
    LEFT JOIN ends e ON e.request_id = c.request_id LEFT JOIN timeouts t ON t.request_id = c.request_id""", ["asked", "responses", "dns"], _SCRAPE)
def _(spark, sf):
    return SC.scrape_stored(table(spark, sf, "asked"), table(spark, sf, "responses"), table(spark, sf, "dns"), allow_tier3=True)


_ROUTE_TABLES = ["route_asked", "route_responses", "route_dns", "route_hops", "route_tweets", "route_mirrors", "route_snapshots"]


def _route_sql(relays: bool) -> dict[str, str]:
    """The staged way, each stage as a relation; handlers of medium hosts only with relays."""
    return {
        "verdicts": _VERDICTS.replace("FROM dns", "FROM route_dns"),
        "asked_pages": f"""SELECT request_id, a.url, mode, {D.guard_host('a.url')} AS host, CASE WHEN tier <> 'Auto' THEN CAST(tier AS INT) END AS forced
            FROM route_asked a""",
        "checked": """SELECT a.*, v.n IS NOT NULL AND v.bad IS NULL AS safe, forced IS NULL AND a.host = 'x.com' AS tw, """
                   f"""forced IS NULL AND a.host = 'medium.com' AND {str(relays).lower()} AS med FROM asked_pages a LEFT JOIN verdicts v ON v.host = a.host""",
        "bodies": f"SELECT url, {D.markdown('html')} AS md, {D.strip(D.article('html'))} AS m, {D.stripped('html')} AS st FROM route_urls",
        "moded": """SELECT url, 'precision' AS mode, CASE WHEN length(m) > 100 THEN m ELSE st END AS text FROM bodies
            UNION ALL SELECT url, 'full', CASE WHEN length(md) > 100 THEN md WHEN length(m) > 100 THEN m ELSE st END FROM bodies""",
        "used": """SELECT r.url, mode, any_value(text) AS text, min(priority) FILTER (WHERE status = 200 AND length(html) > 500 AND length(text) > 300) AS used
            FROM route_mirrors r JOIN moded USING (url) GROUP BY 1, 2""",
        "mirrored": """SELECT u.url, mode, CASE WHEN used IS NOT NULL THEN any_value(u.text) END AS text, sum(latency_ms) FILTER (WHERE used IS NULL OR priority <= used)::BIGINT AS ms
            FROM used u JOIN route_mirrors USING (url) GROUP BY u.url, mode, used""",
        "archived": """SELECT s.url, mode, CASE WHEN status = 200 AND length(html) > 500 AND length(text) > 300 THEN text END AS text, latency_ms AS ms
            FROM route_snapshots s JOIN moded USING (url) WHERE (s.url, captured_at) IN (SELECT (url, max(captured_at)) FROM route_snapshots GROUP BY url)""",
        "one": """SELECT c.*, coalesce(t.latency_ms, 0) AS ms1, t.content AS text1, tw AND coalesce(t.latency_ms, 0) <= 7000 AND coalesce(length(t.content), 0) > 500 AS won1
            FROM checked c LEFT JOIN route_tweets t ON t.url = c.url""",
        "two": """SELECT o.*, CASE WHEN tw THEN least(ms1, 7000) ELSE 0 END AS at2, coalesce(x.ms, 0) AS ms2, x.text AS text2,
            med AND coalesce(x.ms, 0) <= 7000 AND coalesce(length(x.text), 0) > 500 AS won2 FROM one o LEFT JOIN mirrored x ON x.url = o.url AND x.mode = o.mode""",
        "three": """SELECT o.*, at2 + CASE WHEN med THEN least(ms2, 7000) ELSE 0 END AS at3, coalesce(x.ms, 0) AS ms3, x.text AS text3 FROM two o LEFT JOIN archived x ON x.url = o.url AND x.mode = o.mode""",
        "handled": """SELECT *, med AND NOT won2 AND ms3 <= 7000 AND at3 + ms3 <= 12000 AND coalesce(length(text3), 0) > 500 AS won3,
            at3 + CASE WHEN med AND NOT won2 THEN least(ms3, 7000) ELSE 0 END AS begin FROM three""",
        "ends_at": """SELECT h.*, CASE WHEN NOT h.safe THEN NULL WHEN request_id % 4 <> 3 THEN h.url WHEN request_id % 16 IN (11, 15) THEN NULL
            WHEN p.safe THEN p.url END AS final_url FROM handled h LEFT JOIN (SELECT request_id + 1 AS request_id, url, safe FROM checked) p USING (request_id)""",
        "planned": f"""SELECT e.*, o.tier, row_number() OVER (PARTITION BY request_id ORDER BY o.no) - 1 AS attempt_id
            FROM ends_at e JOIN (VALUES (1, 'tier1_curl'), (2, 'tier2_camoufox'), (3, 'tier3_nodriver')) o(no, tier)
            ON coalesce(forced = o.no, NOT (o.no = 1 AND {D.one_of('host', C.JS_HOSTS)})) WHERE NOT (won1 OR won2 OR won3)""",
        "tried": f"""SELECT p.request_id, p.attempt_id, p.tier, p.begin, coalesce(r.latency_ms, 0) AS ms, CASE WHEN p.tier = 'tier2_camoufox' AND length(x.text) <= 100 THEN NULL
            WHEN CASE p.tier WHEN 'tier1_curl' THEN r.status = 200 AND length(r.html) > 500 AND NOT {D.js_wall('r.html')} ELSE NOT {D.js_wall('r.html')} AND r.html <> '' END
            AND coalesce(r.latency_ms, 0) <= {_CAPS.replace('CASE tier', 'CASE p.tier')} THEN x.text END AS text
            FROM planned p LEFT JOIN route_responses r ON r.url = p.final_url AND r.tier = p.tier LEFT JOIN moded x ON x.url = p.final_url AND x.mode = p.mode""",
        "early": f"SELECT request_id, begin + least(ms, 7000) AS failed_ms FROM tried WHERE tier = 'tier1_curl' AND attempt_id = 0 AND coalesce(length(text), 0) = 0",
        "logged": f"""SELECT t.*, coalesce(length(text), 0) AS n, CASE WHEN attempt_id = 0 THEN begin ELSE least(begin + 1500, coalesce(failed_ms, begin + 1500)) END + least(ms, {_CAPS}) AS elapsed_ms
            FROM tried t LEFT JOIN early USING (request_id)""",
        "valid": "SELECT * FROM logged WHERE elapsed_ms <= 12000",
        "best": """SELECT request_id, coalesce(arg_min(attempt_id, (elapsed_ms, attempt_id)) FILTER (WHERE n >= 5000), arg_max(attempt_id, (n, -elapsed_ms, -attempt_id)) FILTER (WHERE n > 0)) AS attempt_id,
            min((elapsed_ms, attempt_id)) FILTER (WHERE n >= 5000) AS hit FROM valid GROUP BY request_id""",
        "ends": "SELECT v.request_id, max(v.elapsed_ms) AS ms FROM valid v JOIN best b USING (request_id) WHERE b.hit IS NULL OR (v.elapsed_ms, v.attempt_id) <= b.hit GROUP BY v.request_id",
        "timeouts": "SELECT request_id FROM logged GROUP BY request_id HAVING bool_or(elapsed_ms > 12000) AND NOT bool_or(n >= 5000 AND elapsed_ms <= 12000)",
        "answers": """SELECT h.request_id, CASE WHEN won1 THEN 'twitter_twikit' WHEN won2 THEN 'medium_freedium' WHEN won3 THEN 'medium_archive' ELSE w.tier END AS tier,
            CASE WHEN won1 THEN text1 WHEN won2 THEN text2 WHEN won3 THEN text3 ELSE w.text END AS text,
            CASE WHEN won1 THEN ms1 WHEN won2 THEN at2 + ms2 WHEN won3 THEN at3 + ms3 WHEN t.request_id IS NOT NULL THEN 12000 ELSE coalesce(e.ms, 0) END AS ms
            FROM handled h LEFT JOIN best b USING (request_id) LEFT JOIN valid w ON w.request_id = b.request_id AND w.attempt_id = b.attempt_id
            LEFT JOIN ends e ON e.request_id = h.request_id LEFT JOIN timeouts t ON t.request_id = h.request_id""",
    }


_ROUTE = f"""SELECT request_id, text IS NOT NULL AS success, CASE WHEN text IS NOT NULL THEN tier END AS tier_used, text AS content, coalesce(length(text), 0) AS char_count,
    CAST(ms // 10 + CASE WHEN ms % 10 > 5 OR (ms % 10 = 5 AND (ms // 10) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100 AS elapsed_time,
    CASE WHEN text IS NULL THEN {D.quote(RP.EXHAUSTED)} END AS error FROM answers"""


def _route(spark: SparkSession, sf: str, relays: bool) -> DataFrame:
    return RO.scrape_route(*[table(spark, sf, name) for name in _ROUTE_TABLES], allow_relays=relays, allow_tier3=True)


@query("scrape_route", _ROUTE, ["route_urls", *_ROUTE_TABLES], _route_sql(False))
def _(spark, sf):
    """Posts, redirects and tiers, without relays."""
    return _route(spark, sf, False)


@query("scrape_route_relays", _ROUTE, ["route_urls", *_ROUTE_TABLES], _route_sql(True))
def _(spark, sf):
    """The same with mirrors and the archive."""
    return _route(spark, sf, True)


# ---------------------------------------------------------------------------- flagship
@query("site_report", f"""
    SELECT host, site_type, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, max(length(text)) AS longest, count(*) FILTER (WHERE len(sig) > 0) AS restricted
    FROM (SELECT *, {D.signals('text')} AS sig FROM (
        SELECT {D.host('url')} AS host, {D.site_type(D.host('url'))} AS site_type,
               CASE WHEN length(m) > 100 THEN m ELSE {D.stripped('html')} END AS text
        FROM (SELECT url, html, {D.strip(D.article('html'))} AS m FROM pages WHERE length(html) > 500 AND NOT {D.js_wall('html')})))
    GROUP BY 1, 2""")
def site_report(spark, sf):
    """Gate, route, extract and assess every page, then report per host."""
    host = U.url_host(F.col("url"))
    passed = pages(spark, sf).filter((F.length("html") > C.MIN_RESPONSE_CHARS) & ~G.has_js_wall(F.col("html")))
    routed = passed.withColumn("host", host).withColumn("site_type", U.site_type(F.col("host")))
    text = EX.extract(routed, "precision", min_pages=None)
    assessed = text.select("host", "site_type", X.char_count(F.col("text")).alias("n"),
                           G.access_restriction(F.col("text"))["flag"].alias("flag"))
    return assessed.groupBy("host", "site_type").agg(
        F.count("*").alias("pages"), F.sum("n").alias("chars"), F.max("n").alias("longest"), F.count_if("flag").alias("restricted"))
