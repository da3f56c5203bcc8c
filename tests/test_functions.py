"""Column functions against the standard library and at their bounds."""

import ipaddress
import random
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from pagesieve import constants as C
from pagesieve.functions import addresses as A, gates as G, text as X, urls as U

URLS = ["http://Ex_ample.com/x", "HTTP://EXAMPLE.com:8080/a b", "http://[::1]:80/", "http://u:p@h.com./x", "ftp://a", "nope", "",
        "https://x.com/a|b", "https://münchen.de/x", "//h/x", "http://a:99999/", "http://a:0/", "http://a:b/", "http://a:/",
        "http://u@v@h:8/", " http://sp.com", "https://h?x@y", "http://h#a@b:9", "http://", "http://a:65535/", "http://a:65536/"]


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_host_scheme_port(spark):
    hosts, ends = column(spark, URLS, U.url_host), column(spark, URLS, U.url_scheme_port)
    for url, host, end in zip(URLS, hosts, ends):
        p = urlparse(url)
        try:
            port, error = p.port or (443 if p.scheme == "https" else 80), None
        except ValueError as exc:
            port, error = None, str(exc)
        assert (host, *end) == (p.hostname or "", p.scheme, port, error), url


def test_resolve_location(spark):
    bases = ["http://a.com", "http://a.com/", "http://a.com/b/c?q=1#f", "https://a.com/b/c/", "https://u@a.com:80/x/y/../z"]
    refs = ["", "/", "x", "./x", "../x", "../../x", "../../../x", "/a/./b/../c", "?z", "#f", "//h.com/p", "https://o.org/x",
            "x?y#z", "..", ".", "x/..", "x/.", "/..", "/a/..", "a//b", "mailto:x", "./", "../", "/../x", "x/../../y?../q"]
    pairs = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(pairs, "b string, r string")
    for row in df.select("b", "r", U.resolve_location(F.col("b"), F.col("r")).alias("o")).collect():
        assert row.o == urljoin(row.b, row.r), (row.b, row.r)


def test_public_addresses(spark):
    rng, texts = random.Random(7), []
    for block in C.IPV4_PRIVATE + C.IPV4_PUBLIC_EXCEPTIONS + C.IPV6_PRIVATE + C.IPV6_PUBLIC_EXCEPTIONS:
        net = ipaddress.ip_network(block)
        for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= n < 2 ** net.max_prefixlen:
                address = type(net[0])(n)
                texts += [str(address), address.exploded]
    texts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(300)]
    texts += ["::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::1", "1::2::3", ":::", "1:2", "1:2:3:4:5:6:7:8:9", "12345::", "::g",
              "::ffff:1.2.3.400", "256.1.1.1", "1.2.3", "01.2.3.4", "a.b", "", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", ":1:2:3:4:5:6:7"]

    def known(text):
        try:
            return ipaddress.ip_address(text).is_global
        except ValueError:
            return None

    assert column(spark, texts, A.is_public_ip) == [known(t) for t in texts]


def test_strip_is_python_strip(spark):
    values = [f"{chr(c)}a{chr(c)}b{chr(c)}" for c in range(1, 0x3001) if not 0xD800 <= c < 0xE000]
    assert column(spark, values, X.strip) == [v.strip() for v in values]


def test_lines_are_python_splitlines(spark):
    breaks = "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"
    values = [f"a{b}b  c {b}" for b in breaks] + ["a\r\nb", "", "a", "\n\n", "x\r\n\r\ny"]

    def chunks(v):
        return "\n".join(p.strip() for line in v.splitlines() for p in line.split("  ") if p.strip())

    assert column(spark, values, X.normalize_chunks) == [chunks(v) for v in values]


@pytest.mark.parametrize("lines", [34, 35, 36, 40])
def test_preview(spark, lines):
    text = "\n".join(f"l{i}" for i in range(lines)) + "\n"
    expected = "\n".join(text.splitlines()[:35])
    if lines > 35:
        expected += f"\n\n... ({lines - 35} more lines)"
    assert column(spark, [text], X.preview_lines) == [expected]


def test_seconds_text(spark):
    ms = [0, 49, 50, 51, 150, 250, 350, 1150, 1249, 1250, 1350, 12000]
    assert column(spark, ms, X.seconds_text, "bigint") == [f"{m / 1000:.1f}" for m in ms]


def test_signals_order_and_prefix(spark):
    text = "paywall. Members only. ACCESS DENIED. Please sign in"
    found = column(spark, [text, "x" * 2990 + "paywall", "x" * 2995 + "paywall", None, ""], G.access_restriction)
    assert found[0].signals == ["please sign in", "access denied", "members only"]
    assert [f.flag for f in found] == [True, True, False, False, False]
    assert found[1].signals == ["paywall: paywall"]


def test_gate_bounds(spark):
    def gate(html, text):
        df = spark.createDataFrame([(html, text)], "h string, t string")
        return df.select(G.is_js_skeleton(F.col("h"), F.col("t"))).first()[0]

    assert not gate("x" * 9_999, "")
    assert gate("x" * 10_000, "x" * 399) and not gate("x" * 10_000, "x" * 400)
    shell = '<div id="ROOT">'.lower() + "x" * 12_000
    assert gate(shell, "x" * 499) and not gate(shell, "x" * 500)
    passes = lambda n, status=200: spark.createDataFrame([(status, "x" * n)], "s int, h string").select(
        G.passes_response_gate(F.col("s"), F.col("h"))).first()[0]
    assert (passes(500), passes(501), passes(501, 404)) == (False, True, False)
    assert column(spark, ["x" * 49, "x" * 50, "x" * 51], G.ocr_text_gate) == [None, "x" * 50, "x" * 51]
    assert column(spark, ["x" * 50, "x" * 51], G.vision_text_gate) == [None, "x" * 51]
    assert column(spark, [499, 500], G.is_sparse, "bigint") == [True, False]
    for source, bounds in C.SOURCE_MIN_CHARS.items():
        kept = column(spark, ["x" * max(bounds), "x" * (max(bounds) + 1)], lambda t, s=source: G.passes_min_length(F.lit(s), t))
        assert kept == [False, True]


def test_clean_markdown(spark):
    values = [None, "", "![a](b) [t](u) x", "[a](b(c)d)", "[](x)", "a\n\n\n\nb  "]
    assert column(spark, values, X.clean_markdown) == ["", "", "t x", "ad)", "", "a\n\nb"]
