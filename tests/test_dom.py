"""Golden pages: one rule each."""

import re

import pytest
from pyspark.sql import functions as F

from pagesieve import constants as C
from pagesieve.functions import dom
from pagesieve.operators import extract as EX

STRIPPED = [
    ("<p>a</p><nav>x<nav>y</nav>z</nav><p>b</p>", "a\nb"),
    ("<div>a<nav>x</div><p>b</p>", "a\nb"),  # the unclosed nav ends with its div
    ("<p>a<b>b<p>c", "a\nb\nc"),
    ("<body><p>a", "a"),
    ("<script>var t='</p>';</script><p>a</p>", "a"),
    ("<script>x<p>never closed", ""),
    ("a &amp; b &copy; &middot; &#233; &#x41; &bogus;", "a & b © · é A &bogus"),
    ("<!-- only a comment -->", ""),
    ("a<!-- c -->b", "a\nb"),
    ("<title>T</title><p>a</p>", "T\na"),
    ("<p>a</p>   <p>b</p>", "a\n \nb"),
    ("<p>a</p>\n\n\n<p>b</p>", "a\n\nb"),
    ("a < b <p>c", "a < b \nc"),
    ("<img alt='>'>a<br/>b", "a\nb"),
    ("<template>x</template><ruby>a<rt>b</rt></ruby>", "a"),
    ("a</p></div>b", "a\nb"),
    ("<a href=x", "<a href=x"),
    *[(f"a<{t}>x</{t}>b", "a\nb") for t in C.STRIPPED_DROP_TAGS],
]
ARTICLE = [
    ("<body>x<main>m</main></body>", "m"),
    ("<main>m</main><article>a</article><article>b</article>", "a"),
    ("<body>x<p>y</body>", "x\ny"),
    ("<p>x</p>", EX.NO_CONTENT),
    ("<aside><article>x</article></aside><article>y</article>", "y"),
    ("<article>a  b \n\n c<footer>f</footer></article>", "a\nb\nc"),
    ("<article></article><main>m</main>", ""),
    ("<article>a<svg>s</svg></article>", "a\ns"),
]
MARKDOWN = [
    ("<h1>T</h1><p>a <b>b</b> <i>c</i></p>", "# T\n\na **b** *c*"),
    ("<h3>A\nB</h3>", "### A B"),
    ("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>", "- a\n- b\n  - c"),
    ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
    ("<ol start=3><li>a</li></ol>", "3. a"),
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
    ("<p>see <a href='u'>the link</a> now</p>", "see the link now"),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"),
    ("<pre>a\n  b</pre>", "```\na\n  b\n```"),
    ("<p>a<br>b</p><hr>", "a  \nb\n\n---"),
    ("<p><img src='s' alt='x'></p>", "![x](s)"),
    ("<p>2*3_4 <code>a_b</code></p>", "2\\*3\\_4 `a_b`"),
    ("<head><title>T</title></head><style>x</style><p>a</p>", "a"),
    ("<div>a<noscript>x</div><p>b</p>", "a\n\nb"),
    ("<p>a</p>\n\n\n<p>b</p>", "a\n\nb"),
]


DEEP = "<h2>T</h2><ul><li><b>one</b> two</li><li>three<blockquote>q<ol start=4><li>r</li></ol></blockquote></li></ul><table><tr><th>a</th></tr><tr><td>b <i>c</i></td></tr></table><pre>x\n y</pre>"


@pytest.mark.parametrize("around", ["div", "section", "span", "article", "font"])
@pytest.mark.parametrize("depth", [1, 50, 400, 20_000])
def test_markdown_at_any_depth(around, depth):
    """Elements that print nothing of their own may stand around a page as often as they like."""
    def markdown(html):
        return re.sub("\n{3,}", "\n\n", dom.to_markdown(html, frozenset()).strip())

    plain = "## T\n\n- **one** two\n- three\n\n  > q\n  > 4. r\n\n| a |\n| --- |\n| b *c* |\n\n```\nx\n y\n```"
    assert markdown(DEEP) == markdown(f"<{around}>" * depth + DEEP + f"</{around}>" * depth) == markdown(f"<{around}>" * depth + DEEP) == plain


def test_nested_items_and_quotes():
    levels = dom.to_markdown("".join(f"<ul><li>{i}" for i in range(60)), frozenset()).strip().split("\n")
    assert levels == [f"{'  ' * i}- {i}" for i in range(60)]
    quotes = dom.to_markdown("<blockquote>a" * 40, frozenset()).strip().split("\n")
    assert quotes[::2] == ["> " * (i + 1) + "a" for i in range(40)] and quotes[1] == ">"
    # beyond the bound the marks stay as they are, the text goes on
    deep = dom.to_markdown("".join(f"<blockquote>{i}" for i in range(150)), frozenset()).strip().split("\n")
    assert [x.lstrip("> ") for x in deep[::2]] == [str(i) for i in range(150)]
    assert deep[-1] == "> " * dom.MAX_MARKS + "149"


def frame(spark, cases):
    return spark.createDataFrame([(i, "http://h/", html) for i, (html, _) in enumerate(cases)], "page_id long, url string, html string")


def texts(df):
    return [r.text for r in df.orderBy("page_id").select("text").collect()]


def test_stripped(spark):
    assert texts(EX.extract_stripped(frame(spark, STRIPPED))) == [t for _, t in STRIPPED]


def test_article(spark):
    assert texts(EX.extract_article(frame(spark, ARTICLE))) == [t for _, t in ARTICLE]


def test_markdown(spark):
    parsed = EX.parse_pages(frame(spark, MARKDOWN), nodes=False, markdown=True)
    assert texts(parsed.withColumn("text", EX.markdown_text(F.col("md")))) == [t for _, t in MARKDOWN]


@pytest.mark.parametrize("chars,kept", [(100, False), (101, True)])
def test_acceptance_bound(spark, chars, kept):
    html = f"<article>{'a' * chars}</article><p>tail</p>"
    df = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert (EX.extract_main(df).first().text is not None) == kept
    assert EX.extract(df, "precision", None).first().method == ("main" if kept else "stripped")
    assert (EX.extract_markdown(df.withColumn("html", F.lit("a" * chars))).first().text is not None) == kept


def test_ladder_modes(spark):
    html = f"<body><h1>{'t' * 60}</h1><article>{'a' * 150}</article></body>"
    df = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    assert EX.extract(df, "full", None).first().text == f"# {'t' * 60}\n\n{'a' * 150}"
    assert EX.extract(df, "nonsense", None).first().text == "a" * 150
    empty = df.withColumn("html", F.lit("<p></p>"))
    assert EX.extract(empty, "precision", None).first().text == ""


def test_noise_selectors(spark):
    html = '<div class="a menu">x</div><div id=nav>y</div><p id="navigator">z</p><aside>w</aside>'
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert EX.drop_noise(df).first().text == "z"
    assert EX.drop_noise(df, C.NOISE_TAGS_SHORT, C.NOISE_SELECTORS_SHORT).first().text == "x\ny\nz"


def test_hostile_markup_is_linear():
    for html in ("<" * 200_000, "<a " * 100_000, "</" * 100_000, "<!--" * 50_000, "<b>" * 50_000 + "x"):
        dom.text_nodes(html)
        dom.to_markdown(html, frozenset())


def test_user_extractor_errors(spark):
    def fails(html, mode):
        raise KeyError("k" * 300)

    df = spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string")
    row = EX.apply_extractor(df, fails, "mine").first()
    assert (row.success, row.content, row.content_length, len(row.error)) == (False, None, 0, 200)
    assert EX.apply_extractor(df, lambda h, m: ("text", h), "mine").first().content == "text"


@pytest.mark.parametrize("isolate", [False, True])
def test_extractors_over_their_time_end_as_attempts(spark, isolate):
    def stubborn(html, mode):
        """Sleeps, runs on for ever, swallows errors, or answers, as the page says."""
        import signal
        import time

        if html == "sleep":
            time.sleep(600)
        while html == "endless":
            pass
        while html == "swallow":
            try:
                time.sleep(600)
            except Exception:
                pass
        if html == "deaf":
            signal.pthread_sigmask(signal.SIG_BLOCK, [signal.SIGALRM])
            time.sleep(600)
        if html == "dies":
            import os
            os._exit(3)
        if html == "error":
            raise ValueError("bad page")
        return None if html == "none" else (html * 300_000 if html == "long" else html, html)

    kinds = ["a", "sleep", "b", "endless", "error", "swallow", "none", "long", "c"] + ["deaf", "dies", "d"] * isolate
    df = spark.createDataFrame([(i, "u", k) for i, k in enumerate(kinds)], "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r for r in EX.apply_extractor(df, stubborn, "mine", limit_ms=300, isolate=isolate).collect()}
    for i, kind in enumerate(kinds):
        row = got[i]
        if kind in ("sleep", "endless", "swallow", "deaf"):
            assert (row.success, row.content, row.content_length, row.error) == (False, None, 0, "Timeout after 0.3s") and 300 <= row.elapsed_ms < 3000
        elif kind in ("error", "none", "dies"):
            assert (row.success, row.content, row.error) == (False, None, {"error": "bad page", "none": C.NO_RESULT, "dies": "Extractor process died"}[kind])
        else:
            assert (row.success, row.error) == (True, None) and row.content == (kind * 300_000 if kind == "long" else kind)


def test_extractor_limit_of_a_tier(spark):
    assert EX.apply_extractor(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), lambda h, m: h, "tier1_curl").first().success
    with pytest.raises(ValueError):
        EX.apply_extractor(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), lambda h, m: h, "mine", isolate=True)
