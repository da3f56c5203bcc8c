"""Time limits for hostile pages and texts: linear in their length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagesieve.functions import dom, text as X

DROP = frozenset(["script", "style", "svg"])
PATTERNS = ['<a ">"', "<a '>", '<a"', "<a<a", "<blockquote>x", "<li>a", "<svg>", "<div>", "<b>x<i>y", "<ul><li>x", "<table><tr><td>x", "<!--",
            "</a<", "<a b=c d>", "<script>", "&amp", "<pre>\n", "<blockquote><li>x\n", "<td>x", "<h1> x", "<div> ", "<p></p> ", "<b> ", "<div><ul><li> <b>x</b>",
            "<span> <p>x</p>", "<ol><li>"]
PIECES = ["<", ">", '"', "'", "[", "]", "<li>", "<blockquote>", "<svg>", "</svg>", "x ", "</li>", "<p>", '<a href="', "\n"]


def seconds(html: str) -> float:
    start = time.process_time()
    dom.to_markdown(html, DROP)
    dom.text_nodes(html, 0, frozenset(["ad"]), frozenset(["x"]))
    return time.process_time() - start


@pytest.mark.parametrize("pattern", PATTERNS)
def test_repeated_pattern(pattern):
    half, whole = (min(seconds(pattern * (n // len(pattern))) for _ in range(2)) for n in (500_000, 1_000_000))
    assert whole < 10 and whole < 3.2 * max(half, 0.5)  # a quadratic step would take four times as long


def test_random_mixes():
    for seed in range(20):
        draw = random.Random(seed)
        few = [draw.choice(PIECES) for _ in range(draw.randint(2, 5))]
        assert seconds("".join(draw.choice(few) for _ in range(1_000_000 // max(1, sum(map(len, few)) // len(few))))[:1_000_000]) < 10


def old_clean(c):
    no_images = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?d)!\[.*?\]\(.*?\)", "")
    return X.strip(X.collapse_newlines(F.regexp_replace(no_images, r"(?d)\[([^\]]*)\]\(.*?\)", "$1")))


def test_links_as_with_plain_patterns(spark):
    draw = random.Random(3)
    pieces = ["[", "]", "(", ")", "!", "![", "](", "x", "y ", "\n", "\r", "[a](b)", "![i](u)", "\n\n\n"]
    rows = [("".join(draw.choice(pieces) for _ in range(draw.choice([3, 12, 40]))),) for _ in range(20_000)] + [(None,)]
    df = spark.createDataFrame(rows, "t string").select("t", X.clean_markdown(F.col("t")).alias("new"), old_clean(F.col("t")).alias("old"))
    assert df.filter("NOT (new <=> old)").count() == 0


@pytest.mark.parametrize("pattern", ["[", "![", "](", "[](", "![](", "[a\n](", "[x](y)"])
def test_links_in_linear_time(spark, pattern):
    df = spark.createDataFrame([(pattern * (1_000_000 // len(pattern)),)], "t string")
    start = time.time()
    df.select(F.length(X.clean_markdown(F.col("t")))).collect()
    assert time.time() - start < 10


def test_seconds_round_like_binary_numbers(spark):
    rows = spark.range(0, 14_001).select("id", X.seconds_text(F.col("id")).alias("s")).collect()
    assert [r for r in rows if r["s"] != f"{r['id'] / 1000:.1f}"] == []
