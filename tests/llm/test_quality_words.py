"""Which words the references of op7 count, and in which documents."""

import math
import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from pagesieve.llm import quality

COMMON = ["the", "of", "information", "and", "to", "in", "government", "is"]
SCHEMA = "doc_id bigint, text string, lang string"


def clean(seed, n=200):
    draw = random.Random(seed)
    return " ".join(draw.choice(COMMON) if draw.random() < 0.4 else f"plain{draw.randrange(5000)}" for _ in range(n))


def test_case_marks_and_length_of_common_words(spark):
    """Title Case, capitals and marks at a word's end change nothing; long words are common words too."""
    text = clean(1000)
    marked = " ".join(w + ",.;:!?"[i % 6] for i, w in enumerate(text.split()))
    rows = [(i, clean(i), "en") for i in range(30)] + [(100, text, "en"), (101, text.title(), "en"), (102, text.upper(), "en"), (103, marked, "en")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["word_distance"] for r in quality.judge(docs).collect()}
    assert got[100] < quality.MAX_WORD_DISTANCE and got[101] == got[102] == got[103] == got[100]
    _, common = quality.references(quality.statistics(docs))
    assert set(COMMON) <= {w for _, w, _ in common}


@pytest.fixture(scope="module")
def spammed(spark):
    rows = [(i, clean(i), "en") for i in range(40)] + [(100 + i, "buy cheap pills now here " * 40, "en") for i in range(20)]
    return spark.createDataFrame(rows, SCHEMA), [t for i, t, _ in rows if i < 100]


def test_references_count_passing_documents_only(spammed):
    """Numerator and denominator of a share cover the documents that pass the base rules."""
    docs, sound = spammed
    stats = quality.statistics(docs)
    assert stats.filter(quality.base_failed()).count() == 20
    _, common = quality.references(stats)
    counts = Counter(w for t in sound for w in t.split())
    assert "pills" not in {w for _, w, _ in common} and sum(q for _, _, q in common) < 1
    assert all(abs(q - counts[w] / sum(counts.values())) < 1e-12 for _, w, q in common)
    assert quality.judge(docs).filter("doc_id < 100").agg(F.min("kept")).first()[0]


# ---------------------------------------------------------------------------- distances by brute force
CLASS = [r"\p{Lu}", "[0-9]", "[!-\"'-),-/:;=?@\\[-`{}~]", "[#*$%&|<>]", r"[\x20\x09-\x0D]"]


def js(p, q):
    terms = [(a, b, (a + b) / 2) for a, b in zip(p, q)]
    return math.sqrt(max(0.0, sum((a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0) for a, b, m in terms) / 2))


def expected(rows, chars, common, limits):
    """{doc_id: (char_distance, word_distance, near)} of all rows, with the operator's references."""
    out = {}
    for i, text, _ in rows:
        text = text or ""
        ws = regex.findall(r"[^\x20\x09-\x0D]+", text)
        c = w = None
        near = True
        if len(text) >= quality.GUARD_CHARS:
            counts = [len(regex.findall(x, text)) for x in CLASS]
            shares = [n / len(text) for n in counts] + [1 - sum(counts) / len(text)]
            c = min(js(shares, q) for q in chars.values())
            near = c <= quality.MAX_CHAR_DISTANCE
        if len(ws) >= quality.GUARD_WORDS:
            seen = Counter(x.lower().rstrip(quality.END_MARKS) for x in ws)
            by = {}
            for lang in limits:
                own = [(seen[word] / len(ws), q) for at, word, q in common if at == lang]
                p, q = [a for a, _ in own], [b for _, b in own]
                by[lang] = js([*p, max(0, 1 - sum(p))], [*q, max(0, 1 - sum(q))])
            w = min(by.values())
            near &= any(by[x] <= limits[x] for x in by)
        out[i] = c, w, near
    return out


def compare(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    chars, common = quality.references(quality.statistics(docs))
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    languages = sorted({x for x, _, _ in common})
    means = expected(rows, chars, common, dict.fromkeys(languages, 0.0))
    most = {}
    for lang in languages:
        own = [(seen, q) for at, seen, q in common if at == lang]
        ds = []
        for i, text, at in rows:
            ws = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
            if at == lang and not got[i]["base_failed"] and len(ws) >= quality.GUARD_WORDS:
                seen = Counter(x.lower().rstrip(quality.END_MARKS) for x in ws)
                p, q = [seen[w] / len(ws) for w, _ in own], [b for _, b in own]
                ds.append(js([*p, max(0, 1 - sum(p))], [*q, max(0, 1 - sum(q))]))
        q = [b for _, b in own]
        none, mean = js([0.0] * len(q) + [1.0], [*q, max(0, 1 - sum(q))]), sum(ds) / len(ds) if ds else 0.0
        assert abs(none - quality.without_common_words(q)) < 1e-12
        most[lang] = min(quality.MAX_WORD_DISTANCE, mean + quality.WAY * (none - mean))
        assert most[lang] < none
    for i, (c, w, near) in expected(rows, chars, common, most).items():
        row = got[i]
        assert (row["char_distance"] is None) == (c is None) and (c is None or abs(row["char_distance"] - c) < 2e-6)
        assert (row["word_distance"] is None) == (w is None) and (w is None or abs(row["word_distance"] - w) < 2e-6)
        assert row["kept"] == (near and not row["base_failed"]), (i, c, w, most)
    assert len(means) == len({i for i, _, _ in rows})
    return got


def test_all_documents_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = compare(spark, rows)
    assert sum(r["word_distance"] is not None for r in got.values()) > 200 and 0.5 < sum(r["kept"] for r in got.values() if not r["base_failed"]) / len(got)


def test_foreign_words_and_texts_without_common_words(spark):
    """A stray word of another language does not hide the own one; a text of no language is far from all."""
    rows = [(i, clean(i), "en") for i in range(30)]
    rows += [(100 + i, clean(100 + i).replace("the", "der").replace("of", "und").replace("and", "das").replace("is", "ist"), "de") for i in range(30)]
    rows += [(200, clean(7) + " und", None), (201, " ".join(f"nothing{i % 150}" for i in range(300)), None), (202, " ".join(f"nothing{i % 150}" for i in range(300)) + " der", None)]
    got = compare(spark, rows)
    assert got[200]["kept"] and not got[201]["kept"] and not got[202]["kept"]
    assert abs(got[200]["word_distance"] - got[7]["word_distance"]) < 0.01
