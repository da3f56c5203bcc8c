"""Operators that SQL cannot express, against brute force; exactness of searches; accuracy of models."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, connect
from pagesieve.llm import langid, licenses, simhash, suffixes
from pagesieve.llm.components import connected_components
from pagesieve.llm.decontaminate import contaminated
from pagesieve.llm.queries import ORACLES, QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, SMALL) is None


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# ---------------------------------------------------------------------------- op2
def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_license_base_counts(spark):
    texts = texts_of(spark, MIDDLE)
    phrases = [(p.split(), label) for p, label in licenses.PHRASES.items()]
    for r in QUERIES["op2_license_scan"](spark, MIDDLE).collect():
        ws = brute_words(texts[r["doc_id"]])
        places = [(i, label) for p, label in phrases for i in range(len(ws)) if ws[i:i + len(p)] == p]
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(ws), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


def fuzzy_words(text, errors):
    return regex.compile(rb"(?:^|(?<= ))(?=[^ ])(?:" + regex.escape(text.encode()) + rb"){e<=%d}(?<=[^ ])(?= |$)" % errors)


def plain_errors(text, line):
    """The fewest errors with which a notice stands between word borders, by edit distance from every place."""
    codes = np.frombuffer(line, np.uint8)
    blank = np.concatenate(([True], codes == 32, [True]))
    place = np.arange(len(line) + 1, dtype=np.int32)
    row = np.where(blank[:-1] & ~blank[1:], 0, 10_000).astype(np.int32)
    for char in text.encode():
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (codes != char))
        row = np.minimum.accumulate(new - place) + place
    return row[~blank[:-1] & blank[1:]].min(initial=10_000)


def test_notices_in_given_documents(spark):
    texts = texts_of(spark, SMALL)
    for r in QUERIES["op2_license_scan"](spark, SMALL).collect():
        line = " ".join(brute_words(texts[r["doc_id"]])).encode()
        hits = {label for text, label, errors in licenses.NOTICES if plain_errors(text, line) <= errors}
        assert set(r["labels"].split(",")) - {""} == hits | set(r["base_labels"].split(",")) - {""}, r["doc_id"]


def test_notices_stand_as_whole_words_and_come_as_a_parameter(spark):
    scan = licenses.scan
    assert scan(b"some small rights reserved here")[5] == "" and scan(b"the all rights reserved2 here")[5] == "reserved"
    docs = spark.createDataFrame([(1, "Do not copy this, ever. Do not coppy this!"), (2, "all rights reserved")], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in licenses.scan_licenses(docs, [("do not copy this", "own", 2)]).collect()}
    assert [(s["label"], s["first_word"], s["last_word"], s["errors"]) for s in out[1]["spans"]] == [("own", 0, 3, 0), ("own", 5, 8, 1)]
    assert out[2]["labels"] == "" and out[2]["score"] == 0


@pytest.mark.parametrize("fragment", [
    "all rights reserved. ", "redistribution and use in ", "permission is hereby granted free of charge to any person obtaining a coppy ",
    "redistribution nd use inn sourc and binary forms wth or wthout modificatin ", "license ", "a ", "all rights", "mit licens"])
def test_license_scan_is_linear(fragment):
    text = (fragment * (1 + 1_000_000 // len(fragment))).encode()
    began = time.monotonic()
    licenses.scan(text)
    assert time.monotonic() - began < 5


def test_seeds_lose_no_fuzzy_match():
    """Every text in which the bounded-error pattern matches whole words has a seed, and so a hit."""
    draw = random.Random(1)
    for text, label, errors in licenses.NOTICES:
        notice = licenses.Notice(text, label, errors)
        for wrong in range(errors + 3):
            chars = list(text)
            for _ in range(wrong):
                at = draw.randrange(len(chars))
                chars[at:at + 1] = draw.choice([[], [draw.choice("qzj")], [chars[at], "x"]])
            line = b"some words before " + "".join(chars).encode() + b" and after"
            plain = fuzzy_words(text, errors).search(line)
            hits = notice.search(licenses.Line(line))
            assert bool(hits) == bool(plain), (text, line)
            assert all(h.errors <= errors for h in hits)
    found = licenses.scan("Relased under the MTI-License; all rigths reserved".encode())
    assert found[1] == 0 and found[5] == "mit" and 0.8 < found[6] < 1 and found[7][0]["first_word"] == 0
    overlapping = licenses.scan(b"MIT  license, (mit) License. general-public\nlicense xmit license")
    assert overlapping[1:5] == (3, 0, 4, "gpl,mit")


# ---------------------------------------------------------------------------- op3, op5
def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op3_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right = {r["toxic"]: r["share"] for r in scored.groupBy("toxic").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double")).alias("share")).collect()}
    assert right[0] > 0.99 and right[1] > 0.85


def test_language_on_held_out_documents(spark):
    out = QUERIES["op5_language_id"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_scores_are_those_of_bundled_vectors(spark):
    """The products added up per trigram give the cosines of the document's own vector."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    profiles = langid.train(docs)
    own, prototypes, langs = langid.space(langid.DIMENSIONS, langid.SEED), langid._prototypes(profiles), list(profiles)
    got = {r["doc_id"]: r for r in langid.predict(docs, profiles).collect()}
    for doc_id, text in list(texts_of(spark, SMALL).items())[:40]:
        cosines = prototypes @ own.bundle(*own.trigrams(text.encode()))
        positive = np.maximum(cosines, 0)
        assert got[doc_id]["lang_pred"] == langs[int(cosines.argmax())]
        assert abs(got[doc_id]["score"] - positive.max() / positive.sum()) < 1e-4
    a, b = own.trigrams("Ab, c!".encode()), own.trigrams(b"ab c")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


# ---------------------------------------------------------------------------- op4
def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s:s + length]
            if window in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeats_cases():
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, rows = prose(22), []
    for i in range(40):
        rows.append((i, f"{prose(draw.randint(0, 40))} {line[draw.randint(0, 30):len(line) - draw.randint(0, 30)]} {prose(draw.randint(0, 40))}"))
    base = prose(120)
    for i in range(40, 70):  # near copies: one letter differs
        at = draw.randrange(len(base))
        rows.append((i, base[:at] + "X" + base[at + 1:]))
    rows += [(70, "a" * 500), (71, "ab" * 130 + "a" * 260), (72, base), (73, line), (74, line[:99]), (75, ""), (76, base + base)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [50_000, 2])
def test_repeats_by_brute_force(spark, hot):
    rows = repeats_cases()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.remove_repeats(docs, hot).collect()}
    assert got == brute_repeats(rows)


def test_repeats_in_given_documents(spark):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in QUERIES["op4_suffix_dedup"](spark, SMALL).collect()}
    assert got == brute_repeats(texts_of(spark, SMALL).items())


@pytest.mark.parametrize("hot", [50_000, 2])
def test_texts_that_share_a_doc_id(spark, hot):
    """Each text of a doc_id is a document of its own, after those with a smaller hash; equal rows are one."""
    draw = random.Random(8)
    prose = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    first, own, both = prose(300), prose(400), prose(210)
    rows = [(0, first), (1, first[50:260]), (1, own), (2, both + own[:120]), (2, "x" + both), (2, "x" + both), (None, first), (3, None), (3, "")]
    rows += [(9, f"{prose(30)}{both}{i}") for i in range(12)]  # one id with more than a third of the rows
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    order = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("*", F.xxhash64("text").alias("h")).collect()}
    numbered = sorted({(d, order[d, t], t) for d, t in rows if d is not None and t}, key=lambda r: r[:2])
    expected = brute_repeats((n, t) for n, (_, _, t) in enumerate(numbered))
    expected = {(d, hashlib.sha256(t.encode()).hexdigest()): expected[n] for n, (d, _, t) in enumerate(numbered)}
    assert {r["n_removed"] for r in suffixes.remove_repeats(docs.filter("doc_id = 1"), hot).collect()} == {0}
    got = suffixes.remove_repeats(docs, hot).collect()
    assert len(got) == len(rows)
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    as_rows = sorted((r["doc_id"], *[r[c] for c in columns]) for r in got if r["doc_id"] is not None and r["n_bytes"])
    assert as_rows == sorted((d, *expected[d, hashlib.sha256(t.encode()).hexdigest()]) for d, t in rows if d is not None and t)
    assert {r["n_removed"] for r in got if r["doc_id"] is None or not r["n_bytes"]} == {0}


def test_buckets_are_as_many_as_suffixes_need(spark, monkeypatch):
    """A bucket stays near its size however few partitions the session has, also for texts of one letter."""
    monkeypatch.setattr(suffixes, "BUCKET_ANCHORS", 400)
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for docs in (given, given.limit(30).select("doc_id", F.lit("a" * 700).alias("text"))):
        versioned, rows, size = suffixes._with_versions(docs)
        bounds = suffixes._splitters(versioned, rows, size, 2)
        held = suffixes._partition(versioned, bounds).groupBy("bucket").agg(F.sum(F.length("places") / 4).alias("n")).collect()
        assert sum(r["n"] for r in held) / (len(bounds) + 1) <= 400 and max(r["n"] for r in held) <= 1200


def test_multikey_sort():
    draw = np.random.default_rng(3)
    columns = [draw.integers(0, k, 500) for k in (3, 4, 2, 1000)]
    assert (suffixes.multikey_sort(columns) == np.lexsort(columns[::-1])).all()


# ---------------------------------------------------------------------------- op7
def test_quality_base_counts(spark):
    texts = texts_of(spark, MIDDLE)
    for r in QUERIES["op7_quality_divergence"](spark, MIDDLE).collect():
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(w, w[1:], w[2:]))
        repeated = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_verdicts_follow_labels(spark):
    out = QUERIES["op7_quality_divergence"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").filter("NOT base_failed")
    share = {r["quality"]: r["kept"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1


# ---------------------------------------------------------------------------- op9
def brute_classes(fps, radius):
    label = np.arange(len(fps))
    while True:
        new = np.array([label[np.bitwise_count(fps ^ f) <= radius].min() for f in fps])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("tile", [4096, 5])
def test_links_by_brute_force(spark, tile):
    draw = np.random.default_rng(4)
    seeds = draw.integers(0, 1 << 63, 20, np.uint64)
    fps = [*seeds, *(s ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for s in seeds for a, b in draw.integers(0, 64, (12, 2)))]
    fps = np.unique(np.array(fps, np.uint64))
    frame = spark.createDataFrame([(int(f.view(np.int64)),) for f in fps], "fp bigint")
    links = simhash.fingerprint_links(frame, tile=tile)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    own = [roots.get(int(f.view(np.int64)), int(f.view(np.int64))) for f in fps]
    label = brute_classes(fps, simhash.RADIUS)
    assert len(set(zip(own, label.tolist()))) == len(set(own)) == len(set(label.tolist()))


def test_fingerprints_and_classes_of_given_documents(spark):
    import xxhash

    texts = texts_of(spark, SMALL)
    ids = sorted(texts)
    prints = []
    for i in ids:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[i]))
        shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = brute_classes(np.array(prints, np.uint64), 2)
    expected = {i: (format(p, "016x"), ids[c]) for i, p, c in zip(ids, prints, label)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash_near_dedup"](spark, SMALL).collect()}
    assert got == expected


def test_components_of_random_graphs(spark):
    draw = random.Random(5)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 500 + i) for i in range(50)]
    label = {n: n for p in pairs for n in p}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in pairs:
        label[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(pairs + pairs[:5], "u bigint, v bigint")).collect()}
    assert got == {n: root(n) for p in pairs if p[0] != p[1] for n in p}


# ---------------------------------------------------------------------------- pipeline
def test_pipeline_on_planted_documents(spark, tmp_path):
    """Each stage's decisions reach the result: what has to go is gone, clean documents stay."""
    item = "the quick brown fox jumps over the lazy dog near the old river bank on sunday morning"
    words = lambda seed, n: " ".join(random.Random(seed).choice(["plain", "clean", "words", "stand", "here", "and", "there", "often", "again", "today"]) + str(random.Random(seed * 1000 + k).randrange(400)) for k in range(n))
    shared = "This long line of text stands in very many documents of the table."
    rows = [(i, words(i, 200) + (f"\n{shared}" if i < 6 else ""), "en", f"s{i % 2}") for i in range(30)]
    rows += [(100, rows[10][1], "en", "s0"), (101, words(77, 120) + " " + item + " " + words(78, 120), "en", "s1"), (102, "1234 5678", "en", "s0"), (103, None, "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("bigint"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    sf, kept = str(tmp_path), docs
    for name, _ in corpus_pipeline.STAGES[:-1]:
        kept = stage[name](spark, kept, sf)
    assert {r["doc_id"] for r in kept.collect()} == set(range(30))
    assert {r["doc_id"] for r in kept.filter(F.contains("text", F.lit(shared))).collect()} == {5}
    out = corpus_pipeline.run(spark, sf)
    assert {"n_copies", "slots"} < set(out.columns) and {r["doc_id"] for r in out.collect()} <= set(range(30)) and out.count() > 20
    assert contaminated(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
