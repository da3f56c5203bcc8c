"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every
numbered operator and every pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagesieve.llm import toxicity
from pagesieve.llm.decontaminate import contaminated, drop_contaminated
from pagesieve.llm.langid import identify
from pagesieve.llm.licenses import scan_licenses
from pagesieve.llm.lines import drop_shared_lines
from pagesieve.llm.mixing import _running, mix_documents, plan_mixture
from pagesieve.llm.preferences import format_preferences, preference_pairs
from pagesieve.llm.quality import judge
from pagesieve.llm.simhash import drop_near_duplicates, near_duplicates
from pagesieve.llm.suffixes import remove_repeats

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 997} stands{i % 13} here." for i in range(60_000))
SHARED = "This line is shared by many documents and is long enough to count."
ROWS = [
    (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t\n ", "en", "a", 5), (3, "x", "en", "a", 1),
    (4, LONG, "en", "a", len(LONG)), (5, LONG, None, "b", len(LONG)), (6, "ÄÖ ÜÉ ß 日本語 \U0001F600", "de", "b", 12),
    (7, "1234 !! $$$", "xx", "b", 11), (None, "a text without a name, but with words", "en", "a", 37),
    (8, "twice the same row", "en", "c", 18), (8, "twice the same row", "en", "c", 18),
    *[(20 + i, f"{SHARED}\nown line {i}", "en", "c", 80) for i in range(6)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    """More columns, named like those that operators use inside."""
    for c in ("n_lines", "n_dropped", "fp", "h1", "key", "hash", "version", "component_id", "fingerprint", "block", "n_copies", "score",
              "_bucket", "dropped", "drop_id", "hit_id", "gone_id", "planned_id", "item_id", "stretches", "word", "toxic"):
        docs = docs.withColumn(c, F.lit("own"))
    return docs


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(0, None), (1, ""), (2, "two words"), (3, SHARED), (3, SHARED), (None, "word1 stands1 here word2 stands2 here")],
        "item_id bigint, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 1), (8, 0, 0), (None, 0, 1), (20, 1, None), (21, 0, 0), (22, 1, 1), (22, 1, 1)],
                                 "doc_id bigint, quality int, toxic int")


def toxicity_query(docs, labels):
    return toxicity.score(docs, toxicity.train(docs, labels))


OPERATORS = {
    "op2": lambda d, b, lab: scan_licenses(d),
    "op3": lambda d, b, lab: toxicity_query(d, lab),
    "op4": lambda d, b, lab: remove_repeats(d).drop("kept"),
    "op5": lambda d, b, lab: identify(d),
    "op6": lambda d, b, lab: drop_shared_lines(d).select("doc_id", "text", "n_lines", "n_dropped"),
    "op7": lambda d, b, lab: judge(d),
    "op8": lambda d, b, lab: contaminated(d, b),
    "op9": lambda d, b, lab: near_duplicates(d),
    "op10": lambda d, b, lab: plan_mixture(d),
}
ROW_PER_DOCUMENT = ["op2", "op3", "op4", "op5", "op6", "op7", "op9"]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(docs, clashing, benchmark, labels, name):
    plain = rows(OPERATORS[name](docs, benchmark, labels))
    assert plain == rows(OPERATORS[name](clashing, benchmark, labels))
    if name in ROW_PER_DOCUMENT:
        assert len(plain) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, benchmark, labels, name):
    nothing = docs.limit(0)
    assert rows(OPERATORS[name](nothing, benchmark.limit(0), labels.limit(0))) == []
    if name in ROW_PER_DOCUMENT:
        assert len(rows(OPERATORS[name](docs, benchmark.limit(0), labels.limit(0)))) == len(ROWS)


def test_defined_results(docs, benchmark, labels):
    """What the docstrings promise for odd rows."""
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    two = by(scan_licenses(docs))
    assert (two[0]["n_words"], two[0]["first_word"], two[0]["labels"], two[0]["score"]) == (0, None, "", 0.0)
    four = by(remove_repeats(docs))
    assert four[0]["n_bytes"] == four[0]["n_removed"] == 0 and four[None]["n_removed"] == 0 and four[8]["n_removed"] == 0
    assert four[5]["n_removed"] == len(LONG.encode()) and four[5]["n_spans"] == 1 and four[5]["kept"] == b""
    five = by(identify(docs))
    assert {k: five[k]["lang_pred"] for k in (0, 1, 2, 7)} == {0: "und", 1: "und", 2: "und", 7: "und"}
    six = by(drop_shared_lines(docs))
    assert (six[0]["text"], six[0]["n_lines"], six[0]["n_dropped"]) == (None, 1, 0)
    assert six[25]["n_dropped"] == 0 and six[24]["text"] == "own line 4" and six[24]["n_dropped"] == 1
    seven = by(judge(docs))
    assert seven[0]["n_words"] == 0 and seven[0]["base_failed"] and not seven[0]["kept"]
    nine = by(near_duplicates(docs))
    assert nine[0]["fingerprint"] == "0" * 16 and nine[2]["component_id"] == 0 and nine[5]["component_id"] == 4
    eight = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, benchmark).collect()}
    assert {(i, 3) for i in range(20, 26)} <= eight and (4, None) in eight and not {i for _, i in eight} & {0, 1, 2}


def test_filters_keep_rows_and_columns(docs, clashing, benchmark):
    kept = drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} >= {None, 0, 4, 6, 8}
    clean = drop_contaminated(clashing, benchmark)
    assert clean.columns == clashing.columns
    assert {r["doc_id"] for r in clean.collect()} == {None, 0, 1, 2, 3, 6, 7, 8}
    assert mix_documents(docs, max_repeats=50.0).filter(F.col("doc_id").isNull()).count() in (0, 1)


def test_rows_without_id_have_slots_of_their_own(spark):
    """300 rows without an id, others that share one, and copies of a row: each row has its own plan."""
    rows = [(None, f"text {i} of a row without a name", "a") for i in range(300)] + [(7, f"other text {i}", "a") for i in range(50)]
    rows += [(8, "a copied row", "b")] * 40 + [(None, "a copied row without a name", "b")] * 40 + [(9, "one more", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = plan_mixture(docs, block_tokens=100)
    out = mix_documents(docs, block_tokens=100).collect()
    assert sum(r["n_copies"] for r in out) == plan.count() and all(r["n_copies"] == len(r["slots"]) for r in out)
    assert max(r["n_copies"] for r in out if r["source"] == "a") == 1
    assert len({(r["n_copies"], str(r["slots"])) for r in out if r["doc_id"] == 8}) == 1
    read = sum(r["n_copies"] * len(r["text"].split()) for r in out)
    assert 0.8 * sum(len(t.split()) for _, t, _ in rows) < read <= sum(len(t.split()) for _, t, _ in rows)


def test_running_sums_do_not_depend_on_slabs(spark, monkeypatch):
    """Sums of slabs and within slabs equal those in one run over a source's blocks."""
    monkeypatch.setattr("pagesieve.llm.mixing.SLAB_BLOCKS", 3)
    made = [(s, e, b, (b * 7919 * (e + 1) + 13) % 97 * (1 << 53), 1 + b % 5, 100, 40) for s in "ab" for e in (0, 1) for b in range(40)]
    epochs = spark.createDataFrame(made, "source string, epoch int, block bigint, order bigint, block_tokens bigint, tokens bigint, blocks bigint")
    want = {}
    for s, e in {(m[0], m[1]) for m in made}:
        used = 100 * e
        for m in sorted((m for m in made if m[:2] == (s, e)), key=lambda m: (m[3], m[2])):
            want[m[:3]], used = used, used + m[4]
    assert {(r["source"], r["epoch"], r["block"]): r["before"] for r in _running(epochs).collect()} == want


def test_short_items_count_as_whole_lines_only(spark):
    docs = spark.createDataFrame([(1, "he said yes to it"), (2, "a question\n- Yes!\nmore"), (3, "is it so or not, yes"), (4, "Is it so?\nyes no")],
                                 "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "yes"), (2, "is it so"), (3, "he said yes to it")], "item_id bigint, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()) == [(1, 3), (2, 1), (4, 2)]


def test_near_duplicates_go_by_text(spark):
    """Of rows that share a doc_id, each goes with its own text; repeated rows of what stays stay."""
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text.upper()), (3, text), (3, "quite another text stands here"), (None, text), (4, None), (5, " "), (6, "")]
    out = drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, out), key=str) == sorted([(1, text), (1, text), (3, "quite another text stands here"), (None, text), (4, None)], key=str)


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, clashing, benchmark, tmp_path, stage):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    fn = dict(corpus_pipeline.STAGES)[stage]
    out = fn(spark, docs, str(tmp_path))
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns and out.count() > 0
        assert fn(spark, clashing, str(tmp_path)).columns == clashing.columns
    assert fn(spark, docs.limit(0), str(tmp_path)).count() == 0


TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_preferences_of_odd_conversations(spark):
    rows = [
        (None, 0, "user", "lost"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"),
        (2, 2, "user", "why"), (3, 0, None, None), (3, 1, "assistant", None), (4, 0, "user", "alone"), (5, None, "assistant", "x"),
        (6, 0, "user", "hi"), (6, 0, "user", "hi"),
    ]
    turns = spark.createDataFrame(rows, TURNS).withColumn("h1", F.lit(1)).withColumn("chosen", F.lit(2))
    out = {(r["conv_id"], r["kind"]): r for r in format_preferences(preference_pairs(turns)).collect()}
    assert set(out) == {(1, "sibling"), (6, "sibling"), (2, "stale"), (3, "stale"), (5, "stale")}
    one = out[1, "sibling"]
    assert one["chosen_id"] == 2 and one["n_shared"] == 1 and one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert [(s["text"], s["train"]) for s in one["rejected_segments"]] == [("<|im_start|>assistant\n", False), ("yes<|im_end|>\n", True)]
    assert [s["train"] for s in one["chosen_segments"]] == [False, True, False, False]
    assert out[3, "stale"]["n_shared"] == 2 and out[3, "stale"]["rejected_segments"] == []  # null texts are empty, so alike
    assert preference_pairs(turns.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, [("user", "a")])], "id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    assert [s["text"] for s in format_preferences(odd).first()["rejected_segments"]] == ["<|im_start|>user\n", "a<|im_end|>\n"]
