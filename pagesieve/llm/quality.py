"""Quality rules on word statistics and on divergence from language references (numbered operator 7).
Column functions only."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagesieve.functions.common import let
from pagesieve.session import materialize

BLANKS, BLANK_RUN = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
COMMON_WORDS = 30  # words of a reference
END_MARKS = ".,;:!?"
# A histogram is judged only when it counts as many characters or words.
GUARD_CHARS, GUARD_WORDS = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.265, 0.387  # Jensen-Shannon distances (roots of divergences in bits)
WAY = 0.75  # from a language's documents to a text without its common words
CLASSES = ["upper", "digit", "mark", "symbol", "blank", "letter"]


def _repeated_words(ws: Column) -> Column:
    """Words that lie in a 3-word window whose words come together twice or more in the text."""
    after = F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda i, k: F.least(F.coalesce(F.get(at, k + 1) - i, F.lit(3)), F.lit(3)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, of_sorted))

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(F.slice(after, F.lit(1), F.size(ws) - 2), count))


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the base counts, a count of each character class and the words in plain form, lower-cased
    and without marks at their end, so that later steps need not split the text again."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    # Most of a text is lower-case words; the classes are counted in what is left without them.
    with_words = docs.select(
        "doc_id", "lang", text.alias("text"),
        F.when(trimmed == "", F.expr("array()").cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN)).alias("ws"),
        F.regexp_replace(text, r"[\p{Ll}\x20\x09-\x0D]+", "").alias("rest"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = with_words.select(
        "doc_id", "lang", F.transform("ws", lambda w: F.rtrim(F.lower(w), F.lit(END_MARKS))).alias("plain"),
        F.size("ws").cast("bigint").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("rest", "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(F.col("ws")).cast("bigint").alias("n_repeat_words"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.regexp_count("rest", F.lit(r"\p{Lu}")).cast("bigint").alias("upper"),
        F.regexp_count("rest", F.lit(r"[0-9]")).cast("bigint").alias("digit"),
        F.regexp_count("rest", F.lit("[!-\"'-),-/:;=?@\\[-`{}~]")).cast("bigint").alias("mark"),
    )
    return counted.withColumns({"symbol": F.col("n_symbols"), "blank": F.col("n_chars") - F.col("word_chars")}).withColumn(
        "letter", F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("mark") - F.col("symbol"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def _term(p: Column, q: Column) -> Column:
    """A bin's part of the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    return (F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)) / 2


def references(stats: DataFrame) -> tuple[dict[str, list[float]], list[tuple[str, str, float]]]:
    """Per language, the shares of the character classes in the documents that pass the base rules;
    and (lang, word, share of all words) of their most common words. Rows by language only."""
    sound = stats.filter(F.col("lang").isNotNull() & ~base_failed())
    totals = sound.groupBy("lang").agg(*[F.sum(c).alias(c) for c in [*CLASSES, "n_words"]]).collect()
    chars = {r["lang"]: [r[c] / max(1, sum(r[k] for k in CLASSES)) for c in CLASSES] for r in totals if r["n_words"]}
    n_words = {r["lang"]: r["n_words"] for r in totals}
    counts = sound.select("lang", F.explode("plain").alias("word")).filter(F.col("word") != "").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(
        F.col("rank") <= COMMON_WORDS).collect()
    common = [(r["lang"], r["word"], r["n"] / n_words[r["lang"]]) for r in top if r["lang"] in chars]
    return chars, sorted(common)


def _divergence(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon divergence of shares p (an array) from q, bin by bin."""
    return F.aggregate(F.zip_with(p, F.array(*[F.lit(float(x)) for x in q]), _term), F.lit(0.0), lambda a, x: a + x)


def _distance(divergence: Column) -> Column:
    return F.round(F.sqrt(F.greatest(divergence, F.lit(0.0))), 6)


def _with_rest(q: list[float], p: Column) -> Column:
    """The distance of shares p from q, each with one more bin for the rest."""
    rest = F.greatest(1 - F.aggregate(p, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))
    return _distance(_divergence(F.concat(p, F.array(rest)), [*q, max(0.0, 1 - sum(q))]))


def _char_distances(chars: dict[str, list[float]]) -> Column:
    """For each language, in order, the distance of a document's character classes from its."""
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    own = F.array(*[F.greatest(F.col(c) / total, F.lit(0.0)) for c in CLASSES])

    def distances(p: Column) -> Column:
        return F.array(*[_distance(_divergence(p, q)) for _, q in sorted(chars.items())])

    return let(own, distances)


def word_counts(plain: Column, words: list[str]) -> Column:
    """How often each of the sorted `words` stands in plain, as an array. The words themselves are added once and all
    is sorted, so that each has a run, one longer than its count."""
    known = F.array(*[F.lit(w) for w in words])
    last = len(words) - 1

    def starts(s: Column) -> Column:
        first = F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i))
        return let(F.concat(F.array_compact(first), F.array(F.size(s))), lengths)

    def lengths(at: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.get(at, k + 1) - F.get(at, k) - 1)

    return let(F.sort_array(F.concat(F.filter(plain, lambda w: w.isin(words)), known)), starts)


def _word_distances(common: list[tuple[str, str, float]], languages: list[str]) -> Column:
    """For each language the distance of a document's words from its common ones; one more bin holds all other words."""
    words = sorted({w for _, w, _ in common})
    place = {w: i for i, w in enumerate(words)}

    def distances(counts: Column) -> Column:
        out = []
        for lang in languages:
            own = [(place[w], q) for at, w, q in common if at == lang]
            shares = F.transform(F.array(*[F.lit(i) for i, _ in own]), lambda i: F.get(counts, i) / F.col("n_words"))
            out.append(let(shares, partial(_with_rest, [q for _, q in own])))
        return F.array(*out)

    return let(word_counts(F.col("plain"), words), distances)


def without_common_words(q: list[float]) -> float:
    """The distance of a text that has none of a language's common words."""
    rest = max(0.0, 1 - sum(q))
    m = (1 + rest) / 2
    return math.sqrt((sum(q) + math.log2(1 / m) + (rest * math.log2(rest / m) if rest else 0.0)) / 2)


def limits(measured: DataFrame, common: list[tuple[str, str, float]], languages: list[str]) -> dict[str, float]:
    """Per language, the word distance up to which a text counts as near: the fixed limit, or less where a text
    without common words would come near it; then a fixed part of the way from the mean of
    its learned documents to such a text."""
    own = F.coalesce(*[F.when(F.col("lang") == lang, F.get("words", F.lit(i))) for i, lang in enumerate(languages)])
    learned = measured.filter(~F.col("base_failed") & F.col("words").isNotNull()).groupBy("lang").agg(F.avg(own).alias("mean")).collect()
    mean = {r["lang"]: r["mean"] for r in learned if r["mean"] is not None}
    out = {}
    for lang in languages:
        none = without_common_words([q for at, _, q in common if at == lang])
        out[lang] = min(MAX_WORD_DISTANCE, mean.get(lang, 0.0) + WAY * (none - mean.get(lang, 0.0)))
    return out


def judge(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) to doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, char_distance, word_distance (the smallest over all languages).

    References are learned from the documents with a lang; a document is compared with all of
    them, and the nearest counts, so a wrong or null lang does no harm. A document is kept if it does not fail
    the base rules, and where its histograms count enough characters and words, is within the
    limits of some language. Null texts have no words and fail. Rows that share doc_id and text get equal results;
    without any lang, the base rules decide alone. The references are literals, a few numbers per language; the
    words are stored once with the statistics and counted in their row.
    """
    stats = materialize(statistics(docs), "statistics", "zstd")
    chars, common = references(stats)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if not chars or not common:
        empty = F.lit(None).cast("double")
        return stats.select(*columns, base_failed().alias("base_failed"), (~base_failed()).alias("kept"),
                            empty.alias("char_distance"), empty.alias("word_distance"))
    languages = sorted({lang for lang, _, _ in common})
    measured = materialize(stats.select(
        *columns, "lang", base_failed().alias("base_failed"),
        F.when(F.col("n_chars") >= GUARD_CHARS, F.array_min(_char_distances(chars))).alias("char_distance"),
        F.when(F.col("n_words") >= GUARD_WORDS, _word_distances(common, languages)).alias("words")), "measured")
    bounds = F.array(*[F.lit(x) for _, x in sorted(limits(measured, common, languages).items())])
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & F.coalesce(
        F.exists(F.zip_with("words", bounds, lambda d, most: d <= most), lambda x: x), F.lit(True))
    return measured.select(*columns, "base_failed", (~F.col("base_failed") & near).alias("kept"), "char_distance",
                           F.array_min("words").alias("word_distance"))
