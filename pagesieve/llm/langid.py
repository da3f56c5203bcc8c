"""Language identification with hyperdimensional profiles (numbered operator 5)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagesieve.llm.util import slices

DIMENSIONS, SEED = 2048, 20240
UNKNOWN = "und"
# A text is recognised when its trigrams agree with the language's profile at least so well, as a share of how
# well those of the learned documents do, and by so many standard deviations of chance agreement.
MIN_SHARE, MIN_DEVIATIONS = 0.5, 4.0
MIN_TRIGRAMS = 20  # with fewer distinct ones a text is too short, or repeats too few words, to be rejected by that
IDS = 2048  # letters up to U+03FF have an id of their own, later ones share 1,024
CACHED = 1 << 15


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Space:
    """Random letter vectors, and what is derived from them: the vector of a trigram is the
    product of its letters' vectors, rotated by 0, 1 and 2 places."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).integers(0, 2, (IDS, dimensions), np.int8) * 2 - 1
        self.rotated = [np.roll(letters, k, axis=1) for k in range(3)]
        points = np.arange(sys.maxunicode + 1)
        ids = np.where(points < 1024, points, 1024 + points % 1024).astype(np.uint16)
        alpha = np.fromiter((chr(p).isalpha() for p in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.ids = np.where(alpha, ids, 0).astype(np.uint16)

    def trigrams(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of the letter trigrams; runs of other characters are one gap (id 0)."""
        points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
        ids = np.concatenate(([0], self.ids[points], [0])).astype(np.int64)
        keep = ids != 0
        keep[1:] |= ids[:-1] != 0  # the first gap of a run stays
        keep[0] = True
        ids = ids[keep]
        if len(ids) < 3:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.unique(ids[:-2] << 22 | ids[1:-1] << 11 | ids[2:], return_counts=True)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes >> 22, codes >> 11 & 2047, codes & 2047
        return self.rotated[0][a] * self.rotated[1][b] * self.rotated[2][c]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.rotated[0].shape[1], np.int64)
        for at in range(0, len(codes), 4096):
            part = self.vectors(codes[at:at + 4096]).astype(np.float64)
            total += (counts[at:at + 4096].astype(np.float64) @ part).astype(np.int64)
        return total


_spaces: dict[tuple[int, int], Space] = {}


def space(dimensions: int, seed: int) -> Space:
    """Built once per Python worker."""
    if (dimensions, seed) not in _spaces:
        _spaces[dimensions, seed] = Space(dimensions, seed)
    return _spaces[dimensions, seed]


def train(
    docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED, trigrams: dict[str, int] | None = None,
) -> dict[str, np.ndarray]:
    """Bundle all texts of each non-null lang; the sums of tasks are added in Spark, and one
    vector per language comes back. Documents without letters add nothing. `trigrams` receives
    the number of trigrams of each language."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = space(dimensions, seed)
        totals: dict[str, dict[int, int]] = {}
        sums: dict[str, np.ndarray] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> None:
            counted = totals.pop(lang)
            codes = np.fromiter(counted, np.int64, len(counted))
            sizes[lang] = sizes.get(lang, 0) + sum(counted.values())
            sums[lang] = sums.get(lang, 0) + own.bundle(codes, np.fromiter(counted.values(), np.int64, len(counted)))

        for batch in batches:
            for part in slices(batch):
                by_lang: dict[str, list] = {}
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for lang, text in zip(part.column("lang").to_pylist(), texts):
                    by_lang.setdefault(lang, []).append(own.trigrams(text))
                for lang, found in by_lang.items():
                    codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    counts = np.bincount(where, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                    held = totals.setdefault(lang, {})
                    for code, n in zip(codes.tolist(), counts.tolist()):
                        held[code] = held.get(code, 0) + n
                    if len(held) > CACHED * 8:
                        flush(lang)
        for lang in list(totals):
            flush(lang)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (dimensions + 1)), pa.array(np.arange(-1, dimensions)), pa.array(np.append(sizes[lang], total))],
                ["lang", "at", "value"])

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    summed = known.mapInArrow(bundles, "lang string, at bigint, value bigint").groupBy("lang", "at").agg(
        F.sum("value").alias("value"))
    # Rows by number of languages and dimensions, whatever the number of documents.
    found: dict[str, np.ndarray] = {}
    for row in summed.toLocalIterator():
        if row["at"] < 0:
            if trigrams is not None:
                trigrams[row["lang"]] = row["value"]
            continue
        found.setdefault(row["lang"], np.zeros(dimensions))[row["at"]] = row["value"]
    return {lang: found[lang] for lang in sorted(found) if found[lang].any()}


def _prototypes(profiles: dict[str, np.ndarray]) -> np.ndarray:
    """Unit vectors of the languages, less what all of them share, as unit vectors again."""
    if not profiles:
        return np.zeros((0, DIMENSIONS))
    unit = np.stack([v / np.linalg.norm(v) for v in profiles.values()])
    apart = unit - unit.mean(axis=0) if len(unit) > 1 else unit
    return apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)


def predict(
    docs: DataFrame, profiles: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED,
    keep: dict[str, float] | None = None,
) -> DataFrame:
    """docs(doc_id, text, ...) to doc_id, lang_pred, score; with `keep`, instead the rows of docs
    that have a language and agree with its profile at least as well as `keep` says, unchanged.
    Agreement is the mean product of a trigram's vector with the profile as a unit vector: it depends
    neither on other languages nor, but for chance, on the text's length. By chance it is normal
    around 0, and has to exceed MIN_DEVIATIONS of its standard deviations. Texts of fewer than
    MIN_TRIGRAMS distinct trigrams stay when their cosine with the best prototype is positive.

    A document's vector is the bundle of its trigrams' vectors; the language whose prototype has
    the largest cosine with it wins (ties: the first in order of name). score is that cosine as
    a share of all positive ones, in which the document's own norm cancels out, so products with
    the prototypes are taken per trigram and added up: the same numbers as from the
    bundled vector. Texts that are null or have no letter, and all texts when nothing was
    learned, give `und` and 0.
    """
    langs, prototypes = list(profiles), _prototypes(profiles)
    n_langs = len(langs)
    if keep is not None:
        least = np.array([keep[lang] for lang in langs])
        prototypes = np.concatenate([prototypes, np.stack([v / np.linalg.norm(v) for v in profiles.values()])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = space(dimensions, seed)
        known, dots = np.zeros(0, np.int64), np.zeros((0, len(prototypes)))
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
                found = [own.trigrams(t) for t in texts]
                fresh = np.setdiff1d(np.concatenate([c for c, _ in found]), known)
                if len(known) + len(fresh) > CACHED:
                    known, dots = np.zeros(0, np.int64), np.zeros((0, len(prototypes)))
                    fresh = np.unique(np.concatenate([c for c, _ in found]))
                new = [own.vectors(fresh[i:i + 4096]).astype(np.float32) @ prototypes.T.astype(np.float32)
                       for i in range(0, len(fresh), 4096)]
                if new:
                    codes = np.concatenate((known, fresh))
                    order = np.argsort(codes)
                    known, dots = codes[order], np.concatenate((dots, *new))[order]
                preds, scores, stays = [], [], []
                for codes, counts in found:
                    if not len(codes) or not langs:
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        stays.append(False)
                        continue
                    products = counts @ dots[np.searchsorted(known, codes)]
                    cosines = products[:n_langs]
                    best = int(cosines.argmax())
                    positive = np.maximum(cosines, 0)
                    preds.append(langs[best])
                    scores.append(float(positive[best] / positive.sum()) if positive[best] > 0 else 0.0)
                    if keep is not None:
                        chance = np.sqrt(np.square(counts, dtype=np.float64).sum())
                        agrees = products[n_langs + best] >= max(least[best] * counts.sum(), MIN_DEVIATIONS * chance)
                        stays.append(bool(agrees if len(codes) >= MIN_TRIGRAMS else positive[best] > 0))
                if keep is not None:
                    yield part.filter(pa.array(stays, pa.bool_()))
                    continue
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(preds, pa.string()), pa.array(scores)],
                    ["doc_id", "lang_pred", "score"])

    if keep is not None:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """docs whose text has a recognised language: it agrees with the language's profile at least
    `min_share` as well as the learned documents do on average, and more than by chance, or is too short to tell; profiles are
    learned from docs as in `identify`. When docs has no lang to learn from, all with letters stay."""
    trigrams: dict[str, int] = {}
    profiles = train(docs.filter(~held_out(F.col("doc_id"))), trigrams=trigrams)
    if not profiles:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # The mean agreement of a language's own trigrams is the length of their sum by their number.
    return predict(docs, profiles, keep={lang: min_share * float(np.linalg.norm(v)) / trigrams[lang] for lang, v in profiles.items()})


def identify(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) to doc_id, held_out, lang_pred, score; learns from the documents
    with a lang that are not held out. An empty table gives no rows."""
    profiles = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
