"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios
(numbered operator 3)."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagesieve.llm.util import slices
from pagesieve.session import materialize

ORDERS = (3, 4, 5, 6)
BITS = 20  # n-grams are hashed to so many bits
# Bounds of the fit: labelled documents per class for the ratios, of them for the weights, features kept.
MAX_COUNTED, MAX_FITTED, MAX_FEATURES = 40_000, 10_000, 8_000
MIN_DOCS, SMOOTHING, PENALTY, ITERATIONS = 4, 1.0, 1e-5, 400


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


_letters = np.zeros(0, np.uint32)


def _letter_table() -> np.ndarray:
    """Code point to itself for letters, to a blank else; built once per Python worker."""
    global _letters
    if not len(_letters):
        n = sys.maxunicode + 1
        alpha = np.fromiter((chr(p).isalpha() for p in range(n)), bool, n)
        _letters = np.where(alpha, np.arange(n), 32).astype(np.uint32)
    return _letters


def features(text: bytes) -> list[np.ndarray]:
    """Hashed n-grams of each order at each place of the lower-cased text, in which runs of
    characters that are no letters are one blank, and there is a blank at both ends."""
    points = np.frombuffer((" " + text.decode("utf-8", "replace").lower() + " ").encode("utf-32-le"), np.uint32)
    chars = _letter_table()[points]
    keep = chars != 32
    keep[1:] |= chars[:-1] != 32
    keep[0] = True
    chars = chars[keep]
    out, running = [], chars * np.uint32(1)
    for order in range(2, max(ORDERS) + 1):
        if len(running) < 2:
            break
        running = running[:-1] * np.uint32(0x01000193) ^ chars[order - 1:]
        if order in ORDERS:
            mixed = (running ^ running >> np.uint32(15)) * np.uint32(0x85EBCA6B) + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)
            out.append((mixed ^ mixed >> np.uint32(13)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS))
    return out


def _present(text: bytes) -> np.ndarray:
    found = features(text)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Score = logistic(bias + the sum of the weights of the n-grams present)."""

    bias: float
    weights: np.ndarray  # by hash, 0 for n-grams that were not kept


def _sample(labels: DataFrame, bound: int) -> DataFrame:
    """At most `bound` rows of each class, those with the smallest hashes of doc_id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        "doc_id", "toxic", F.xxhash64("doc_id").alias("order"))
    return _first(known, bound)


def _first(rows: DataFrame, bound: int) -> DataFrame:
    parts = [rows.filter(F.col("toxic") == c).orderBy("order", "doc_id").limit(bound) for c in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "toxic", "order")


def _document_counts(rows: DataFrame) -> DataFrame:
    """feature, toxic, clean: documents of the sample in which the n-gram is present."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for part in slices(batch):
                for text, toxic in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("toxic").to_pylist()):
                    totals[toxic, _present(text or b"")] += 1
        at = np.nonzero(totals.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[1, at]), pa.array(totals[0, at])], ["feature", "toxic", "clean"])

    counts = rows.select("text", "toxic").mapInArrow(count, "feature bigint, toxic bigint, clean bigint")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _fit_weights(rows: list[tuple[int, bytes]], ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression over x = ratio where the feature is present, else 0, with
    classes of equal weight, by accelerated gradient steps."""
    y = np.array([t for t, _ in rows], np.float64)
    lists = [np.frombuffer(b, np.uint16).astype(np.int64) for _, b in rows]
    of_row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    cols = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    values = ratios[cols]
    norms = np.bincount(of_row, values * values, len(lists)) + 1
    step = 4 / (np.mean(norms) + 1e-9)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(len(ratios)), 0.0
    vw, vb = np.zeros_like(w), 0.0
    for t in range(ITERATIONS):
        momentum = t / (t + 3)
        aw, ab = w + momentum * vw, b + momentum * vb
        margin = np.bincount(of_row, values * aw[cols], len(lists)) + ab
        error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        error *= share
        gw = np.bincount(cols, values * error[of_row], len(w)) + PENALTY * aw
        gb = error.sum()
        nw, nb = aw - step * gw, ab - step * gb
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled documents that are not held out: at most MAX_COUNTED per class.

    The ratio of an n-gram is the log of its smoothed share among toxic documents over that among
    clean ones. The MAX_FEATURES n-grams whose document counts differ most between the classes, in
    standard deviations, are kept, and weights for them are fitted on at most MAX_FITTED
    documents per class. With one class only, or no labels, all texts score that share.
    """
    sample = materialize(_sample(labels, MAX_COUNTED), "sample")
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    weights = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        return Model(float(np.log((n1 + 1) / (n0 + 1))), weights)
    share = (F.col("toxic") + F.col("clean")) / F.lit(n1 + n0)
    differ = F.abs(F.col("toxic") - share * n1) / F.sqrt(share * (1 - share) * n1 * n0 / (n1 + n0) + 0.5)
    kept = (
        _document_counts(rows).filter(F.col("toxic") + F.col("clean") >= MIN_DOCS)
        .orderBy(differ.desc(), "feature").limit(MAX_FEATURES).collect()
    )
    kept.sort(key=lambda r: r["feature"])
    chosen = np.array([r["feature"] for r in kept], np.int64)
    toxic, clean = (np.array([r[c] for r in kept], np.float64) for c in ("toxic", "clean"))
    ratios = np.log((toxic + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n0 + 2 * SMOOTHING))
    number = np.full(1 << BITS, 65535, np.uint16)
    number[chosen] = np.arange(len(chosen))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
                found = [number[_present(t)] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic").cast(pa.int32()), pa.array([f[f != 65535].tobytes() for f in found], pa.binary())], ["toxic", "kept"])

    fitted = rows.join(F.broadcast(_first(sample, MAX_FITTED).select("doc_id").distinct()), "doc_id", "left_semi").select(
        "text", "toxic").mapInArrow(encode, "toxic int, kept binary")
    w, bias = _fit_weights([(r["toxic"], r["kept"]) for r in fitted.toLocalIterator()], ratios)
    weights[chosen] = w * ratios
    return Model(bias, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, score, predicted. Null and empty texts score by the
    bias alone; equal texts score alike."""
    bias, weights = model.bias, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                margins = []
                for text in part.column("text").cast(pa.binary()).fill_null(b"").to_pylist():
                    total = bias
                    found = [f[weights[f] != 0] for f in features(text)]
                    if found:
                        total += float(weights[np.unique(np.concatenate(found))].sum(dtype=np.float64))
                    margins.append(total)
                scores = 1 / (1 + np.exp(-np.clip(np.array(margins, np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(scores)], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
