"""Embedding whitening from an exact covariance by bit-sliced cross-products (numbered operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagesieve.session import materialize

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
# Rows whose bit planes a task holds at once, in words of 64 rows.
WORDS = 64
LIMB = 60  # cross-products leave a task as low bits and the rest, so that sums of either fit a decimal
DECIMALS = 10 ** 38
# An eigenvalue of at most this share of the largest one cannot be told from zero in doubles.
ZERO = 2.0 ** -40
_OUT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column to (x of all entries, first entry of each row, entries of each row, -1 for a row that is
    left out: null, empty, or with an entry that is null, not finite or whose x is no long)."""
    column = column.cast(pa.list_(pa.float64()))
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(sizes)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(values * SCALE)
        bad = ~(np.abs(scaled) < 2.0 ** 63 - 2.0 ** 20)
    x = np.where(bad, 0, scaled).astype(np.int64) + OFFSET
    upto = np.concatenate(([0], np.cumsum(bad)))
    usable = (sizes > 0) & (upto[ends] == upto[ends - sizes])
    return x, ends - sizes, np.where(usable, sizes, -1)


def _matrix(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and x of the rows with `dims` entries."""
    x, starts, sizes = integers(batch.column("vector"))
    rows = np.nonzero(sizes == dims)[0]
    return rows, x[starts[rows][:, None] + np.arange(dims)]


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, dim, n, low, high) of a task's rows, for each length of vector."""
    seen: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        x, starts, sizes = integers(batch.column("vector"))
        for dims in np.unique(sizes[sizes > 0]).tolist():
            at = starts[sizes == dims]
            part = x[at[:, None] + np.arange(dims)]
            n, low, high = seen.get(dims, (0, part[0], part[0]))
            seen[dims] = n + len(part), np.minimum(low, part.min(0)), np.maximum(high, part.max(0))
    for dims, (n, low, high) in seen.items():
        columns = [np.full(dims, dims), np.arange(dims), np.full(dims, n), low, high]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
            ["dims", "dim", "n", "low", "high"])


def bit_planes(y: np.ndarray, planes: int) -> np.ndarray:
    """y (rows x dims, not negative) to words (dims, planes, rows / 64): bit r of a word is one plane's bit in row r."""
    rows = -(-len(y) // 64) * 64
    bits = np.zeros((y.shape[1], planes, rows), np.uint8)
    for p in range(planes):
        bits[:, p, :len(y)] = (y.T >> np.uint64(p)) & np.uint64(1)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)


def cross_products(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of y_a * y_b (upper triangle) and of y_a: each pair of planes is cut with AND, its
    bits are counted and weighed with the planes' powers of two."""
    dims, planes, _ = words.shape
    kind = np.int64 if 2 * planes + 12 < 63 else object  # a chunk has at most 2^12 rows
    weights = np.array([1 << p for p in range(planes)], kind)
    cross, sums = np.zeros((dims, dims), object), np.bitwise_count(words).sum(axis=2, dtype=np.int64).astype(kind) @ weights
    for a in range(dims):
        for p in range(planes):
            counts = np.bitwise_count(words[a, p] & words[a:]).sum(axis=2, dtype=np.int64)
            cross[a, a:] += (counts.astype(kind) @ weights * weights[p]).astype(object)
    return cross, sums.astype(object)


def _scatter(low: np.ndarray, planes: int):
    """A task's cross-products as rows (a, b, high, low); b is -1 for the plain sums."""
    dims = len(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, sums = np.zeros((dims, dims), object), np.zeros(dims, object)
        for batch in batches:
            _, x = _matrix(batch, dims)
            y = x.astype(np.uint64) - low.astype(np.uint64)  # modulo 2^64, so right for any span
            for at in range(0, len(y), 64 * WORDS):
                c, s = cross_products(bit_planes(y[at:at + 64 * WORDS], planes))
                cross += c
                sums += s
        a, b = np.triu_indices(dims)
        a, b = np.concatenate((a, np.arange(dims))), np.concatenate((b, np.full(dims, -1)))
        values = np.concatenate((cross[np.triu_indices(dims)], sums)).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int32()), pa.array(b, pa.int32()),
             pa.array([v >> LIMB for v in values], pa.decimal128(38, 0)), pa.array([v & ((1 << LIMB) - 1) for v in values], pa.decimal128(20, 0))],
            ["a", "b", "high", "low"])

    return run


@dataclass(frozen=True)
class Whitening:
    """What is learned: n vectors with sums S, up to `components` unit eigenvectors (as rows) with their
    eigenvalues, largest first. Its size depends on the number of dimensions only."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def decompose(n: int, cross: np.ndarray, sums: list[int], low: list[int], high: list[int], components: int = COMPONENTS) -> Whitening:
    """`cross` and `sums` are of y = x - low, as integers. n * cross - sums * sums is n^2 times the
    covariance, exactly; it is rounded once, when it is divided."""
    dims, own = len(sums), np.array(sums, object)
    scatter = n * (np.triu(cross) + np.triu(cross, 1).T) - own[:, None] * own[None, :]
    trace = sum(scatter[d, d] for d in range(dims))
    cov = np.array([[v / (n * n) for v in row] for row in scatter.tolist()], np.float64)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors.T[order]
    flip = np.sign(vectors[np.arange(len(order)), np.abs(vectors).argmax(axis=1)])
    vectors = vectors * flip[:, None]
    solid = values > max(0.0, ZERO * values[0])
    error = None
    if solid.any():
        unit = (vectors[solid] / np.sqrt(values[solid])[:, None]).astype(np.longdouble)
        error = float(np.abs(unit @ cov.astype(np.longdouble) @ unit.T - np.eye(len(unit))).max())
    explained = [float(max(v, 0.0)) / (trace / (n * n)) if trace else None for v in values]
    total = [s + n * b for s, b in zip(sums, low)]
    return Whitening(n, total, low, high, vectors, np.where(solid, values, np.nan), explained, error)


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Learn from all usable vectors; None if there are none. Three narrow tables: bounds of each dimension, then
    cross-products as one row per pair of dimensions, added up in Spark. Only these reach the driver."""
    vectors = embeddings.select(F.col(vector).alias("vector"))
    bounds = materialize(vectors.mapInArrow(_bounds, "dims int, dim int, n bigint, low bigint, high bigint").groupBy("dims", "dim").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "bounds")
    chosen = bounds.filter("dim = 0").orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not chosen:
        return None
    dims, n = chosen[0]["dims"], chosen[0]["n"]
    spans = bounds.filter(F.col("dims") == dims).orderBy("dim").collect()
    low, high = [r["low"] for r in spans], [r["high"] for r in spans]
    planes = max(1, max(h - b for b, h in zip(low, high)).bit_length())
    parts = vectors.mapInArrow(_scatter(np.array(low, np.int64), planes), "a int, b int, high decimal(38,0), low decimal(20,0)")
    cross, sums = np.zeros((dims, dims), object), [0] * dims
    for r in parts.groupBy("a", "b").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toLocalIterator():
        value = (int(r["high"]) << LIMB) + int(r["low"])
        if r["b"] < 0:
            sums[r["a"]] = value
        else:
            cross[r["a"], r["b"]] = value
    return decompose(n, cross, sums, low, high, components)


def squares(d: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows of d, in limbs of 24 bits."""
    if d.dtype == object:
        return (d * d).sum(axis=1).tolist()
    size = np.abs(d)
    limbs = [(size >> (24 * i)) & 0xFFFFFF for i in range(3)]
    sums = [[(limbs[i] * limbs[j]).sum(axis=1).tolist() for j in range(3)] for i in range(3)]
    return [sum(v << (24 * (k // 3 + k % 3)) for k, v in enumerate(row)) for row in zip(*(sums[i][j] for i in range(3) for j in range(3)))]


def _project(model: Whitening):
    dims, n, k = len(model.sums), model.n, len(model.values)
    widest = max(h - b for b, h in zip(model.low, model.high))
    kind = np.int64 if n * widest < 1 << 62 else object
    # n * (x - low) - (S - n * low): small although x and S may not be
    shift = np.array([s - n * b for s, b in zip(model.sums, model.low)], kind)
    low, scale = np.array(model.low, np.int64), model.vectors / np.sqrt(model.values)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64 * WORDS):
                part = batch.slice(start, 64 * WORDS)
                rows, x = _matrix(part, dims)
                y = (x.astype(np.uint64) - low.astype(np.uint64)).astype(kind)
                centred = y * n - shift
                white = (centred / n).astype(np.float64) @ scale.T
                m = len(rows)
                ids = part.column("vec_id").take(pa.array(np.repeat(rows, k)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pa.array([v if v < DECIMALS else None for v in squares(centred) for _ in range(k)], pa.decimal128(38, 0)),
                    pa.array(white.ravel(), pa.float64(), from_pandas=True),
                    pa.array(model.explained * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64()),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(embeddings: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation (exact), whitened,
    explained (share of the variance) and identity_error.

    Left out are null and empty vectors, those with a null or non-finite entry or one too large for a long,
    and those of another length than most have (of equally frequent lengths the longer counts). Rows with a
    null or repeated vec_id are rows like others. There are as many components as dimensions, but at
    most those asked for; one without variance has whitened null and explained 0, and if no component has any,
    explained and identity_error are null. A deviation of more than 38 digits is null. An empty table gives no rows.
    """
    rows = embeddings.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"))
    if model is None:
        return embeddings.sparkSession.createDataFrame([], _OUT)
    return rows.mapInArrow(_project(model), _OUT)
