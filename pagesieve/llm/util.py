"""Table access, Arrow maps and identity keys shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Rows a task holds at once; a slice is also cut at this many bytes of text.
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of a slice stays bounded; one text is never cut."""
    offsets = batch.column(column).nbytes
    rows = max(1, min(SLICE_ROWS, SLICE_BYTES * max(1, batch.num_rows) // max(1, offsets)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def map_texts(
    docs: DataFrame, fn: Callable[[list, list[bytes]], Sequence[list]], schema: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Map (keys, UTF-8 texts) of a slice to output columns; a null text arrives as b''."""
    spark_schema = StructType.fromDDL(schema)
    arrow, names = to_arrow_schema(spark_schema), spark_schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
                columns = fn(part.column("key").to_pylist(), texts)
                arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, spark_schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. `lower` does just that for texts that are ASCII throughout, and faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def hash128(c: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they stand for the value."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(7), c).alias("h2")]
