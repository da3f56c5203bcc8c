"""Session settings the engine relies on, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE splits hot join keys at run time; the joins in operators.skew are shaped so that it may.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Skips recording a Python call site for every column expression, which slows query building.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's runtime settings; sizes and partition counts stay the cluster's."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, name: str = "pagesieve", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; a local folder only on a local master without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="pagesieve-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name in the shared folder (not created)."""
    _FOLDERS.append(f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what operators called within it have written to the shared folder. Write or
    collect their results inside: DataFrames that read those folders are of no use later."""
    kept = len(_FOLDERS)
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for folder in _FOLDERS[kept:]:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _FOLDERS[kept:]


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: work done once, lineage cut, columns
    pruned on each later read, and nothing lost with an executor. `intermediates` deletes it."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
