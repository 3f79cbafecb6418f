"""Helpers that the corpus operators share: written intermediate tables, word patterns, memory of workers."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting to remove an execution's shuffle files at its end.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MAX_BATCH_BYTES = 8 << 20

#: Rows for which a small table has a file of its own.
FILE_ROWS = 4096

_OWN_SCRATCH: dict[str, str] = {}


def give_back() -> None:
    """Return memory that is free to the system: a worker lives on between tasks, and what its largest batch needed would stay with it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where that is unset a temporary one, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_SCRATCH:
            _OWN_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="factorloom-")
        base = _OWN_SCRATCH[app]
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def byte_count(text: str) -> int:
    """A size setting as Spark writes them (``64m``, ``1gb``, ``8388608``) in bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << (10 * " kmgtp".index(unit or " "))


def bound_batches(spark: SparkSession) -> None:
    """Hold the batches that go to Python workers to ``MAX_BATCH_BYTES``, so that long texts do not add up.

    A lower bound of the session stays; a higher one is lowered for the session,
    since what is planned now runs later.
    """
    if byte_count(spark.conf.get(_BATCH_BYTES)) > MAX_BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, MAX_BATCH_BYTES)


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with files that outlive executors and keeps expensive
    Python passes from running once per consumer. The shuffle files of the
    write go as soon as it ends: nothing else reads them. ``rows``: what the
    table has at most, if that is known; a file is not made for less than
    ``FILE_ROWS`` of them, as long as every core has one to write.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    bound_batches(spark)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote and nothing reads any more, so that what is kept at once is bounded."""
    for df in tables:
        folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
        for folder in folders:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(df: DataFrame, key: str, limit: int):
    """About ``limit`` rows (all, if there are no more) for the driver, in order of ``key``: those under a hash bound of it.

    The bound comes from the count, so tasks send nothing but the sample. Rows
    that share a key stay or go together; twice the limit is the most.
    """
    n, span = df.count(), 1 << 40
    if n > limit:
        df = df.where(F.pmod(F.xxhash64(key), F.lit(span)) < int(span * limit / n))
    return df.limit(2 * limit).toPandas().sort_values(key, kind="stable", ignore_index=True)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
