"""Helpers shared by the operators: input scans, word pattern, lineage cuts."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.session import ensure_checkpoint_dir, ship_package

# A word is a run of characters other than space and ASCII tab .. carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fresh scan of one input table (no file listing is kept between calls)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Bytes that a Python task is handed at a time: rows hold whole texts, and thousands of
# them at once (Spark's default) are in memory several times over in JVM and worker.
ARROW_BYTES = 4 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> str:
    """Prepare a session for Python tasks and lineage cuts; returns the shared folder."""
    root = ensure_checkpoint_dir(spark)
    if str(spark.conf.get(_ARROW_LIMIT, "64MB")) in ("64MB", "67108864", "67108864b"):  # not chosen by the user
        spark.conf.set(_ARROW_LIMIT, str(ARROW_BYTES))
    ship_package(spark)
    return root


_RESIDENT: dict[tuple, Any] = {}  # of this process, at most one


def resident(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: the value of the last key.

    Workers outlive a query.  With a cache for each operator they would hold the
    tables of every operator that they ever ran, beside those of the present one.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        hand_back()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def hand_back() -> None:
    """Give memory that is free in this process back to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The Python task ``run``, which hands its memory back when it ends: the idle worker
    waits for its next task beside others that need it."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return task


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back.

    The copy is a plain Parquet table in the folder that all executors share,
    so a lost executor re-reads it instead of running the stages before it
    again, and several consumers share one computation.
    """
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays (null counts as empty)."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n`` (the fold of a document)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
