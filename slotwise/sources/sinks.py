"""Writers: CSV export, JSON chart series, ledger snapshots and the outbox.

Snapshots are written to a new directory under the shared checkpoint root
and then published by appending a row to a small table of commits.  Nothing is
overwritten or deleted, so a reader sees the newest committed snapshot, whole,
at every moment.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.session import checkpoint_root

# Options that reproduce Python's csv.writer defaults: minimal quoting,
# doubled quote characters, CRLF line ends, None written as an empty field.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "lineSep": "\r\n",
    "dateFormat": "yyyy-MM-dd",
}


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_json_lines(rows: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    w = rows.write.mode(mode)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.json(path)


def snapshot_root(df: DataFrame, name: str) -> str:
    return os.path.join(checkpoint_root(df.sparkSession), "snapshots", name)


def write_snapshot(df: DataFrame, name: str, partition_by: str | None = None) -> str:
    """Write ``df`` as a new immutable snapshot and publish it; returns its path.

    The write is a normal Spark job (tasks are retried if an executor is
    lost); its path is committed only after it ended.
    """
    root = snapshot_root(df, name)
    path = os.path.join(root, f"v-{uuid.uuid4().hex}")
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    _commit(df.sparkSession, root, path)
    return path


def current_snapshot(spark, name: str) -> str | None:
    """Path of the newest committed snapshot, None before the first."""
    commits = _commits(spark, os.path.join(checkpoint_root(spark), "snapshots", name))
    last = commits.orderBy(F.desc("version")).first() if commits is not None else None
    return last["path"] if last else None


COMMITS = "version long, path string"


def _commits(spark, root: str) -> DataFrame | None:
    """The commits of a snapshot, None if there are none yet."""
    try:
        return spark.read.schema(COMMITS).parquet(os.path.join(root, "_commits"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _commit(spark, root: str, path: str) -> None:
    """Append ``path`` as the next version."""
    known = _commits(spark, root)
    version = (known.agg(F.max("version")).first()[0] or 0) + 1 if known is not None else 1
    spark.createDataFrame([(version, path)], COMMITS).coalesce(1).write.mode("append").parquet(
        os.path.join(root, "_commits")
    )
