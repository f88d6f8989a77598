"""Command stream → ledger, as appended changes (T-5, T-6).

A micro-batch of book, cancel and status commands is settled as if handled one
by one (``operators/arbitration.py``), so the ledger does not depend on how the
stream is cut into batches.  Written are only the ledger rows that are new or
changed and the replies: what a batch writes follows the batch, not the ledger.

A run of the stream has a folder below the shared checkpoint folder:

    batch-<n>-<attempt>/changes, replies, ...   what batch n wrote
    base-<n>-<attempt>/ledger, sessions         where things stand after batch n
    _commits                                    rows (batch_id, kind, path, tables)

A folder counts once its row stands in ``_commits``; what a failed attempt
left is never read, and a batch replayed after its commit is skipped.  The
current ledger is the newest base with the later changes merged on read, the
last one of an id; :func:`compact` writes a new base.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators import arbitration
from slotwise.operators import ledger as L
from slotwise.session import checkpoint_root
from slotwise.streaming.dialogue import PICKS

BATCH, BASE = "batch", "base"
COMMIT = "batch_id long, kind string, path string, tables array<string>"
SESSION = ["phone", "step", *PICKS, "updated_at"]


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_root(spark), "snapshots", name)


def commits(spark: SparkSession, name: str) -> list:
    """Commit rows (batch_id, kind, path, tables) since and with the newest base, oldest first (a row per batch)."""
    path = os.path.join(_folder(spark, name), "_commits")
    try:
        rows = spark.read.schema(COMMIT).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    newest = rows.where(F.col("kind") == BASE).select(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
    later = (F.col("kind") == BATCH) & (F.col("batch_id") > newest) | (F.col("kind") == BASE) & (F.col("batch_id") == newest)
    return rows.where(later).orderBy("batch_id").collect()


def _publish(spark: SparkSession, name: str, batch_id: int, kind: str, tables: dict[str, DataFrame]) -> None:
    """Write tables to a folder of their own, then commit it."""
    path = os.path.join(_folder(spark, name), f"{kind}-{batch_id:012d}-{uuid.uuid4().hex}")
    for what, df in tables.items():
        df.write.parquet(os.path.join(path, what))
    row = spark.createDataFrame([(batch_id, kind, path, list(tables))], COMMIT)
    row.coalesce(1).write.mode("append").parquet(os.path.join(_folder(spark, name), "_commits"))


def last_applied_batch(spark: SparkSession, name: str) -> int:
    """Id of the newest committed batch, -1 if none."""
    return max((r.batch_id for r in commits(spark, name)), default=-1)


def written(spark: SparkSession, name: str, what: str) -> DataFrame | None:
    """What the batches since the newest base wrote under ``what``, with their ``batch_id``; None if there is no batch."""
    return _read(spark, [r for r in commits(spark, name) if r.kind == BATCH], what)


def _read(spark: SparkSession, rows: list, what: str) -> DataFrame | None:
    frames = [
        spark.read.parquet(os.path.join(r.path, what)).withColumn("batch_id", F.lit(r.batch_id)) for r in rows if what in r.tables
    ]
    return reduce(DataFrame.unionByName, frames) if frames else None


def current_ledger(spark: SparkSession, name: str, initial: DataFrame) -> DataFrame:
    """The ledger after all committed batches: base and changes, merged on read."""
    base = _read(spark, [r for r in commits(spark, name) if r.kind == BASE], "ledger")
    ledger = (initial if base is None else base).select(*L.LEDGER_COLUMNS)
    changes = written(spark, name, "changes")
    if changes is None:
        return ledger
    last = changes.groupBy("id").agg(F.max_by(F.struct(*L.LEDGER_COLUMNS), "batch_id").alias("r")).select("r.*")
    return arbitration.merged(ledger, last)


def current_sessions(spark: SparkSession, name: str) -> DataFrame | None:
    """Where each phone stands after all committed batches, if any wrote sessions."""
    kept = _read(spark, commits(spark, name), "sessions")
    if kept is None:
        return None
    # A base has the number of its last batch, and what that batch wrote.
    return kept.groupBy("phone").agg(F.max_by(F.struct(*SESSION), "batch_id").alias("s")).select("s.*")


def compact(spark: SparkSession, name: str, initial: DataFrame) -> None:
    """Write the current ledger and sessions as the new base, so that later reads merge less.

    The ledger is sorted into files by day; a busy day spans several.
    """
    last = last_applied_batch(spark, name)
    if last < 0:
        return
    ledger = current_ledger(spark, name, initial).repartitionByRange("appointment_date", "doctor_id", "id")
    sessions = current_sessions(spark, name)
    kept = {"ledger": ledger.sortWithinPartitions("appointment_date", "doctor_id", "id")}
    _publish(spark, name, last, BASE, kept if sessions is None else {**kept, "sessions": sessions})


def apply_commands(ledger: DataFrame, commands: DataFrame, doctors: DataFrame, leaves: DataFrame) -> DataFrame:
    """Next ledger from (msg_id, phone, ts, command, doctor_id, date, slot, name)."""
    return arbitration.merged(ledger, arbitration.arbitrate(ledger, commands, doctors, leaves).changes)


def ledger_writer(
    name: str, doctors: DataFrame, leaves: DataFrame, initial_ledger: DataFrame,
    prepare: Callable[[DataFrame, DataFrame], tuple[DataFrame, dict[str, DataFrame]]] | None = None,
):
    """A ``foreachBatch`` function that applies each batch once.

    ``prepare(batch, current ledger)`` gives the commands of a batch and
    further tables to write with it; without it the batch is the commands.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= last_applied_batch(spark, name):
            return  # replay of a committed batch
        current = current_ledger(spark, name, initial_ledger)
        commands, more = prepare(batch, current) if prepare else (batch, {})
        settled = arbitration.arbitrate(current, commands, doctors, leaves)
        replies = arbitration.replies(settled.outcomes, doctors)
        _publish(spark, name, batch_id, BATCH, {"changes": settled.changes, "replies": replies, **more})

    return write
