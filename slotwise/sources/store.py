"""Stored layout of the scheduling tables.

``appointments`` is written partitioned by ``appointment_date`` so that the
day-bound reports (day sheets, reminders, dashboard, availability horizon,
daily counts) prune whole directories (``PartitionFilters`` in the plan).
Rows are range-partitioned on (date, doctor, id) before the write, so a busy
day is spread over several bounded write tasks instead of one.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("doctors", "patients", "appointments", "doctor_leaves")
PARTITION_COLUMN = {"appointments": "appointment_date"}
RANGE_KEYS = {"appointments": ("appointment_date", "doctor_id", "id"), "doctor_leaves": ("doctor_id", "leave_date")}


def store_tables(source, root: str) -> dict[str, str]:
    """Write the tables of ``source`` (an object with one DataFrame attribute
    per table, e.g. :func:`slotwise.sources.fixtures.tables`) below ``root``."""
    paths = {}
    for name in TABLES:
        df: DataFrame = getattr(source, name)
        if name in RANGE_KEYS:
            df = df.repartitionByRange(*RANGE_KEYS[name])
        w = df.write.mode("errorifexists")
        if name in PARTITION_COLUMN:
            w = w.partitionBy(PARTITION_COLUMN[name])
        path = os.path.join(root, name)
        w.parquet(path)
        paths[name] = path
    return paths


class StoredTables:
    """The stored tables as lazy scans (same attribute names as the fixtures)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.root, name))

    @property
    def doctors(self) -> DataFrame:
        return self._read("doctors")

    @property
    def patients(self) -> DataFrame:
        return self._read("patients")

    @property
    def appointments(self) -> DataFrame:
        df = self._read("appointments")
        return df.select("id", "patient_phone", "patient_name", "doctor_id", "appointment_date", "slot_time",
                         "token_number", "status")

    @property
    def doctor_leaves(self) -> DataFrame:
        return self._read("doctor_leaves")
