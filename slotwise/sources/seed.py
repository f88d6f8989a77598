"""Idempotent seeding of the doctors dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotwise.schemas import DOCTORS

# The six doctors a new installation starts with.
SEED_DOCTORS = (
    ("Dr. Ramesh Kumar", "General OPD", "Mon,Tue,Wed,Thu,Fri", 15, "09:00", "13:00"),
    ("Dr. Priya Sharma", "General OPD", "Mon,Wed,Fri", 15, "10:00", "14:00"),
    ("Dr. Anil Verma", "Orthopedics", "Tue,Thu,Sat", 20, "09:00", "12:00"),
    ("Dr. Sunita Rao", "Gynecology", "Mon,Tue,Wed,Thu", 20, "10:00", "13:00"),
    ("Dr. Kiran Mehta", "Cardiology", "Mon,Wed,Fri", 30, "09:00", "12:00"),
    ("Dr. Deepak Singh", "Pediatrics", "Mon,Tue,Wed,Thu,Fri", 15, "09:00", "13:00"),
)


def seed_rows(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *r) for i, r in enumerate(SEED_DOCTORS)]
    return spark.createDataFrame(rows, DOCTORS)


def seed_doctors(existing: DataFrame) -> DataFrame:
    """``existing`` if it has any row, else the seed rows (ids 1..6).

    Lazy: the emptiness test is an EXISTS subquery in the plan, which stops
    at the first row found.
    """
    seed = seed_rows(existing.sparkSession)
    cols = [f.name for f in DOCTORS.fields]
    return existing.select(*cols).unionByName(seed.where(~existing.exists()))


def seed_doctors_table(spark: SparkSession, path: str) -> bool:
    """Write the seed doctors to the table at ``path`` only if it has no row.

    The emptiness test reads at most one row (``limit(1)``).  Returns True
    when the seed was written.  Running it again is a no-op.
    """
    from pyspark.errors import AnalysisException

    try:
        empty = spark.read.parquet(path).limit(1).count() == 0
    except AnalysisException:  # no table yet
        empty = True
    if empty:
        seed_rows(spark).write.mode("append").parquet(path)
    return empty
