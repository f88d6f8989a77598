"""Integrity rules of the schema as a data-quality report.

The source database declared these constraints but did not enforce all of
them (foreign keys were off), so here they are checked over whole tables and
reported as (table_name, rule, row_key) rows.  Duplicate checks are
aggregates (combined map-side); foreign-key checks are left joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.schemas import STATUSES


def _rows(df: DataFrame, table: str, rule: str, key) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), key.cast("string").alias("row_key"))


def dangling_appointments(appointments: DataFrame, doctors: DataFrame) -> DataFrame:
    """Appointments whose doctor does not exist (the rows inner joins drop)."""
    return appointments.join(doctors.select(F.col("id").alias("doctor_id")), "doctor_id", "left_anti")


def _broken(df: DataFrame, table: str, key: str, rules: dict) -> DataFrame:
    """One row per row and violated rule, in one pass over the table."""
    names = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return df.select(F.col(key).alias("_key"), F.explode(names).alias("_rule")).select(
        F.lit(table).alias("table_name"), F.col("_rule").alias("rule"), F.col("_key").cast("string").alias("row_key")
    )


def _repeated(df: DataFrame, table: str, rule: str, columns: list[str]) -> DataFrame:
    """Values that a unique rule sees more than once (nulls are never equal)."""
    present = df.select(*columns).dropna()
    twice = present.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return _rows(twice, table, rule, F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def _any_null(*columns: str):
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def constraint_violations(
    patients: DataFrame, doctors: DataFrame, appointments: DataFrame, leaves: DataFrame, sessions: DataFrame
) -> DataFrame:
    """Rows that break a rule of the schema.

    Row rules of a table are looked at together in one pass; a foreign key is
    a left join with the distinct ids (a null key is a matter of ``not_null``);
    unique rules are aggregates.
    """
    known = doctors.select(F.col("id").alias("doctor_id")).dropna().distinct().withColumn("_known", F.lit(True))
    no_doctor = F.col("doctor_id").isNotNull() & F.col("_known").isNull()
    bad_status = F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES)
    checks = [
        _broken(
            appointments.join(known, "doctor_id", "left"), "appointments", "id",
            {
                "check_status": bad_status,
                "not_null": _any_null("patient_phone", "doctor_id", "appointment_date", "slot_time"),
                "fk_doctor": no_doctor,
            },
        ),
        _broken(
            leaves.join(known, "doctor_id", "left"), "doctor_leaves", "id",
            {"not_null": _any_null("doctor_id", "leave_date"), "fk_doctor": no_doctor},
        ),
        _broken(patients, "patients", "id", {"not_null": _any_null("phone")}),
        _broken(doctors, "doctors", "id", {"not_null": _any_null("name", "department", "available_days")}),
        _repeated(patients, "patients", "unique_phone", ["phone"]),
        _repeated(sessions, "sessions", "unique_phone", ["phone"]),
        _repeated(leaves, "doctor_leaves", "unique_doctor_day", ["doctor_id", "leave_date"]),
        *[
            _repeated(df, name, "unique_id", ["id"])
            for name, df in (("patients", patients), ("doctors", doctors), ("appointments", appointments),
                             ("doctor_leaves", leaves))
        ],
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
