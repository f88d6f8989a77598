"""Key lookups and small dimension listings, in set form.

The source application looks up one key per call; here the keys are a DataFrame and
the single-key form is a filter on top.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.text import normalize_phone
from slotwise.plans.numbering import id_slice, number_rows
from slotwise.schemas import DEFAULT_STEP, DEFAULT_TEMP_DATA

DOCTOR_COLUMNS = ("name", "department", "available_days", "slot_duration_mins", "start_time", "end_time")


def doctor_lookup(keys: DataFrame, doctors: DataFrame, key: str = "doctor_id") -> DataFrame:
    """Doctor attributes for every requested id; unknown ids keep NULL attributes."""
    d = doctors.select(F.col("id").alias(key), *DOCTOR_COLUMNS)
    return keys.select(key).distinct().join(d, key, "left")


def session_lookup(phones: DataFrame, sessions: DataFrame) -> DataFrame:
    """Current step and payload per phone, ``start`` / ``{}`` when none stored."""
    s = sessions.select(normalize_phone("phone").alias("phone"), "step", "temp_data")
    return (
        phones.select(normalize_phone("phone").alias("phone")).distinct()
        .join(s, "phone", "left")
        .select(
            "phone",
            F.coalesce("step", F.lit(DEFAULT_STEP)).alias("step"),
            F.coalesce("temp_data", F.lit(DEFAULT_TEMP_DATA)).alias("temp_data"),
        )
    )


def doctors_by_department(doctors: DataFrame, department: str | None = None) -> DataFrame:
    """Doctor menu per department in insertion (id) order, with its menu number.

    Departments are few and large, so they are numbered in slices of ids
    instead of in one window partition per department.
    """
    d = doctors if department is None else doctors.where(F.col("department") == department)
    return number_rows(d.where(F.col("department").isNotNull()), ["department"], ["id"], "menu_no", [id_slice("id")])


def departments(doctors: DataFrame) -> DataFrame:
    """Distinct departments in menu (alphabetical) order with their menu number."""
    distinct = doctors.select("department").where(F.col("department").isNotNull()).distinct()
    return number_rows(distinct, [], ["department"], "menu_no", [F.substring("department", 1, 2)]).orderBy("menu_no")


def doctor_options(doctors: DataFrame) -> DataFrame:
    """Doctor choices for the listing filter bar, by name."""
    return doctors.select("id", "name", "department").orderBy("name", "id")
