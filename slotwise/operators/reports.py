"""Admin reports: day sheets, filtered listings, doctors with leaves, patients.

Filters are applied before joins so Catalyst pushes them into the Parquet
scan; appointment rows are reduced per key before they meet a dimension.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.text import EMPTY_CELL, contains_like, given, normalize_phone, or_fallback
from slotwise.plans.numbering import number_rows

LISTING_COLUMNS = (
    "id", "token_number", "patient_name", "patient_phone", "doctor_name", "department",
    "doctor_id", "appointment_date", "slot_time", "status",
)

# Column headers of the CSV export, in file order, and the
# listing column each one shows.
CSV_HEADERS = (
    ("Token", "token_number"),
    ("Patient Name", "patient_name"),
    ("Phone", "patient_phone"),
    ("Doctor", "doctor_name"),
    ("Department", "department"),
    ("Date", "appointment_date"),
    ("Time", "slot_time"),
    ("Status", "status"),
)


def _day(d) -> Column:
    return F.lit(d).cast("date") if isinstance(d, (str, dt.date)) else d


def _doctor_dim(doctors: DataFrame) -> DataFrame:
    return doctors.select(
        F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"), "department"
    )


def with_doctors(appointments: DataFrame, doctors: DataFrame) -> DataFrame:
    """Appointments ⋈ doctors on doctor_id (dangling doctor ids drop out).

    The join strategy is left to the planner: broadcast when the doctor side
    is estimated (and, under AQE, measured) below the broadcast threshold,
    sort-merge otherwise, with AQE splitting a skewed doctor partition.
    """
    return appointments.join(_doctor_dim(doctors), "doctor_id")


def day_sheet(appointments: DataFrame, doctors: DataFrame, days) -> DataFrame:
    """All appointments (any status) of the given days, by token."""
    days = [days] if isinstance(days, (str, dt.date)) else list(days)
    a = appointments.where(F.col("appointment_date").isin([_day(d) for d in days]))
    return with_doctors(a, doctors).select(
        "appointment_date", "id", "token_number", "patient_name", "patient_phone",
        "doctor_name", "department", "slot_time", "status",
    ).orderBy("appointment_date", "token_number", "id")


def appointments_listing(
    appointments: DataFrame,
    doctors: DataFrame,
    date=None,
    doctor_id=None,
    department=None,
    status=None,
    sort: bool = True,
) -> DataFrame:
    """Appointment search with up to four optional conjuncts.

    An empty string, 0 or None means "no filter", as in the admin screen.
    """
    conds: list[Column] = []
    if given(date):
        conds.append(F.col("appointment_date") == _day(date))
    if given(doctor_id):
        conds.append(F.col("doctor_id") == F.lit(int(doctor_id)))
    if given(status):
        conds.append(F.col("status") == F.lit(status))
    a = appointments.where(reduce(lambda x, y: x & y, conds)) if conds else appointments
    d = _doctor_dim(doctors)
    if given(department):
        d = d.where(F.col("department") == F.lit(department))
    out = a.join(d, "doctor_id").select(*LISTING_COLUMNS)
    return out.orderBy(F.desc("appointment_date"), "token_number", "id") if sort else out


def csv_rows(listing: DataFrame) -> DataFrame:
    """The listing projected to the export's eight named columns."""
    return listing.select(*[F.col(src).alias(header) for header, src in CSV_HEADERS])


def doctors_with_leaves(doctors: DataFrame, leaves: DataFrame) -> DataFrame:
    """Each doctor with the array of its leaves sorted by date (empty if none).

    Leaves are unique per (doctor, date), so one doctor's array is bounded by
    the number of calendar days in the data, not by the table size.
    """
    per_doctor = leaves.groupBy("doctor_id").agg(
        F.sort_array(F.collect_list(F.struct("leave_date", "id", "reason"))).alias("_l")
    )
    nested = F.transform(
        F.col("_l"), lambda x: F.struct(x["id"].alias("id"), x["leave_date"].alias("leave_date"), x["reason"].alias("reason"))
    )
    return (
        doctors.join(per_doctor, doctors["id"] == per_doctor["doctor_id"], "left")
        .select(
            *[doctors[c] for c in doctors.columns],
            F.coalesce(nested, F.array().cast("array<struct<id:bigint,leave_date:date,reason:string>>")).alias("leaves"),
        )
        .orderBy("department", "name", "id")
    )


def doctor_leave_rows(doctors: DataFrame, leaves: DataFrame) -> DataFrame:
    """Flat twin of :func:`doctors_with_leaves`: one row per (doctor, leave);
    doctors without leaves appear once with NULL leave columns."""
    l = leaves.select(
        "doctor_id", F.col("id").alias("leave_id"), "leave_date", "reason"
    )
    return (
        doctors.join(l, doctors["id"] == l["doctor_id"], "left")
        .select(
            doctors["id"].alias("doctor_id"), "name", "department", "leave_id", "leave_date", "reason"
        )
        .orderBy("department", "name", "doctor_id", "leave_date")
    )


def patients_summary(patients: DataFrame, appointments: DataFrame, search: str | None = None) -> DataFrame:
    """Patients with their appointment count (all statuses, 0 if none) and
    latest appointment date, newest patients first.

    The search filter runs on patients before the join; appointments are
    reduced to one row per phone (map-side partial aggregate) before the
    outer join, so a hot phone is pre-aggregated, never shuffled row by row.
    """
    p = patients
    if given(search):
        p = p.where(contains_like("name", search) | contains_like("phone", search))
    per_phone = appointments.groupBy(normalize_phone("patient_phone").alias("_phone")).agg(
        F.count("id").alias("total_appts"), F.max("appointment_date").alias("last_appt")
    )
    return (
        p.join(per_phone, normalize_phone(p["phone"]) == per_phone["_phone"], "left")
        .select(
            "id", "name", "phone", "created_at",
            F.coalesce("total_appts", F.lit(0)).cast("bigint").alias("total_appts"),
            "last_appt",
        )
        .orderBy(F.desc("created_at"), "id")
    )


def patients_table(summary: DataFrame) -> DataFrame:
    """The patients screen: running row number and display fallbacks.

    The row number is global; it is counted in slices of a registration day,
    the newest first, instead of in a single-partition window.
    """
    newest_first = F.coalesce(-F.unix_date(F.to_date("created_at")), F.lit(2**31 - 1))
    numbered = number_rows(summary, [], [F.desc("created_at"), F.col("id")], "row_no", [newest_first])
    return numbered.select(
        "row_no",
        "id",
        or_fallback("name", EMPTY_CELL).alias("name"),
        "phone",
        "total_appts",
        F.coalesce(F.col("last_appt").cast("string"), F.lit(EMPTY_CELL)).alias("last_appt"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit(EMPTY_CELL)).alias("registered"),
    ).orderBy("row_no")


def listing_counts(listing: DataFrame, patients: DataFrame) -> DataFrame:
    """Row counts shown under the two listings (one row)."""
    return listing.agg(F.count(F.lit(1)).alias("appointments_listed")).select(
        "appointments_listed",
        patients.select(F.count(F.lit(1))).scalar().alias("patients_listed"),
    )
