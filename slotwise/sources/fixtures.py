"""Scheduling tables derived from the supplied star schema.

Each table is a pure, lazy DataFrame expression over the supplied parquet
tables, so its size grows with the scale factor and every query built on it
reads the real inputs.  The derivation rules are listed in FIXTURES.md; the
SQL oracle applies the same rules.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.sources.tables import read_table

# Fixed values of the test fixtures.
AS_OF = dt.date(2025, 7, 1)
FIRST_APPOINTMENT_DAY = dt.date(2025, 6, 1)
APPOINTMENT_SPAN_DAYS = 60
FIRST_PATIENT_DAY = dt.date(2025, 1, 1)
FIRST_MESSAGE_TS = dt.datetime(2025, 6, 1, 0, 0, 0)
PHONE_PREFIX = "whatsapp:+91"
PHONE_BASE = 9000000000
DEPARTMENTS = ("General OPD", "Orthopedics", "Gynecology", "Cardiology", "Pediatrics", "ENT")
DAY_LISTS = ("Mon,Tue,Wed,Thu,Fri", "Mon,Wed,Fri", "Tue,Thu,Sat", "Sun", " Mon, Thu,xx,sat")
DURATIONS = (15, 20, 30, 25)
START_TIMES = ("09:00", "10:00", "10:00")
END_TIMES = ("12:00", "09:30", "13:00", "13:00", "13:00", "13:00", "13:00")
SLOT_TIMES = ("09:00", "09:15", "09:30", "10:00", "10:20", "10:30", "11:00", "11:30")
# Texts of the scripted dialogues, one message each.
DIALOGUES = (
    (" Hi ", "1", "1", "1", "1", "rahul sharma"),
    ("hi", "2", "1", "2", "1", "meera nair", "CANCEL"),
    ("status", "my appointment", "   ", "99", "hello", "0", "1", "7"),
    ("Hello", "3", "1", "1", "2", "x", "ravi kumar", "status", "cancel appointment"),
    ("hi", "4", "1", "1", "99", "3", "anita rao", "hi", "4", "1", "1", "3", "anita rao"),
)
STEP_OF_EVENT = (
    ("view", "choose_dept"),
    ("click", "choose_doctor"),
    ("signup", "choose_date"),
    ("purchase", "confirm_name"),
)


def _case(index_sql: str, values) -> str:
    """SQL ``CASE`` picking values[index] from a small fixed tuple."""
    arms = " ".join(f"WHEN {i} THEN {_lit(v)}" for i, v in enumerate(values))
    return f"CASE {index_sql} {arms} END"


def _lit(v) -> str:
    return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _phone(key_sql: str) -> str:
    return f"concat('{PHONE_PREFIX}', CAST({PHONE_BASE} + {key_sql} AS STRING))"


# Each derivation is one projection written as SQL expressions (a single
# call into the JVM per table instead of one per column operation).


def doctors(supplier: DataFrame) -> DataFrame:
    return supplier.selectExpr(
        "s_suppkey + 1 AS id",
        # Every fourth doctor has a namesake.
        "concat('Dr. ', CAST(s_suppkey - CASE WHEN s_suppkey % 4 = 3 THEN 1 ELSE 0 END AS STRING)) AS name",
        f"{_case('s_suppkey % 6', DEPARTMENTS)} AS department",
        f"{_case('s_suppkey % 5', DAY_LISTS)} AS available_days",
        f"CAST({_case('s_suppkey % 4', DURATIONS)} AS INT) AS slot_duration_mins",
        f"{_case('s_suppkey % 3', START_TIMES)} AS start_time",
        f"{_case('s_suppkey % 7', END_TIMES)} AS end_time",
    )


def patients(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey + 1 AS id",
        "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_name END AS name",
        f"{_phone('c_custkey')} AS phone",
        f"CAST(date_add(DATE'{FIRST_PATIENT_DAY}', CAST(c_custkey % 150 AS INT)) AS TIMESTAMP_NTZ) AS created_at",
    )


def appointments(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """Appointments ledger; ``id`` is also the arrival order of the bookings.

    ``token_number`` stands in for the stored column: the rank of the booking
    inside its (doctor, day).  Column pruning drops the window whenever a
    query does not read it.
    """
    n_ids = supplier.select(F.count(F.lit(1)) + 1).scalar()  # lazy scalar subquery
    base = orders.select(
        "*", n_ids.alias("_n_ids")
    ).selectExpr(
        "o_orderkey + 1 AS id",
        f"{_phone('o_custkey')} AS patient_phone",
        "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE concat('Patient ', CAST(o_custkey AS STRING)) END AS patient_name",
        "1 + (o_orderkey * 31 + o_custkey) % _n_ids AS doctor_id",
        f"date_add(DATE'{FIRST_APPOINTMENT_DAY}', CAST((o_orderkey * 7 + o_custkey) % {APPOINTMENT_SPAN_DAYS} AS INT))"
        " AS appointment_date",
        f"{_case('o_orderkey % 8', SLOT_TIMES)} AS slot_time",
        "CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 'booked' "
        "WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'cancelled' END AS status",
    )
    return base.selectExpr(
        "id", "patient_phone", "patient_name", "doctor_id", "appointment_date", "slot_time",
        "CAST(row_number() OVER (PARTITION BY doctor_id, appointment_date ORDER BY id) AS BIGINT) AS token_number",
        "status",
    )


def doctor_leaves(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """Leave days: every urgent pending order marks its (doctor, day) as a
    leave; (doctor, day) is unique, the earliest order gives the id, and the
    month of the earliest order date gives the reason."""
    n_doctors = supplier.select(F.count(F.lit(1))).scalar()
    marked = orders.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(
        "*", n_doctors.alias("_n")
    ).selectExpr(
        "o_orderkey", "o_orderdate", "1 + o_orderkey % _n AS doctor_id",
        f"date_add(DATE'{FIRST_APPOINTMENT_DAY}', CAST(o_custkey % {APPOINTMENT_SPAN_DAYS} AS INT)) AS leave_date",
    )
    return marked.groupBy("doctor_id", "leave_date").agg(
        (F.min("o_orderkey") + 1).alias("id"),
        F.expr("CASE WHEN month(min(o_orderdate)) <= 6 THEN 'conference' ELSE 'personal' END").alias("reason"),
    ).select("id", "doctor_id", "leave_date", "reason")


def messages(conversations: DataFrame) -> DataFrame:
    """Inbound chat messages: every user turn of the conversations table as it
    is, and after each conversation's own turns one of the scripted dialogues.
    A phone is written with and without the address prefix."""
    said = conversations.where("role = 'user'")
    number = f"concat(CASE WHEN {{n}} % 3 = 0 THEN '+91' ELSE '{PHONE_PREFIX}' END, CAST({PHONE_BASE} + conv_id AS STRING))"
    start = f"TIMESTAMP_NTZ'{FIRST_MESSAGE_TS}' + make_dt_interval(0, 0, CAST(conv_id * 60 AS INT), 0)"
    own = said.selectExpr(
        "conv_id * 1000 + turn AS id", f"{number.format(n='(conv_id + turn)')} AS from_number", "text AS body",
        f"{start} + make_dt_interval(0, 0, 0, CAST(turn AS INT)) AS ts",
    )
    arms = " ".join(f"WHEN {i} THEN array({', '.join(map(_lit, d))})" for i, d in enumerate(DIALOGUES))
    scripted = (
        said.select("conv_id").distinct()
        .selectExpr("conv_id", f"posexplode(CASE conv_id % {len(DIALOGUES)} {arms} END) AS (k, body)")
        .selectExpr(
            "conv_id * 1000 + 500 + k AS id", f"{number.format(n='(conv_id + k)')} AS from_number", "body",
            f"{start} + make_dt_interval(0, 0, 30, CAST(k AS INT)) AS ts",
        )
    )
    return own.unionByName(scripted)


def session_updates(events: DataFrame) -> DataFrame:
    """Writes of conversation state (many per phone)."""
    arms = " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in STEP_OF_EVENT)
    return events.selectExpr(
        f"{_phone('user_id')} AS phone",
        f"CASE event_type {arms} ELSE 'start' END AS step",
        "props AS temp_data", "ts AS updated_at", "event_id AS seq",
    )


def admin_status_ids(orders: DataFrame, priority: str) -> DataFrame:
    """Appointment ids an admin acts on: every order of one priority class
    (``1-URGENT`` → cancel, ``2-HIGH`` → complete)."""
    return orders.where(F.col("o_orderpriority") == priority).select((F.col("o_orderkey") + 1).alias("id"))


def leave_requests(orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """Leave requests typed by an admin: one per low-priority order, with the
    date as text (some of it not a real date)."""
    n_doctors = supplier.select(F.count(F.lit(1))).scalar()
    k = F.col("o_orderkey")
    day = F.date_add(F.lit(FIRST_APPOINTMENT_DAY), (k % APPOINTMENT_SPAN_DAYS).cast("int"))
    return orders.where(F.col("o_orderpriority") == "5-LOW").select(
        (k + 1).alias("request_id"),
        (F.lit(1) + F.col("o_custkey") % n_doctors).alias("doctor_id"),
        F.when(k % 97 == 0, F.lit("2025-02-30")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("leave_date"),
        F.concat(F.lit("Leave "), F.col("o_orderstatus")).alias("reason"),
    )


# Expressions that make some rows break each rule of the schema; Spark and the
# SQL oracle evaluate the same text.  Columns not named stay as they are.
DIRTY = {
    "patients": {
        "id": "CASE WHEN id % 211 = 0 THEN id - 1 ELSE id END",
        "phone": "CASE WHEN id % 101 = 0 THEN NULL WHEN id % 103 = 0 THEN '+910000000000' ELSE phone END",
    },
    "doctors": {
        "id": "CASE WHEN id % 7 = 0 THEN id - 1 ELSE id END",
        "name": "CASE WHEN id % 9 = 0 THEN NULL ELSE name END",
        "available_days": "CASE WHEN id % 5 = 0 THEN NULL ELSE available_days END",
    },
    "appointments": {
        "id": "CASE WHEN id % 211 = 0 THEN id - 1 ELSE id END",
        "patient_phone": "CASE WHEN id % 101 = 0 THEN NULL ELSE patient_phone END",
        "doctor_id": "CASE WHEN id % 113 = 0 THEN NULL ELSE doctor_id END",
        "appointment_date": "CASE WHEN id % 107 = 0 THEN NULL ELSE appointment_date END",
        "status": "CASE WHEN id % 109 = 0 THEN 'lost' ELSE status END",
    },
    "doctor_leaves": {
        "id": "CASE WHEN id % 3 = 0 THEN 3 ELSE id END",
        "doctor_id": "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN -1 ELSE doctor_id END",
        "leave_date": "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 13 = 0 THEN DATE '2025-06-01' ELSE leave_date END",
    },
}


def dirty(df: DataFrame, table: str) -> DataFrame:
    """``df`` with rows that break the rules of its table."""
    changed = DIRTY[table]
    return df.selectExpr(*[f"{changed[c]} AS {c}" if c in changed else c for c in df.columns])


@dataclass
class Tables:
    """Lazily derived scheduling tables for one scale-factor directory."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def _src(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def _get(self, name, build):
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    @property
    def doctors(self) -> DataFrame:
        return self._get("doctors", lambda: doctors(self._src("supplier")))

    @property
    def patients(self) -> DataFrame:
        return self._get("patients", lambda: patients(self._src("customer")))

    @property
    def appointments(self) -> DataFrame:
        return self._get("appointments", lambda: appointments(self._src("orders"), self._src("supplier")))

    @property
    def doctor_leaves(self) -> DataFrame:
        return self._get("doctor_leaves", lambda: doctor_leaves(self._src("orders"), self._src("supplier")))

    @property
    def messages(self) -> DataFrame:
        return self._get("messages", lambda: messages(self._src("conversations")))

    @property
    def session_updates(self) -> DataFrame:
        return self._get("session_updates", lambda: session_updates(self._src("events")))

    @property
    def admin_cancel_ids(self) -> DataFrame:
        return admin_status_ids(self._src("orders"), "1-URGENT")

    @property
    def admin_complete_ids(self) -> DataFrame:
        return admin_status_ids(self._src("orders"), "2-HIGH")

    @property
    def leave_requests(self) -> DataFrame:
        return leave_requests(self._src("orders"), self._src("supplier"))

    def ledger_split(self) -> tuple[DataFrame, DataFrame]:
        """(ledger, requests): the first half of the appointment ids is the
        existing ledger, the second half arrives as booking requests."""
        n = self._src("orders").select(F.count(F.lit(1))).scalar()
        a = self.appointments
        return a.where(F.col("id") * 2 <= n), a.where(F.col("id") * 2 > n)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
