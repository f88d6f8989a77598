"""Canonical schemas of the scheduling tables and their insert defaults."""

from __future__ import annotations

from pyspark.sql import types as T

PATIENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("phone", T.StringType(), False),
        T.StructField("age", T.StringType()),
        T.StructField("last_message", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

DOCTORS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType(), False),
        T.StructField("department", T.StringType(), False),
        T.StructField("available_days", T.StringType(), False),
        T.StructField("slot_duration_mins", T.IntegerType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
    ]
)

APPOINTMENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("patient_phone", T.StringType(), False),
        T.StructField("patient_name", T.StringType()),
        T.StructField("doctor_id", T.LongType(), False),
        T.StructField("appointment_date", T.DateType(), False),
        T.StructField("slot_time", T.StringType(), False),
        T.StructField("token_number", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

SESSIONS = T.StructType(
    [
        T.StructField("phone", T.StringType(), False),
        T.StructField("step", T.StringType()),
        T.StructField("temp_data", T.StringType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("phone", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("details", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

DOCTOR_LEAVES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("doctor_id", T.LongType(), False),
        T.StructField("leave_date", T.DateType(), False),
        T.StructField("reason", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]
)

# Inbound chat message as delivered by the messaging provider.
MESSAGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("from_number", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

# Insert defaults of the scheduling tables.
DEFAULT_SLOT_DURATION_MINS = 15
DEFAULT_START_TIME = "09:00"
DEFAULT_END_TIME = "13:00"
DEFAULT_STATUS = "booked"
DEFAULT_STEP = "start"
DEFAULT_TEMP_DATA = "{}"

STATUSES = ("booked", "cancelled", "completed")

TABLE_SCHEMAS = {
    "patients": PATIENTS,
    "doctors": DOCTORS,
    "appointments": APPOINTMENTS,
    "sessions": SESSIONS,
    "logs": LOGS,
    "doctor_leaves": DOCTOR_LEAVES,
}

# Column defaults applied when a column is absent from an insert; the
# timestamp columns default to the insert time (``now``).
INSERT_DEFAULTS = {
    "patients": {"created_at": "now"},
    "doctors": {"slot_duration_mins": DEFAULT_SLOT_DURATION_MINS, "start_time": DEFAULT_START_TIME,
                "end_time": DEFAULT_END_TIME},
    "appointments": {"status": DEFAULT_STATUS, "created_at": "now"},
    "sessions": {"step": DEFAULT_STEP, "temp_data": DEFAULT_TEMP_DATA, "updated_at": "now"},
    "logs": {"created_at": "now"},
    "doctor_leaves": {"created_at": "now"},
}


def with_insert_defaults(df, table: str, now=None):
    """Conform ``df`` to ``table``'s schema as an INSERT would.

    Columns absent from ``df`` get their declared default (or NULL); columns
    present keep their values, so an explicit NULL stays NULL.  ``now`` is
    the insert time for timestamp defaults.
    """
    from pyspark.sql import functions as F

    cols = []
    for f in TABLE_SCHEMAS[table].fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
            continue
        default = INSERT_DEFAULTS[table].get(f.name)
        if default == "now":
            default = now
        cols.append(F.lit(default).cast(f.dataType).alias(f.name))
    return df.select(*cols)
