"""Conversation state payload (the JSON ``temp_data`` column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.text import col_

DOCTOR_STRUCT = (
    "struct<id:bigint,name:string,department:string,available_days:string,"
    "slot_duration_mins:int,start_time:string,end_time:string>"
)

# One nullable struct covers the payload of every conversation step; keys that
# a step does not write come back NULL.
PAYLOAD_DDL = (
    f"depts array<string>, dept string, doctors array<{DOCTOR_STRUCT}>, "
    f"doctor {DOCTOR_STRUCT}, dates array<string>, date string, "
    "slots array<string>, slot string"
)


def parse_payload(c: Column | str) -> Column:
    """JSON text → payload struct (NULL text reads as the empty payload)."""
    return F.from_json(F.coalesce(col_(c), F.lit("{}")), PAYLOAD_DDL)


def dump_payload(c: Column | str) -> Column:
    """Payload struct → JSON text; absent keys are left out."""
    return F.to_json(col_(c))
