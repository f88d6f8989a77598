"""Message texts and a column renderer for them.

The texts below are fixed values: patients and staff receive them verbatim,
so they must read exactly as in the original service (emoji included).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCTOR = "\U0001F468\u200d\u2695\ufe0f"  # man health worker
HOSPITAL = "\U0001F3E5"
CLOCK = "\u23f0"
TICKET = "\U0001F3AB"
WARNING = "\u26a0\ufe0f"
CHECK = "\u2705"
CROSS = "\u274c"
CALENDAR = "\U0001F4C5"
CLIPBOARD = "\U0001F4CB"
PERSON = "\U0001F464"
CHART = "\U0001F4CA"
BULLET = "\u2022"
DASH = "\u2014"

# Message templates ({name} marks a field).
REMINDER = (
    f"{CLOCK} *Appointment Reminder*\n\n"
    "Hi {patient},\n"
    "Your appointment is *tomorrow*!\n\n"
    f"{DOCTOR} {{doctor_name}}\n"
    f"{HOSPITAL} {{department}}\n"
    f"{CLOCK} {{slot_time}}\n"
    f"{TICKET} Token No: *{{token_number}}*\n\n"
    "Please arrive 10 mins early. Type *cancel* to cancel."
)
SUMMARY_HEADER = f"{CHART} *Tomorrow's Appointments {DASH} {{day}}*\n\nTotal booked: *{{count}}*\n\n"
SUMMARY_LINE = f"{BULLET} {{patient_name}} {DASH} {{doctor_name}} @ {{slot_time}}\n"
ADMIN_CANCEL_NOTICE = (
    f"{WARNING} *Appointment Cancelled*\n\n"
    "We apologize, but your appointment with *{doctor_name}* on "
    "*{day}* at *{slot_time}* has been cancelled by the hospital.\n\n"
    "Please type *hi* to book a new slot."
)
LEAVE_NOTICE = (
    f"{WARNING} *Emergency Appointment Cancellation*\n\n"
    "We apologize, but your appointment with *{doctor_name}* on "
    "*{day}* at *{slot_time}* has been cancelled because the doctor had to take an emergency leave.\n\n"
    "Please type *hi* to book a new slot for a different day."
)
BOOKING_CONFIRMED = (
    f"{CHECK} *Appointment Confirmed!*\n\n"
    f"{PERSON} Patient: *{{name}}*\n"
    f"{HOSPITAL} {{department}}\n"
    f"{DOCTOR} {{doctor_name}}\n"
    f"{CALENDAR} {{day}}\n"
    f"{CLOCK} {{slot_time}}\n"
    f"{TICKET} Token No: *{{token_number}}*\n\n"
    "Please arrive 10 mins early. Bring this token number.\n\n"
    "Type *status* to view appointment.\n"
    "Type *cancel* to cancel."
)
SLOT_TAKEN_REPLY = f"{CROSS} Sorry, this slot was just taken. Please choose another.\n\nType *hi* to try again."
ON_LEAVE_REPLY = (
    f"{CROSS} Sorry! *{{doctor_name}}* is not available on "
    "*{day}* (marked on leave).\n\n"
    "Type *hi* to book another date."
)
CANCEL_DONE_REPLY = (
    f"{CHECK} Your appointment with {{doctor_name}} on "
    "{day} at {slot_time} has been cancelled.\n\n"
    "Type *hi* to book a new appointment."
)
CANCEL_NONE_REPLY = f"{CROSS} No upcoming appointment found.\n\nType *hi* to book a new appointment."
STATUS_CARD = (
    f"{CLIPBOARD} *Your Upcoming Appointment*\n\n"
    f"{HOSPITAL} {{department}}\n"
    f"{DOCTOR} {{doctor_name}}\n"
    f"{CALENDAR} {{day}}\n"
    f"{CLOCK} {{slot_time}}\n"
    f"{TICKET} Token No: *{{token_number}}*\n\n"
    "Type *cancel* to cancel this appointment."
)
STATUS_NONE_REPLY = "No upcoming appointment found.\n\nType *hi* to book one."

_FIELD = re.compile(r"\{(\w+)\}")


def render(template: str, **fields: Column) -> Column:
    """Fill a template with column values (callers make the values non-NULL,
    since ``concat`` is NULL if any part is)."""
    parts: list[Column] = []
    pos = 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos : m.start()]))
        parts.append(fields[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)
