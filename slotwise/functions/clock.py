"""Time-of-day and weekday expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.text import col_, py_strip

# Weekday tokens accepted in ``available_days`` (case-sensitive,
# Monday first, as produced by date_format(d, 'EEE') in the US locale).
WEEKDAY_TOKENS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def hhmm_to_minutes(c: Column | str) -> Column:
    """``'09:30'`` → 570; NULL when either part is not an integer."""
    parts = F.split(col_(c), ":")
    h = F.get(parts, 0).try_cast("int")
    m = F.get(parts, 1).try_cast("int")
    return h * 60 + m


def minutes_to_hhmm(c: Column | str) -> Column:
    """570 → ``'09:30'``."""
    m = col_(c)
    return F.concat(
        F.lpad(F.floor(m / 60).cast("int").cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((m % 60).cast("string"), 2, "0"),
    )


def working_day_tokens(c: Column | str) -> Column:
    """``' Mon, Thu,xx,sat'`` → ``['Mon','Thu']``: split on commas, strip,
    keep only exact (case-sensitive) weekday tokens."""
    allowed = F.array(*[F.lit(t) for t in WEEKDAY_TOKENS])
    tokens = F.transform(F.split(col_(c), ","), lambda t: py_strip(t))
    return F.filter(tokens, lambda t: F.array_contains(allowed, t))


def weekday_token(d: Column | str) -> Column:
    """Weekday token of a date (``Mon`` .. ``Sun``)."""
    return F.date_format(col_(d), "EEE")
