"""Message intent classification and numbered-menu selection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.functions.text import col_, py_strip

# Global command words, matched after strip + lower-case, tested
# in this order from any conversation state.
CANCEL_WORDS = ("cancel", "cancel appointment")
STATUS_WORDS = ("status", "my appointment", "appointment")
GREETING_WORDS = ("hi", "hello", "hey", "book", "start", "menu", "0", "home")

INTENT_CANCEL = "cancel"
INTENT_STATUS = "status"
INTENT_GREET = "greet"
INTENT_OTHER = "other"


def message_text(body: Column | str) -> Column:
    """Text the state machine compares: stripped and lower-cased."""
    return F.lower(py_strip(body))


def intent(text: Column | str) -> Column:
    """cancel / status / greet / other for an already normalised text."""
    t = col_(text)
    return (
        F.when(t.isin(*CANCEL_WORDS), F.lit(INTENT_CANCEL))
        .when(t.isin(*STATUS_WORDS), F.lit(INTENT_STATUS))
        .when(t.isin(*GREETING_WORDS), F.lit(INTENT_GREET))
        .otherwise(F.lit(INTENT_OTHER))
    )


def menu_index(text: Column | str) -> Column:
    """1-based choice typed by the user, NULL when it is not an integer
    (digits with an optional sign; ``2.5`` or ``two`` are not choices)."""
    t = py_strip(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def menu_pick(text: Column | str, options: Column | str) -> Column:
    """The option a reply selects, NULL when not a number or out of range."""
    i = menu_index(text)
    return F.when((i >= 1) & (i <= F.size(col_(options))), F.get(col_(options), i - 1))
