"""Text expressions with the exact semantics the scheduling rules need.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Messaging address prefix and display fallbacks.
ADDRESS_PREFIX = "whatsapp:"
PATIENT_FALLBACK = "Patient"
EMPTY_CELL = "—"  # em dash shown for a missing value

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

# Python's str.strip() removes every Unicode white-space character and the
# four ASCII information separators; Spark's trim() only removes spaces.
# Named one by one: btrim looks at the ends of a text, a pattern at all of it.
_STRIPPED = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# A "word" for title-casing is a run of cased letters.
_TITLE_TOKENS = r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Whitespace strip with Python ``str.strip()`` semantics."""
    return F.btrim(col_(c), F.lit(_STRIPPED))


def ascii_lower(c: Column | str) -> Column:
    """Lower-case ASCII letters only (what SQLite's LIKE folds)."""
    return F.translate(col_(c), _UPPER, _LOWER)


def ascii_lower_py(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def contains_like(c: Column | str, needle: str) -> Column:
    """``c LIKE '%needle%'`` with SQLite rules.

    ASCII-only case folding, ``%`` and ``_`` typed by the user stay wildcards,
    and there is no escape character (so a backslash is literal; Spark's LIKE
    treats ``\\`` as its escape, hence it is doubled).
    """
    pattern = "%" + ascii_lower_py(needle).replace("\\", "\\\\") + "%"
    return ascii_lower(c).like(pattern)


def title_case(c: Column | str) -> Column:
    """Python ``str.title()``: upper-case the first letter of every run of
    cased letters, lower-case the rest (``mary-jane o'brien`` → ``Mary-Jane O'Brien``).

    Spark's ``initcap`` only splits on spaces, so split into letter / non-letter
    runs first and capitalise each run.
    """
    parts = F.regexp_extract_all(F.lower(col_(c)), F.lit(_TITLE_TOKENS), 1)
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def normalize_phone(c: Column | str) -> Column:
    """Phone identity used for every join, dedup and notice: no address prefix."""
    return F.replace(col_(c), F.lit(ADDRESS_PREFIX), F.lit(""))


def messaging_address(c: Column | str) -> Column:
    """Outbound address, prefixed exactly once."""
    return F.concat(F.lit(ADDRESS_PREFIX), normalize_phone(c))


def fmt_day(d: Column | str) -> Column:
    """``2025-06-10`` → ``Tue, 10 Jun``."""
    return F.date_format(col_(d), "EEE, dd MMM")


def parse_day(c: Column | str) -> Column:
    """Lenient ISO date parse; NULL (instead of an exception) on bad input."""
    return F.try_to_date(col_(c), "yyyy-M-d")


def numbered_list(arr: Column | str) -> Column:
    """``['a','b']`` → ``'1. a\\n2. b'``."""
    return F.array_join(
        F.transform(col_(arr), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)),
        "\n",
    )


def or_fallback(c: Column | str, fallback: str) -> Column:
    """``value or fallback`` — NULL and empty string both fall back."""
    return F.coalesce(F.nullif(col_(c), F.lit("")), F.lit(fallback))


def py_str(c: Column | str) -> Column:
    """How a Python f-string prints a value: NULL prints as ``None``."""
    return F.coalesce(col_(c).cast("string"), F.lit("None"))


def given(value) -> bool:
    """Truthiness of an optional filter argument: None, '' and 0 mean 'no filter'."""
    return bool(value)
