"""Account handles: input form and lookup variants for misread ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of a handle and how many variants are tried.
HANDLE = r"^[a-z0-9_]{1,15}$"
MOST_VARIANTS = 6


def handle_input(raw: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(raw), "^@+", ""))


def handle_variants(handle: Column) -> Column:
    """The handle and what it may have been: digits as letters, letters as digits, rn as m, m as rn, without its last character."""
    base = F.trim(F.lower(handle))
    tries = F.array(
        base, F.translate(base, "015", "ols"), F.translate(base, "ols", "015"), F.replace(base, F.lit("rn"), F.lit("m")), F.replace(base, F.lit("m"), F.lit("rn")),
        F.when(F.length(base) > 1, F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(""),
    )
    return F.slice(F.array_distinct(F.filter(tries, lambda x: x != "")), 1, MOST_VARIANTS)


def repair_variants(handle: Column) -> Column:
    """Variants worth a lookup: other than the handle, and handles themselves."""
    return F.filter(handle_variants(handle), lambda v: (v != F.lower(handle)) & v.rlike(HANDLE))
