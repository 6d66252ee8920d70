"""Time-ordered post ids: decoding, ranges of ids for a time window, and decimal prefixes that cover a range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: The first millisecond of the id clock, and the bits below the clock.
CLOCK_START_MS = 1288834974657
CLOCK_BITS = 22
MAX_PREFIXES = 12


def id_to_ms(post_id: Column) -> Column:
    """Creation time of a decimal id in epoch ms; null for what isn't digits. Ids beyond 64 bits go through decimals."""
    digits = F.nullif(F.regexp_extract(post_id.cast("string"), r"^\s*([0-9]{1,38})\s*$", 1), F.lit(""))
    narrow = F.shiftright(digits.try_cast("bigint"), CLOCK_BITS)
    number, unit = digits.try_cast("decimal(38,0)"), F.lit(1 << CLOCK_BITS).cast("decimal(10,0)")
    wide = F.floor((number - number % unit) / unit).try_cast("bigint")
    return F.coalesce(narrow, wide) + F.lit(CLOCK_START_MS)


def _clock(ms: Column) -> Column:
    return F.shiftleft(ms.cast("bigint") - F.lit(CLOCK_START_MS), CLOCK_BITS)


def first_id(ms: Column) -> Column:
    """The smallest id of a millisecond; 0 up to the start of the clock."""
    return F.when(ms <= CLOCK_START_MS, F.lit(0).cast("bigint")).otherwise(_clock(ms))


def last_id(ms: Column) -> Column:
    """The largest id of a millisecond; that of the clock's first one up to its start."""
    return F.when(ms <= CLOCK_START_MS, F.lit((1 << CLOCK_BITS) - 1).cast("bigint")).otherwise(_clock(ms + 1) - 1)


def _head(digits: Column, k: Column) -> Column:
    return F.substring(digits, F.lit(1), k).cast("bigint")


def _same_length(lo: Column, hi: Column, most: int) -> Column:
    """Prefixes of the greatest length at which at most ``most`` of them reach from ``lo`` to ``hi``, two strings of one length."""
    lengths = F.sequence(F.length(lo), F.lit(1), F.lit(-1))
    fits = F.filter(lengths, lambda k: (_head(hi, k) - _head(lo, k) < most) | (k == 1))
    return let(F.element_at(fits, 1), lambda k: F.transform(F.sequence(_head(lo, k), _head(hi, k)), lambda p: F.lpad(p.cast("string"), k, "0")))


def prefix_cover(a: Column, b: Column, most: int = MAX_PREFIXES) -> Column:
    """At most ``most`` decimal prefixes that every id from ``a`` to ``b`` (64-bit, either order) begins with.

    A range over several lengths is covered length by length; if those are too many, all lose as many last digits as
    it takes. A prefix also admits ids outside the range, so the range stays the exact test.
    """

    def cover(r: Column) -> Column:
        lo, hi = r["lo"], r["hi"]
        per_length = F.transform(
            F.sequence(F.length(lo), F.length(hi)),
            lambda n: _same_length(F.when(n == F.length(lo), lo).otherwise(F.rpad(F.lit("1"), n, "0")), F.when(n == F.length(hi), hi).otherwise(F.rpad(F.lit("9"), n, "9")), most),
        )
        return F.when(lo == hi, F.array(lo)).when(F.length(lo) == F.length(hi), _same_length(lo, hi, most)).otherwise(let(F.array_distinct(F.flatten(per_length)), shortened))

    def shortened(all_: Column) -> Column:
        shorter = lambda cut: F.array_distinct(F.transform(all_, lambda p: F.substring(p, F.lit(1), F.greatest(F.length(p) - cut, F.lit(1)))))
        return let(F.element_at(F.filter(F.sequence(F.lit(0), F.lit(24)), lambda c: (F.size(shorter(c)) <= most) | (c == 24)), 1), shorter)

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(F.least(a, b).cast("string").alias("lo"), F.greatest(a, b).cast("string").alias("hi")), cover))
