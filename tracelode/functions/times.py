"""Displayed dates against instants: windows, plausible zone offsets, timestamps of captures.

A displayed date is a string without a zone and stays one: an impossible date must compare unequal, not become null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets from UTC in use, in minutes, and how far a clock may be off.
OFFSET_MIN, OFFSET_MAX, OFFSET_STEP, SLACK = -720, 840, 15, 2
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _when_iso(iso: Column) -> Column:
    return F.when(iso.rlike(_ISO), iso)


def day_start_ms(iso: Column) -> Column:
    """Midnight UTC of a displayed date; null if there is no such day."""
    return F.unix_millis(F.try_to_timestamp(F.concat(_when_iso(iso), F.lit(" 00:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")))


def window_of(dates: Column, inclusive_midnight: bool = False) -> Column:
    """struct(from_ms, to_ms) that holds all instants at which any of the dates was shown somewhere; null without a real date.

    14 hours before the first day to 12 hours after the last, whose last second counts (its end, if ``inclusive_midnight``).
    """
    starts = F.filter(F.transform(dates, day_start_ms), lambda x: x.isNotNull())
    end = DAY_MS if inclusive_midnight else DAY_MS - 1000
    return F.when(F.size(starts) > 0, F.struct((F.array_min(starts) - 14 * HOUR_MS).alias("from_ms"), (F.array_max(starts) + end + 12 * HOUR_MS).alias("to_ms")))


def implied_offset(iso: Column, minute: Column, ms: Column) -> Column:
    """Minutes by which the displayed wall clock is ahead of UTC; halves round up."""
    return F.floor((day_start_ms(iso) + minute * 60_000 - ms) / F.lit(60_000.0) + 0.5).cast("int")


def time_consistent(iso: Column, minute: Column, ms: Column) -> Column:
    """Whether some offset in use puts the instant at the displayed minute; null if something is missing or no date."""
    off = implied_offset(iso, minute, ms)
    near = F.pmod(off, F.lit(OFFSET_STEP))
    return off.between(OFFSET_MIN - SLACK, OFFSET_MAX + SLACK) & ((near <= SLACK) | (near >= OFFSET_STEP - SLACK))


def _day_at(ms: Column, offset_ms: int) -> Column:
    return F.date_format(F.timestamp_millis(ms + offset_ms), "yyyy-MM-dd")


def date_consistent(iso: Column, ms: Column) -> Column:
    """Whether some offset puts the instant on the displayed day. The offsets span 26 hours, so three of them tell."""
    return F.when(iso.rlike(_ISO) & ms.isNotNull(), (iso == _day_at(ms, OFFSET_MIN * 60_000)) | (iso == _day_at(ms, 0)) | (iso == _day_at(ms, OFFSET_MAX * 60_000)))


def capture_timestamp(ms: Column) -> Column:
    """14 digits, UTC; their text order is the order in time."""
    return F.date_format(F.timestamp_millis(ms), "yyyyMMddHHmmss")


def next_day(iso: Column) -> Column:
    return F.coalesce(F.date_format(F.date_add(F.to_date(F.try_to_timestamp(_when_iso(iso), F.lit("yyyy-MM-dd"))), 1), "yyyy-MM-dd"), iso)
