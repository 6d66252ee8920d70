"""Displayed dates and times in a line of recognised text.

Plain functions over texts, and one Arrow UDF over them: the forms need lookbehind and backtracking order that chained
SQL expressions would hide. Dates stay as displayed; nothing is shifted between zones.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import ship

#: Month names, and the forms in the order in which they are tried.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "(?P<month>jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_ORDINAL = "(?:st|nd|rd|th)?"
_YEAR = r"(?P<year>\d{2,4})(?!\d)"
WITH_YEAR = (
    rf"{_MONTH}\b\s+(?P<day>\d{{1,2}})(?!\d){_ORDINAL}\s*(?:[,.;*·•\-–—]\s*)?{_YEAR}",
    rf"(?<!\d)(?P<day>\d{{1,2}}){_ORDINAL}\s+{_MONTH}\b\s*,?\s*{_YEAR}",
    r"(?<!\d)(?P<year>\d{4})(?!\d)\s*[/.-]\s*(?P<number>\d{1,2})(?!\d)\s*[/.-]\s*(?P<day>\d{1,2})(?!\d)",
)
EITHER_ORDER = rf"(?<!\d)(?P<one>\d{{1,2}})(?!\d)\s*[/.-]\s*(?P<two>\d{{1,2}})(?!\d)\s*[/.-]\s*{_YEAR}"
WITHOUT_YEAR = (
    rf"{_MONTH}\b\s+(?P<day>\d{{1,2}}){_ORDINAL}\b(?!\s*[,.;*·•\-–—]?\s*\d)",
    rf"(?<!\d)(?P<day>\d{{1,2}}){_ORDINAL}\s+{_MONTH}\b(?!\s*,?\s*\d)",
)
AGO = r"\s*\d+\s*(?:s|sec|secs|second|seconds|m|min|mins|minute|minutes|h|hr|hrs|hour|hours|d|day|days|w|week|weeks)\b\s*(?:ago)?\s*"
CLOCK_12 = r"(?<!\d)(\d{1,2})\s*[:：;]\s*(\d{2})(?!\d)\s*([APap])\s*\.?\s*[Mm]\s*\.?"
CLOCK_24 = r"(?<!\d)(\d{1,2})\s*[:：;]\s*(\d{2})(?!\d)"

_FLAGS = re.ASCII | re.IGNORECASE
_WITH_YEAR = [re.compile(p, _FLAGS) for p in WITH_YEAR]
_EITHER = re.compile(EITHER_ORDER, _FLAGS)
_WITHOUT_YEAR = [re.compile(p, _FLAGS) for p in WITHOUT_YEAR]
_AGO = re.compile(AGO, _FLAGS)
_12, _24 = re.compile(CLOCK_12, re.ASCII), re.compile(CLOCK_24, re.ASCII)

DATE_SCHEMA = T.ArrayType(T.StructType([T.StructField("iso_date", T.StringType()), T.StructField("minute", T.IntegerType()), T.StructField("year_inferred", T.BooleanType()), T.StructField("dm_ambiguous", T.BooleanType()), T.StructField("raw", T.StringType())]))


def minute_of_day(text: str) -> int | None:
    """The first displayed time; one with a meridiem goes before any without."""
    if (m := _12.search(text)) and 1 <= int(m[1]) <= 12 and int(m[2]) <= 59:
        return (int(m[1]) % 12 + (12 if m[3] in "Pp" else 0)) * 60 + int(m[2])
    if (m := _24.search(text)) and int(m[1]) <= 23 and int(m[2]) <= 59:
        return int(m[1]) * 60 + int(m[2])
    return None


def _month(found: re.Match) -> int:
    parts = found.groupdict()
    if "number" in parts:
        return int(parts["number"])
    return next(i for i, name in enumerate(MONTHS, 1) if name.startswith(parts["month"].lower()[:3]))


def _year(digits: str) -> int:
    return int(digits) + (2000 if int(digits) < 100 else 0)


def _iso(year: int, month: int, day: int) -> str | None:
    if year < 1 or not 1 <= month <= 12 or not 1 <= day <= calendar.monthrange(year, month)[1]:
        return None
    return f"{year:04d}-{month:02d}-{day:02d}"


def _readings(text: str, today: date) -> Iterator[tuple[list[str], str | None]]:
    """Of each form that is found the real dates it may mean, with what is uncertain about them."""
    for form in _WITH_YEAR:
        if m := form.search(text):
            yield [_iso(_year(m["year"]), _month(m), int(m["day"]))], None
    if m := _EITHER.search(text):
        one, two, year = int(m["one"]), int(m["two"]), _year(m["year"])
        both = list(dict.fromkeys(x for x in (_iso(year, two, one), _iso(year, one, two)) if x))
        yield both, "dm_ambiguous" if len(both) == 2 else None
    for form in _WITHOUT_YEAR:
        if m := form.search(text):
            yield [_iso(y, _month(m), int(m["day"])) for y in (today.year, today.year - 1)], "year_inferred"
            break


def date_candidates(line: str, today: date) -> list[dict]:
    """The dates that a line may show, likeliest first; none for a time alone, an impossible date or an age such as ``3h``."""
    text = re.sub("[–—]", "-", re.sub("[·•*|]", " ", line.replace("\xa0", " ")))
    minute = minute_of_day(text)
    for dates, doubt in _readings(text, today):
        if dates := [d for d in dates if d]:
            return [{"iso_date": d, "minute": minute, "year_inferred": doubt == "year_inferred" or None, "dm_ambiguous": doubt == "dm_ambiguous" or None, "raw": line} for d in dates]
    return []


def is_age(line: str) -> bool:
    return bool(_AGO.fullmatch(line))


def parse_dates(line: Column, today: str) -> Column:
    """array of struct(iso_date, minute, year_inferred, dm_ambiguous, raw). ``today`` (ISO) settles dates without a year, so reruns agree."""
    ship()
    now = date.fromisoformat(today)

    @F.pandas_udf(DATE_SCHEMA)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: [] if x is None or is_age(x) else date_candidates(x, now))

    return run(line)


def edited_date(previous: Column, iso: Column) -> Column:
    """The dates field after a day was picked by hand: the time that was read stays if the day is the same."""
    minute = F.when(previous["iso_date"] == iso, previous["minute"])
    none = F.lit(None).cast("boolean")
    one = F.array(F.struct(iso.alias("iso_date"), minute.cast("int").alias("minute"), none.alias("year_inferred"), none.alias("dm_ambiguous"), iso.alias("raw")))
    return F.when(iso == "", F.array().cast(DATE_SCHEMA)).otherwise(one)
