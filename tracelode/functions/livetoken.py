"""The token and address under which a live post's public record is asked for."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import ship

#: Fixed values of the endpoint.
LIVE_HOST = "cdn.syndication.twimg.com"
LIVE_ID = re.compile("[0-9]{1,25}")
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def to_base_36(value: float) -> str:
    """A positive double in base 36 with as many digits as tell it from its neighbours."""
    whole, fraction = math.floor(value), value - math.floor(value)
    digits: list[int] = []
    room = max(0.5 * (math.nextafter(value, math.inf) - value), math.ulp(0.0))
    while fraction >= room:
        fraction, room = fraction * 36, room * 36
        digits.append(int(fraction))
        fraction -= digits[-1]
        if (fraction > 0.5 or (fraction == 0.5 and digits[-1] % 2)) and fraction + room > 1:
            while digits:  # round up, carrying
                digits[-1] += 1
                if digits[-1] < 36:
                    break
                digits.pop()
            else:
                whole += 1
            break
    head = ""
    while whole or not head:
        whole, digit = divmod(whole, 36)
        head = _DIGITS[digit] + head
    return head + ("." + "".join(_DIGITS[d] for d in digits) if digits else "")


def live_token_of(post_id: str | None) -> str | None:
    if post_id is None or not LIVE_ID.fullmatch(post_id):
        return None
    whole, rest = divmod(int(post_id), 10**15)
    return re.sub(r"0+|\.", "", to_base_36((float(whole) + float(rest) / 1e15) * math.pi))


@F.pandas_udf(T.StringType())
def _token(ids: pd.Series) -> pd.Series:
    return ids.map(live_token_of)


def live_token(post_id: Column) -> Column:
    ship()
    return _token(post_id)


def live_url(post_id: Column) -> Column:
    return F.concat(F.lit(f"https://{LIVE_HOST}/tweet-result?id="), post_id, F.lit("&lang=en&token="), live_token(post_id))
