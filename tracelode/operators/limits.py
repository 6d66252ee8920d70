"""Request limits over a sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Requests and seconds for each kind.
LIMITS = {"search": (30, 600), "snapshot": (60, 600), "syndication": (60, 600), "issue": (5, 3600)}


def rate_limited(events: DataFrame, window_seconds: int, limit: int, keys: tuple[str, ...] = ("kind", "user_id"), at: str = "ts_ms") -> DataFrame:
    """``events`` with ``in_window``, how many requests of the same keys fell into the window that ends with each, and ``allowed``.

    A window reaches into two blocks of its length at most. So events are listed under their block and the next, and
    counted within (keys, block): a user with a third of all requests is spread over time.
    """
    span = window_seconds * 1000
    block = F.floor(F.col(at) / span)
    rows = events.withColumn("__own", block).withColumn("__block", F.explode(F.array(block, block + 1)))
    over = Window.partitionBy(*keys, "__block").orderBy(at).rangeBetween(-span, 0)
    counted = rows.withColumn("in_window", F.count("*").over(over)).where("__block = __own").drop("__own", "__block")
    return counted.withColumn("allowed", F.col("in_window") <= limit)
