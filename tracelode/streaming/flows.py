"""Streams of requests and edits.

The batch operators are exact; a stream bounds its state with a watermark (``late``), so what comes later than that is
not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import LIMITS
from ..scratch import ship


def sliding_counts(requests: DataFrame, kind: str, late: str = "2 minutes", step: str = "60 seconds") -> DataFrame:
    """Requests (ts, user_id) of a kind in sliding windows of its limit's length: user_id, window, n, over_limit."""
    limit, seconds = LIMITS[kind]
    counts = requests.withWatermark("ts", late).groupBy("user_id", F.window("ts", f"{seconds} seconds", step)).agg(F.count("*").alias("n"))
    return counts.withColumn("over_limit", F.col("n") > limit)


def distinct_requests(requests: DataFrame, key: str = "query_key", late: str = "10 minutes") -> DataFrame:
    """The first request (ts, key) of each key within the watermark: requests in flight share one computation."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def settled_edits(edits: DataFrame, quiet: str = "500 milliseconds", late: str = "2 seconds") -> DataFrame:
    """The last edit (ts, claim_id, value) of each burst: a burst ends when nothing came for ``quiet``."""
    bursts = edits.withWatermark("ts", late).groupBy("claim_id", F.session_window("ts", quiet))
    return bursts.agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts")).select("claim_id", "ts", "value")


def cached_values(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """A cache over a stream of (key, at timestamp, value, ttl_sec, request_id): writes have a value, reads a request_id.

    A read gets the latest value written before it that hasn't expired: request_id, key, value, hit. The state of a key
    is its last entry, and goes when that has expired.
    """
    ship(events.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, until = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        # Writes go before reads of the same time.
        rows = pd.concat(list(frames))
        rows = rows.assign(is_read=rows["value"].isna()).sort_values(["at", "is_read"], kind="stable")
        for row in rows.itertuples():
            now = row.at.value // 1_000_000
            if not row.is_read:
                value, until = row.value, now + int(row.ttl_sec) * 1000
            else:
                hit = value is not None and now <= until
                out.append((row.request_id, key[0], value if hit else None, hit))
        if value is not None:
            state.update((value, until))
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["request_id", "key", "value", "hit"])

    return events.withWatermark("at", late).groupBy("key").applyInPandasWithState(step, "request_id string, key string, value string, hit boolean", "value string, until long", "append", GroupStateTimeout.EventTimeTimeout)
