"""From claims to ranked captures.

Relations. ``claims``: claim_id, handle, dates (array of struct iso_date, minute, ...), and more. ``captures``:
handle, post_id (bigint), snapshot_ts, url, status, and more; id_ms comes from the id.

A claim's window becomes a range of ids, since ids are ordered in time. The join is on handle and day: claims are
listed under the few days of their window, so an account with a large part of all captures is spread over its days, and
the exact window is a residual predicate. The test also drops what was captured before the window begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import handles, ids, times, urls
from ..scratch import stage

#: How many captures a search yields, how many are compared, and when X pages stopped carrying text.
SEARCH_CAP, COMPARE_MOST, EARLY_EXIT = 500, 10, 0.93
TEXT_ERA_END = "20230701"


def with_window(claims: DataFrame, inclusive_midnight: bool = False) -> DataFrame:
    """Claims with from_ms, to_ms, min_id, max_id; all null where no date is real."""
    out = claims.withColumn("__w", times.window_of(F.transform("dates", lambda d: d["iso_date"]), inclusive_midnight))
    return out.withColumns({"from_ms": F.col("__w.from_ms"), "to_ms": F.col("__w.to_ms")}).drop("__w").withColumns({"min_id": ids.first_id(F.col("from_ms")), "max_id": ids.last_id(F.col("to_ms"))})


def readability(url: Column, ts: Column) -> Column:
    """Which captures tend to hold text: the older host's, and those of the time when pages were rendered by servers."""
    return 2 * url.contains("twitter.com").cast("int") + (ts < TEXT_ERA_END).cast("int")


def _day(ms: Column) -> Column:
    return F.floor(ms / times.DAY_MS).cast("int")


def matches(claims: DataFrame, captures: DataFrame) -> DataFrame:
    """Every capture of each claim's account whose post was made in the window: claim_id with the capture's columns."""
    found = captures.withColumn("id_ms", F.shiftright("post_id", ids.CLOCK_BITS) + ids.CLOCK_START_MS).withColumn("__day", _day(F.col("id_ms")))
    asked = claims.where("from_ms IS NOT NULL").select("claim_id", F.lower(F.trim("handle")).alias("__h"), "from_ms", "to_ms", "min_id", "max_id", F.explode(F.sequence(_day(F.col("from_ms")), _day(F.col("to_ms")))).alias("__day"))
    on = (F.col("__h") == F.col("handle")) & (asked["__day"] == found["__day"]) & F.col("post_id").between(F.col("min_id"), F.col("max_id")) & F.col("id_ms").between(F.col("from_ms"), F.col("to_ms")) & (F.col("snapshot_ts") >= times.capture_timestamp(F.col("from_ms")))
    return asked.join(found, on).drop("__h", "__day", "from_ms", "to_ms", "min_id", "max_id")


def earliest_capture(captures: DataFrame, *by: str) -> DataFrame:
    """One capture for each post (of the same ``by``): with status 200 if there is one, then the earliest."""
    order = Window.partitionBy(*by, "post_id").orderBy((F.col("status") == 200).desc(), "snapshot_ts", "url")
    return captures.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def readable_capture(captures: DataFrame, *by: str) -> DataFrame:
    """One capture for each post (of the same ``by``): with status 200 if there is one, then the most readable, then the earliest."""
    order = Window.partitionBy(*by, "post_id").orderBy((F.col("status") == 200).desc(), readability(F.col("url"), F.col("snapshot_ts")).desc(), "snapshot_ts", "url")
    return captures.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def search(claims: DataFrame, captures: DataFrame) -> DataFrame:
    """What a search yields: of each claim its captures, one a post, at most SEARCH_CAP in order of ids (``seq``)."""
    # Dealt by claim once, the rows need no further shuffle for the three windows to come.
    best = readable_capture(matches(claims, captures).repartition("claim_id"), "claim_id")
    return best.withColumn("seq", F.row_number().over(Window.partitionBy("claim_id").orderBy("post_id"))).where(F.col("seq") <= SEARCH_CAP)


def has_captures(names: DataFrame, captures: DataFrame, name: str = "handle") -> DataFrame:
    """Rows whose account has any capture under the newer host; the probe doesn't look at the older one."""
    known = captures.where(F.col("url").contains("://x.com/")).select(F.col("handle").alias("__known")).distinct()
    return names.join(known, F.col(name) == F.col("__known"), "left_semi")


def repair(claims: DataFrame, found: DataFrame, captures: DataFrame) -> DataFrame:
    """Search results of claims without any, under the first variant of their handle that has captures and yields some: claim_id, repaired_handle and the capture."""
    empty = claims.join(found.select("claim_id").distinct(), "claim_id", "left_anti")
    tries = empty.select("claim_id", "dates", "from_ms", "to_ms", "min_id", "max_id", F.posexplode(handles.repair_variants(F.col("handle"))).alias("__nth", "__variant"))
    tries = has_captures(tries, captures, "__variant")
    key = F.concat_ws(" ", F.col("claim_id").cast("string"), F.col("__nth").cast("string"))
    under = search(tries.select(key.alias("claim_id"), F.col("__variant").alias("handle"), "dates", "from_ms", "to_ms", "min_id", "max_id"), captures)
    back = under.withColumnRenamed("claim_id", "__key").join(tries.select(key.alias("__key"), "claim_id", "__nth", F.col("__variant").alias("repaired_handle")), "__key").drop("__key")
    first = F.min("__nth").over(Window.partitionBy("claim_id"))
    return back.withColumn("__first", first).where("__nth = __first").drop("__nth", "__first")


def discover(claims: DataFrame, captures: DataFrame) -> DataFrame:
    """Search with handle repair: claim_id, capture columns, seq, repaired_handle (null if none was needed)."""
    found = stage(search(claims, captures), "found")
    return found.withColumn("repaired_handle", F.lit(None).cast("string")).unionByName(repair(claims, found, captures).select(*found.columns, "repaired_handle"))


def rank(candidates: DataFrame, claims: DataFrame, most: int | None = COMPARE_MOST) -> DataFrame:
    """Candidates with time_ok, date_ok and ``position``: those whose time fits first, then unknown, then the rest; at most ``most`` a claim.

    The claim's first date counts; its day decides where no time was read. ``position`` is cut before pages are joined.
    """
    first = claims.select("claim_id", F.try_element_at("dates", F.lit(1)).alias("__d"))
    out = candidates.join(first, "claim_id").withColumns({"time_ok": times.time_consistent(F.col("__d.iso_date"), F.col("__d.minute"), F.col("id_ms")), "date_ok": times.date_consistent(F.col("__d.iso_date"), F.col("id_ms"))})
    fits = F.when(F.col("__d.minute").isNull(), F.col("date_ok")).otherwise(F.col("time_ok"))
    key = F.when(fits, 0).when(fits.isNull(), 1).otherwise(2)
    out = out.withColumn("position", F.row_number().over(Window.partitionBy("claim_id").orderBy(key, "seq"))).drop("__d")
    return out if most is None else out.where(F.col("position") <= most)


def until_convinced(scored: DataFrame, enough: float = EARLY_EXIT) -> DataFrame:
    """Scored candidates up to the first that is ``enough``, in order of position: what a search that stops there has compared."""
    before = F.max((F.col("score") >= enough).cast("int")).over(Window.partitionBy("claim_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return scored.withColumn("__done", F.coalesce(before, F.lit(0))).where("__done = 0").drop("__done")


def coverage(claims: DataFrame, candidates: DataFrame, compared: DataFrame, captures: DataFrame) -> DataFrame:
    """A row for each claim: how much was found and compared, in how many prefix buckets, whether the account is known."""
    hosts = 2
    counts = candidates.groupBy("claim_id").agg(F.count("*").alias("captures_found"), F.max("repaired_handle").alias("repaired_handle"))
    looked = compared.groupBy("claim_id").agg(F.count("*").alias("captures_compared"))
    known = has_captures(claims.select("claim_id", F.lower(F.trim("handle")).alias("handle")), captures).select("claim_id", F.lit(True).alias("__known"))
    out = claims.select("claim_id", (F.size(ids.prefix_cover(F.col("min_id"), F.col("max_id"))) * hosts).alias("buckets"), "from_ms", "to_ms").join(counts, "claim_id", "left").join(looked, "claim_id", "left").join(known, "claim_id", "left")
    return out.select(
        "claim_id", F.when(F.col("from_ms").isNotNull(), F.col("buckets")).alias("buckets"), F.coalesce("captures_found", F.lit(0)).cast("long").alias("captures_found"), F.coalesce("captures_compared", F.lit(0)).cast("long").alias("captures_compared"),
        (F.coalesce("captures_found", F.lit(0)) >= SEARCH_CAP).alias("truncated"), (F.coalesce("__known", F.lit(False)) | F.col("repaired_handle").isNotNull()).alias("handle_has_any_captures"), "repaired_handle",
    )


def candidate_columns(raw: DataFrame) -> DataFrame:
    """Rows of an index (timestamp, original, statuscode) as captures; rows whose URL is no status URL go."""
    post = urls.post_id_of(F.col("original"))
    return raw.where(post.isNotNull()).select(
        urls.handle_of(F.col("original")).alias("handle"), post.try_cast("bigint").alias("post_id"), ids.id_to_ms(post).alias("id_ms"), F.col("timestamp").alias("snapshot_ts"), F.col("original").alias("url"),
        urls.replay_url(F.col("timestamp"), F.col("original")).alias("replay_url"), F.col("statuscode").alias("status"), urls.snapshot_eligible(F.col("original")).alias("snapshot_eligible"),
    )
