"""Attestations, caches with a time to live, and one computation for like requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, similarity, times, urls
from . import evidence

#: Forms of fields, lengths, and times to live in seconds.
ATTESTATION_ID = r"^[A-Za-z0-9_-]{10}$"
SNIPPET, SCHEMA_VERSION = 140, 1
TTL_FOUND, TTL_EMPTY, TTL_SNAPSHOT, TTL_LIVE, TTL_DEAD = 30 * 86_400, 6 * 3_600, 180 * 86_400, 3_600, 600
ATTESTATION_DDL = "id string, schema_version int, verdict_code string, score double, handle string, claimed_date_iso string, snapshot_ts string, original_url string, archive_snippet string, fields_edited int, created_at long"


def request_valid(r: str = "") -> Column:
    """Whether an attestation request's fields have their forms."""
    c = lambda name: F.col(f"{r}{name}")
    minute = c("claimed_minute")
    checks = [
        c("platform") == "x", c("handle").rlike(r"^[A-Za-z0-9_]{1,15}$"), c("claimed_date_iso").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), minute.isNull() | minute.between(0, 1439), F.length(c("claimed_text")) <= 2000,
        c("fields_edited").isNotNull(), c("snapshot_ts").rlike(r"^[0-9]{14}$"), urls.snapshot_eligible(c("original_url")),
    ]
    out = F.lit(True)
    for check in checks:
        out = out & F.coalesce(check, F.lit(False))
    return out


def search_valid(platform: Column, handle: Column, from_ms: Column, to_ms: Column) -> Column:
    return F.coalesce((platform == "x") & handle.rlike(r"^[A-Za-z0-9_]{1,15}$") & from_ms.isNotNull() & to_ms.isNotNull(), F.lit(False))


def snapshot_valid(ts: Column, url: Column) -> Column:
    return F.coalesce(ts.rlike(r"^[0-9]{14}$"), F.lit(False)) & urls.snapshot_eligible(url)


def live_valid(post_id: Column) -> Column:
    return F.coalesce(post_id.rlike(r"^[0-9]{1,25}$"), F.lit(False))


def attestation_id(*parts: Column) -> Column:
    """Ten characters of a digest in the URL-safe alphabet: the same request always has the same id."""
    digest = F.base64(F.unhex(F.sha2(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256)))
    return F.substring(F.translate(digest, "+/", "-_"), 1, 10)


def issue(requests: DataFrame, texts: DataFrame, now_ms: int, compatibility: bool = True) -> DataFrame:
    """Attestations of valid requests whose page is had. Scores are computed from the page, never taken from the request.

    ``texts``: snapshot_ts, url, post. A repeated request yields one attestation.
    """
    rows = requests.where(request_valid()).join(texts.withColumnRenamed("url", "original_url"), ["snapshot_ts", "original_url"])
    ms = ids.id_to_ms(urls.post_id_of(F.col("original_url")))
    readable = similarity.is_readable(F.col("post.text"))
    rows = rows.withColumns({"__date": times.date_consistent(F.col("claimed_date_iso"), ms), "__time": times.time_consistent(F.col("claimed_date_iso"), F.col("claimed_minute"), ms), "__t": similarity.text_similarity(F.col("claimed_text"), F.when(readable, F.col("post.text")), compatibility)})
    rows = rows.withColumn("__s", similarity.gated_score(F.col("__t"), F.lit(True), F.col("__date"), F.col("__time"), readable))
    code = evidence.verdict_code(F.lit("x"), F.lit(True), F.lit(True), F.lit(False), F.col("__s.score"), F.col("__time"), readable)
    key = attestation_id(F.col("handle"), F.col("claimed_date_iso"), F.col("claimed_minute"), F.col("claimed_text"), F.col("snapshot_ts"), F.col("original_url"), F.col("fields_edited"))
    out = rows.select(
        key.alias("id"), F.lit(SCHEMA_VERSION).alias("schema_version"), code.alias("verdict_code"), F.col("__s.score").alias("score"), "handle", "claimed_date_iso", "snapshot_ts", "original_url",
        F.substring(F.coalesce("post.text", F.lit("")), 1, SNIPPET).alias("archive_snippet"), F.col("fields_edited").cast("int").alias("fields_edited"), F.lit(now_ms).cast("long").alias("created_at"),
    )
    return out.dropDuplicates(["id"])


def with_defaults(attestations: DataFrame) -> DataFrame:
    """The table's columns: defaults filled, rows without a required value gone, the first row of each id."""
    blank = {"schema_version": F.lit(SCHEMA_VERSION), "archive_snippet": F.lit(""), "fields_edited": F.lit(0)}
    columns = [c.split()[0] for c in ATTESTATION_DDL.split(", ")]
    out = attestations.withColumns({c: F.coalesce(F.col(c) if c in attestations.columns else F.lit(None), d) for c, d in blank.items()})
    for c in ("id", "verdict_code", "handle", "claimed_date_iso", "snapshot_ts", "original_url", "created_at"):
        out = out.where(F.col(c).isNotNull())
    first = Window.partitionBy("id").orderBy("created_at", "verdict_code")
    return out.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").select(*columns)


def save(attestations: DataFrame, path: str) -> None:
    """Append attestations that the store doesn't have yet, clustered by id so that a look-up reads few row groups."""
    spark = attestations.sparkSession
    rows = with_defaults(attestations)
    if _exists(spark, path):
        rows = rows.join(spark.read.schema(ATTESTATION_DDL).parquet(path).select("id"), "id", "left_anti")
    rows.repartition("id").sortWithinPartitions("id").write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def lookup(attestations: DataFrame, attestation: str) -> DataFrame:
    """The attestation of an id; an ill-formed one is an error. The equality reaches the Parquet scan."""
    if not re.fullmatch(ATTESTATION_ID[1:-1], attestation):
        raise ValueError("an attestation id has ten characters of A-Z a-z 0-9 _ -")
    return attestations.where(F.col("id") == attestation)


# --- caches -------------------------------------------------------------------------------------------------------


def query_key(handle: Column, from_ms: Column, to_ms: Column) -> Column:
    return F.concat_ws(":", F.lower(handle), from_ms.cast("string"), to_ms.cast("string"))


def search_cache_key(key: Column) -> Column:
    return F.concat(F.lit("cdx:v1:"), key)


def snapshot_cache_key(ts: Column, url: Column) -> Column:
    return F.concat(F.lit("snap:v1:"), ts, F.lit(":"), url)


def search_ttl(empty: Column) -> Column:
    return F.when(empty, TTL_EMPTY).otherwise(TTL_FOUND)


def live_ttl(status: Column) -> Column:
    return F.when(status == "live", TTL_LIVE).otherwise(TTL_DEAD)


def cache_lookup(requests: DataFrame, entries: DataFrame, block: int = 86_400) -> DataFrame:
    """Requests (request_id, key, at) with the value that a cache of ``entries`` (key, value, written_at, ttl_sec) had then.

    The latest write up to the request counts, if it hasn't expired. Writes and reads of a key are merged into one
    stream, so no request meets more than one entry: the last write before each is carried along. Streams are cut into
    blocks of ``block`` seconds, each of which begins with the last write before it, so a key with a third of all rows is
    spread over its blocks.
    """
    kinds = dict(entries.dtypes)
    entry = f"struct<written_at:{kinds['written_at']},value:{kinds['value']},ttl_sec:{kinds['ttl_sec']}>"
    none = lambda kind: F.lit(None).cast(kind)
    of = lambda at: F.floor(F.col(at) / block)
    # Of two writes at one time the greater value stands, so that reruns agree.
    written = entries.select("key", F.struct("written_at", "value", "ttl_sec").alias("__e"), F.col("written_at").alias("__at"), of("written_at").alias("__block"))
    asked = requests.select("key", "request_id", F.col("at").alias("__at"), of("at").alias("__block"))
    last = written.groupBy("key", "__block").agg(F.max("__e").alias("__e"))
    marks = last.unionByName(asked.select("key", "__block").distinct().withColumn("__e", none(entry)))
    marks = marks.groupBy("key", "__block").agg(F.max("__e").alias("__e"))
    before = Window.partitionBy("key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("__e", F.last("__e", ignorenulls=True).over(before)).where(F.col("__e").isNotNull())
    kind = dict(requests.dtypes)["request_id"]
    stream = (
        carried.select("key", "__block", F.col("__e.written_at").alias("__at"), F.lit(0).alias("__is"), none(kind).alias("request_id"), "__e")
        .unionByName(written.select("key", "__block", "__at", F.lit(0).alias("__is"), none(kind).alias("request_id"), "__e"))
        .unionByName(asked.select("key", "__block", "__at", F.lit(1).alias("__is"), "request_id", none(entry).alias("__e")))
    )
    order = Window.partitionBy("key", "__block").orderBy("__at", "__is", "__e").rowsBetween(Window.unboundedPreceding, 0)
    rows = stream.withColumn("__last", F.last("__e", ignorenulls=True).over(order)).where("__is = 1")
    fresh = F.col("__at") <= F.col("__last.written_at") + F.col("__last.ttl_sec")
    return rows.select("request_id", "key", F.col("__at").alias("at"), F.when(fresh, F.col("__last.value")).alias("value"), F.coalesce(fresh, F.lit(False)).alias("hit"))


def newest_entries(entries: DataFrame, most: int) -> DataFrame:
    """What a cache of ``most`` keys keeps when the oldest inserted goes first: its limit is the feature."""
    first = entries.groupBy("key").agg(F.min("written_at").alias("__first"), F.max(F.struct("written_at", "value", "ttl_sec")).alias("__e"))
    kept = first.orderBy(F.col("__first").desc(), F.col("key").desc()).limit(most)
    return kept.select("key", "__e.value", "__e.written_at", "__e.ttl_sec")


def coalesced(requests: DataFrame, key: str, compute) -> DataFrame:
    """``compute`` on one row for each key, its columns joined back to all requests of the key."""
    return requests.join(compute(requests.select(key).distinct()), key, "left")
