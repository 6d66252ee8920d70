"""The relations of the domain from the driver's tables, in Spark and, by the same expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, times, urls

CLOCK = ids.CLOCK_START_MS
_DATE = "struct<iso_date:string,minute:int,year_inferred:boolean,dm_ambiguous:boolean,raw:string>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _name(user: Column) -> Column:
    return F.concat(F.lit("user_"), F.translate(user.cast("string"), "0123456789", "abcdefghij"))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", ms.alias("ms"))
    return rows.withColumn("post_id", F.shiftleft(F.col("ms") - CLOCK, ids.CLOCK_BITS) + F.col("event_id") % (1 << ids.CLOCK_BITS)).withColumn("account", _name(F.col("user_id")))


def post_text(account: Column, kind: Column, number: Column) -> Column:
    return F.concat(F.lit("Account "), account, F.lit(" reported a "), kind, F.lit(" as number "), number.cast("string"), F.lit(" of the evening service"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two captures of each event's post, under either host, the second a day later: handle, post_id, snapshot_ts, url, status, event_id."""
    base = _base(spark, sf_dir)
    one = lambda copy: base.select(
        F.col("account").alias("handle"), "post_id", times.capture_timestamp(F.col("ms") + (F.col("event_id") % 90 + copy) * times.DAY_MS).alias("snapshot_ts"),
        F.concat(F.when((F.col("event_id") + copy) % 2 == 0, "https://x.com/").otherwise("https://twitter.com/"), "account", F.lit("/status/"), F.col("post_id").cast("string")).alias("url"),
        (F.when(F.col("event_type") == "error", 404).otherwise(200) if copy == 0 else F.when(F.col("event_id") % 3 == 0, 302).otherwise(200)).alias("status"), "event_id",
    )
    return one(0).unionByName(one(1))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each event: claim_id, platform, handle, text, dates. Some handles and texts are misread, some have no time, one in 17 no date."""
    base = _base(spark, sf_dir)
    shown = F.timestamp_millis(F.col("ms") + (F.col("event_id") % 27 - 12) * times.HOUR_MS)
    iso = F.date_format(shown, "yyyy-MM-dd")
    minute = F.when(F.col("event_id") % 13 != 0, F.hour(shown) * 60 + F.minute(shown))
    date = F.struct(iso.alias("iso_date"), minute.cast("int").alias("minute"), F.lit(None).cast("boolean").alias("year_inferred"), F.lit(None).cast("boolean").alias("dm_ambiguous"), iso.alias("raw"))
    said = post_text(F.col("account"), F.col("event_type"), F.col("event_id"))
    return base.select(
        F.col("event_id").alias("claim_id"), F.when(F.col("event_id") % 19 == 0, "unknown").otherwise("x").alias("platform"), F.when(F.col("event_id") % 11 == 0, F.replace("account", F.lit("s"), F.lit("5"))).otherwise(F.col("account")).alias("handle"),
        F.when(F.col("event_id") % 7 == 0, F.replace(said, F.lit("o"), F.lit("0"))).otherwise(said).alias("text"), F.when(F.col("event_id") % 17 != 0, F.array(date)).otherwise(F.array().cast(f"array<{_DATE}>")).alias("dates"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each capture: snapshot_ts, url, html, content_type. One in five is a shell without the post's text."""
    kinds = read(spark, sf_dir, "events").select("event_id", "event_type")
    rows = captures(spark, sf_dir).join(kinds, "event_id")
    text = post_text(F.col("handle"), F.col("event_type"), F.col("event_id"))
    title = F.when(F.col("event_id") % 5 == 0, "X").otherwise(F.concat("handle", F.lit(' on X: "'), text, F.lit('" / X')))
    return rows.select("snapshot_ts", "url", F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body></body></html>")).alias("html"), F.lit("text/html").alias("content_type"))


def live_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live record of each event's post: post_id, status, text, screen_name. One in four is gone."""
    base = _base(spark, sf_dir)
    there = F.col("event_id") % 4 != 3
    return base.select("post_id", F.when(there, "live").otherwise("unavailable").alias("status"), F.when(there, post_text(F.col("account"), F.col("event_type"), F.col("event_id"))).alias("text"), F.when(there, F.col("account")).alias("screen_name"))


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures as an index lists them: timestamp, original, statuscode."""
    rows = captures(spark, sf_dir)
    return rows.select(F.col("snapshot_ts").alias("timestamp"), F.col("url").alias("original"), F.col("status").alias("statuscode"))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(spark, sf_dir).withColumn("replay_url", urls.replay_url(F.col("snapshot_ts"), F.col("url")))


#: The same relations for DuckDB: WITH clauses that a query's SQL begins with.
_STAMP = "strftime(make_timestamp(({ms}) * 1000), '%Y%m%d%H%M%S')"
BASE_SQL = f"""base AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, ((epoch_us(ts) // 1000 - {CLOCK}) << 22) + event_id % 4194304 AS post_id,
    'user_' || translate(CAST(user_id AS VARCHAR), '0123456789', 'abcdefghij') AS account FROM events)"""
_SAID = "'Account ' || account || ' reported a ' || event_type || ' as number ' || event_id || ' of the evening service'"
CAPTURES_SQL = f"""{BASE_SQL}, captures AS (
  SELECT account AS handle, post_id, {_STAMP.format(ms="ms + (event_id % 90) * 86400000")} AS snapshot_ts, CASE WHEN event_id % 2 = 0 THEN 'https://x.com/' ELSE 'https://twitter.com/' END || account || '/status/' || post_id AS url,
    CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status, event_id FROM base
  UNION ALL
  SELECT account, post_id, {_STAMP.format(ms="ms + (event_id % 90 + 1) * 86400000")}, CASE WHEN event_id % 2 = 1 THEN 'https://x.com/' ELSE 'https://twitter.com/' END || account || '/status/' || post_id,
    CASE WHEN event_id % 3 = 0 THEN 302 ELSE 200 END, event_id FROM base)"""
CLAIMS_SQL = f"""claims AS (
  SELECT event_id AS claim_id, CASE WHEN event_id % 19 = 0 THEN 'unknown' ELSE 'x' END AS platform, CASE WHEN event_id % 11 = 0 THEN replace(account, 's', '5') ELSE account END AS handle,
    CASE WHEN event_id % 7 = 0 THEN replace({_SAID}, 'o', '0') ELSE {_SAID} END AS text,
    CASE WHEN event_id % 17 <> 0 THEN strftime(make_timestamp((ms + (event_id % 27 - 12) * 3600000) * 1000), '%Y-%m-%d') END AS iso,
    CASE WHEN event_id % 17 <> 0 AND event_id % 13 <> 0 THEN CAST(hour(make_timestamp((ms + (event_id % 27 - 12) * 3600000) * 1000)) * 60 + minute(make_timestamp((ms + (event_id % 27 - 12) * 3600000) * 1000)) AS INTEGER) END AS minute FROM base)"""
WINDOWS_SQL = """windows AS (SELECT *, epoch_ms(CAST(iso AS TIMESTAMP)) - 50400000 AS from_ms, epoch_ms(CAST(iso AS TIMESTAMP)) + 86399000 + 43200000 AS to_ms FROM claims)"""
MATCHES_SQL = f"""matches AS (
  SELECT w.claim_id, w.iso, w.minute, c.*, (c.post_id >> 22) + {CLOCK} AS id_ms FROM windows w JOIN captures c ON lower(w.handle) = c.handle
    AND (c.post_id >> 22) + {CLOCK} BETWEEN w.from_ms AND w.to_ms AND c.snapshot_ts >= {_STAMP.format(ms="w.from_ms")})"""
READABLE_ORDER = "(status = 200) DESC, 2 * CAST(contains(url, 'twitter.com') AS INTEGER) + CAST(snapshot_ts < '20230701' AS INTEGER) DESC, snapshot_ts, url"
OFFSET_SQL = "CAST(floor((epoch_ms(CAST(iso AS TIMESTAMP)) + minute * 60000 - id_ms) / 60000.0 + 0.5) AS INTEGER)"
TIME_OK_SQL = f"({OFFSET_SQL} BETWEEN -722 AND 842 AND ((({OFFSET_SQL} % 15) + 15) % 15 <= 2 OR (({OFFSET_SQL} % 15) + 15) % 15 >= 13))"
DATE_OK_SQL = "(iso IN (strftime(make_timestamp((id_ms - 43200000) * 1000), '%Y-%m-%d'), strftime(make_timestamp(id_ms * 1000), '%Y-%m-%d'), strftime(make_timestamp((id_ms + 50400000) * 1000), '%Y-%m-%d')))"
SEARCH_SQL = f"""picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, post_id ORDER BY {READABLE_ORDER}) AS rn FROM matches) WHERE rn = 1),
searched AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY post_id) AS seq FROM picked) WHERE seq <= 500)"""
RANKED_SQL = f"""judged AS (SELECT *, {TIME_OK_SQL} AS time_ok, {DATE_OK_SQL} AS date_ok FROM searched),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY CASE WHEN (CASE WHEN minute IS NULL THEN date_ok ELSE time_ok END) THEN 0 WHEN (CASE WHEN minute IS NULL THEN date_ok ELSE time_ok END) IS NULL THEN 1 ELSE 2 END, seq) AS position FROM judged) WHERE position <= 10)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
