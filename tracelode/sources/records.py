"""Live posts, bundled claims and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an image may be.
IMAGE_SUFFIX, IMAGE_BYTES = r"(?i)\.(png|jpe?g|webp)$", 15 * 1024 * 1024
_LIVE = "struct<__typename:string,text:string,created_at:string,favorite_count:bigint,user:struct<screen_name:string>>"


def parse_live(post_id: Column, body: Column) -> Column:
    """struct(post_id, status, text, screen_name, created_at_iso, favorite_count) of an answer; unavailable unless it is a post with text."""
    j = F.from_json(body, _LIVE)
    live = (F.coalesce(j["__typename"], F.lit("Tweet")) == "Tweet") & (F.trim(F.coalesce(j["text"], F.lit(""))) != "")
    given = lambda c: F.when(live, c)
    return F.struct(post_id.alias("post_id"), F.when(live, "live").otherwise("unavailable").alias("status"), given(j["text"]).alias("text"), given(j["user"]["screen_name"]).alias("screen_name"), given(j["created_at"]).alias("created_at_iso"), given(j["favorite_count"]).alias("favorite_count"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Claims bundled as JSON files: always of the platform, with their first date only."""
    field = "struct<value:string>"
    schema = f"displayName {field}, handle {field}, text {field}, dates struct<value:array<struct<isoDate:string,raw:string>>>, language string"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    d = F.try_element_at("dates.value", F.lit(1))
    none = F.lit(None)
    date = F.struct(d["isoDate"].alias("iso_date"), none.cast("int").alias("minute"), none.cast("boolean").alias("year_inferred"), none.cast("boolean").alias("dm_ambiguous"), F.coalesce(d["raw"], F.lit("")).alias("raw"))
    return rows.select(F.col("handle.value").alias("claim_id"), F.lit("x").alias("platform"), F.col("displayName.value").alias("display_name"), F.col("handle.value").alias("handle"), F.col("text.value").alias("text"), F.filter(F.array(F.when(d["isoDate"].isNotNull(), date)), lambda x: x.isNotNull()).alias("dates"), F.coalesce("language", F.lit("en")).alias("language"))


def image_accepted(path: Column, length: Column) -> Column:
    return path.rlike(IMAGE_SUFFIX) & (length <= IMAGE_BYTES)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images that are taken in: path, length, content."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.where(image_accepted(F.col("path"), F.col("length"))).select("path", "length", "content")
