"""Claims from the recognised lines of a screenshot.

``lines``: shot_id, line_no, text, confidence, bbox (struct x, y, w, h). Handles and dates are found line by line; lines
are then gathered by screenshot, which has a few dozen, and read from top to bottom.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, handles
from ..functions import lines as text_lines
from ..scratch import ship

#: Fixed value: how a handle looks when recognised; the sign before it may be misread.
MENTION = re.compile(r"[@©Q€]\s?([A-Za-z0-9_]{1,15})")
_MENTIONS = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("whole_line", T.BooleanType())]))


def mentions_in(text: str | None) -> list[dict]:
    """Handles on a line. Inside a word or before a domain's ending it is an address; such a match uses up its text all the same."""
    out = []
    for m in MENTION.finditer(text or ""):
        before, after = text[: m.start()], text[m.end() :]
        if not re.search(r"[A-Za-z0-9_.]$", before) and not re.match(r"\.[A-Za-z]", after):
            out.append({"value": m[1].lower(), "at": m.start(), "whole_line": not before.strip() and not after.strip()})
    return out


@F.pandas_udf(_MENTIONS)
def _mentions(text: pd.Series) -> pd.Series:
    return text.map(mentions_in)


def mentions(text: Column) -> Column:
    ship()
    return _mentions(text)


def best_mention(all_lines: Column) -> Column:
    """Of lines (struct line_no, mentions, ...) in order: alone on its line first, then the longest, the topmost, the leftmost."""
    each = F.flatten(F.transform(all_lines, lambda line: F.transform(line["mentions"], lambda m: F.struct((~m["whole_line"]).alias("a"), (-F.length(m["value"])).alias("b"), line["line_no"].alias("line_no"), m["at"].alias("at"), m["value"].alias("value")))))
    return F.when(F.size(each) > 0, F.array_min(each))


def union_box(boxes: Column) -> Column:
    """The least box (struct x, y, w, h) around all; null of none."""
    edge = lambda pick, f: pick(F.transform(boxes, f))
    x, y = edge(F.array_min, lambda b: b["x"]), edge(F.array_min, lambda b: b["y"])
    right, bottom = edge(F.array_max, lambda b: b["x"] + b["w"]), edge(F.array_max, lambda b: b["y"] + b["h"])
    return F.when(F.size(boxes) > 0, F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h")))


def mean_confidence(rows: Column) -> Column:
    total = F.aggregate(rows, F.lit(0.0), lambda s, r: s + F.coalesce(r["confidence"], F.lit(0.0)))
    return F.when(F.size(rows) > 0, total / F.size(rows)).otherwise(0.0)


def read_screens(lines: DataFrame, today: str) -> DataFrame:
    """A claim for each screenshot: platform, display_name, handle, text, dates (each with its confidence and box)."""
    rows = lines.select(
        "shot_id", F.col("line_no").cast("int").alias("line_no"), F.coalesce("text", F.lit("")).alias("text"), F.trim(F.coalesce("text", F.lit(""))).alias("trimmed"), F.col("confidence").cast("double").alias("confidence"), "bbox",
        mentions(F.col("text")).alias("mentions"), dates.parse_dates(F.trim("text"), today).alias("dates"),
    )
    rows = rows.withColumn("chrome", text_lines.is_chrome_line(F.col("trimmed")))
    one = F.struct("line_no", "text", "trimmed", "confidence", "bbox", "mentions", "dates", "chrome")
    shots = rows.groupBy("shot_id").agg(F.array_sort(F.collect_list(one), lambda a, b: a["line_no"] - b["line_no"]).alias("all"))
    shots = shots.withColumn("found", best_mention(F.col("all")))
    shots = shots.withColumn("own", F.try_element_at(F.filter("all", lambda r: r["line_no"] == F.col("found.line_no")), F.lit(1)))
    above = F.filter("all", lambda r: r["line_no"] < F.col("found.line_no"))
    first_text = F.filter("all", lambda r: r["trimmed"] != "")
    prefix = F.trim(F.substring(F.col("own.text"), F.lit(1), F.col("found.at")))
    last_above = F.try_element_at(above, F.lit(-1))
    name = (
        F.when(F.col("found").isNull(), F.struct(F.try_element_at(first_text, F.lit(1))["trimmed"].alias("value"), F.try_element_at(first_text, F.lit(1)).alias("line")))
        .when(F.size(above) > 0, F.struct(F.nullif(last_above["trimmed"], F.lit("")).alias("value"), last_above.alias("line")))
        .otherwise(F.struct(F.nullif(prefix, F.lit("")).alias("value"), F.col("own").alias("line")))
    )
    shots = shots.withColumn("name", name).withColumn("stamp", F.try_element_at(F.filter("all", lambda r: (r["trimmed"] != "") & (F.size(r["dates"]) > 0)), F.lit(-1)))
    head = F.coalesce(F.col("found.line_no"), F.when(F.col("name.value").isNotNull(), F.col("name.line.line_no")), F.lit(-1))
    end = F.coalesce(F.col("stamp.line_no"), F.lit(2**31 - 1))
    shots = shots.withColumn("body", F.filter("all", lambda r: (r["line_no"] > head) & (r["line_no"] < end) & (r["trimmed"] != "") & ~r["chrome"]))
    text = F.nullif(text_lines.join_body(F.transform("body", lambda r: r["trimmed"])), F.lit(""))
    signal = text_lines.has_platform_signal(F.transform("all", lambda r: r["text"]))
    field = lambda value, confidence, box: F.struct(value.alias("value"), confidence.alias("confidence"), box.alias("bbox"), F.lit("ocr").alias("source"))
    named = F.col("name.value").isNotNull()
    return shots.select(
        "shot_id", F.when(F.col("found").isNotNull() & signal, "x").otherwise("unknown").alias("platform"),
        field(F.col("name.value"), F.when(named, F.col("name.line.confidence")).otherwise(0.0), F.when(named, F.col("name.line.bbox"))).alias("display_name"),
        field(F.col("found.value"), F.coalesce("own.confidence", F.lit(0.0)), F.col("own.bbox")).alias("handle"),
        field(text, F.when(text.isNotNull(), mean_confidence(F.col("body"))).otherwise(0.0), F.when(text.isNotNull(), union_box(F.transform("body", lambda r: r["bbox"])))).alias("text"),
        field(F.coalesce("stamp.dates", F.array().cast(dates.DATE_SCHEMA)), F.coalesce("stamp.confidence", F.lit(0.0)), F.col("stamp.bbox")).alias("dates"),
        F.lit("eng").alias("language"),
    )


def as_claims(screens: DataFrame) -> DataFrame:
    """The columns that the search takes."""
    return screens.select(F.col("shot_id").alias("claim_id"), "platform", F.col("handle.value").alias("handle"), F.col("text.value").alias("text"), F.col("dates.value").alias("dates"))


def with_edits(claims: DataFrame, edits: DataFrame) -> DataFrame:
    """Claims with fields that a user set (claim_id, handle, text, iso_date; null: as read); ``fields_edited`` tells where."""
    e = edits.select("claim_id", handles.handle_input(F.col("handle")).alias("__handle"), F.col("text").alias("__text"), F.col("iso_date").alias("__iso"))
    rows = claims.join(e, "claim_id", "left")
    date = dates.edited_date(F.try_element_at("dates", F.lit(1)), F.col("__iso"))
    touched = F.col("__handle").isNotNull() | F.col("__text").isNotNull() | F.col("__iso").isNotNull()
    return rows.withColumns({"handle": F.coalesce("__handle", "handle"), "text": F.coalesce("__text", "text"), "dates": F.when(F.col("__iso").isNull(), F.col("dates")).otherwise(date), "fields_edited": touched}).drop("__handle", "__text", "__iso")


def field_flags(screens: DataFrame) -> DataFrame:
    """Which fields of a claim are missing, and whether its handle is uncertain."""
    blank = lambda c: F.trim(F.coalesce(F.col(f"{c}.value"), F.lit(""))) == ""
    return screens.select("shot_id", blank("handle").alias("missing_handle"), (F.size("dates.value") == 0).alias("missing_date"), blank("text").alias("missing_text"), (~blank("handle") & (F.col("handle.source") == "ocr") & (F.col("handle.confidence") < 0.5)).alias("uncertain_handle"))
