"""Hashed client addresses and redacted logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a key that mark personal content.
PRIVATE_KEYS = r"(?i)ip|ocr|image|screenshot|text"


def hashed_address(address: Column, day: Column) -> Column:
    """SHA-256 of the UTC date and the address, so that hashes of two days can't be joined."""
    return F.sha2(F.concat_ws(":", day, address).cast("binary"), 256)


def client_address(edge: Column, forwarded: Column) -> Column:
    """The edge's header, else the first forwarded address, else ``unknown``."""
    return F.coalesce(F.nullif(edge, F.lit("")), F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), F.lit("unknown"))


def redacted(fields: Column) -> Column:
    """A map without the keys that hold a private part anywhere."""
    return F.map_filter(fields, lambda k, _: ~k.rlike(PRIVATE_KEYS))


def log_line(event: Column, fields: Column) -> Column:
    return F.to_json(F.map_concat(F.create_map(F.lit("event"), event), redacted(fields)))


def error_fields(code: Column, message: Column, retry_after_ms: Column) -> Column:
    """struct(code, message, retry_after_ms) of a known error; any other becomes INTERNAL."""
    known = F.struct(code.alias("code"), message.alias("message"), retry_after_ms.cast("long").alias("retry_after_ms"))
    other = F.struct(F.lit("INTERNAL").alias("code"), F.lit("Internal error").alias("message"), F.lit(None).cast("long").alias("retry_after_ms"))
    return F.when(code.isNotNull(), known).otherwise(other)
