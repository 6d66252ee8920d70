"""Exact deduplication by two-pass Bloom filtering, with DataFrame functions only.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Their identity is the SHA-256 of the
normalised text.

Pass 1 hashes every digest to two cells of a filter with 16 cells a row and counts the hits of each cell; the filter
keeps one bit for each cell hit twice or more. Equal texts hit equal cells, so a row with either cell unset has no
equal: it passes straight through in pass 2. Only rows with both set, the possibly repeated, shuffle; they are grouped by
digest after each task has combined its own, so a text with a third of all rows sends one row a task.

The filter has 2 bytes a row. Up to BROADCAST_BYTES it is broadcast; beyond that the probe is a join on the filter's
buckets, which shuffles digests, ids and numbers of rows, but never texts or other columns.

Defined results. Of equal texts the row with the largest doc_id stays (null is smaller than any); among rows of the
same doc_id the last as they stand in the files. Empty table: no rows. Columns of any name and type are taken as they
are; names of this module begin with ``__tl_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CELLS_PER_ROW = 16
_BUCKET = 1 << 15  # cells of one bitmap, as bitmap_construct_agg makes them


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(common.ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _cells(digest: Column, cells: int) -> tuple[Column, Column]:
    return tuple(F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(cells)) for k in (1, 2))


def repeated_filter(digests: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """(``__tl_bucket``, ``__tl_bits``) of the cells that two or more of ``digests`` (column ``__tl_digest``) hit, and how many cells there are."""
    cells = max(_BUCKET, 1 << (CELLS_PER_ROW * rows - 1).bit_length())
    hits = digests.select(F.explode(F.array(*_cells(F.col("__tl_digest"), cells))).alias("__tl_cell"))
    twice = hits.groupBy("__tl_cell").agg(F.count("*").alias("__tl_n")).where("__tl_n >= 2")
    bits = twice.groupBy(F.expr(f"__tl_cell div {_BUCKET}").alias("__tl_bucket")).agg(F.expr(f"bitmap_construct_agg(__tl_cell % {_BUCKET})").alias("__tl_bits"))
    return bits, cells


def _probe(df: DataFrame, bits: DataFrame, cells: int, digest: Column) -> DataFrame:
    """``df`` with ``__tl_maybe``: whether both cells of ``digest`` are set."""
    side = common.bounded_broadcast(bits, cells // _BUCKET, _BUCKET // 8 + 64)
    maybe = F.lit(True)
    for k, cell in enumerate(_cells(digest, cells)):
        df = df.withColumn(f"__tl_b{k}", F.floor(cell / _BUCKET).cast("long")).withColumn(f"__tl_p{k}", (cell % _BUCKET).cast("int"))
        df = df.join(side.select(F.col("__tl_bucket").alias(f"__tl_b{k}"), F.col("__tl_bits").alias(f"__tl_bits{k}")), f"__tl_b{k}", "left")
        byte = F.expr(f"cast(conv(hex(substring(__tl_bits{k}, __tl_p{k} div 8 + 1, 1)), 16, 10) as bigint)")
        maybe = maybe & F.coalesce(F.getbit(byte, F.col(f"__tl_p{k}") % 8) == 1, F.lit(False))
    return df.withColumn("__tl_maybe", maybe).drop(*(f"__tl_{x}{k}" for x in ("b", "p", "bits") for k in (0, 1)))


def dedup_report(docs: DataFrame) -> DataFrame:
    """A row for each document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", text_digest(F.col("text")).alias("__tl_digest"), F.monotonically_increasing_id().alias("__tl_row"))
    rows = common.stage(rows, "dedup-digests")
    n = rows.count()
    bits, cells = repeated_filter(rows, n)
    bits = common.stage(bits, "dedup-filter")
    probed = _probe(rows, bits, cells, F.col("__tl_digest"))
    # Two reads of the digests: what can't repeat goes on as it is, the rest is grouped.
    groups = probed.where("__tl_maybe").groupBy("__tl_digest").agg(F.max(F.struct("doc_id", "__tl_row")).alias("__tl_top"), F.count("*").alias("__tl_n")).where("__tl_n >= 2")
    groups = common.stage(groups, "dedup-groups")
    side = common.bounded_broadcast(groups, groups.count(), 96)
    found = probed.where("__tl_maybe").join(side, "__tl_digest", "left")
    alone = probed.where("NOT __tl_maybe")
    return found.select(
        "doc_id", F.when(F.col("__tl_n").isNull(), F.col("doc_id")).otherwise(F.col("__tl_top.doc_id")).alias("keep_id"), F.coalesce("__tl_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__tl_n").isNull() | (F.col("__tl_top.__tl_row") == F.col("__tl_row"))).alias("kept"), F.lower(F.hex("__tl_digest")).alias("text_sha256"),
    ).unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("__tl_digest")).alias("text_sha256")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only digests, ids and numbers of rows shuffle, and of the possibly repeated only."""
    numbered = common.Numbered(docs, "dedup-documents")
    rows = numbered.rows().select(text_digest(F.col(f"`{text_col}`")).alias("__tl_digest"), F.col(f"`{id_col}`").alias("__tl_id"), "__tl_row")
    rows = common.stage(rows, "dedup-digests")
    bits, cells = repeated_filter(rows, rows.count())
    maybe = _probe(rows, common.stage(bits, "dedup-filter"), cells, F.col("__tl_digest")).where("__tl_maybe").drop("__tl_maybe")
    groups = maybe.groupBy("__tl_digest").agg(F.max(F.struct("__tl_id", "__tl_row")).alias("__tl_top"), F.count("*").alias("__tl_n")).where("__tl_n >= 2")
    groups = common.stage(groups.select("__tl_digest", F.col("__tl_top.__tl_row").alias("__tl_stay")), "dedup-groups")
    side = common.bounded_broadcast(groups, groups.count(), 96)
    return numbered.without(maybe.join(side, "__tl_digest").where("__tl_row <> __tl_stay").select("__tl_row"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(common.table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
