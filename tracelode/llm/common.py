"""What the operators of this subpackage share: scratch tables, shipping, batches and running offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from ..scratch import BROADCAST_BYTES, bounded_broadcast, scratch_path, stage  # noqa: F401  operators take them from here

#: Rows of an Arrow batch to Python. Texts make batches large in bytes, and both sides hold whole batches.
ARROW_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application, and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    scratch.ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for texts without other letters; it is much faster than ``translate``."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def sub_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that what a worker holds doesn't follow Arrow's row count. A longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = np.cumsum(n) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def add_from_texts(docs: DataFrame, text_col: str, keep: list[str] | None, fields: list[T.StructField], compute: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), whatever their names and types, and what ``compute`` makes of the texts of a batch."""
    ship(docs.sparkSession)
    names = docs.columns if keep is None else keep
    # To Python, columns go by number: there, names with dots would be taken for fields. A text that is kept goes once.
    whole = names.index(text_col) if text_col in names and docs.schema[text_col].dataType == T.StringType() else -1
    at = {i: "__tl_text" if i == whole else f"__tl_c{i}" for i in range(len(names))}
    rows = docs.select(*(F.col(f"`{c}`").alias(at[i]) for i, c in enumerate(names) if i != whole), F.col(f"`{text_col}`").cast("string").alias("__tl_text"))
    passed, new = rows.columns, [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "__tl_text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(texts(batch.column("__tl_text")))], names=[*passed, *new])

    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields, *fields]))
    return out.select(*(F.col(at[i]).alias(c) for i, c in enumerate(names)), *new)


_FILE = 40  # a row's number: that of its file, then so many bits for its place there
_FILES = 50_000  # whose paths are broadcast at once
_BLOCK = 15  # of places; a bitmap of bitmap_construct_agg has so many


class Numbered:
    """A table of files whose rows have numbers, ``__tl_row``, that stay the same whenever it is read: of a row's file and its place there.

    A table just read from files is taken as it is; anything else is written first.
    """

    def __init__(self, docs: DataFrame, name: str):
        if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
            docs = stage(docs, name)
        self.docs = docs
        self.paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # as many as files

    def rows(self, first: int = 0, last: int | None = None) -> DataFrame:
        """Rows of the files from ``first`` to before ``last`` (all by default), with their numbers."""
        last = len(self.paths) if last is None else last
        if last - first > _FILES:
            return reduce(DataFrame.unionAll, [self.rows(a, min(a + _FILES, last)) for a in range(first, last, _FILES)])
        paths = self.paths[first:last]
        own = [F.col(f"`{c}`") for c in self.docs.columns]
        files = self.docs.sparkSession.range(1).select(F.posexplode(F.lit(paths) if paths else F.array().cast("array<string>")).alias("__tl_file", "__tl_path"))
        files = F.broadcast(files.withColumn("__tl_file", F.col("__tl_file").cast("long") + first))  # at most _FILES paths
        some = self.docs if len(paths) == len(self.paths) else self.docs.where(F.col("_metadata.file_path").isin(paths))
        some = some.select(*own, F.col("_metadata.file_path").alias("__tl_path"), F.col("_metadata.row_index").alias("__tl_index"))
        return some.join(files, "__tl_path").select(*own, (F.shiftleft("__tl_file", _FILE) + F.col("__tl_index")).alias("__tl_row"))

    def without(self, drop: DataFrame) -> DataFrame:
        """The rows as they were, without those whose number is in ``drop`` (``__tl_row``)."""
        return self.picked(drop, False).select(*(F.col(f"`{c}`") for c in self.docs.columns))

    def picked(self, numbers: DataFrame, inside: bool, limit: int = BROADCAST_BYTES) -> DataFrame:
        """The rows, with their numbers, whose number is in ``numbers`` (``__tl_row``), or else is not. They never shuffle.

        ``numbers`` become bitmaps of blocks of places, which are broadcast; if all of them are more than ``limit`` bytes, files
        are taken in groups, each with the bitmaps of its own files.
        """
        bits = numbers.groupBy(F.shiftright("__tl_row", _BLOCK).alias("__tl_block")).agg(F.expr(f"bitmap_construct_agg(__tl_row & {(1 << _BLOCK) - 1})").alias("__tl_bits"))
        bits = stage(bits, "rows-picked")
        blocks = {r[0]: r[1] for r in bits.groupBy(F.shiftright("__tl_block", _FILE - _BLOCK)).count().collect()}  # of each file
        groups, taken = [0], 0
        for k in range(len(self.paths)):
            size = blocks.get(k, 0) * ((1 << _BLOCK) // 8 + 64)
            if taken and taken + size > limit:
                groups.append(k)
                taken = 0
            taken += size
        parts = []
        for a, b in zip(groups, [*groups[1:], len(self.paths)]):
            own = bits if len(groups) == 1 else bits.where(F.shiftright("__tl_block", _FILE - _BLOCK).between(a, b - 1))
            place = F.col("__tl_row").bitwiseAND((1 << _BLOCK) - 1)
            found = self.rows(a, b).withColumn("__tl_block", F.shiftright("__tl_row", _BLOCK)).join(F.broadcast(own), "__tl_block", "left")
            byte = F.conv(F.hex(F.substring(F.col("__tl_bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
            there = F.coalesce(F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1, F.lit(False))
            parts.append(found.where(there if inside else ~there).drop("__tl_block", "__tl_bits"))
        return reduce(DataFrame.unionAll, parts)


def partition_index() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def with_offsets(df: DataFrame, totals: DataFrame, part: str, total: str, local: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out`` = ``local`` + the sum of ``total`` over all earlier parts (of the same ``keys``).

    ``totals`` has a row for each part (and key). It is as long as the job has tasks, so it is the one thing here
    that goes through the driver: a prefix sum over it needs no window over the rows themselves.
    """
    spark = df.sparkSession
    rows = sorted(totals.select(part, *keys, total).collect(), key=lambda r: r[0])
    running: dict[tuple, int] = {}
    before = []
    for r in rows:
        k = tuple(r[1:-1])
        before.append((*r[:-1], running.get(k, 0)))
        running[k] = running.get(k, 0) + r[-1]
    schema = ", ".join([f"__part int", *(f"__k{i} {dict(totals.dtypes)[k]}" for i, k in enumerate(keys)), "__before long"])
    side = spark.createDataFrame(before, schema)
    on = F.col(part) == F.col("__part")
    for i, k in enumerate(keys):
        on = on & (F.col(k) == F.col(f"__k{i}"))
    side = bounded_broadcast(side, len(before), 64)
    return df.join(side, on, "left").withColumn(out, F.col(local) + F.coalesce("__before", F.lit(0))).drop("__part", "__before", *(f"__k{i}" for i in range(len(keys))))
