"""Hierarchical packing of token streams into sequences of several context sizes.

Context tiers are the powers of two up to ``size``. A document of at least ``size`` tokens gives whole windows of the
largest tier; what is left of it, like any shorter document, is routed to the least tier that holds it. Tiers are then
packed from the longest down: each window begins with a piece of its own tier, its gap takes the longest pieces of
shorter tiers that fit, and the last of the gap is filled by cutting one piece, whose rest goes back to its tier. So
every window comes out full but the last that a task has; that one is cut into full windows of lower powers of two
down to ``least``, below which it is padded. Sequences of a tier are then dealt into step groups of equal tokens.

A task packs the rows it reads, a bounded pool at a time, so nothing shuffles and nothing is collected: padding is
below ``size`` tokens a task. Ids of sequences and groups run over all tasks through each task's counts.

Defined results. Null text: as empty, so the document is its end token. Null doc_id: packed, stays null. Repeated
rows: each is a document. Empty table: no pieces. Other columns of the input, whatever their names, are not read. One
very long text is held by one worker, with 4 bytes a token.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import worker_tokenizer

POOL = 4096  # documents that a task holds to choose from

_SCHEMA = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("tier", pa.int32()), ("tier_rank", pa.int64()), ("ids", pa.binary())])
_DDL = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, sequence_tokens long, tier int, tier_rank long, ids binary"


def tier_of(n: int, least: int) -> int:
    """The least power of two that holds ``n`` tokens, ``least`` at least."""
    return max(least, 1 << max(n - 1, 0).bit_length())


class Packer:
    """Packs pieces (length, document, start) of one task; ``emit`` gets each finished sequence with its tier."""

    def __init__(self, size: int, least: int, emit):
        if size & (size - 1) or least & (least - 1) or least > size:
            raise ValueError("size and least must be powers of two, least no larger than size")
        self.size, self.least, self.emit = size, least, emit
        self.pool: list[tuple[int, int, int]] = []

    def add(self, doc: int, tokens: int) -> None:
        whole = tokens // self.size * self.size
        for start in range(0, whole, self.size):
            self.emit(self.size, [(self.size, doc, start)])
        if tokens > whole:
            insort(self.pool, (tokens - whole, doc, whole))
        if len(self.pool) > POOL:
            self.pack(POOL // 2)

    def pack(self, down_to: int = 0) -> None:
        """Fill windows, longest tier first, until so few pieces are left."""
        while len(self.pool) > down_to:
            first = self.pool.pop()
            window, gap = [first], tier_of(first[0], self.least) - first[0]
            tier = first[0] + gap
            while gap and self.pool:
                i = bisect_right(self.pool, (gap, 1 << 62, 0)) - 1
                if i >= 0:
                    piece = self.pool.pop(i)
                else:  # all are longer than the gap: cut the shortest
                    n, doc, start = self.pool.pop(0)
                    piece = (gap, doc, start)
                    insort(self.pool, (n - gap, doc, start + gap))
                window.append(piece)
                gap -= piece[0]
            if gap:
                self.rest(window)
            else:
                self.emit(tier, window)

    def rest(self, window: list[tuple[int, int, int]]) -> None:
        """No piece is left to fill this one: cut it into full windows of lower tiers."""
        total = sum(n for n, _, _ in window)
        while total:
            tier = min(self.size, 1 << total.bit_length() - 1)
            take = tier = tier if tier >= self.least else self.least
            part, window, now = [], window[:], min(take, total)
            total -= now
            while now:
                n, doc, start = window.pop(0)
                part.append((min(n, now), doc, start))
                if n > now:
                    window.insert(0, (n - now, doc, start + now))
                now -= min(n, now)
            self.emit(tier, part)


def _pack(tokenizer: str, end: int, size: int, least: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = worker_tokenizer(tokenizer), common.partition_index()
        held: dict[int, list] = {}  # document: doc_id, ids, tokens not yet placed
        out: list[tuple] = []
        ranks: dict[int, int] = {}
        sequences = 0

        def emit(tier: int, window: list[tuple[int, int, int]]) -> None:
            nonlocal sequences
            at, total, rank = 0, sum(n for n, _, _ in window), ranks.get(tier, 0)
            for n, doc, start in window:
                doc_id, ids, left = held[doc]
                data = ids[start : start + n].astype("<u4").tobytes()
                out.append((part, doc_id, start, n, zlib.crc32(data), len(ids), sequences, at, total, tier, rank, data if with_ids else None))
                at += n
                held[doc][2] = left - n
                if left == n:
                    del held[doc]
            ranks[tier] = rank + 1
            sequences += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)]
            out.clear()
            return pa.record_batch(columns, schema=_SCHEMA)

        packer, count = Packer(size, least, emit), 0
        for batch in common.sub_batches(batches):
            ids, offsets = encoder.encode(common.texts(batch.column("text")), end)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                held[count] = [doc_id, ids[a:b].copy(), b - a]
                packer.add(count, b - a)
                count += 1
            if len(out) > 2000:
                yield flush()
        packer.pack()
        if out:
            yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 1, size: int = 2048, least: int = 64, step_tokens: int = 1 << 16, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and tier, sequence_tokens, step_group (with ``ids`` too if asked for).

    A step group has sequences of one tier with ``step_tokens`` tokens in all; groups are numbered within their tier,
    so a schedule over tiers may draw whole groups in any order. ``docs`` may be any rows of (doc_id, text).
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = common.stage(rows.mapInArrow(_pack(tokenizer, end, size, least, with_ids), _DDL), "packed")
    parts = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("sequences"))
    tiers = pieces.groupBy("part", "tier").agg((F.max("tier_rank") + 1).alias("n"))
    numbered = common.with_offsets(pieces, parts, "part", "sequences", "sequence", "sequence_id")
    ranked = common.with_offsets(numbered, tiers, "part", "n", "tier_rank", "rank", keys=("tier",))
    group = F.floor(F.col("rank") / F.expr(f"{step_tokens} div tier")).cast("long")
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "sequence_tokens", group.alias("step_group"), *(["ids"] if with_ids else []))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))
