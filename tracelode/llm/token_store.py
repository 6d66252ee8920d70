"""Content-addressed store of token ids.

Documents are encoded, their id streams cut into chunks where a rolling hash of the last ids says so, and each
distinct chunk is stored once under its digest. A recipe lists the chunks of a document; a Merkle root over them, one
over each part and one over the store let a reader prove what it rebuilt.

Layout under a path (all Parquet, so any store that Spark reaches will do):

``kind=chunk``     digest, n_tokens, ids (little-endian unsigned integers of ``width`` bytes)
``recipes``        part, doc_id, local_start, n_tokens, digests, lengths, root; ascending doc_id over all parts
                   and a row for each part (``kind=manifest``) with its totals and Merkle root

Defined results. Null text: as empty, so the document is its end id. Null doc_id: kept, before all others. Repeated
doc_id: each row is a document; their order is by root. Empty table: an empty store, Merkle root of nothing. Other
columns of the input, whatever their names, are not read. One very long text is held by one worker, with 4 bytes an id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import worker_tokenizer

WINDOW = 16


@dataclass(frozen=True)
class Chunking:
    """Cut where the top ``bits`` bits of the hash of the last 16 ids are zero, between ``least`` and ``most`` ids."""

    bits: int = 9
    least: int = 64
    most: int = 4096


# --- chunks -------------------------------------------------------------------------------------------------------

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """For each place the polynomial hash (mod 2**64) of the WINDOW ids that end there, from one prefix sum."""
    n = len(ids)
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _FACTOR, dtype=np.uint64)]), dtype=np.uint64)[:n]
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), _INVERSE, dtype=np.uint64)]), dtype=np.uint64)[:n]
    value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    total = np.cumsum(value * down, dtype=np.uint64)
    total[WINDOW:] -= total[:-WINDOW].copy()
    h = total * up
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def cut_points(ids: np.ndarray, offsets: np.ndarray, how: Chunking) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all documents in ``ids``, and how many chunks each document has.

    No chunk is shorter than ``least`` ids but a document's last, and ``least`` is more than the window, so a cut
    depends on ids of its own chunk alone: equal passages are cut alike wherever they stand.
    """
    marks = np.flatnonzero(rolling_hash(ids) >> np.uint64(64 - how.bits) == 0) + 1
    first = np.searchsorted(marks, offsets)
    ends, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    marks = marks.tolist()
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        before = len(ends)
        for m in marks[first[d] : first[d + 1]]:
            while m - a > how.most:
                a += how.most
                ends.append(a)
            if m - a >= how.least:
                ends.append(m)
                a = m
        while b - a > how.most:
            a += how.most
            ends.append(a)
        if b > a:
            ends.append(b)
        counts[d] = len(ends) - before
    return np.array(ends, dtype=np.int64), counts


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is. No leaves: the digest of nothing."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=16).digest()
    level = leaves
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\x01" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0]


class MerkleStream:
    """The same kind of root over leaves that come one by one, holding a node for each level."""

    def __init__(self) -> None:
        self.nodes: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, node in enumerate(self.nodes):
            if node is None:
                self.nodes[i] = leaf
                return
            leaf, self.nodes[i] = hashlib.blake2b(b"\x01" + node + leaf, digest_size=16).digest(), None
        self.nodes.append(leaf)

    def root(self) -> bytes:
        top = None
        for node in self.nodes:
            if node is not None:
                top = node if top is None else hashlib.blake2b(b"\x01" + node + top, digest_size=16).digest()
        return top or merkle_root([])


# --- writing ------------------------------------------------------------------------------------------------------

_RAW = pa.schema([("kind", pa.string()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32()))])
_RAW_DDL = "kind string, digest binary, doc_id long, n_tokens long, ids binary, digests array<binary>, lengths array<int>"


def _encode(tokenizer: str, end: int | None, width: int, how: Chunking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = worker_tokenizer(tokenizer), set()
        for batch in common.sub_batches(batches):
            ids, offsets = encoder.encode(common.texts(batch.column("text")), end)
            ends, counts = cut_points(ids, offsets, how)
            data = ids.astype(f"<u{width}").tobytes()
            starts = np.concatenate([[0], ends[:-1]])
            pieces = [data[a * width : b * width] for a, b in zip(starts.tolist(), ends.tolist())]
            digests = [hashlib.blake2b(p, digest_size=16).digest() for p in pieces]
            lengths = (ends - starts).astype(np.int32)
            fresh = [i for i, d in enumerate(digests) if d not in seen and not seen.add(d)]
            if len(seen) > 2_000_000:  # what is seen again after this is stored once all the same, by the shuffle
                seen.clear()
            yield pa.record_batch([pa.array(["chunk"] * len(fresh)), pa.array([digests[i] for i in fresh], pa.binary()), pa.nulls(len(fresh), pa.int64()), pa.array(lengths[fresh], pa.int64()), pa.array([pieces[i] for i in fresh], pa.binary()), pa.nulls(len(fresh), _RAW.field("digests").type), pa.nulls(len(fresh), _RAW.field("lengths").type)], schema=_RAW)
            edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            n = batch.num_rows
            yield pa.record_batch([pa.array(["recipe"] * n), pa.nulls(n, pa.binary()), batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.nulls(n, pa.binary()), pa.ListArray.from_arrays(edges, pa.array(digests, pa.binary())), pa.ListArray.from_arrays(edges, pa.array(lengths))], schema=_RAW)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All copies of a digest are in this partition; keep its first."""
    seen: set[bytes] = set()
    for batch in batches:
        mask = [d is None or (d not in seen and not seen.add(d)) for d in batch.column("digest").to_pylist()]
        yield batch.filter(pa.array(mask, pa.bool_()))


_RECIPE_DDL = "kind string, part int, doc_id long, local_start long, n_tokens long, digests array<binary>, lengths array<int>, root binary"


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in ascending doc_id: add where each begins in this part, and at the end the part's manifest."""
    part, at, docs, tree = common.partition_index(), 0, 0, MerkleStream()
    kinds = {f.name: f.type for f in _RAW}
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("digests", kinds["digests"]), ("lengths", kinds["lengths"]), ("root", pa.binary())])
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        roots = batch.column("root").to_pylist()
        for r in roots:
            tree.add(r)
        starts = at + np.cumsum(n) - n
        at, docs, k = at + int(n.sum()), docs + len(n), len(n)
        yield pa.record_batch([pa.array(["recipe"] * k), pa.array([part] * k, pa.int32()), batch.column("doc_id"), pa.array(starts, pa.int64()), batch.column("n_tokens"), batch.column("digests").cast(kinds["digests"]), batch.column("lengths").cast(kinds["lengths"]), batch.column("root")], schema=schema)
    yield pa.record_batch([pa.array(["manifest"]), pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([0], pa.int64()), pa.array([at], pa.int64()), pa.nulls(1, kinds["digests"]), pa.nulls(1, kinds["lengths"]), pa.array([tree.root()], pa.binary())], schema=schema)


@F.pandas_udf(T.BinaryType())
def _document_root(digests: pd.Series) -> pd.Series:
    return digests.map(lambda d: merkle_root([bytes(x) for x in d]))


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str
    width: int

    def chunks(self) -> DataFrame:
        return self.spark.read.schema(_RAW_DDL).parquet(f"{self.path}/packs").where("kind = 'chunk'").select("digest", "n_tokens", "ids")

    def recipes(self) -> DataFrame:
        """Of each document its part, its place in it, its chunks and its Merkle root, with ``start`` over the whole store."""
        rows = self.spark.read.schema(_RECIPE_DDL).parquet(f"{self.path}/recipes")
        recipes = rows.where("kind = 'recipe'").drop("kind")
        return common.with_offsets(recipes, self.manifest(), "part", "n_tokens", "local_start", "start")

    def manifest(self) -> DataFrame:
        rows = self.spark.read.schema(_RECIPE_DDL).parquet(f"{self.path}/recipes")
        return rows.where("kind = 'manifest'").select("part", F.col("doc_id").alias("n_docs"), "n_tokens", "root")

    def root(self) -> bytes:
        """Merkle root of the whole store: over the roots of its parts, in order. There are as many as writing tasks."""
        return merkle_root([bytes(r.root) for r in sorted(self.manifest().collect(), key=lambda r: r.part) if r.n_docs])


def write_store(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end: int | None = 2, width: int = 2, how: Chunking = Chunking()) -> Store:
    """Encode ``docs`` (doc_id, text) into a store at ``path``.

    Chunks shuffle once, by digest, after each task has dropped what it saw before, so a passage that many documents
    share is sent once a task. Recipes hold digests only; they alone are sorted.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(tokenizer, end, width, how), _RAW_DDL)
    key = F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("doc_id", "n_tokens"))
    packs = rows.repartition(key).mapInArrow(_once, _RAW_DDL)
    packs.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/packs")
    raw = spark.read.schema(_RAW_DDL).parquet(f"{path}/packs").where("kind = 'recipe'")
    ordered = raw.select("doc_id", "n_tokens", "digests", "lengths", _document_root("digests").alias("root")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    ordered.mapInArrow(_recipes, _RECIPE_DDL).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/recipes")
    return Store(spark, path, width)


# --- reading ------------------------------------------------------------------------------------------------------

_POLYNOMIAL = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo CRC-32's, bits reversed."""
    a, b = np.broadcast_arrays(a, b)
    b, out = b.copy(), np.zeros(b.shape, dtype=np.uint32)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ _POLYNOMIAL, b >> np.uint32(1))
    return out


def crc_shift(n_bytes: np.ndarray) -> np.ndarray:
    """The factor that moves a CRC-32 past so many bytes."""
    n = n_bytes.astype(np.uint64) * np.uint64(8)
    out, square = np.full(n.shape, 1 << 31, dtype=np.uint32), np.array([1 << 30], dtype=np.uint32)
    while n.any():
        out = np.where(n & np.uint64(1), _times(square, out), out)
        square, n = _times(square, square), n >> np.uint64(1)
    return out


def crc_join(first: np.ndarray, second: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of two texts one after the other from theirs and the second's length."""
    return _times(crc_shift(n_bytes), first) ^ second


def _read_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, data = batch.column("digest").to_pylist(), batch.column("ids").to_pylist()
            for d, x in zip(digests, data):
                if hashlib.blake2b(x, digest_size=16).digest() != d:
                    raise ValueError(f"chunk {d.hex()} does not hold the ids that it was stored under")
            crc = np.array([zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in data], dtype=np.int64)
            n = np.array([len(x) // width for x in data], dtype=np.int64)
            yield pa.record_batch([batch.column("digest"), pa.array(crc), pa.array(n)], names=["digest", "crc", "n"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the chunks of a document in order (place, crc, n, digest): its CRC-32 over 32-bit ids, checked against count and Merkle root."""
    for batch in batches:
        chunks = batch.column("chunks")
        offsets = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        flat = chunks.flatten()
        chunk_crc, chunk_n = (pc.fill_null(flat.field(c), 0).to_numpy(zero_copy_only=False).astype(t) for c, t in (("crc", np.uint32), ("n", np.int64)))
        shift, digests = crc_shift(chunk_n * 4), flat.field("digest").to_pylist()
        sizes = np.diff(offsets)
        crc, total = np.zeros(len(sizes), dtype=np.uint32), np.zeros(len(sizes), dtype=np.int64)
        for k in range(int(sizes.max(initial=0))):
            on = np.flatnonzero(sizes > k)
            at = offsets[on] + k
            crc[on] = _times(shift[at], crc[on]) ^ chunk_crc[at]
            total[on] += chunk_n[at]
        roots = [merkle_root([d for d in digests[a:b] if d is not None]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        bad = [i for i, (x, n) in enumerate(zip(batch.column("root").to_pylist(), batch.column("n_tokens").to_pylist())) if x != roots[i] or n != total[i]]
        if bad:
            raise ValueError(f"the store doesn't rebuild document {batch.column('doc_id')[bad[0]]}")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(store: Store) -> DataFrame:
    """Of each document doc_id, start, n_tokens and ids_crc32 from the files.

    Every stored chunk is read once, checked against its digest and reduced to its CRC-32; those join to documents by
    the recipes, so payloads never shuffle. A document whose chunks don't add up to its recipe's count or Merkle root
    fails the job.
    """
    common.ship(store.spark)
    chunks = store.chunks().mapInArrow(_read_chunks(store.width), "digest binary, crc long, n long")
    recipes = store.recipes()
    refs = recipes.select("part", "local_start", "doc_id", "start", "n_tokens", "root", F.posexplode_outer("digests").alias("place", "digest"))
    found = refs.join(chunks, "digest", "left").groupBy("part", "local_start", "doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("place", "crc", "n", "digest"))).alias("chunks"))
    return found.mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _concatenate(width: int):
    @F.pandas_udf("binary")
    def run(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda x: b"".join(bytes(c["ids"]) for c in sorted(x, key=lambda c: c["place"]) if c["ids"] is not None))

    return run


def read_documents(store: Store) -> DataFrame:
    """doc_id, start, n_tokens and the ids of each document (little-endian, ``width`` bytes each), rebuilt from its chunks."""
    common.ship(store.spark)
    refs = store.recipes().select("part", "local_start", "doc_id", "start", "n_tokens", F.posexplode_outer("digests").alias("place", "digest"))
    whole = refs.join(store.chunks().select("digest", "ids"), "digest", "left").groupBy("part", "local_start", "doc_id", "start", "n_tokens").agg(F.collect_list(F.struct("place", "ids")).alias("chunks"))
    return whole.select("doc_id", "start", "n_tokens", _concatenate(store.width)("chunks").alias("ids"))


# --- query --------------------------------------------------------------------------------------------------------


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return read_digests(write_store(docs, common.scratch_path(spark, "token-store")))
