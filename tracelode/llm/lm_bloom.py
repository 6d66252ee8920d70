"""Language-model scores from a log-frequency Bloom filter.

Counts. Each task counts the words and word pairs of its training texts, merging as it goes, and sends them as sorted,
packed hashes, a blob for each shard of the hash space. Their number of shards follows the corpus, so what a reducer
merges stays bounded; a pair reaches it once a task at most, however frequent it is. All training rows count.

Filter. A pair counted c times is stored as the events (pair, 1) ... (pair, q) with q = 1 + floor(log(c) / log(base)). A
query probes level after level until one is missing, which gives c up to the quantisation, and never too few.
Word counts are a sorted exact table.

Model. With c counts, N training tokens, V distinct ones: P1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), and the smoothed
P(w | h) = (c(h w) + mass P1(w)) / (c(h) + mass). A text's score is the sum of log10 P over its words and its end.

Size. Filter and table grow with the corpus. They are broadcast in slices of whole shards of at most ``slice_bytes``;
with one slice texts are scored in one pass, with more each pass answers for its shards and the answers are added up
per document before scoring.

Defined results. Null or empty text: the end alone. Null doc_id: belongs to the fold of the empty text's crc32.
Repeated rows: each is scored, and counted if it is a training row. No training rows: N and V are 0, all scores are
finite. Empty table: no rows. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = np.uint64(0x9DDFEA08EB382D69)
START = np.uint64(0xC2B2AE3D27D4EB4F)
SHARD_BYTES = 24 << 20  # text for each shard
BITS = 14  # of filter an event
PROBES = 6
_ONE = np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all ``docs``, each document's followed by END, and where each document begins (one more than documents)."""
    split = [d.lower().split() for d in docs]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, (w for s in split for w in s)), dtype=np.uint64, count=int(counts.sum()))
    ends = np.cumsum(counts)
    return np.insert(words, ends, END), np.concatenate([[0], ends]) + np.arange(len(docs) + 1)


def pairs(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each token the hash of it behind the one before; 48 bits, so that they pack well."""
    before = np.concatenate([[START], hashes[:-1]]) if len(hashes) else hashes
    before[offsets[:-1][offsets[:-1] < len(hashes)]] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes) >> np.uint64(16)


# --- counting -----------------------------------------------------------------------------------------------------


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps, and counts, byte plane by byte plane: the high planes are nearly all zero and compress away."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(16, -1)
    keys, counts = (np.ascontiguousarray(x.T).view("<u8").ravel() for x in (planes[:8], planes[8:]))
    return np.cumsum(keys, dtype=np.uint64), counts


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Counter:
    """Counts hashes, merging whenever as many wait as are counted."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, hashes: np.ndarray) -> None:
        keys, counts = np.unique(hashes, return_counts=True)
        self.parts.append((keys, counts.astype(np.uint64)))
        self.waiting += len(keys)
        if self.waiting > max(1 << 21, 2 * len(self.parts[0][0])):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.parts:
            self.parts = [_merge(self.parts)]
            self.waiting = len(self.parts[0][0])
            return self.parts[0]
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def _count(shards: int, most: int = 1 << 23):
    width = {"word": 64, "pair": 48}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {k: _Counter() for k in width}

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, counter in counters.items():
                keys, counts = counter.merge()
                edges = np.searchsorted(keys, np.arange(shards, dtype=np.uint64) << np.uint64(width[kind] - shards.bit_length() + 1)) if shards > 1 else np.zeros(1, np.int64)
                edges = [*edges.tolist(), len(keys)]
                found = [s for s in range(shards) if edges[s + 1] > edges[s]]
                blobs = [_pack(keys[edges[s] : edges[s + 1]], counts[edges[s] : edges[s + 1]]) for s in found]
                counters[kind] = _Counter()
                yield pa.record_batch([pa.array([kind] * len(found)), pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "shard", "blob"])

        for batch in common.sub_batches(batches):
            hashes, offsets = tokens(common.texts(batch.column("text")))
            counters["word"].add(hashes)
            counters["pair"].add(pairs(hashes, offsets))
            if counters["pair"].waiting > most:
                yield from flush()
        yield from flush()

    return run


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    """Quantised counts: 1 + floor(log(count) / log(base)), exact at powers of the base."""
    return 1 + np.floor(np.log(counts.astype(np.float64)) / math.log(base) + 1e-9).astype(np.int64)


def level_counts(base: float, most: int = 256) -> np.ndarray:
    """The count that each level stands for: the middle of the whole numbers from base**(q-1) to below base**q; 0 for level 0."""
    edge = np.ceil(base ** np.minimum(np.arange(most), 1000 / base) - 1e-9)
    return np.concatenate([[0.0], (edge[:-1] + np.maximum(edge[1:] - 1, edge[:-1])) / 2])


def _event(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))


def _spots(keys: np.ndarray, level: int, words: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Of each event (key, level) two words of the filter and the three bits of each that it sets.

    All probes of an event fall into two words: looking one up touches memory once or twice, not once a bit.
    """
    h = _event(keys, level)
    g = mix(h ^ np.uint64(0x2545F4914F6CDD1D))
    for half, shift in ((h & np.uint64(0xFFFFFFFF), 0), (h >> np.uint64(32), 18)):
        yield (half * words >> np.uint64(32)).astype(np.int64), [g >> np.uint64(shift + 6 * k) & np.uint64(63) for k in range(PROBES // 2)]


def _mask(bits: list[np.ndarray]) -> np.ndarray:
    out = _ONE << bits[0]
    for b in bits[1:]:
        out |= _ONE << b
    return out


def build_filter(keys: np.ndarray, counts: np.ndarray, base: float) -> np.ndarray:
    """The filter of one shard, as 64-bit words."""
    q = levels(counts, base)
    size = max(1, -(-int(q.sum()) * BITS // 64))
    on = np.zeros(size * 64, dtype=bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        for at, bits in _spots(keys[q >= level], level, np.uint64(size)):
            for b in bits:
                on[at * 64 + b.astype(np.int64)] = True
    return np.packbits(on, bitorder="little").view("<u8")


def _reduce(base: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, shard = key
        keys, counts = _merge([_unpack(bytes(b)) for b in rows["blob"]])
        blob = _pack(keys, counts) if kind == "word" else build_filter(keys, counts, base).tobytes()
        return pd.DataFrame({"kind": [kind], "shard": [shard], "entries": [len(keys)], "total": [int(counts.sum())], "size": [len(keys) * 12 if kind == "word" else len(blob)], "blob": [blob]})

    return run


@dataclass(frozen=True)
class Model:
    parts: DataFrame  # kind, shard, entries, total, size, blob: one row a shard and kind
    shards: int
    base: float
    n: int  # training tokens
    v: int  # distinct ones
    starts: int  # training texts
    sizes: list[tuple[str, int, int, int, int]]  # kind, shard, entries, total, bytes
    slices: list[list[int]]


def train(docs: DataFrame, base: float = 1.5, slice_bytes: int = 256 << 20) -> Model:
    """Counts all rows of ``docs`` (text) into a model in the shared folder."""
    common.ship(docs.sparkSession)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    seen = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    shards = 1 << max(3, (seen.bytes // SHARD_BYTES).bit_length())
    blobs = texts.mapInArrow(_count(shards), "kind string, shard int, blob binary")
    parts = blobs.groupBy("kind", "shard").applyInPandas(_reduce(base), "kind string, shard int, entries long, total long, size long, blob binary")
    parts = common.stage(parts, "lm-parts")
    # Two rows a shard, each of which stands for SHARD_BYTES of text.
    sizes = sorted(map(tuple, parts.select("kind", "shard", "entries", "total", "size").collect()), key=lambda r: (r[1], r[0]))
    slices: list[list[int]] = [[]]
    room, bytes_of = slice_bytes, dict.fromkeys(range(shards), 0)
    for r in sizes:
        bytes_of[r[1]] += r[4]
    for shard, size in bytes_of.items():
        if slices[-1] and size > room:
            slices.append([])
            room = slice_bytes
        slices[-1].append(shard)
        room -= size
    n, v = (sum(r[k] for r in sizes if r[0] == "word") for k in (3, 2))
    return Model(parts, shards, base, n, v, seen.n, sizes, slices)


# --- scoring ------------------------------------------------------------------------------------------------------


class Slice:
    """Word counts and filters of some shards, ready for look-ups. It is made on the driver and broadcast as it is."""

    def __init__(self, sizes: list[tuple[str, int, int, int, int]], shards: int, base: float):
        """``sizes``: (kind, shard, entries, total, bytes) of what is to come, which gets its room at once."""
        self.shift, self.base = shards.bit_length() - 1, base
        at = {kind: np.zeros(shards + 1, np.int64) for kind in ("word", "pair")}
        for kind, shard, entries, _, n in sizes:
            at[kind][shard + 1] = entries if kind == "word" else n // 8
        self.word_first, self.first = (np.cumsum(at[kind]) for kind in ("word", "pair"))
        self.size = np.diff(self.first).astype(np.uint64)
        self.keys = np.zeros(self.word_first[-1], np.uint64)
        self.counts = np.zeros(len(self.keys), np.uint32 if all(total < 1 << 32 for *_, total, _ in sizes) else np.uint64)
        self.filter = np.zeros(self.first[-1], np.uint64)

    def put(self, kind: str, shard: int, blob: bytes) -> None:
        if kind == "pair":
            self.filter[self.first[shard] : self.first[shard + 1]] = np.frombuffer(blob, "<u8")
        else:
            here = slice(self.word_first[shard], self.word_first[shard + 1])
            self.keys[here], self.counts[here] = _unpack(blob)

    def close(self) -> Slice:
        """Index the words, whose hashes ascend over all shards, by their first bits."""
        self.top = max(1, len(self.keys).bit_length())
        self.index = np.searchsorted(self.keys, np.arange(1 << self.top, dtype=np.uint64) << np.uint64(64 - self.top)).astype(np.int32 if len(self.keys) < 1 << 31 else np.int64)
        return self

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Their exact counts; 0 for those that this slice doesn't have."""
        out = np.zeros(len(hashes), dtype=np.int64)
        if not len(self.keys):
            return out
        at = self.index[(hashes >> np.uint64(64 - self.top)).astype(np.int64)].astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            key = self.keys[np.minimum(at, len(self.keys) - 1)]
            want = hashes[left]
            hit = (key == want) & (at < len(self.keys))
            out[left[hit]] = self.counts[at[hit]]
            on = (key < want) & (at < len(self.keys))
            left, at = left[on], at[on] + 1
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Their quantised counts; 0 for unseen ones and those that this slice doesn't have."""
        out = np.zeros(len(keys), dtype=np.uint8)
        shard = (keys >> np.uint64(48 - self.shift)).astype(np.int64) if self.shift else np.zeros(len(keys), np.int64)
        left = np.flatnonzero(self.size[shard])
        level = 1
        while len(left):
            home = shard[left]
            (one, first), (two, second) = _spots(keys[left], level, self.size[home])
            base = self.first[home]
            mask = _mask(first)
            on = np.flatnonzero(self.filter[one + base] & mask == mask)
            mask = _mask([b[on] for b in second])
            on = on[self.filter[two[on] + base[on]] & mask == mask]
            left = left[on]
            out[left] = level
            level += 1
        return out


def scores(count: np.ndarray, quantised: np.ndarray, offsets: np.ndarray, n: int, v: int, starts: int, base: float, mass: float) -> tuple[np.ndarray, ...]:
    """From each token's count and its pair's level: per document n_tokens, n_known, the base score and the model's."""
    one = (count + 0.5) / (n + 0.5 * (v + 1))
    context = np.concatenate([[starts], count[:-1]]).astype(np.float64) if len(count) else count.astype(np.float64)
    context[offsets[:-1]] = starts
    # Never more than c(h) or c(w), which are exact.
    pair = np.minimum(level_counts(base)[quantised], np.minimum(context, count))
    both = (pair + mass * one) / (context + mass)
    add = lambda x: np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)
    return np.diff(offsets), add((count > 0).astype(np.int64)), add(np.log10(one)), add(np.log10(both))


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _one_pass(sent, base: float, n: int, v: int, starts: int, mass: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for batch in common.sub_batches(batches):
            hashes, offsets = tokens(common.texts(batch.column("text")))
            found = scores(tables.words(hashes), tables.pairs(pairs(hashes, offsets)), offsets, n, v, starts, base, mass)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(x) for x in found)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _answers(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, press = sent.value, zstandard.ZstdCompressor(level=1)
        for batch in common.sub_batches(batches):
            hashes, offsets = tokens(common.texts(batch.column("text")))
            count, level = tables.words(hashes).astype("<i8"), tables.pairs(pairs(hashes, offsets))
            blobs = [press.compress(count[a:b].tobytes() + level[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(blobs, pa.binary())], names=["row", "doc_id", "held_out", "blob"])

    return run


def _added(base: float, n: int, v: int, starts: int, mass: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            found = []
            for blobs in batch.column("blobs").to_pylist():
                count = level = 0
                for blob in blobs:
                    data = open_.decompress(blob)
                    k = len(data) // 9
                    count, level = count + np.frombuffer(data, "<i8", k), level + np.frombuffer(data, np.uint8, k, 8 * k)
                found.append([x[0] for x in scores(count, level, np.array([0, len(count)]), n, v, starts, base, mass)])
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))] if found else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, model: Model, mass: float = 500.0) -> DataFrame:
    """``docs`` (doc_id, held_out, text) scored: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"))

    def send(number: int):
        mine = set(model.slices[number])
        tables = Slice([r for r in model.sizes if r[1] in mine], model.shards, model.base)
        for r in model.parts.where(F.col("shard").isin(*mine)).select("kind", "shard", "blob").toLocalIterator():
            tables.put(r.kind, r.shard, bytes(r.blob))
        return spark.sparkContext.broadcast(tables.close())

    numbers = (model.n, model.v, model.starts)
    if len(model.slices) == 1:
        out = rows.mapInArrow(_one_pass(send(0), model.base, *numbers, mass), _OUT)
    else:
        rows = rows.withColumn("row", F.monotonically_increasing_id())  # of the same files in the same order, pass by pass
        found = None
        for k in range(len(model.slices)):
            sent = send(k)
            one = common.stage(rows.mapInArrow(_answers(sent), "row long, doc_id long, held_out boolean, blob binary"), "lm-answers")
            sent.unpersist()
            found = one if found is None else found.unionByName(one)
        whole = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), F.collect_list("blob").alias("blobs"))
        out = whole.mapInArrow(_added(model.base, *numbers, mass), _OUT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_bloom(spark: SparkSession, sf_dir: str, slice_bytes: int = 256 << 20, mass: float = 500.0) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", (common.fold_of(F.col("doc_id")) == 1).alias("held_out"))
    return score_documents(docs, train(docs.where("NOT held_out"), slice_bytes=slice_bytes), mass)
