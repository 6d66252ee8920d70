"""Near-duplicate classes by SimHash fingerprints: pigeonhole blocks, a join on blocks, then the Hamming distance.

Texts are lower-cased (A-Z) and cut into word shingles; bit b of a fingerprint is set if it is set in more than half
of the shingles' XXH64 (seed 42). Documents of one fingerprint collapse before anything is joined.

A fingerprint has four blocks of 16 bits. Two that differ in at most two bits agree in two blocks at least, so they meet
under one of six keys of 32 bits. Keys with up to ``crowd`` fingerprints compare them within a row. A larger key, as many near
copies make, would cost its square; its fingerprints go another exact way: each is listed under itself and its 64
neighbours at one bit. Two at distance two share the value between them, two at distance one share themselves, and any
two under one value are at most two bits apart. So no group has over 65 members and every link is found.

Links join into components by alternating large and small stars, each round written to the shared folder.

Defined results. Null or empty text: fingerprint zero, linked like any other. Null doc_id: never the smallest of
a component, whose id is null if it has no other. Repeated rows: the same fingerprint, so one component. Empty table: no
rows. Other columns stay as they are; names of this module begin with ``__tl_``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DISTANCE = 2
BLOCKS = 4
SEED = 42


def fingerprint(text: bytes, width: int = 3) -> int:
    """Of one whole text, as an unsigned 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    else:
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: 1 - width].tolist()
        ends = (ends - 1)[width - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes of 64 bits, as an unsigned 64-bit integer; none: zero."""
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[a : a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, width: int = 3) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``__tl_fp``, the fingerprint as a signed 64-bit integer."""
    signed = lambda texts: [pa.array(np.array([fingerprint(x, width) for x in texts], dtype=np.uint64).view(np.int64))]
    return common.add_from_texts(docs, text_col, keep, [T.StructField("__tl_fp", T.LongType())], signed)


def links(prints: DataFrame, crowd: int = 32) -> DataFrame:
    """(a, b) with a < b: pairs of distinct fingerprints (column ``__tl_fp``) whose chains connect all that are at most DISTANCE bits apart."""
    bits = 64 // BLOCKS
    block = [F.shiftrightunsigned("__tl_fp", bits * i).bitwiseAND((1 << bits) - 1) for i in range(BLOCKS)]
    keys = [F.lit(k << 2 * bits) + F.shiftleft(block[i], bits) + block[j] for k, (i, j) in enumerate(combinations(range(BLOCKS), BLOCKS - DISTANCE))]
    keyed = prints.select(F.explode(F.array(*(k.cast("long") for k in keys))).alias("__tl_key"), "__tl_fp")
    groups = keyed.groupBy("__tl_key").agg(F.count("*").alias("__tl_n"), F.min("__tl_fp").alias("a"), F.max("__tl_fp").alias("b")).where("__tl_n >= 2")
    groups = common.stage(groups, "simhash-keys")
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= DISTANCE
    two = groups.where("__tl_n = 2").where(near(F.col("a"), F.col("b"))).select("a", "b")

    few = groups.where(f"__tl_n > 2 AND __tl_n <= {crowd}").select("__tl_key")
    lists = keyed.join(few, "__tl_key", "left_semi").groupBy("__tl_key").agg(F.array_sort(F.collect_list("__tl_fp")).alias("__tl_all"))
    pair = lambda x: F.transform(F.filter("__tl_all", lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b")))
    some = lists.select(F.explode(F.flatten(F.transform("__tl_all", pair))).alias("p")).select("p.a", "p.b")

    many = groups.where(f"__tl_n > {crowd}").select("__tl_key")
    crowded = keyed.join(many, "__tl_key", "left_semi").select("__tl_fp").distinct()
    flips = F.concat(F.array("__tl_fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("__tl_fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    around = crowded.select(F.explode(flips).alias("__tl_v"), "__tl_fp").groupBy("__tl_v").agg(F.min("__tl_fp").alias("a"), F.collect_list("__tl_fp").alias("__tl_all")).where(F.size("__tl_all") >= 2)
    stars = around.select("a", F.explode("__tl_all").alias("b")).where("a < b")
    return two.unionByName(some).unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b) but the roots themselves; a root is the smallest node of its component.

    Large star: every larger neighbour of a node moves to the smallest node around it. Small star: so do the node and
    its smaller neighbours. Both keep components as they are and end as stars, in a number of rounds that grows with
    the logarithm of the longest chain. Edges are stars once no node has two smaller ones or is both an upper and a lower end.
    """
    now = common.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    while True:
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(True).alias("upper")), F.struct(F.col("v").alias("x"), F.lit(False).alias("upper")))).alias("e")).select("e.x", "e.upper")
        of = ends.groupBy("x").agg(F.count_if("upper").alias("ups"), F.count_if(~F.col("upper")).alias("downs"))
        if not of.where("ups > 1 OR ups = 1 AND downs > 0").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.stage(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = common.stage(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")


def classes(rows: DataFrame, id_col: str = "doc_id", crowd: int = 32) -> DataFrame:
    """``rows``, a written table with ``__tl_fp``, with ``component_id`` and ``__tl_root`` (the class)."""
    prints = common.stage(rows.groupBy("__tl_fp").agg(F.min(f"`{id_col}`").alias("__tl_first")), "simhash-prints")
    roots = components(links(prints, crowd))
    of = prints.join(roots, F.col("__tl_fp") == F.col("node"), "left").select("__tl_fp", "__tl_first", F.coalesce("root", "__tl_fp").alias("__tl_root"))
    first = of.groupBy("__tl_root").agg(F.min("__tl_first").alias("component_id"))
    of = common.stage(of.select("__tl_fp", "__tl_root").join(first, "__tl_root"), "simhash-classes")
    return rows.join(of, "__tl_fp")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """A row for each document: doc_id, fingerprint, component_id."""
    rows = common.stage(with_fingerprints(docs, keep=["doc_id"], width=width), "simhash-documents")
    return classes(rows).select("doc_id", F.lower(F.lpad(F.hex("__tl_fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The row of smallest doc_id of each class, with all its columns. Of the classes only the numbers of rows to drop come back to the rows."""
    numbered = common.Numbered(docs, "simhash-documents")
    rows = numbered.rows().select(F.col(f"`{id_col}`").alias("__tl_id"), F.col(f"`{text_col}`").alias("__tl_of"), "__tl_row")
    known = common.stage(with_fingerprints(rows, "__tl_of", ["__tl_id", "__tl_row"], width), "simhash-fingerprints")
    known = common.stage(classes(known, "__tl_id").select("__tl_root", "__tl_id", "__tl_row"), "simhash-known")
    stays = known.groupBy("__tl_root").agg(F.count("*").alias("__tl_n"), F.min(F.struct(F.col("__tl_id").isNull(), F.col("__tl_id"), F.col("__tl_row"))).alias("__tl_stay")).where("__tl_n >= 2").select("__tl_root", F.col("__tl_stay.__tl_row").alias("__tl_stay"))
    return numbered.without(known.join(stays, "__tl_root").where("__tl_row <> __tl_stay").select("__tl_row"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
