"""Near-duplicate classes by SimHash fingerprints and word shingles: two texts are linked if the Jaccard similarity of their five-word shingles is 0.8 or more.

Texts are lower-cased (A-Z); a text of at most five words is one shingle. Shingles are compared as XXH64 (seed 42), sets by
all their shingles, in whole numbers: c common ones of a and b link if 9c >= 4(a + b). Every link is found:

- Fingerprints first. Bits set in over half of a set's hashes make its SimHash; ``simhash.links`` joins those at most two bits apart on
  blocks of bits. Sets of one fingerprint, and the first ones of two that are linked, are compared shingle by shingle. What these links join needs
  no other comparison. Texts just alike by 0.8 differ in more bits than blocks can part, so the rest has an exact way:
- Prefixes. Under any one order of all shingles, linked sets of n share one of their first n - ceil(4n/5) + 1. The order is
  by hash, but shingles in more than ``crowd`` prefixes, counted over all texts, come last, by their number, at most ``most`` of
  them. So are those which then take their places in prefixes: for each one that goes, a text's next AHEAD shingles are counted too.
- A shared shingle at places i and j, if it is the first they share, leaves at most min(a - i, b - j) common ones. Pairs that
  this bound rules out are no candidates; a link passes it at the first shingle of its two prefixes.
- The parities of classes of shingles, two to four classes for each shingle, differ in no more classes than the sets differ in shingles, at most
  (a + b) / 9 for a link. Those of a larger set fold to the number of classes of a smaller one.

What passes is compared shingle by shingle, but only as far as it can join classes: first each text with the one that differs
least by its parities, then of any two classes that still have such pairs between them the most alike, then whatever pairs are left
between classes. Places in prefixes shuffle once, sorted by shingle; texts are parsed again where
sets are needed, as these are larger than the texts on disk. Shingles in up to ``crowd`` prefixes give pairs. What more crowded ones
hold together is compared in blocks of about ``block`` texts: within blocks, then the texts that stand for the classes found, then members of
classes that may still be linked. So near copies of one text cost their number and not its square; texts alike by a little less cost their square, spread over tasks.

Equal sets collapse before anything is joined. Defined results. Null or empty text: no shingles, alike among themselves. Null id: kept
only if no other of its class has one. Repeated rows: one stays. Empty table: no rows. Other columns stay as they are;
names of this module begin with ``__tl_``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .simhash import SEED, components

WIDTH = 5
AHEAD = 4
WALK_BITS = 2048  # classes of the parities that a walk compares


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of one whole text as sorted signed 64-bit integers."""
    words = text.lower().split()
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= WIDTH:
        hashes = np.array([digest(line, SEED)] if words else [], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: 1 - WIDTH].tolist()
        ends = (ends - 1)[WIDTH - 1 :].tolist()
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts))
    return np.unique(hashes.view(np.int64))


def parities(hashes: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Of each of ``bits`` classes (a power of two; by default the first from twice the shingles on, at least 64) whether it has an odd number of the shingles, as ``bits`` / 64 integers."""
    bits = bits or max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else bits or 64
    odd = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def differences(a: Column, b: Column) -> Column:
    """In how many classes parities differ; one of both may have twice as many classes."""

    def folded(x: Column, y: Column) -> Column:
        return F.when(F.size(x) <= F.size(y), x).otherwise(F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda p, q: p.bitwiseXOR(q)))

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)


def _prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def prefix(hashes: np.ndarray, crowded: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in order; ``crowded`` (sorted) come last, by ``numbers``."""
    most = _prefix_size(len(hashes))
    if len(crowded):
        at = np.minimum(np.searchsorted(crowded, hashes), len(crowded) - 1)
        late = np.where(crowded[at] == hashes, numbers[at], 0)
        if late.any():
            return hashes[np.lexsort((hashes, late))[:most]]
    return hashes[:most]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text a digest of its set, its fingerprint, its size and its parities."""
    for batch in common.sub_batches(batches):
        sets = [shingles(x) for x in common.texts(batch.column("text"))]
        digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64)
        prints = np.array([simhash.majority(s) for s in sets], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(digests.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), _lists([parities(s) for s in sets])], names=["row", "digest", "print", "n", "bits"])


def ahead(hashes: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """The shingles that may take the places of ``crowded`` (sorted) ones in the prefix of a set: the next AHEAD for each."""
    most = _prefix_size(len(hashes))
    at = np.searchsorted(crowded, hashes[:most])
    go = int((crowded[np.minimum(at, len(crowded) - 1)] == hashes[:most]).sum())
    return hashes[most : most + AHEAD * go]


def _counted(some: Callable[[np.ndarray], np.ndarray]):
    """Of each batch the shingles that ``some`` takes of the sets, in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sub_batches(batches):
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *(some(shingles(x)) for x in common.texts(batch.column("text")))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["key", "m"])

    return run


def _places(crowded: np.ndarray, numbers: np.ndarray):
    """Of each text its prefix: shingle, row, and size and place as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sub_batches(batches):
            sets = [shingles(x) for x in common.texts(batch.column("text"))]
            keys = [prefix(s, crowded, numbers) for s in sets]
            n = np.array(list(map(len, keys)), dtype=np.int64)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            size = np.repeat(np.array(list(map(len, sets)), dtype=np.int64), n)
            rows = np.repeat(batch.column("row").to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(rows), pa.array(size << 32 | place)], names=["key", "row", "at"])

    return run


def _meet(crowd: int):
    """From places sorted by shingle: candidate pairs, and for crowded shingles each row beside the first one."""

    def pairs(key: np.ndarray, row: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(start, len(key)))
        first, few = np.repeat(row[start], many), np.repeat(many, many) <= crowd
        n, i = at >> 32, at & 0xFFFFFFFF
        a, b = [first[~few]], [row[~few]]
        for d in range(1, min(crowd, int(many.max()))):
            x = np.flatnonzero((key[d:] == key[:-d]) & few[d:])
            y = x + d
            ok = 9 * np.minimum(n[x] - i[x], n[y] - i[y]) >= 4 * (n[x] + n[y])
            a.append(np.minimum(row[x[ok]], row[y[ok]]))
            b.append(np.maximum(row[x[ok]], row[y[ok]]))
        a, b = np.concatenate(a), np.concatenate(b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < int((~few).sum()))], names=["a", "b", "crowded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if batch.num_rows:
                held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("key", "row", "at"))]
                # The last shingle may go on in the next batch.
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield from pairs(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        yield from pairs(*held)

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.sub_batches(batches):
        yield pa.RecordBatch.from_arrays([batch.column("row"), _lists([shingles(x) for x in common.texts(batch.column("text"))])], names=["row", "hashes"])


def _at_least(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles differ at least between sets of these parities; the longer ones fold to the length of the shorter."""
    k = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(p.reshape(-1, k), axis=0) for p in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _compare(sets: list[np.ndarray], label: np.ndarray, reach: np.ndarray, left: np.ndarray, right: np.ndarray | None, own: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links that connect all that is linked between ``left`` and ``right`` (None: within ``left``), and of the classes that stay apart pairs of sets that differ by at most 0.2 and both their ``reach``.

    ``label``: the class of each set, a number of one of its members; it is changed where links join classes. Sets of equal ``own`` are not compared.
    """
    n = np.array(list(map(len, sets)), dtype=np.int64)
    bits = np.stack([parities(s, WALK_BITS) for s in sets]).view(np.uint64)
    fine = [parities(s).view(np.uint64) for s in sets]  # as long as the set asks for: the others say little of long texts
    links, near = [], []
    for i, x in enumerate(left.tolist()):
        y = left[i + 1 :] if right is None else right
        y = y[(label[y] != label[x]) & (True if own is None else own[y] != own[x])]
        # Sets that differ in d shingles are 2d / (a + b + d) apart.
        differ = np.maximum(np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64), np.abs(n[y] - n[x]))
        ok = np.flatnonzero(2 * differ <= (0.2 + reach[x] + reach[y] + 1e-9) * (n[x] + n[y] + differ))
        for k in y[ok[np.argsort(differ[ok], kind="stable")]].tolist():
            both, least = int(n[x] + n[k]), _at_least(fine[x], fine[k])
            far = 0.2 + reach[x] + reach[k] + 1e-9
            if label[k] == label[x] or 2 * least > far * (both + least):
                continue
            c = len(np.intersect1d(sets[x], sets[k], assume_unique=True))
            if 9 * c >= 4 * both:
                links.append((x, k))
                label[label == label[k]] = label[x]
            elif reach[x] + reach[k] > 0 and both - 2 * c <= far * (both - c):
                near.append((x, k))
    return links, [(x, k) for x, k in near if label[x] != label[k]]


def _sets_of(group: pa.Table) -> list[np.ndarray]:
    return [shingles(x or b"") for x in group.column("text").cast(pa.large_binary()).to_pylist()]


def _within(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """The classes of a block: of each row one member that stands for the class, and how far the row is from that."""
    rows, sets = group.column("row").to_numpy(), _sets_of(group)
    label = np.arange(len(rows))
    _compare(sets, label, np.zeros(len(rows)), label.copy(), None)
    common_ones = [len(np.intersect1d(sets[i], sets[k], assume_unique=True)) for i, k in enumerate(label.tolist())]
    far = [1 - c / max(len(sets[i]) + len(sets[k]) - c, 1) for i, (k, c) in enumerate(zip(label.tolist(), common_ones))]
    root, own = (pa.array([k.as_py()] * len(rows), t) for k, t in zip(key, (pa.int64(), pa.int32())))
    return pa.table({"root": root, "own": own, "parts": group.column("parts"), "rep": pa.array(rows[label]), "row": pa.array(rows), "n": group.column("n"), "far": pa.array(far, pa.float64())})


def _between_blocks(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Links between two blocks (or within one) of rows that stand for classes, and pairs whose classes may still have links. Classes of one block of members (``own``) have none."""
    rows = group.column("row").to_numpy()
    first = np.asarray(group.column("first").to_numpy(zero_copy_only=False), dtype=bool)
    one = key[1].as_py() == key[2].as_py()
    left, right = (np.arange(len(rows)), None) if one else (np.flatnonzero(first), np.flatnonzero(~first))
    links, near = _compare(_sets_of(group), np.arange(len(rows)), group.column("reach").to_numpy(), left, right, group.column("own").to_numpy())
    a, b = np.array([*links, *near], dtype=np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(rows[a]), "b": pa.array(rows[b]), "linked": pa.array(np.arange(len(a)) < len(links))})


def _across(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Links between members of classes of one block (``first``) and those of classes of others."""
    rows = group.column("row").to_numpy()
    first = np.asarray(group.column("first").to_numpy(zero_copy_only=False), dtype=bool)
    _, at, label = np.unique(group.column("class").to_numpy(), return_index=True, return_inverse=True)
    links, _ = _compare(_sets_of(group), at[label], np.zeros(len(rows)), np.flatnonzero(first), np.flatnonzero(~first))
    a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(rows[a]), "b": pa.array(rows[b])})


def _parts(count: Column, shingles_of: Column, block: int) -> Column:
    """In how many blocks of about ``block`` rows, and of 4096 shingles a row at most, so many rows and shingles go."""
    return F.greatest(F.ceil(count / block), F.ceil(shingles_of / (block << 12)), F.lit(1)).cast("int")


def crowded_links(together: DataFrame, texts_of: Callable[[DataFrame, bool], DataFrame], block: int) -> DataFrame:
    """(a, b): pairs that connect what is linked among the rows of each ``root`` of ``together`` (row, root, n; a written table).

    No task gets over about three blocks of rows. First blocks of each root are compared within, which settles roots of one block. Else one row
    stands for each class found, with its reach, the distance of the member farthest from it; these rows are compared in pairs of blocks. Distance is a
    metric, so two classes can only be linked by other members if the rows that stand for them are within 0.2 and both reaches: the members of such
    classes, if still apart, are compared last, those of a block's larger classes with the others in chunks of a block. So no text goes to more
    tasks than twice the blocks of its root.
    """

    def with_texts(some: DataFrame, row_bytes: int) -> DataFrame:
        # One row may go to several groups; its text is read once and joined to them.
        return texts_of(some.select("row").distinct(), True).join(common.bounded_broadcast(some, some.count(), row_bytes), "row")

    def dealt(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("root").agg(F.count("*").alias("many"), _parts(F.count("*"), F.sum("n"), block).alias("parts"))
        return rows.join(common.bounded_broadcast(sizes, sizes.count(), 32), "root").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))

    alone = common.stage(dealt(together).select("row", "root", "n", "part", "parts"), "shingles-blocks")
    members = with_texts(alone, 48).groupBy("root", "part").applyInArrow(_within, "root long, own int, parts int, rep long, row long, n long, far double")
    members = common.stage(members, "shingles-members")
    edges = members.where("rep <> row").select(F.col("rep").alias("a"), F.col("row").alias("b"))

    reps = members.where("parts > 1").groupBy("root", "own", F.col("rep").alias("row")).agg(
        F.max("far").alias("reach"), F.count("*").alias("size"), F.sum("n").alias("weight"), F.max(F.when(F.col("rep") == F.col("row"), F.col("n"))).alias("n")
    )
    reps = common.stage(dealt(reps).where("many >= 2"), "shingles-reps")
    if reps.isEmpty():
        return edges
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.struct(F.least("part", t).alias("lo"), F.greatest("part", t).alias("hi")))
    pairs = reps.select("root", "own", "row", "reach", "part", F.explode(meet).alias("p")).select("root", "own", "row", "reach", "p.lo", "p.hi", (F.col("part") == F.col("p.lo")).alias("first"))
    pairs = common.stage(pairs, "shingles-meet")
    found = common.stage(with_texts(pairs, 56).groupBy("root", "lo", "hi").applyInArrow(_between_blocks, "a long, b long, linked boolean"), "shingles-between")
    edges = edges.unionByName(found.where("linked").select("a", "b"))

    near = found.where("NOT linked").select("a", "b")
    if near.isEmpty():
        return edges
    of = reps.select("root", "own", "row", "size", "weight").join(components(edges).toDF("row", "class"), "row", "left")
    of = common.stage(of.select("row", F.struct("size", "weight", "root", "own", F.col("row").alias("rep"), F.coalesce("class", "row").alias("class")).alias("end")), "shingles-ends")
    apart = near.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").where("x.class <> y.class")
    apart = common.stage(apart.select(F.greatest("x", "y").alias("home"), F.least("x", "y").alias("other")), "shingles-apart")
    homes = apart.select("home.root", "home.own", "home.rep", "home.class", F.lit(True).alias("first")).distinct()
    others = apart.select("home.root", "home.own", "other.rep", "other.class", "other.size", "other.weight", F.lit(False).alias("first")).distinct()
    chunks = others.groupBy("root", "own").agg(_parts(F.sum("size"), F.sum("weight"), block).alias("chunks"))
    others = others.join(chunks, ["root", "own"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    homes = homes.join(chunks, ["root", "own"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sides = others.drop("size", "weight").unionByName(homes).drop("chunks")
    sides = common.stage(sides.join(members.select("rep", "row"), "rep").drop("rep"), "shingles-sides")
    return edges.unionByName(with_texts(sides, 64).groupBy("root", "own", "chunk").applyInArrow(_across, "a long, b long"))


def _between(pairs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``pairs`` those whose ends ``edges`` don't connect, with their classes ``u`` and ``v`` (u < v); and the classes (node, root)."""
    roots = common.stage(components(edges), "shingles-roots")
    of = lambda c, to: roots.select(F.col("node").alias(c), F.col("root").alias(to))
    found = pairs.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").withColumns({"x": F.coalesce("x", "a"), "y": F.coalesce("y", "b")})
    return found.where("x <> y").select("a", "b", "differ", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")), roots


def _ends_of(some: DataFrame) -> DataFrame:
    return common.stage(some.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "shingles-ends")


def _sets_of_ends(pairs: DataFrame, texts_of: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    return common.stage(texts_of(_ends_of(pairs), True).mapInArrow(_hashes, "row long, hashes array<long>"), "shingles-sets")


def _linked(some: DataFrame, sets: DataFrame, name: str = "shingles-linked") -> DataFrame:
    """Those of the pairs ``some`` whose sets are alike."""
    both = some.select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return common.stage(both.where("9 * size(array_intersect(set_a, set_b)) >= 4 * (size(set_a) + size(set_b))").select("a", "b"), name)


def print_links(sketches: DataFrame, texts_of: Callable[[DataFrame, bool], DataFrame], crowd: int = 32) -> DataFrame:
    """(a, b), a written table: linked rows, one of each set, among those that their fingerprints (``print``) bring together."""
    own = common.stage(sketches.groupBy("digest").agg(F.min("row").alias("row"), F.first("print").alias("__tl_fp")).select("row", "__tl_fp"), "shingles-own")
    prints = common.stage(own.groupBy("__tl_fp").agg(F.min("row").alias("first")), "shingles-prints")
    same = own.join(prints, "__tl_fp").where("first <> row").select(F.col("first").alias("a"), F.col("row").alias("b"))
    of = lambda c: prints.select(F.col("__tl_fp").alias(c), F.col("first").alias(f"row_{c}"))
    near = simhash.links(prints.select("__tl_fp"), crowd).join(of("a"), "a").join(of("b"), "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    met = common.stage(same.unionByName(near), "shingles-near-prints")
    return _linked(met, _sets_of_ends(met, texts_of), "shingles-print-links")


def alike(pairs: DataFrame, texts_of: Callable[[DataFrame, bool], DataFrame], known: DataFrame) -> DataFrame:
    """The links ``known`` and links (a, b) among ``pairs`` (a, b, differ), a written table, that together connect all links of both. ``texts_of``: as ``links`` takes it."""
    if not pairs.isEmpty():
        pairs = common.stage(_between(pairs, known)[0].select("a", "b", "differ"), "shingles-unknown")
    if pairs.isEmpty():
        return known
    sets = _sets_of_ends(pairs, texts_of)

    def linked(some: DataFrame) -> DataFrame:
        ends = _ends_of(some)
        return _linked(some, sets.join(common.bounded_broadcast(ends, ends.count(), 16), "row", "left_semi"))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("row"), F.struct("differ", "a", "b").alias("p"))
    first = common.stage(ends.groupBy("row").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct(), "shingles-first")
    edges = known.unionByName(linked(first))
    left, _ = _between(pairs.join(first, ["a", "b"], "left_anti"), edges)
    left = common.stage(left, "shingles-left")
    second = common.stage(left.groupBy("u", "v").agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b"), "shingles-second")
    edges = edges.unionByName(linked(second))
    left, _ = _between(left.select("a", "b", "differ").join(second, ["a", "b"], "left_anti"), edges)
    return edges.unionByName(linked(left))


def links(texts: DataFrame, texts_of: Callable[[DataFrame, bool], DataFrame], sketches: DataFrame, known: DataFrame, crowd: int = 32, most: int = 1 << 20, block: int = 1024) -> DataFrame:
    """(a, b): linked rows whose chains connect all that are alike, those of ``known`` (a written table) among them.

    ``texts``: ``row`` and ``text``, no two of the same shingles; ``texts_of``: gives those of some rows (True) or of all others; ``sketches``: ``row``, ``n`` and ``bits``.
    """
    def counted(some: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        return texts.select("text").mapInArrow(_counted(some), "key long, m long").groupBy("key").agg(F.sum("m").alias("m")).where(f"m > {crowd}")

    def most_crowded(counts: DataFrame) -> pa.Table:
        least = crowd
        while counts.where(f"m > {least}").count() > most:
            least *= 2
        return counts.where(f"m > {least}").toArrow().sort_by("key")

    none = np.zeros(0, np.int64)
    late = common.stage(counted(lambda s: prefix(s, none, none)), "shingles-crowded")
    table = most_crowded(late)
    if table.num_rows:
        first = table.column("key").to_numpy()
        late = late.unionByName(counted(lambda s: ahead(s, first))).groupBy("key").agg(F.sum("m").alias("m"))
        table = most_crowded(common.stage(late, "shingles-crowded"))
    places = texts.mapInArrow(_places(table.column("key").to_numpy(), table.column("m").to_numpy()), "key long, row long, at long")
    met = places.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(crowd), "a long, b long, crowded boolean").distinct()
    met = common.stage(met, "shingles-met")

    of = lambda c: sketches.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    pairs = met.where("NOT crowded").select("a", "b").join(of("a"), "a").join(of("b"), "b").withColumn("differ", differences(F.col("bits_a"), F.col("bits_b"))).where("9 * differ <= n_a + n_b")
    edges = alike(common.stage(pairs.select("a", "b", (F.col("differ") / (F.col("n_a") + F.col("n_b"))).alias("differ")), "shingles-pairs"), texts_of, known)

    together = components(met.where("crowded AND a <> b").select("a", "b"))
    together = together.unionByName(together.select(F.col("root").alias("node"), "root")).distinct().toDF("row", "root")
    together = common.stage(together.join(sketches.select("row", "n"), "row"), "shingles-together")
    return edges.unionByName(crowded_links(together, texts_of, block))


def shingle_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 32, block: int = 1024) -> DataFrame:
    """The row of smallest doc_id of each class, with all its columns. Of the classes only the numbers of rows to drop come back to the rows."""
    common.ship(docs.sparkSession)
    numbered = common.Numbered(docs, "shingles-documents")
    rows = numbered.rows()
    of = lambda some: some.select(F.col("__tl_row").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts_of = lambda some, inside: of(numbered.picked(some.select(F.col("row").alias("__tl_row")), inside))
    texts = of(rows)
    sketches = common.stage(texts.mapInArrow(_sketches, "row long, digest long, print long, n long, bits array<long>"), "shingles-sketches")

    first = sketches.groupBy("digest").agg(F.count("*").alias("many"), F.min("row").alias("a")).where("many >= 2").select("digest", "a")
    equal = common.stage(sketches.select("digest", F.col("row").alias("b")).join(first, "digest").where("a <> b").select("a", "b"), "shingles-equal")
    known = print_links(sketches, texts_of)
    edges = links(texts_of(equal.select(F.col("b").alias("row")), False), texts_of, sketches, known, crowd, block=block).unionByName(equal)
    roots = common.stage(components(edges), "shingles-roots")
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    known = rows.select(F.col("__tl_row").alias("node"), F.col(f"`{id_col}`").alias("__tl_id")).join(nodes, "node")
    known = common.stage(known.select("root", "node", F.struct(F.col("__tl_id").isNull().alias("x"), F.col("__tl_id").alias("y"), F.col("node").alias("z")).alias("rank")), "shingles-known")
    stays = known.groupBy("root").agg(F.min("rank").alias("stay"))
    return numbered.without(known.join(stays, "root").where("node <> stay.z").select(F.col("node").alias("__tl_row")))
