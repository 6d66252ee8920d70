"""Tokenizer, token store and packing: exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracelode.llm import common, packing, token_store, tokens

DATA = "/root/testdata/sf0.001"

PATH = tokens.tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_the_text(plain):
    letters = list("abZé \t\n\r\x0b\x0c\x1c\x85\xa0́​  'sIİßΣς1２,!|<>*×÷ǅ") + ["<|endoftext|>", "'ll", "H̱", "***", "don't"]
    rng = random.Random(3)
    t = tokens.WordTokenizer(PATH, most=50)  # so that the memory starts afresh on the way
    for _ in range(150):
        docs = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(8)]
        ids, at = t.encode([d.encode() for d in docs], end=1)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain(d) + [1] for d in docs]


def test_cuts_depend_on_content_alone():
    rng = np.random.default_rng(1)
    how = token_store.Chunking(bits=6, least=32, most=200)
    passage = rng.integers(0, 49_000, 3000).astype(np.uint32)
    docs = [np.concatenate([rng.integers(0, 49_000, n).astype(np.uint32), passage]) for n in (0, 17, 500)]
    pieces = []
    for d in docs:
        ends, counts = token_store.cut_points(d, np.array([0, len(d)]), how)
        assert counts.tolist() == [len(ends)] and ends[-1] == len(d) and max(np.diff(ends, prepend=0)) <= how.most
        pieces.append({d[a:b].tobytes() for a, b in zip([0, *ends], ends)})
    assert len(pieces[0] & pieces[1] & pieces[2]) > 0.6 * len(pieces[0])
    together = np.concatenate(docs)
    ends, counts = token_store.cut_points(together, np.cumsum([0, *map(len, docs)]), how)
    assert sum(counts) == sum(len(token_store.cut_points(d, np.array([0, len(d)]), how)[0]) for d in docs)


def test_checksums_join():
    rng = random.Random(5)
    for _ in range(20):
        a, b = (rng.randbytes(rng.randrange(40)) for _ in "ab")
        got = token_store.crc_join(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert got[0] == zlib.crc32(a + b)


def test_merkle_stream_is_a_root():
    leaves = [bytes([i]) * 16 for i in range(11)]
    roots = set()
    for n in range(12):
        s = token_store.MerkleStream()
        for x in leaves[:n]:
            s.add(x)
        roots.add(s.root())
    assert len(roots) == 12


def expected_store(rows, plain):
    out, at = [], 0
    for i, t in rows:
        ids = np.array(plain(t) + [2], dtype="<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_store_of_odd_rows(spark, odd, empty, plain, tmp_path):
    store = token_store.write_store(odd, f"file://{tmp_path}/a", how=token_store.Chunking(bits=5, least=24, most=256))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_digests(store).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda i: -1 if i is None else i)
    content = lambda rs: Counter((i, n, crc) for i, _, n, crc in rs)
    assert content(found) == content(expected_store(rows, plain)) and [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()
    by_id = defaultdict(list)
    for r in token_store.read_documents(store).collect():
        by_id[r.doc_id].append(np.frombuffer(r.ids, "<u2").tolist())
    for i in (1, 6, 9, 13):
        assert by_id[i] == [plain(t) + [2] for d, t in rows if d == i]
    digests = [bytes(r.digest) for r in store.chunks().collect()]
    assert len(digests) == len(set(digests)) and len(store.root()) == 16
    assert token_store.read_digests(token_store.write_store(empty, f"file://{tmp_path}/b")).count() == 0


def test_a_changed_chunk_is_found(spark, odd, tmp_path):
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    store = token_store.write_store(odd, f"file://{tmp_path}/a")
    bad = store.chunks().withColumn("ids", F.concat(F.col("ids"), F.lit(b"\x00\x00"))).withColumn("kind", F.lit("chunk"))
    bad.write.partitionBy("kind").parquet(f"file://{tmp_path}/c/packs")
    store.spark.read.parquet(f"{store.path}/recipes").write.partitionBy("kind").parquet(f"file://{tmp_path}/c/recipes")
    with pytest.raises(PythonException):
        token_store.read_digests(token_store.Store(spark, f"file://{tmp_path}/c", 2)).count()


def test_op1(spark, plain):
    rows = sorted((r.doc_id, r.text) for r in common.table(spark, DATA, "documents").collect())
    assert sorted(map(tuple, token_store.op1_token_store(spark, DATA).collect())) == expected_store(rows, plain)


def check_packing(pieces, rows, plain):
    rows = Counter((i, tuple(plain(t) + [1])) for i, t in rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        assert p.ids_crc32 == zlib.crc32(p.ids)
    got = Counter()
    for i, ps in docs.items():
        wanted = Counter({k: n for k, n in rows.items() if k[0] == i})
        parts = Counter((p.doc_tokens, p.start, bytes(p.ids)) for p in ps)
        expected = Counter()
        # Pieces of one document tile it; those of equal documents can't be told apart, so cover by position.
        for (_, ids), n in wanted.items():
            cover = Counter()
            for p in ps:
                if p.doc_tokens == len(ids) and np.array(ids[p.start : p.start + p.length], "<u4").tobytes() == bytes(p.ids):
                    cover.update(range(p.start, p.start + p.length))
            same = sum(m for (_, other), m in wanted.items() if other == ids)
            assert all(cover[k] >= same for k in range(len(ids)))
        got[i] = sum(p.length for p in ps)
        assert parts and not expected
    total = Counter()
    for (i, ids), n in rows.items():
        total[i] += n * len(ids)
    assert got == total
    padding = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == ps[0].sequence_tokens <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding


def test_packing_of_odd_rows(odd, empty, plain):
    pieces = packing.pack_documents(odd, with_ids=True).collect()
    assert check_packing(pieces, [(r.doc_id, r.text) for r in odd.collect()], plain) <= 2048 * odd.rdd.getNumPartitions()
    assert packing.pack_documents(empty).count() == 0


def test_op6_packs_all(spark, plain):
    docs = common.table(spark, DATA, "documents")
    pieces = packing.pack_documents(docs, with_ids=True)
    assert check_packing(pieces.collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], plain) <= 2048
    assert packing.op6_packing(spark, DATA).count() == pieces.count()


def test_step_groups_are_even(odd):
    groups = defaultdict(int)
    for p in packing.pack_documents(odd, step_tokens=4096).select("tier", "step_group", "sequence_id", "sequence_tokens").distinct().collect():
        groups[p.tier, p.step_group] += p.tier
    last = {t: max(g for u, g in groups if u == t) for t, _ in groups}
    assert all(n == 4096 for (t, g), n in groups.items() if g < last[t])


def test_packer_fills_windows():
    out = []
    p = packing.Packer(256, 16, lambda tier, window: out.append((tier, window)))
    rng = random.Random(2)
    sizes = [rng.randrange(1, 700) for _ in range(400)]
    for d, n in enumerate(sizes):
        p.add(d, n)
    p.pack()
    assert sum(n for _, w in out for n, _, _ in w) == sum(sizes)
    assert sum(sum(n for n, _, _ in w) < tier for tier, w in out) <= 1
