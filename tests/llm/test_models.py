"""Classifiers on held-out labels, the language model against exact counts, WARC round trips."""

import base64
import gzip
import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracelode.llm import common, lm_bloom, pairwise_quality, toxicity_crf, warc
from tracelode.llm.queries import queries

DATA = "/root/testdata/sf0.001"

SF = DATA.replace("0.001", "0.1")


def held_out(doc_id, folds=5):
    return zlib.crc32((str(doc_id) if doc_id is not None else "").encode()) % folds


def accuracy(spark, scores, label):
    labels = common.table(spark, SF, "labels").select("doc_id", F.col(label).alias("y"))
    rows = scores.join(labels, "doc_id").where("held_out").select("score", "predicted", "y").collect()
    good, bad = ([r.score for r in rows if r.y == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(good, bad)])
    return auc, Counter((r.y, r.predicted) for r in rows)


def test_quality_on_held_out_labels(spark):
    scores = pairwise_quality.op3_pairwise_quality(spark, SF)
    auc, table = accuracy(spark, scores, "quality")
    assert auc > 0.99 and table[1, 1] > 0.98 * (table[1, 1] + table[1, 0]) and table[0, 0] > 0.95 * (table[0, 0] + table[0, 1])


def test_toxicity_on_held_out_labels(spark):
    scores = toxicity_crf.op7_toxicity_crf(spark, SF)
    auc, table = accuracy(spark, scores, "toxic")
    assert auc > 0.9 and table[1, 1] > 0.75 * (table[1, 1] + table[1, 0]) and table[0, 0] > 0.98 * (table[0, 0] + table[0, 1])
    texts = scores.where(F.size("spans") > 0).join(common.table(spark, SF, "documents").select("doc_id", "text"), "doc_id").limit(50).collect()
    for r in texts:
        for s in r.spans:
            assert r.text[s.start : s.end].split() and (s.start == 0 or r.text[s.start - 1].isspace())


def test_labels_that_are_held_out_do_not_count(spark, labels, odd):
    flipped = labels.withColumns({c: F.when(common.fold_of(F.col("doc_id")) == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for f in (pairwise_quality.quality_scores, toxicity_crf.toxicity):
        assert sorted(map(repr, f(odd, labels).collect())) == sorted(map(repr, f(odd, flipped).collect()))


@pytest.mark.parametrize("f", [pairwise_quality.quality_scores, toxicity_crf.toxicity])
def test_scores_of_odd_rows(spark, odd, empty, labels, f):
    for known in (labels, labels.where("false")):
        rows = f(odd, known).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and all(r.held_out == (held_out(r.doc_id) == 0) for r in rows)
        cut = 0.3 if f is pairwise_quality.quality_scores else 0.5
        assert all(r.predicted == int(r.score >= cut) for r in rows)
    assert f(empty, labels).count() == 0


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(4)
    moves = rng.normal(size=(2, 2))
    lengths = np.array([7, 5, 5, 1])
    e = rng.normal(size=(7, 4))
    p = toxicity_crf.forward_backward(e, moves, lengths)
    for k, n in enumerate(lengths):
        weight, total = np.zeros(n), 0.0
        for path in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e[t, k] for t in range(n) if path[t]) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            weight += w * np.array(path)
        assert np.allclose(p[:n, k], weight / total)


def test_field_gradient_learns_neighbours():
    """Toxic tokens come in runs; one that is ambiguous is toxic beside another and clean alone."""
    rng = np.random.default_rng(5)
    x, y = np.full((300, 64), 0), np.zeros((300, 64), dtype=int)
    for i in range(0, 300, 2):
        at = int(rng.integers(0, 60))
        x[i, at : at + 3], y[i, at : at + 3] = [1, 2, 1], 1
    for i in range(1, 300, 2):
        x[i, rng.integers(0, 64)] = 2
    bias, own, moves = toxicity_crf.fit_field(x, y, np.arange(3)[:, None], 2)
    potential = lambda row: bias + own[row]
    beside = toxicity_crf.forward_backward(potential(np.array([0, 0, 1, 2, 1, 0]))[:, None], moves, np.array([6]))[:, 0]
    alone = toxicity_crf.forward_backward(potential(np.array([0, 0, 0, 2, 0, 0]))[:, None], moves, np.array([6]))[:, 0]
    assert beside[3] > 0.9 and alone[3] < 0.5 and beside[0] < 0.1


def test_pairs_rank():
    rng = np.random.default_rng(6)
    good, bad = rng.normal([1, 0], 1, (400, 2)), rng.normal([-1, 0], 1, (300, 2))
    w = pairwise_quality.fit_pairs(good, bad, 20_000)
    assert w[0] > 1 and abs(w[1]) < 0.3 and not pairwise_quality.fit_pairs(good, bad[:0], 10).any()


def plain_model(rows, mass):
    """Scores from exact counts: n_tokens, n_known, base, and the model's."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    token = lambda t: [w for w in (t or "").translate(lower).encode().split()] + [b"\n"]
    one, two, starts = Counter(), Counter(), 0
    for i, t in rows:
        if held_out(i) != 1:
            w = token(t)
            one.update(w)
            two.update(zip([b"", *w], w))
            starts += 1
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in rows:
        w, base, both = token(t), 0.0, 0.0
        for a, b in zip([b"", *w], w):
            p = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            both += math.log10((two[a, b] + mass * p) / ((one[a] if a else starts) + mass))
        out.append((i, held_out(i) == 1, len(w), sum(one[x] > 0 for x in w), n, base, both))
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 30, 20_000])
def test_language_model(spark, slice_bytes):
    rows = [(r.doc_id, r.text) for r in common.table(spark, DATA, "documents").collect()]
    got = {r.doc_id: r for r in lm_bloom.op9_lm_bloom(spark, DATA, slice_bytes=slice_bytes).collect()}
    for i, out, n, known, total, base, both in plain_model(rows, 500.0):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
        assert abs(r.score - both) < 0.05 * abs(both) + 0.3  # counts are quantised
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_language_model_of_odd_rows(spark, odd, empty):
    for train in (odd, empty):
        model = lm_bloom.train(train)
        rows = lm_bloom.score_documents(odd.withColumn("held_out", F.lit(True)), model).collect()
        assert len(rows) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows) and {r.n_tokens for r in rows if r.doc_id in (4, 5, 8)} == {1}
        assert model.n == sum(r.n_tokens for r in rows) or train is empty
    assert lm_bloom.score_documents(empty.withColumn("held_out", F.lit(True)), model).count() == 0


def test_filter_never_counts_too_few():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 2**48, 5000, dtype=np.uint64))
    counts = rng.integers(1, 2000, len(keys)).astype(np.uint64)
    blob = lm_bloom.build_filter(keys, counts, 1.5).tobytes()
    table = lm_bloom.Slice([("pair", 0, len(keys), int(counts.sum()), len(blob))], 1, 1.5)
    table.put("pair", 0, blob)
    level = table.pairs(keys).astype(int)
    assert (level >= lm_bloom.levels(counts, 1.5)).all() and (level == lm_bloom.levels(counts, 1.5)).mean() > 0.98
    others = np.setdiff1d(rng.integers(0, 2**48, 20_000, dtype=np.uint64), keys)
    assert (table.pairs(others) > 0).mean() < 0.005
    k, c = lm_bloom._unpack(lm_bloom._pack(keys, counts))
    assert (k == keys).all() and (c == counts).all()


PAGES = "page_id long, url string, html string, record_type string, payload binary"
PAGE_ROWS = [(3, "http://a/1", "same"), (1, "http://a/2", "same"), (2, None, "same"), (4, "http://b\r\nX: y", ""), (5, "u", None), (6, "u", "WARC/1.1\r\n\r\nHTTP\r\n\r\nßß"), (None, "u", "same"), (7, "u", "x" * 300_000), (7, "u", "x" * 300_000), (8, "u", "x" * 300_000), (None, None, "alone")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "x", b"y") for r in PAGE_ROWS], PAGES).repartition(2)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip(spark, pages, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path, compression)
    rows = warc.read_warc(spark, path).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    urn = lambda i: None if i is None else f"urn:x-page:{i}"
    expected = Counter()
    for i, _, html in PAGE_ROWS:
        same = [k for k, _, t in PAGE_ROWS if (t or "") == (html or "") and k is not None]
        again = bool(same) and i != min(same)
        expected[(urn(i) if i is not None else None, len((html or "").encode()), digest(html), "revisit" if again else "response", urn(min(same)) if again else None, None if again else (html or "").encode())] += 1
    got = Counter((r.record_id if r.record_id.startswith("urn:x-page") else None, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows)
    assert got == expected
    assert {r.target_uri for r in rows} == {"http://a/1", "http://a/2", None, "http://b%0D%0AX: y", "u"}
    for mode in ("no", "verify"):
        assert Counter(r.payload_digest for r in warc.read_warc(spark, path, mode).collect()) == Counter(k[2] for k in expected.elements())


def test_warc_pushdown(spark, pages, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_pages(pages, path)
    df = warc.read_warc(spark, path).where("record_type = 'revisit' AND record_id IN ('urn:x-page:3', 'urn:x-page:8') AND payload_bytes > 3")
    assert sorted(r.record_id for r in df.collect()) == ["urn:x-page:3", "urn:x-page:8"]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(rest) == 1 and reader.wanted == {"record_type": {"revisit"}}
    assert {t for p in reader.partitions() for b in reader.read(p) for t in b.column("record_type").to_pylist()} == {"revisit"}


def test_warc_of_others(spark, tmp_path):
    """Files without a manifest or member lengths, a truncated file, and a wrong digest."""
    one = warc.record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:a>", "Content-Type": "text/plain"}, b"info")
    two = warc.record_bytes({"warc-type": "response", "WARC-Record-ID": "<urn:b>", "Content-Type": "application/http", "WARC-Payload-Digest": "sha1:" + warc.payload_digest(b"body")}, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody")
    (tmp_path / "x.warc").write_bytes(one + two)
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in rows) == [("response", b"body")] * 2 + [("warcinfo", b"info")] * 2
    assert warc.read_warc(spark, f"file://{tmp_path}").where("record_type = 'response'").count() == 2
    (tmp_path / "z.warc").write_bytes((one + two)[:-12])
    with pytest.raises(Exception, match="ends within"):
        warc.read_warc(spark, f"file://{tmp_path}/z.warc").collect()
    (tmp_path / "z.warc").write_bytes(two.replace(b"body", b"bodx"))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, f"file://{tmp_path}/z.warc", "verify").collect()


def test_warc_of_no_pages(spark, pages, tmp_path):
    warc.write_pages(pages.where("false"), f"file://{tmp_path}/w")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 0


def test_op8(spark):
    rows = common.table(spark, DATA, "pages").collect()
    least: dict = {}
    for r in rows:
        least[r.html or ""] = min(least.get(r.html or "", r.page_id), r.page_id)
    got = {r.page_id: r for r in warc.op8_warc(spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        data, first = (r.html or "").encode(), least[r.html or ""]
        g = got[r.page_id]
        assert (g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == r.page_id else "revisit", None if first == r.page_id else first)


def test_all_ten_are_registered():
    names = [n.split("_")[0] for n in queries()]
    assert names == [f"op{i}" for i in range(1, 11)] and "pipeline" in entry.queries()
