"""Texts shorter than a training window and the ends of longer ones train the field."""

import math
import zlib
from collections import Counter

import numpy as np

from tracelode.llm import common, toxicity_crf


def test_padding_does_not_count():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (40, 10))
    y = (x == 3).astype(np.int64)
    own = np.arange(4)[:, None]
    padded = [np.pad(t, ((0, 0), (0, 7))) for t in (x, y)]
    for a, b in zip(toxicity_crf.fit_field(x, y, own, 3), toxicity_crf.fit_field(*padded, own, 3, lengths=np.full(40, 10))):
        assert np.allclose(a, b)


def test_weights_count_windows():
    """A window of weight three counts as three windows."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 4, (30, 12))
    y = (x == 2).astype(np.int64)
    own, often = np.arange(4)[:, None], rng.integers(1, 4, 30)
    for a, b in zip(toxicity_crf.fit_field(np.repeat(x, often, axis=0), np.repeat(y, often, axis=0), own, 3), toxicity_crf.fit_field(x, y, own, 3, weights=often.astype(float))):
        assert np.allclose(a, b)


def test_clean_windows_train_beside_many_toxic_ones():
    """Trait 2 stands in toxic and clean documents alike; so many windows of toxic ones that they would fill all places don't make it toxic."""
    rng = np.random.default_rng(2)
    docs, y = [], []
    for i in range(250):
        d = np.where(rng.random(640) < 0.2, 2, 0)
        if i % 5 == 0:
            d[rng.integers(0, 640, 30)] = 1
        docs.append(d)
        y.append(int(i % 5 == 0))
    model = toxicity_crf.train(docs, np.array(y), {11: 9.0, 12: 7.0}, windows=300)
    assert model.traits[11] + model.other > 0 > model.traits[12] + model.other


def test_tails_train():
    """Traits 1 stand after the last whole window only."""
    docs = [np.array([0] * 64 + [label] * 6, dtype=np.int16) for label in (0, 1)] * 30
    model = toxicity_crf.train(docs, np.array([0, 1] * 30), {11: 8.0})
    assert model.traits[11] > 0 > model.other


def test_short_labelled_texts(spark):
    rng = np.random.default_rng(1)
    words = [f"plain{k}" for k in range(200)]
    rows = []
    for i in range(600):
        text = rng.choice(words, 10).tolist()
        if i % 2:
            text[4:6] = ["vilest", "scum"]
        rows.append((i, " ".join(text), i % 2))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = toxicity_crf.toxicity(docs, labels).collect()
    assert len(out) == 600 and any(r.held_out for r in out)
    assert all(r.predicted == r.doc_id % 2 and bool(r.spans) == bool(r.doc_id % 2) for r in out)


def test_kinds_of_tokens():
    rng = np.random.default_rng(4)
    lists = [sorted(rng.choice(9, rng.integers(0, 4), replace=False) + 1) for _ in range(300)]
    kind, traits_of = toxicity_crf.token_kinds(np.array(list(map(len, lists)), dtype=np.int8), np.array([k for x in lists for k in x], dtype=np.int16))
    assert [[k for k in traits_of[j].tolist() if k] for j in kind] == lists
    assert len(traits_of) == len({tuple(x) for x in lists})
    assert toxicity_crf.token_kinds(np.zeros(3, np.int8), np.zeros(0, np.int16))[0].tolist() == [0, 0, 0]


def plain_score(text, model):
    """Forward-backward over one text, step by step; the curve over its marginals."""
    tokens = (text or "").encode().lower().split()
    e, a = [math.exp(model.other + sum(model.traits.get(t, 0.0) for t in toxicity_crf.traits(w))) for w in tokens], np.exp(model.moves)
    forward, backward = [], [(1.0, 1.0)]
    for x in e:
        f = (1.0, x) if not forward else tuple(sum(forward[-1][i] * a[i, j] for i in (0, 1)) * (1.0, x)[j] for j in (0, 1))
        forward.append(tuple(v / sum(f) for v in f))
    for x in e[:0:-1]:
        b = tuple(sum(a[i, j] * (1.0, x)[j] * backward[-1][j] for j in (0, 1)) for i in (0, 1))
        backward.append(tuple(v / sum(b) for v in b))
    p = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward[::-1])]
    measures = [max(p), math.log1p(sum(p)), math.sqrt(sum(p) / len(p))] if p else [0.0] * 3
    return 1 / (1 + math.exp(-(model.curve[0] + sum(w * m for w, m in zip(model.curve[1:], measures)))))


def test_against_plain(spark, monkeypatch):
    """Traits counted one document at a time, and scores of whole texts, on all documents of a small table."""
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    models = []
    train = toxicity_crf.train
    monkeypatch.setattr(toxicity_crf, "train", lambda *a: models.append(train(*a)) or models[-1])
    got = {r.doc_id: r.score for r in toxicity_crf.toxicity(docs, labels).collect()}

    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    seen = Counter(), Counter()
    for i, text in rows:
        if i in y:
            seen[y[i]].update({t for w in (text or "").encode().lower().split() for t in toxicity_crf.traits(w)})
    known = sum(i in y for i, _ in rows)
    bad = sum(y.get(i, 0) for i, _ in rows)
    better = {t for t, n in seen[1].items() if n >= 3 and n / bad > (n + seen[0][t]) / known}
    assert len(better) < 5000 and set(models[0].traits) == better

    assert len(got) == len(rows)
    for i, text in rows:
        assert abs(got[i] - plain_score(text, models[0])) < 1e-6
