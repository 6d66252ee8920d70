"""The near-dedup stage takes its first links from SimHash fingerprints, and finds the others as well."""

import random

import numpy as np
from test_shingle_dedup import plain_kept

import corpus_pipeline
from tracelode.llm import common, shingle_dedup, simhash


def rows():
    r = random.Random(3)
    out = []
    for _ in range(12):
        text = [f"w{r.randrange(10**6)}" for _ in range(400)]
        out += [text + [f"n{k}"] for k in range(6)]  # a few bits apart at most
        out.append([w for w in text for _ in range(1 + (w == text[7]))])
        out.append(text[:180] + [f"m{r.randrange(10**6)}"] * 3 + text[180:] + [f"e{r.randrange(10**6)}" for _ in range(40)])  # alike by 0.8 and more, many bits apart
    r.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def test_links_of_fingerprints_are_taken_first(spark, monkeypatch):
    found, asked, stage, links = {}, [], common.stage, simhash.links
    monkeypatch.setattr(common, "stage", lambda df, name, by=None: found.setdefault(name, stage(df, name, by)) if name.startswith(("shingles-near-prints", "shingles-print-links", "shingles-pairs", "shingles-unknown")) else stage(df, name, by))
    monkeypatch.setattr(simhash, "links", lambda prints, crowd=32: asked.append(prints.count()) or links(prints, crowd))
    data = rows()
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(3), "")
    assert sorted(x.doc_id for x in kept.collect()) == plain_kept(data) and len(plain_kept(data)) == 12
    assert len(asked) == 1 and asked[0] > 12
    linked = found["shingles-print-links"].count()
    assert linked >= 12 and found["shingles-near-prints"].count() >= linked
    # Pairs that these links join are not compared again, and others are left to the prefixes.
    assert 0 < found["shingles-unknown"].count() < found["shingles-pairs"].count()


def test_fingerprints_propose_and_shingles_decide(spark):
    r = random.Random(4)
    data = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(30))) for i in range(50)]
    data += [(50 + i, t + " more") for i, t in data[:5]]
    docs = spark.createDataFrame(data, "row long, text string")
    prints = [(i, i, 7 if i % 50 < 4 else 4 if i == 4 else 5 if i == 54 else ~i << 20) for i, _ in data]  # equal, one bit apart, and far
    sketches = spark.createDataFrame(prints, "row long, digest long, print long")
    found = shingle_dedup.print_links(sketches, lambda some, inside: docs.join(some, "row"))
    # Of those of one fingerprint only the first meets the others: what that misses is found by prefixes.
    assert sorted(map(tuple, found.collect())) == [(0, 50), (4, 54)]


def test_majority():
    assert simhash.majority(np.zeros(0, np.int64)) == 0 and simhash.majority(np.array([-1, 5, 4], np.int64)) == 5
    assert simhash.majority(np.array([-1, 0], np.int64)) == 0  # over half, not half
