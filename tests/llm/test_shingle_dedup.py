"""Near deduplication by five-word shingles against a comparison of all pairs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelode.llm import common, shingle_dedup

DATA = "/root/testdata/sf0.01"


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def plain_kept(rows):
    """Ids that stay of rows (id, text): the least of each class."""
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s or {None}:
            at[x].append(k)
    for k, s in enumerate(sets):
        common_ones = Counter(j for x in s or {None} for j in at[x] if j > k)
        for j, c in common_ones.items():
            if not s or 5 * c >= 4 * (len(s) + len(sets[j]) - c):
                a, b = root(k), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted(least.values())


def crowds():
    """Copies with a few words changed, a line that many share, and short texts."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(rng.choices(words, k=14))
    out = []
    for base in range(6):
        text = rng.choices(words, k=(30, 60, 120, 250, 25, 400)[base])
        for _ in range(70):
            copy = list(text)
            for _ in range(rng.randrange(max(len(text) // 20, 2))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy) if rng.random() < 0.7 else f"{line} {' '.join(copy)}")
    out += [f"{line} {' '.join(rng.choices(words, k=rng.randrange(1, 30)))}" for _ in range(150)]
    out += [" ".join(rng.choices(words[:3], k=rng.randrange(7))) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("crowd, block", [(2, 1024), (2, 16), (32, 1024), (10_000, 1024)])
def test_every_link_is_found(spark, crowd, block):
    rows = crowds()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = plain_kept(rows)
    assert len(kept) < len(rows) - 200
    assert sorted(r.doc_id for r in shingle_dedup.shingle_dedup(docs, crowd=crowd, block=block).collect()) == kept


def test_stage_of_the_pipeline(spark):
    """Near copies whose fingerprints differ by three bits and more don't reach mixing."""
    docs = common.table(spark, DATA, "documents").where(F.length("text") > 100)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = corpus_pipeline.near_copies(spark, docs, DATA)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == plain_kept(rows)


def test_odd_rows(odd, empty):
    kept = shingle_dedup.shingle_dedup(odd)
    assert kept.columns == odd.columns and shingle_dedup.shingle_dedup(empty).count() == 0
    # 2, 3 and both rows of 10 are alike to 1; 4, 5, 8 and a row without id have no words.
    assert sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i)) == [1, 4, 6, 7, 9, 11, 12, 13, None]


def test_crowded_groups_do_not_depend_on_tasks(spark, monkeypatch):
    """A shingle that many texts hold comes last in their prefixes even if no task holds it twice, so texts with little else in common don't meet."""
    rng = random.Random(6)
    line = [f"l{k}" for k in range(12)]
    rows = [(i, " ".join([*line, *(f"w{rng.randrange(10**6)}" for _ in range(200))])) for i in range(40)]
    found, stage = [], common.stage

    def counted(df, name, by=None):
        out = stage(df, name, by)
        if name == "shingles-together":
            found.append(out.count())
        return out

    monkeypatch.setattr(common, "stage", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert shingle_dedup.shingle_dedup(docs.coalesce(1), crowd=8).count() == 40
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # a task for each file
    try:
        assert shingle_dedup.shingle_dedup(docs.repartitionByRange(40, "doc_id"), crowd=8).count() == 40
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == [0, 0]


def test_passages_of_many_texts_hold_none_together(spark, monkeypatch):
    """What takes the places of crowded shingles in prefixes is as common, and must come last too."""
    r = random.Random(5)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = own(60)
    rows = [(k, " ".join([*own(50), *passage, *own(50)])) for k in range(60)]
    held = []
    links = shingle_dedup.crowded_links

    def watched(together, *rest):
        held.append(together.count())
        return links(together, *rest)

    monkeypatch.setattr(shingle_dedup, "crowded_links", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(x.doc_id for x in shingle_dedup.shingle_dedup(docs, crowd=8).collect()) == plain_kept(rows) == list(range(60))
    assert held == [0]
