"""Quality rules, exact dedup, mixing, SimHash and the pipeline against plain versions."""

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_shingle_dedup import plain_kept

import corpus_pipeline
from tracelode.llm import common, exact_dedup, mixing, quality_rules, shingle_dedup, simhash

DATA = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_counts(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def documents(spark):
    return common.table(spark, DATA, "documents")


def plain_verdicts(rows):
    """Rows (key, text, lang, source) judged with exact quantiles instead of sketches."""
    facts = []
    for _, text, lang, source in rows:
        n, chars, symbols, dup, rep = plain_counts(text)
        w = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = n < 20 or 100 * rep > 30 * n
        angle = lambda a, b: (math.asin(math.sqrt(min(1.0, (a + 0.375) / (max(b, 1) + 0.75)))), max(b, 1))
        upper, adjacent = len(re.findall("[A-Z]", text or "")), sum(a == b for a, b in zip(w, w[1:]))
        facts.append((lang, source, failed, {"symbol_share": angle(symbols, chars), "word_length": (math.sqrt(chars / max(n, 1)), max(n, 1)), "dup_line_share": angle(dup, len(lines)), "adjacent_share": angle(adjacent, n), "upper_share": angle(upper, chars)}))
    good = [f for f in facts if not f[2]]
    out = []
    for lang, source, failed, ratios in facts:
        ok = not failed
        group = [f for f in good if f[:2] == (lang, source)]
        if len(group) < 200:
            group = [f for f in good if f[0] == lang]
        if len(group) < 200:
            group = good
        for r, (_, _, side) in quality_rules.RULES.items():
            if group and ok:
                values = np.sort([f[3][r][0] for f in group])
                at = lambda q, v=values: v[max(0, math.ceil(q * len(v)) - 1)]
                off, n = ratios[r][0] - at(0.5), ratios[r][1]
                deviation = math.hypot((at(0.5) - at(0.02)) / 2.0537489, 0.5 / math.sqrt(n + 0.5))
                ok = ok and (abs(off) if side == "both" else off) <= 6.0 * deviation
        out.append(ok)
    return out


def test_counts_of_odd_texts(odd):
    for r in quality_rules.quality_report(odd).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)


def test_rules_against_exact_quantiles(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in documents(spark).collect()]
    got = {r.doc_id: r.kept for r in quality_rules.op2_quality_rules(spark, DATA).collect()}
    assert got == {r[0]: ok for r, ok in zip(rows, plain_verdicts(rows))}
    labels = {r.doc_id: r.quality for r in common.table(spark, DATA, "labels").collect()}
    assert all(not got[i] for i, q in labels.items() if q == 0)
    assert all(got[r[0]] for r in rows if labels.get(r[0]) == 1 and plain_counts(r[1])[0] >= 20)


def test_bounds_follow_the_groups(spark):
    """Two groups of the same texts but for their symbols: what is usual in one is junk in the other, with no bound that both share."""
    rng = random.Random(4)
    words = [f"word{k}" for k in range(400)]
    rows = []
    for k in range(600):
        text = rng.choices(words, k=rng.randrange(40, 120))
        if k % 2:
            text = [w + "#" * rng.randrange(1, 4) for w in text]
        rows.append((k, " ".join(text), "en", ("plain", "marked")[k % 2]))
    odd_one = " ".join(w + "##" for w in rng.choices(words, k=80))
    rows += [(1000, odd_one, "en", "plain"), (1001, odd_one, "en", "marked")]
    got = {r.doc_id: (r.kept, r.broken) for r in quality_rules.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000][0] and "symbol_share" in got[1000][1] and got[1001][0] and all(got[k][0] for k in range(600))


@pytest.mark.parametrize("f", [quality_rules.apply_rules, exact_dedup.exact_dedup, simhash.near_dedup, shingle_dedup.shingle_dedup, mixing.mix])
def test_names_with_dots_and_maps(odd, f):
    rich = odd.select("doc_id", "text", "lang", "source", F.lit(1).alias("a.b"), F.lit("no text").alias("text.x"), F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    out = f(rich)
    assert out.columns == rich.columns
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, (r.doc_id for r in f(rich.select("doc_id", "text", "lang", "source")).collect())))
    assert all(r.m == {"k": r.doc_id} for r in out.collect())


def shuffled_columns(df):
    """Names of the columns that each exchange of a plan carries."""
    walks = "FlatMapGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()
    found, nodes = [], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.initialPlan()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            names = {node.output().apply(k).name() for k in range(node.output().size())}
            found.append(names - {"text"} if walks else names)  # texts that crowded shingles hold together
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return found


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, simhash.near_dedup, shingle_dedup.shingle_dedup])
def test_whole_rows_never_shuffle(spark, odd, f, monkeypatch):
    """With no room for broadcasts, and bitmaps a file at a time."""
    small = {str(r.doc_id): r for r in f(odd).collect()}
    staged, plans = common.stage, []
    monkeypatch.setattr(common, "stage", lambda df, *a, **b: plans.append(df) or staged(df, *a, **b))
    monkeypatch.setattr(common, "bounded_broadcast", lambda df, *_: df)
    picked = common.Numbered.picked
    monkeypatch.setattr(common.Numbered, "picked", lambda self, numbers, inside: picked(self, numbers, inside, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = staged(odd.repartition(4), "test")
        out = f(table)
        assert {str(r.doc_id) for r in out.collect()} == set(small) and out.count() == len(f(table).collect())
        carried = [x for df in (*plans, out) for x in shuffled_columns(df)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert carried and not any(x & {"text", "__tl_text", "__tl_of", "kind", "n_words"} for x in carried)


def test_rules_keep_columns_and_repeats(odd, empty):
    kept = quality_rules.apply_rules(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect())[10] == 2 and quality_rules.apply_rules(empty).count() == 0 and quality_rules.quality_report(empty).count() == 0


def plain_groups(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    return groups


def test_dedup_report(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    groups = plain_groups(rows)
    report = exact_dedup.dedup_report(odd).collect()
    assert len(report) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for digest, ids in by_digest.items():
        found = [r for r in report if r.text_sha256 == digest]
        top = max((i for i in ids if i is not None), default=None)
        assert len(found) == len(ids) and {r.group_size for r in found} == {len(ids)} and {r.keep_id for r in found} == {top} and sum(r.kept for r in found) == 1 and next(r for r in found if r.kept).doc_id == top
    assert exact_dedup.dedup_report(empty).count() == 0


def test_exact_dedup_keeps_one_whole_row(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns
    got = Counter((r.doc_id, (r.text or "").translate(LOWER)) for r in kept.collect())
    assert got == Counter({(max((i for i in ids if i is not None), default=None), t): 1 for t, ids in plain_groups(rows).items()})
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_op4_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    assert sorted(con.execute(exact_dedup.OP4_SQL).fetchall()) == sorted(map(tuple, exact_dedup.op4_exact_dedup(spark, DATA).collect()))


def test_filter_beyond_the_broadcast_bound(spark, odd, monkeypatch):
    monkeypatch.setattr(common.bounded_broadcast, "__defaults__", (0,))
    assert sorted(map(repr, exact_dedup.dedup_report(odd).collect())) and exact_dedup.exact_dedup(odd).count() == len(plain_groups([(r.doc_id, r.text) for r in odd.collect()]))


def plain_level(caps_and_weights, budget):
    """The level at which least(cap, level * weight) sums to the budget, by bisection."""
    low, high = 0.0, 1.0
    total = lambda x: sum(min(c, x * w) for c, w in caps_and_weights)
    if budget <= 0 or not caps_and_weights:
        return 0.0
    while total(high) < budget and high < 1e18:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < budget else (low, middle)
    return high


def plain_mix(rows):
    """Rows (source, size, hash): target and copies of each, by sorting each source."""
    size_of = defaultdict(int)
    for s, n, _ in rows:
        size_of[s] += n
    order = sorted(size_of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    level = plain_level([(2 * size_of[s], weight[s]) for s in order], 1.5 * sum(size_of.values()))
    target = {s: min(2 * size_of[s], level * weight[s]) for s in order}
    copies = [0] * len(rows)
    for s in order:
        own = [k for k, r in enumerate(rows) if r[0] == s and r[1] > 0]
        g = {k: rows[k][1].bit_length() for k in own}
        inner = plain_level([(2 * rows[k][1], rows[k][1] * g[k]) for k in own], target[s] * (1 - 1e-12))
        ranked, left = [], target[s]
        for k in own:
            e = 2.0 if target[s] >= 2 * size_of[s] * (1 - 1e-12) else min(2.0, inner * g[k])
            copies[k] = math.floor(e + 1e-9)
            left -= copies[k] * rows[k][1]
            p = max(0.0, e - copies[k])
            if p > 1e-9:
                u = ((rows[k][2] % 2**64 >> 11) + 0.5) / 2**53
                ranked.append((u / (1 - u) * (1 - p) / p, k))
        used = 0
        for _, k in sorted(ranked):
            if left > 0 and used + rows[k][1] / 2 <= left:
                copies[k] += 1
            used += rows[k][1]
    return [target[r[0]] for r in rows], copies


def sized(df):
    return df.withColumn("h", F.xxhash64("doc_id", "source", "text"))


def test_mix_against_plain(spark):
    rows = sized(documents(spark)).select("doc_id", "source", "text", "h").collect()
    target, copies = plain_mix([(r.source, len(WORD.findall(r.text or "")), r.h) for r in rows])
    got = {r.doc_id: r for r in mixing.op5_mixing(spark, DATA).collect()}
    for r, t, c in zip(rows, target, copies):
        g = got[r.doc_id]
        assert g.size == len(WORD.findall(r.text or "")) and g.target == pytest.approx(t, rel=1e-9) and (g.copies, g.taken) == (c, c * g.size)
    again = {r.doc_id: r.copies for r in mixing.mix_report(documents(spark).repartition(7)).collect()}
    assert again == {i: r.copies for i, r in got.items()}


def test_mix_of_odd_rows(odd, empty):
    got = mixing.mix_report(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 2 * r.size for r in got) and all(r.taken == 0 for r in got if not r.size)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs) / 2 + 1e-6 and {r.source_size for r in rs} == {sum(r.size for r in rs)}
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0 and mixing.mix_report(empty).count() == 0


def test_hot_source_is_cut_exactly(spark):
    """A source with nearly all rows: the bins find the same cut as a sort."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.when(F.col("id") % 50 == 0, "b").when(F.col("id") % 50 == 1, "c").otherwise("a").alias("source"))
    rows = sized(df).select("doc_id", "source", "text", "h").collect()
    _, copies = plain_mix([(r.source, len(WORD.findall(r.text)), r.h) for r in rows])
    assert {r.doc_id: r.copies for r in mixing.mix_report(df).collect()} == {r.doc_id: c for r, c in zip(rows, copies)}


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(prints):
    fp = np.array(prints, dtype=np.uint64)
    parent = list(range(len(fp)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 2):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fp))]


def plain_classes(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = defaultdict(list)
    for (i, _), r in zip(rows, roots):
        least[r] += [i] if i is not None else []
    return [(i, f"{p:016x}", min(least[r], default=None)) for (i, _), p, r in zip(rows, prints, roots)]


def test_simhash(spark, odd, empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_dedup(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter(map(tuple, simhash.near_duplicates(odd).collect())) == Counter(plain_classes(rows))
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert sorted(map(tuple, simhash.op10_simhash(spark, DATA).collect())) == sorted(plain_classes(rows))


@pytest.mark.parametrize("crowd", [2, 4, 32])
def test_links_of_crowded_blocks(spark, crowd):
    """Hundreds of fingerprints that share most blocks: either way of joining finds every link."""
    rng = np.random.default_rng(crowd)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    prints = set()
    for b in base.tolist():
        for _ in range(120):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << k
            prints.add(x)
    prints |= set(rng.integers(0, 2**63, 100, dtype=np.uint64).tolist())
    prints = sorted(prints)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in prints], "__tl_fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, crowd)).collect()}
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    expected = plain_components(prints)
    groups = lambda keys: {frozenset(i for i, k in enumerate(keys) if k == key) for key in set(keys)}
    assert groups([roots.get(x, x) for x in signed]) == groups(expected)


def test_long_chains_join(spark):
    n = 300
    order = np.random.default_rng(0).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(1, n)}, 1001: 1000}


def test_near_dedup_keeps_one_row_of_a_class(odd):
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    wanted = Counter(c for c in {(c, f) if c is None else (c,) for _, f, c in plain_classes([(r.doc_id, r.text) for r in odd.collect()])})
    assert kept.count() == sum(wanted.values()) and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(c[0] for c in wanted if c[0] is not None)


def test_pipeline_against_plain(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text", "lang", "source").collect()]
    rows = [r for r, ok in zip(rows, plain_verdicts(rows)) if ok]
    top = {}
    for r in rows:
        key = (r[1] or "").translate(LOWER)
        top[key] = max(top.get(key, r), r, key=lambda x: x[0])
    rows = sorted(top.values())
    near = set(plain_kept([r[:2] for r in rows]))  # the stage links five-word shingles alike by 0.8, not fingerprints
    rows = [r for r in rows if r[0] in near]
    hashes = {r.doc_id: r.h for r in sized(documents(spark)).select("doc_id", "h").collect()}
    _, copies = plain_mix([(r[3], len(WORD.findall(r[1] or "")), hashes[r[0]]) for r in rows])
    expected = {r[0]: c for r, c in zip(rows, copies) if c}
    pieces = corpus_pipeline.run(spark, DATA).collect()
    placed, tokens = Counter(), {}
    for p in pieces:
        placed[p.doc_id] += p.length
        tokens[p.doc_id] = p.doc_tokens
    assert {i: n / tokens[i] for i, n in placed.items()} == expected


def test_stages_return_documents(spark, odd, empty):
    """Columns stay, those with clashing names too, and an empty table passes every stage."""
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns
            docs = common.stage(out, f"test-{name}")
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
        assert "doc_id" in pieces.columns and bool(pieces.count()) == bool(docs.count())
    assert docs.count() == 0
