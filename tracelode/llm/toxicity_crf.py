"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Token labels. Labels are of documents, so tokens are labelled from them. A token has traits: its word, beginnings and
endings. The evidence of a trait is the signed root of the likelihood ratio of standing in toxic and clean documents. Where
that of one of a token's traits is beyond what the best of so many has by chance (``chance``), the token is toxic if its
document is; all other tokens are clean.

Field. Two states. A token's potential has a bias and the sum of its traits' weights, so that a word that shares but a
beginning with a toxic one gets a part of its weight; a transition matrix links neighbours. Training maximises the likelihood of windows of the labelled documents with
exact forward-backward gradients; the last window of a text is padded and its padding masked. Half of the windows are drawn from
those that hold a trait beyond chance, in toxic documents or clean ones, half from the rest, and each half is weighed as it stands in
all, so the field learns the same whichever share of the windows has such traits. Scoring runs forward-backward over each whole
text: with two states the messages are ratios, one number a token, so many texts advance together.

Document score. A logistic curve over the greatest marginal, the expected number of toxic tokens and their share, fitted
on the labelled documents. Spans are runs of tokens with a marginal of 0.5 or more, as offsets in code points.

Bounds, all of them on what is learnt from: at most ``most`` labelled rows (those of the lowest hash), ``windows`` windows of them,
and of the traits in ``least`` toxic documents or more the ``kinds`` of greatest evidence. Traits are
counted on the executors; the driver gets counts, and of each token of those rows the 16-bit numbers of its known traits.

Defined results. Null or empty text: no tokens, scored as such, no spans. Null doc_id: belongs to the fold of the empty
text's crc32; it has no label. Null label: not used. Repeated rows: each is scored. No toxic labels: nothing is tagged and all
scores are the prior's. Empty table: no rows. Labels, lang, source and doc_id are never inputs of a score; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pairwise_quality import labelled

WIDTH = 64  # tokens of a training window
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def traits(word: bytes) -> list[int]:
    """Hashes of what a token (already lower-cased) is known by: the word without marks at its ends, its beginnings and its endings."""
    core = word.strip(_EDGES) or word
    text = core.decode("utf-8", "replace")
    parts = [core] + [f"{text[:k]}-".encode() for k in range(3, min(9, len(text)))] + [f"-{text[-k:]}".encode() for k in range(3, min(7, len(text)))]
    return [xxhash.xxh3_64_intdigest(x) for x in parts]


# --- training -----------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """What scoring needs: potentials of traits, transitions, and the document's curve."""

    traits: dict[int, float] = field(default_factory=dict)  # weights of known traits (toxic against clean)
    other: float = -12.0  # potential of a token without any
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log potentials from state to state
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))

    def potential(self, word: bytes) -> float:
        return self.other + sum(self.traits.get(t, 0.0) for t in traits(word))


def forward_backward(potential: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marginals of state 1. ``potential``: tokens by texts, texts by falling length; each text has its first ``lengths`` rows.

    r is the ratio of the forward messages of states 1 and 0, b that of the backward ones.
    """
    e, a = np.exp(np.clip(potential, -30, 30)), np.exp(moves)
    steps, texts = e.shape
    live = np.searchsorted(-lengths, -np.arange(steps) - 0.5)  # texts with a token at each step
    r = np.empty_like(e)
    now = np.ones(texts)
    for t in range(steps):
        k = live[t]
        now = e[t, :k] * ((a[0, 1] + now[:k] * a[1, 1]) / (a[0, 0] + now[:k] * a[1, 0])) if t else e[t, :k]
        r[t, :k] = now
    out = np.zeros_like(e)
    b = np.ones(texts)
    for t in range(steps - 1, -1, -1):
        k = live[t]
        odds = r[t, :k] * b[:k]
        out[t, :k] = odds / (1 + odds)
        x = e[t, :k] * b[:k]
        b[:k] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
    return out


def fit_field(x: np.ndarray, y: np.ndarray, traits_of: np.ndarray, count: int, rounds: int = 150, ridge: float = 1e-3, lengths: np.ndarray | None = None, weights: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights of traits 0 to ``count`` and moves from windows (texts by tokens) of token kinds ``x`` and labels ``y``.

    ``traits_of``: of each kind its traits' numbers, filled up with 0, which stands for none and weighs nothing. Of each window the first
    ``lengths`` tokens count (all by default); what follows them is padding. A window counts ``weights`` times (once by default).
    """
    theta = np.zeros(2 + count + 4)
    theta[0] = -4.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    n, width = x.shape
    real = np.arange(width) < (np.full(n, width) if lengths is None else lengths)[:, None]
    often = np.ones(n) if weights is None else weights
    same = np.array([((y[:, :-1] == i) & (y[:, 1:] == j) & real[:, 1:]).sum(axis=1) @ often for i in (0, 1) for j in (0, 1)])
    for step in range(1, rounds + 1):
        e = np.exp(np.clip(theta[0] + theta[1 + traits_of].sum(axis=1), -30, 30))[x].T
        a = np.exp(theta[-4:].reshape(2, 2))
        f0, f1 = np.empty((width, n)), np.empty((width, n))
        f0[0], f1[0] = 1 / (1 + e[0]), e[0] / (1 + e[0])
        for t in range(1, width):
            u0, u1 = f0[t - 1] * a[0, 0] + f1[t - 1] * a[1, 0], (f0[t - 1] * a[0, 1] + f1[t - 1] * a[1, 1]) * e[t]
            f0[t], f1[t] = u0 / (u0 + u1), u1 / (u0 + u1)
        b0, b1 = np.ones(n), np.ones(n)
        p, pairs = np.empty((width, n)), np.zeros(4)
        for t in range(width - 1, -1, -1):
            z0, z1 = f0[t] * b0, f1[t] * b1
            p[t] = z1 / (z0 + z1)
            if t:
                w0, w1 = b0, b1 * e[t]
                joint = np.stack([f0[t - 1] * a[0, 0] * w0, f0[t - 1] * a[0, 1] * w1, f1[t - 1] * a[1, 0] * w0, f1[t - 1] * a[1, 1] * w1])
                here = real[:, t]
                pairs += (joint / joint.sum(axis=0)) @ (often * here)
                b0, b1 = a[0, 0] * w0 + a[0, 1] * w1, a[1, 0] * w0 + a[1, 1] * w1
                scale = b0 + b1
                b0, b1 = np.where(here, b0 / scale, 1.0), np.where(here, b1 / scale, 1.0)
        diff = np.where(real, y - p.T, 0.0) * often[:, None]
        of_kind = np.bincount(x.ravel(), weights=diff.ravel(), minlength=len(traits_of))
        of_trait = np.bincount(traits_of.ravel(), weights=np.repeat(of_kind, traits_of.shape[1]), minlength=count + 1)
        gradient = np.concatenate([[diff.sum()], of_trait, same - pairs]) / often.sum() - ridge * theta
        gradient[1] = 0.0  # no trait
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return float(theta[0]), theta[1:-4], theta[-4:].reshape(2, 2)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's method; the first weight is the constant."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)), x.T @ (y - p) / len(x) - ridge * w)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
    return w


MEASURES = 3


def summary(marginals: list[np.ndarray]) -> np.ndarray:
    """Of each text the greatest marginal, the log of the expected toxic tokens plus one, and the root of their share."""
    return np.array([[m.max(), np.log1p(m.sum()), np.sqrt(m.mean())] if len(m) else [0.0] * MEASURES for m in marginals]).reshape(-1, MEASURES)


def evidence(in_bad: np.ndarray, in_good: np.ndarray, bad: int, good: int) -> np.ndarray:
    """Signed root of the likelihood ratio statistic (G) of standing in so many toxic and clean documents."""
    total = in_bad + in_good
    expected_bad, expected_good = total * bad / (bad + good), total * good / (bad + good)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(in_bad > 0, in_bad * np.log(in_bad / expected_bad), 0.0) + np.where(in_good > 0, in_good * np.log(in_good / expected_good), 0.0))
    return np.sqrt(np.maximum(g, 0.0)) * np.sign(in_bad - expected_bad)


def chance(tested: int) -> float:
    """Evidence that the best of so many traits without bearing hardly reaches: a normal maximum, and one more for traits that go together."""
    return float(np.sqrt(2 * np.log(max(tested, 2)))) + 1


def train(docs: list[np.ndarray], y: np.ndarray, value: dict[int, float], traits_of: np.ndarray | None = None, sure: float = 6.5, windows: int = 10_000, seed: int = 7) -> Field:
    """A field from labelled documents, each given by the kinds of its tokens, and the numbers of each kind's traits (by default a kind is a trait): k for the k-th of ``value`` (trait: evidence), 0 for none.

    A trait of evidence ``sure`` or more makes tokens of toxic documents toxic.
    """
    bad, good = int((y == 1).sum()), int((y == 0).sum())
    if not bad or not good:
        return Field(curve=np.array([0.0 if not len(y) else (5.0 if bad else -5.0), *np.zeros(MEASURES)]))
    traits_of = np.arange(len(value) + 1)[:, None] if traits_of is None else traits_of
    strong = (np.array([0.0, *value.values()]) >= sure)[traits_of].any(axis=1)
    x, tags, lengths = [], [], []
    for d, label in zip(docs, y):
        n = -(-len(d) // WIDTH)
        x.append(np.pad(d, (0, n * WIDTH - len(d))).reshape(n, WIDTH))
        tags.append(strong[x[-1]] & (label == 1))
        lengths.append(np.minimum(len(d) - WIDTH * np.arange(n), WIDTH))
    x, tags, lengths = np.concatenate(x), np.concatenate(tags), np.concatenate(lengths)
    model, potential = Field(), np.full(len(traits_of), Field.other)
    if len(x):
        rng = np.random.default_rng(seed)
        hot = strong[x].any(axis=1)
        kinds = [rng.permutation(np.flatnonzero(hot)), rng.permutation(np.flatnonzero(~hot))]
        taken = min(len(kinds[0]), max(windows // 2, windows - len(kinds[1])))
        parts = [kinds[0][:taken], kinds[1][: windows - taken]]
        pick = np.concatenate(parts)
        weights = np.concatenate([np.full(len(p), len(k) / max(len(p), 1)) for p, k in zip(parts, kinds)])
        bias, own, moves = fit_field(x[pick], tags[pick].astype(np.int64), traits_of, len(value), lengths=lengths[pick], weights=weights)
        potential = bias + own[traits_of].sum(axis=1)
        model = Field(dict(zip(value, own[1:].tolist())), bias, moves)
    model.curve = fit_curve(summary(marginals([potential[d] for d in docs], model.moves)), y)
    return model


def marginals(potentials: list[np.ndarray], moves: np.ndarray, together: int = 4 << 20) -> list[np.ndarray]:
    """Marginals of each text, in groups of like lengths whose tables hold at most ``together`` numbers (or one text)."""
    order = sorted(range(len(potentials)), key=lambda i: -len(potentials[i]))
    out: list[np.ndarray] = [np.zeros(0)] * len(potentials)
    a = 0
    while a < len(order) and len(potentials[order[a]]):
        longest = len(potentials[order[a]])
        b = a
        while b < len(order) and (b - a) * longest <= together and 8 * len(potentials[order[b]]) >= longest and len(potentials[order[b]]):
            b += 1
        b = max(b, a + 1)
        group = order[a:b]
        lengths = np.array([len(potentials[i]) for i in group])
        table = np.zeros((longest, len(group)))
        for k, i in enumerate(group):
            table[: lengths[k], k] = potentials[i]
        p = forward_backward(table, moves, lengths)
        for k, i in enumerate(group):
            out[i] = p[: lengths[k], k].copy()
        a = b
    return out


# --- scoring ------------------------------------------------------------------------------------------------------


def spans(text: bytes, p: np.ndarray) -> list[tuple[int, int]]:
    """Runs of tokens with a marginal of 0.5 or more, as offsets in code points."""
    places = [m.span() for m in _WORD.finditer(text)]
    out: list[list[int]] = []
    last = -2
    for i in np.flatnonzero(p >= 0.5).tolist():
        if i == last + 1:
            out[-1][1] = places[i][1]
        else:
            out.append(list(places[i]))
        last = i
    return [(len(text[:a].decode("utf-8", "replace")), len(text[:b].decode("utf-8", "replace"))) for a, b in out]


def _trait_counts(known: np.ndarray | None):
    """In how many documents of a task each trait stands; of ``known`` ones only, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in common.sub_batches(batches):
            found = []
            for text in common.texts(batch.column("text")):
                words = set(text.lower().split())
                for w in words.difference(seen):
                    t = np.array(traits(w), dtype=np.uint64)
                    seen[w] = t if known is None else t[known[np.minimum(np.searchsorted(known, t), len(known) - 1)] == t]
                if words:
                    found.append(np.unique(np.concatenate([seen[w] for w in words])))
            if len(seen) > 200_000:
                seen.clear()
            if found:
                k, at = np.unique(np.concatenate([keys, *found]), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, *(np.ones(len(f)) for f in found)]), minlength=len(k)).astype(np.int64)
                keys = k
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["trait", "n"])

    return run


def _trait_numbers(value: dict[int, float]):
    """Of each document how many known traits each token has, and their numbers one after the other."""
    number = {t: k + 1 for k, t in enumerate(value)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in common.sub_batches(batches):
            many, numbers = [], []
            for text in common.texts(batch.column("text")):
                words = text.lower().split()
                for w in set(words).difference(seen):
                    seen[w] = sorted(number[t] for t in traits(w) if t in number)
                found = [seen[w] for w in words]
                many.append(np.fromiter(map(len, found), dtype=np.int8, count=len(found)))
                numbers.append(np.array([k for f in found for k in f], dtype=np.int16))
            if len(seen) > 400_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(many, pa.list_(pa.int8())), pa.array(numbers, pa.list_(pa.int16()))], names=["y", "many", "numbers"])

    return run


def token_kinds(many: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens with so many traits each, whose numbers stand one after the other: the kind of each token, and the traits of each kind (tokens of the same traits are of one kind, 0 has none)."""
    kind = np.zeros(len(many), dtype=np.int32)
    have = np.flatnonzero(many)
    n = many[have].astype(np.int64)
    if not len(have):
        return kind, np.zeros((1, 1), dtype=np.int64)
    start = np.cumsum(n) - n
    mix = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    _, first, at = np.unique(np.add.reduceat(mix ^ (mix >> np.uint64(32)), start), return_index=True, return_inverse=True)
    kind[have] = at + 1
    traits_of = np.zeros((len(first) + 1, int(n.max())), dtype=np.int64)
    for k in range(traits_of.shape[1]):
        longer = np.flatnonzero(n[first] > k)
        traits_of[longer + 1, k] = numbers[start[first[longer]] + k]
    return kind, traits_of


def toxic_traits(sample: DataFrame, kinds: int = 5000, least: int = 3) -> tuple[dict[int, float], int]:
    """The traits of greatest evidence in ``sample`` (text, y), and among how many they are. They are counted on the executors: first in toxic documents, then, those in ``least`` or more, in clean ones."""
    count = lambda label, known: sample.where(F.col("y") == label).select("text").mapInArrow(_trait_counts(known), "trait long, n long").groupBy("trait").agg(F.sum("n").alias("n"))
    totals = dict(sample.groupBy("y").count().collect())
    bad = count(1, None).where(F.col("n") >= least).toArrow()
    names = bad.column("trait").to_numpy().view(np.uint64)
    order = np.argsort(names)
    names, in_bad = names[order], bad.column("n").to_numpy()[order].astype(np.float64)
    in_good = np.zeros(len(names))
    if len(names):
        good = count(0, names).toArrow()
        in_good[np.searchsorted(names, good.column("trait").to_numpy().view(np.uint64))] = good.column("n").to_numpy()
    root = evidence(in_bad, in_good, totals.get(1, 0), totals.get(0, 0))
    best = np.argsort(-root, kind="stable")[:kinds]
    return {int(names[i]): float(root[i]) for i in best if root[i] > 0}, len(names)


_OUT = "doc_id long, held_out boolean, score double, spans array<struct<start:long,end:long>>"


def _score(model: Field, memory: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}  # words seen lately and their potentials
        for batch in common.sub_batches(batches, most=8 << 20):  # a step costs as much for many texts as for few
            docs = common.texts(batch.column("text"))
            if len(known) > memory:
                known.clear()
            split = [d.lower().split() for d in docs]
            for w in {w for s in split for w in s}.difference(known):
                known[w] = model.potential(w)
            p = marginals([np.fromiter(map(known.__getitem__, s), dtype=np.float64, count=len(s)) for s in split], model.moves)
            x = np.concatenate([np.ones((len(docs), 1)), summary(p)], axis=1)
            score = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
            found = [[{"start": a, "end": b} for a, b in spans(d, m)] if len(m) and m.max() >= 0.5 else [] for d, m in zip(docs, p)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "held_out", "score", "spans"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 20_000, windows: int = 10_000, kinds: int = 5000, least: int = 3) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted (score >= 0.5), spans (start, end)."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = common.stage(rows.join(labelled(labels, label, most), "doc_id").select("y", "text"), "toxicity-sample")
    if sample.count() > most:  # ids repeat
        sample = common.stage(sample.limit(most), "toxicity-sample")
    value, tested = toxic_traits(sample, kinds, least)
    coded = sample.mapInArrow(_trait_numbers(value), "y int, many array<byte>, numbers array<short>").toArrow().combine_chunks()
    many, numbers = (coded.column(c).combine_chunks() for c in ("many", "numbers"))
    kind, traits_of = token_kinds(many.flatten().to_numpy(), numbers.flatten().to_numpy())
    cuts = np.cumsum(np.concatenate([[0], many.value_lengths().to_numpy()])).tolist()
    model = train([kind[a:b] for a, b in zip(cuts, cuts[1:])], coded.column("y").to_numpy(), value, traits_of, chance(tested), windows)
    held = rows.withColumn("held_out", common.fold_of(F.col("doc_id")) == 0)
    scored = held.mapInArrow(_score(model), _OUT)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
