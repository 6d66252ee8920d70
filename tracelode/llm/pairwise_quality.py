"""Document quality by Bradley-Terry ranking: scores learnt from preference pairs, then a threshold at a score quantile.

Each text becomes a few measures of its form. A pair prefers a document labelled 1 to one labelled 0; weights minimise
the logistic loss of the difference of their measures. The raw score of a document is weights times measures, computed
in SQL over the written measures. The threshold is a quantile of the raw scores of all documents: of a fine grid the
one that parts the labelled training rows best. Scores are logistic around it.

Labels come from at most ``most`` labelled rows (those of the lowest hash), and ``pairs`` pairs of them.

Defined results. Null or empty text: measures of an empty text, scored like any. Null doc_id: belongs to the fold of
the empty text's crc32; it has no label. Null label: not used. Repeated rows: each is scored; a label counts for each
row it joins. No labels of one kind: all weights are zero and all scores alike. Empty table: no rows. Labels, lang,
source and doc_id are never measures; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality_rules import text_counts

MEASURES = (
    "log_words", "short", "word_length", "symbols", "duplicate_lines", "repeats", "upper", "adjacent",
    "punctuation", "digits", "other_bytes", "lines", "distinct", "top_byte", "pipes", "shouting",
)
_PUNCTUATION = list(b".,;:'\"()[]{}-_/\\@+=~`^?")
GRID = 2000


def measures(text: bytes) -> list[float]:
    """Of one whole text, in the order of MEASURES. Shares enter as square roots, which spreads small ones."""
    n, chars, symbols, dup_lines, repeats, lines, upper, adjacent = text_counts(text)
    size = max(len(text), 1)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda a, b: math.sqrt(min(1.0, a / max(b, 1)))
    distinct = math.log1p(len(set(text.split()))) / math.log1p(n) if n else 1.0
    return [
        math.log1p(n), float(n < 20), min(chars / max(n, 1), 30.0), share(symbols, size), share(dup_lines, lines), share(repeats, n), share(upper, chars), share(adjacent, n),
        share(int(count[_PUNCTUATION].sum()), size), share(int(count[48:58].sum()), size), share(int(count[128:].sum()), size), share(lines, n), distinct, share(int(count[33:].max()), size), share(int(count[124]), size), share(int(count[33]), size),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.sub_batches(batches):
        rows = np.array([measures(x) for x in common.texts(batch.column("text"))], dtype=np.float64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[:, i].copy()) for i in range(len(MEASURES)))], names=["doc_id", *MEASURES])


def with_measures(docs: DataFrame) -> DataFrame:
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measure, ", ".join(["doc_id long", *(f"{m} double" for m in MEASURES)]))


def labelled(labels: DataFrame, label: str, most: int, folds: int = 5) -> DataFrame:
    """(doc_id, y) of at most ``most`` training rows, those whose id hashes lowest; small enough to be broadcast."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (common.fold_of(F.col("doc_id"), folds) != 0))
    return F.broadcast(rows.select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "y").limit(most))


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int, ridge: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights of the Bradley-Terry model, by Newton's method on ``pairs`` random pairs (good preferred to bad)."""
    k = good.shape[1] if len(good) else bad.shape[1]
    w = np.zeros(k)
    if not len(good) or not len(bad):
        return w
    rng = np.random.default_rng(seed)
    d = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        gradient = d.T @ p / pairs - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(k)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_quantile(raw: np.ndarray, y: np.ndarray, grid: np.ndarray) -> float:
    """The grid's value that parts ``raw`` by label with the fewest errors, each label weighing the same; the middle one of equals."""
    if not len(grid):
        return 0.0
    wrong = [np.mean(raw[y == 1] < t) + np.mean(raw[y == 0] >= t) if len(set(y.tolist())) == 2 else 0.0 for t in grid]
    best = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-12)
    return float(grid[best[len(best) // 2]])


def slope(raw: np.ndarray, y: np.ndarray, cut: float, at: float) -> float:
    """The slope of a logistic curve through (cut, at) that fits the labels best."""
    if not len(raw):
        return 1.0
    steps = np.logspace(-2, 2, 60)
    base = math.log(at / (1 - at))
    loss = [np.logaddexp(0, np.where(y == 1, -1, 1) * (a * (raw - cut) + base)).mean() for a in steps]
    return float(steps[int(np.argmin(loss))])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", at: float = 0.3, most: int = 20_000, pairs: int = 100_000) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted (score >= ``at``), raw."""
    rows = common.stage(with_measures(docs), "quality-measures")
    sample = rows.join(labelled(labels, label, most), "doc_id").select("y", *MEASURES).toArrow().to_pandas()
    y, x = sample["y"].to_numpy(), sample[list(MEASURES)].to_numpy(dtype=np.float64)
    centre, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(MEASURES)), np.ones(len(MEASURES)))
    z = np.clip((x - centre) / scale, -8, 8)
    w = fit_pairs(z[y == 1], z[y == 0], pairs)
    clipped = lambda m, c, s: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(m) - float(c)) / float(s)))
    raw = sum((clipped(m, c, s) * float(a) for m, c, s, a in zip(MEASURES, centre, scale, w)), F.lit(0.0))
    scored = rows.select("doc_id", raw.alias("raw"))
    grid = scored.agg(F.percentile_approx("raw", [i / GRID for i in range(GRID + 1)], 10 * GRID).alias("q")).first().q or []
    cut = best_quantile(z @ w, y, np.unique(np.array(grid, dtype=np.float64)))
    a = slope(z @ w, y, cut, at)
    score = 1 / (1 + F.exp(-((F.col("raw") - cut) * a + math.log(at / (1 - at)))))
    out = scored.withColumn("score", score)
    return out.select("doc_id", (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"), "raw")


def op3_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
