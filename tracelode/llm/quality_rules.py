"""Quality rules with adaptive thresholds instead of fixed cutoffs.

Each text gets a few shares, of symbols among characters for one, on a scale on which a share of n things varies by chance
with the same deviation whatever it is, 1 / (2 sqrt(n)). For each (lang, source) a mergeable KLL sketch of each share gives its
median and a lower quantile, and their distance the deviation within the group. A text whose share lies further than ``spread``
times both deviations (the group's and its own by chance, added as variances) from the median fails. There is no fixed bound: where
most texts of a group have none of a thing, the sketches say how near none is, and a short text must differ by more. Only the
lower side of the distribution sets the scale, so a group keeps its threshold while under half of it is junk. A group below ``least`` rows takes the
merged sketch of its language, and a small language the sketch of all. Documents join their group's thresholds and are filtered.

Defined results. Null or empty text: no words, so ``base_failed``. Null lang or source: a group of its own. Null
doc_id and repeated rows: each row is judged. Empty table: no rows. Other columns stay as they are; names of this
module begin with ``__tl_``.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_adjacent")

#: Share: what is counted, among how many, side on which it is junk. The length of words is no share; its root varies like one.
RULES = {
    "symbol_share": ("n_symbols", "word_chars", "above"),
    "word_length": ("word_chars", "n_words", "both"),
    "dup_line_share": ("n_dup_lines", "n_lines", "above"),
    "adjacent_share": ("n_adjacent", "n_words", "above"),
    "upper_share": ("n_upper", "word_chars", "above"),
}
#: The lower quantile that sets a group's scale, and how many deviations below the median it is in a normal distribution.
OUTER, OUTER_DEVIATIONS = 0.02, 2.0537489


def text_counts(text: bytes) -> tuple[int, ...]:
    """The counts of one whole text, in the order of _COUNTS. Words are runs without ASCII white space."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * 8
    bytes_of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    # Each code point has one byte that isn't 10xxxxxx.
    points = int(bytes_of[:128].sum() + bytes_of[192:].sum())
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    repeated = 0
    if n > WINDOW:
        h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
        m = n - WINDOW + 1
        key = np.zeros(m, dtype=np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + m] ^ (h[k : k + m] >> np.uint64(31)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if same.any():
            twice = np.zeros(m, dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeated = int((np.cumsum(cover[:n]) > 0).sum())
    return (
        n, points - int(bytes_of[list(_SPACE)].sum()), int(bytes_of[list(SYMBOLS)].sum()), sum(c - 1 for c in Counter(lines).values()), repeated, len(lines),
        int(bytes_of[65:91].sum()), sum(map(eq, words, words[1:])),
    )


def _counts(texts: list[bytes]) -> list[pa.Array]:
    counts = np.array([text_counts(x) for x in texts], dtype=np.int64).reshape(-1, len(_COUNTS))
    return [pa.array(counts[:, i].copy()) for i in range(len(_COUNTS))]


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and the counts of its texts as ``__tl_<count>``."""
    return common.add_from_texts(docs, text_col, keep, [T.StructField(f"__tl_{c}", T.LongType()) for c in _COUNTS], _counts)


def _total(of: str) -> Column:
    return F.greatest(F.col(f"__tl_{of}"), F.lit(1)).cast("double")


def _shares() -> dict[str, Column]:
    """Each share on the scale of even deviation: the angle of a share, the root of a mean count."""
    angle = lambda a, n: F.asin(F.sqrt(F.least(F.lit(1.0), (F.col(f"__tl_{a}") + 0.375) / (_total(n) + 0.75))))
    return {r: angle(a, n) if side == "above" else F.sqrt(F.col(f"__tl_{a}") / _total(n)) for r, (a, n, side) in RULES.items()}


def base_failed(words: Column, repeated: Column) -> Column:
    return (words < 20) | (100 * repeated > 30 * words)


def _failed(counted: DataFrame) -> Column:
    return base_failed(F.col("__tl_n_words"), F.col("__tl_n_repeat_words"))


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source", least: int = 200) -> DataFrame:
    """One row for each (lang, source): of each share the median and the variance within the group.

    Rows that ``base_failed`` don't count. Sketches are merged upwards: each group's into its language's, those into
    one of all, so documents are read once.
    """
    shares = _shares()
    good = counted.where(~_failed(counted)).select(F.col(f"`{lang}`").alias("__tl_lang"), F.col(f"`{source}`").alias("__tl_source"), *(c.alias(f"__tl_r_{r}") for r, c in shares.items()))
    groups = good.groupBy("__tl_lang", "__tl_source").agg(F.count("*").alias("__tl_n0"), *(F.expr(f"kll_sketch_agg_double(__tl_r_{r})").alias(f"__tl_s0_{r}") for r in shares))
    groups = common.stage(groups, "rules-sketches")

    def merged(df: DataFrame, level: int, by: list) -> DataFrame:
        return df.groupBy(*by).agg(F.sum(f"__tl_n{level - 1}").alias(f"__tl_n{level}"), *(F.expr(f"kll_merge_agg_double(__tl_s{level - 1}_{r})").alias(f"__tl_s{level}_{r}") for r in shares))

    langs = merged(groups, 1, [F.col("__tl_lang").alias("__tl_of")])
    whole = merged(langs, 2, []).first()  # one row: a sketch of each share
    both = groups.join(langs, F.col("__tl_lang").eqNullSafe(F.col("__tl_of"))).drop("__tl_of")
    both = both.withColumns({f"__tl_s2_{r}": F.lit(bytes(whole[f"__tl_s2_{r}"] or b"")) for r in shares})
    out = []
    for r in RULES:
        sketch = F.when(F.col("__tl_n0") >= least, F.col(f"__tl_s0_{r}")).when(F.col("__tl_n1") >= least, F.col(f"__tl_s1_{r}")).otherwise(F.col(f"__tl_s2_{r}"))
        both = both.withColumn(f"__tl_k_{r}", sketch)
        at = lambda q, r=r: F.expr(f"kll_sketch_get_quantile_double(__tl_k_{r}, {q}D)")
        out += [at(0.5).alias(f"__tl_mid_{r}"), F.pow((at(0.5) - at(OUTER)) / OUTER_DEVIATIONS, F.lit(2.0)).alias(f"__tl_var_{r}")]
    return both.select("__tl_lang", "__tl_source", *out)


def judged(counted: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source", spread: float = 6.0) -> DataFrame:
    """``counted`` with ``__tl_base_failed``, ``__tl_kept`` and ``__tl_broken`` (the rules that a row breaks). ``limits``: of ``thresholds``, written."""
    side = common.bounded_broadcast(limits, limits.count(), 256)
    joined = counted.join(side, F.col(f"`{lang}`").eqNullSafe(F.col("__tl_lang")) & F.col(f"`{source}`").eqNullSafe(F.col("__tl_source")), "left")
    marks = []
    for r, share in _shares().items():
        _, n, on = RULES[r]
        off = share - F.col(f"__tl_mid_{r}")
        reach = F.sqrt(F.col(f"__tl_var_{r}") + 0.25 / (_total(n) + 0.5)) * spread
        marks.append(F.when((F.abs(off) if on == "both" else off) > reach, F.lit(r)))
    joined = joined.withColumn("__tl_base_failed", _failed(counted)).withColumn("__tl_broken", F.filter(F.array(*marks), lambda x: x.isNotNull()))
    return joined.withColumn("__tl_kept", ~F.col("__tl_base_failed") & (F.size("__tl_broken") == 0)).drop("__tl_lang", "__tl_source", *(f"__tl_{x}_{r}" for r in RULES for x in ("mid", "var")))


def quality_report(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, broken."""
    counted = common.stage(with_counts(docs, keep=["doc_id", "lang", "source"]), "rules-counts")
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken"]
    return judged(counted, common.stage(thresholds(counted), "rules-limits")).select("doc_id", *(F.col(f"__tl_{c}").alias(c) for c in shown))


def apply_rules(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. Texts are counted twice, for the thresholds and then for the verdicts, so they are neither written nor shuffled."""
    names = docs.columns
    seen = common.stage(with_counts(docs, text_col, [lang, source]), "rules-counts")
    limits = common.stage(thresholds(seen, lang, source), "rules-limits")
    return judged(with_counts(docs, text_col), limits, lang, source).where("__tl_kept").select(*(F.col(f"`{c}`") for c in names))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(common.table(spark, sf_dir, "documents"))
