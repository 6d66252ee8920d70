"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets. Sources in code-point order (null last) get the weights in turn and share ``budget`` times all words; no
source gives more than ``most`` times its own words, and what is above that is shared anew by weight. That is the level
at which least(cap, level * weight) over all sources sums to the budget; with sources sorted by cap / weight it is the
largest of (budget - caps before) / (weights from here on).

Copies. Within a source the expected copies of a document grow with the binary logarithm of its size, up to ``most``,
at the level that meets the source's target (the same computation, over size classes). The whole part is certain. The
fraction p is an inclusion probability: documents are ranked by (u / (1 - u)) / (p / (1 - p)) with u from a hash of the
row, and those of lowest rank are taken until the words left to the source are spent.

Ranking doesn't sort a source: ranks are counted in 4096 bins, the bin where the budget ends in 4096 again, and only
the rows of that last bin are ordered. So a source with a third of all rows is spread over all tasks.

Defined results. Null text: size 0, never taken. Null source: a source, last in order; the empty one is a source too.
Null doc_id: treated as any row. Repeated rows: each is a document; equal ranks are broken by the row's place, so
either may be taken. Empty table: no rows. Columns are taken as they are; names of this module begin with ``__tl_``.
Reruns agree: the hash is of doc_id, source and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
_EPS = 1e-9


def _level(df: DataFrame, cap: str, weight: str, budget: Column, out: str, by: list[str]) -> DataFrame:
    """Add ``out``: the level at which least(cap, level * weight) sums to ``budget`` over the rows of the same ``by``."""
    order = Window.partitionBy(*by).orderBy(F.col(cap) / F.col(weight), weight)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("__tl_level", (budget - before) / left).withColumn(out, F.max("__tl_level").over(Window.partitionBy(*by))).drop("__tl_level")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """From rows (source, size): source, source_size, target. One row a source, so its windows hold no documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("__tl_w", weight).withColumn("__tl_cap", F.col("source_size") * F.lit(float(most)))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget))
    per = _level(per.withColumn("__tl_t", total), "__tl_cap", "__tl_w", F.col("__tl_t"), "__tl_l", [])
    return per.select("source", "source_size", F.least("__tl_cap", F.col("__tl_l") * F.col("__tl_w")).alias("target"))


def _cut(df: DataFrame, bin_col: str, budget: str) -> DataFrame:
    """For each source the bin in which the running words reach ``budget``, and the words before it."""
    per = df.groupBy("source", bin_col, budget).agg(F.sum("size").alias("__tl_s"))
    run = F.sum("__tl_s").over(Window.partitionBy("source").orderBy(bin_col))
    per = per.withColumn("__tl_run", run).where(F.col("__tl_run") >= F.col(budget))
    return per.groupBy("source").agg(F.min_by(F.struct(F.col(bin_col).alias("bin"), (F.col(budget) - F.col("__tl_run") + F.col("__tl_s")).alias("left")), bin_col).alias("__tl_cut")).select("source", "__tl_cut.*")


def _join(df: DataFrame, side: DataFrame, n: int) -> DataFrame:
    side = common.bounded_broadcast(side, n, 256).withColumnRenamed("source", "__tl_source")
    return df.join(side, F.col("source").eqNullSafe(F.col("__tl_source")), "left").drop("__tl_source")


def plan_copies(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2, whole: DataFrame | None = None) -> DataFrame:
    """``rows`` (source, size, __tl_row, __tl_hash, more) with source_size, target and copies; or ``whole``, the same rows with more columns. ``rows`` must be a written table: it is read several times."""
    targets = common.stage(source_targets(rows, weights, budget, most), "mix-targets")
    n = targets.count()
    level = F.length(F.bin("size")).cast("double")  # 1 + floor(log2(size))
    classes = rows.where("size > 0").groupBy("source", level.alias("__tl_g")).agg(F.sum("size").alias("__tl_s"))
    classes = _join(classes, targets, n).withColumn("__tl_cap", F.col("__tl_s") * F.lit(float(most))).withColumn("__tl_w", F.col("__tl_s") * F.col("__tl_g"))
    classes = _level(classes, "__tl_cap", "__tl_w", F.col("target"), "__tl_l", ["source"])
    expected = F.when(F.col("target") >= F.col("source_size") * F.lit(float(most)), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("__tl_l") * F.col("__tl_g")))
    certain = F.floor(expected + _EPS)
    classes = classes.withColumn("__tl_sure", certain.cast("long")).withColumn("__tl_p", F.greatest(F.lit(0.0), expected - certain))
    levels = classes.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), (F.first("target") - F.sum(F.col("__tl_sure") * F.col("__tl_s"))).alias("__tl_rest"), F.map_from_entries(F.collect_list(F.struct(F.col("__tl_g").cast("int"), F.struct("__tl_sure", "__tl_p")))).alias("__tl_classes"))
    levels = targets.join(levels.select(F.col("source").alias("__tl_source"), "__tl_rest", "__tl_classes"), F.col("source").eqNullSafe(F.col("__tl_source")), "left").drop("__tl_source")
    levels = common.stage(levels, "mix-levels")

    own = F.try_element_at("__tl_classes", F.length(F.bin("size")))
    u = (F.shiftrightunsigned("__tl_hash", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    ratio = (u / (1 - u)) * (1 - F.col("__tl_p")) / F.col("__tl_p")
    drawn = F.col("__tl_p") > _EPS
    # q / (1 + q) is in order of q and lies in (0, 1).
    spot = F.col("__tl_q") * BINS

    def ranked(df: DataFrame) -> DataFrame:
        df = _join(df, levels, n * 16).withColumn("__tl_own", F.when(F.col("size") > 0, own)).withColumn("__tl_sure", F.coalesce("__tl_own.__tl_sure", F.lit(0))).withColumn("__tl_p", F.coalesce("__tl_own.__tl_p", F.lit(0.0)))
        df = df.drop("__tl_own", "__tl_classes").withColumn("__tl_q", F.when(drawn, ratio / (1 + ratio)))
        return df.withColumn("__tl_b1", F.floor(spot).cast("int")).withColumn("__tl_b2", F.floor((spot - F.floor(spot)) * BINS).cast("int"))

    docs = ranked(rows)

    first = common.stage(_cut(docs.where(F.col("__tl_q").isNotNull() & (F.col("__tl_rest") > 0)), "__tl_b1", "__tl_rest"), "mix-cut").select("source", F.col("bin").alias("__tl_c1"), F.col("left").alias("__tl_left1"))
    docs = _join(docs, first, n)
    second = common.stage(_cut(docs.where("__tl_b1 = __tl_c1"), "__tl_b2", "__tl_left1"), "mix-cut").select("source", F.col("bin").alias("__tl_c2"), F.col("left").alias("__tl_left2"))
    docs = _join(docs, second, n)
    last = docs.where("__tl_b1 = __tl_c1 AND __tl_b2 = __tl_c2")
    before = F.sum("size").over(Window.partitionBy("source").orderBy("__tl_q", "__tl_row")) - F.col("size")
    last = last.withColumn("__tl_before", before).where(F.col("__tl_before") + F.col("size") / 2 <= F.col("__tl_left2")).groupBy("source").agg(F.max(F.struct("__tl_q", "__tl_row")).alias("__tl_end"))
    last = common.stage(last, "mix-cut")
    docs = _join(docs, last, n) if whole is None else _join(_join(_join(ranked(whole), first, n), second, n), last, n)
    inside = (F.col("__tl_b1") < F.col("__tl_c1")) | ((F.col("__tl_b1") == F.col("__tl_c1")) & ((F.col("__tl_b2") < F.col("__tl_c2")) | ((F.col("__tl_b2") == F.col("__tl_c2")) & (F.struct("__tl_q", "__tl_row") <= F.col("__tl_end")))))
    # No cut: the fractions hold fewer words than are left, so all are taken; nothing left: none.
    extra = F.col("__tl_q").isNotNull() & (F.col("__tl_rest") > 0) & F.when(F.col("__tl_c1").isNull(), True).otherwise(F.coalesce(inside, F.lit(False)))
    return docs.withColumn("copies", F.col("__tl_sure") + extra.cast("long"))


def _sized(docs: DataFrame, text_col: str, id_col: str, source_col: str, keep: list[Column], row: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, F.col(f"`{source_col}`").alias("source"), size.alias("size"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), F.col(f"`{text_col}`")).alias("__tl_hash"), row.alias("__tl_row"))


def mix_report(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken (words)."""
    rows = common.stage(_sized(docs, "text", "doc_id", "source", [F.col("doc_id")], F.monotonically_increasing_id()), "mix-sizes")
    return plan_copies(rows, weights, budget, most).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns. Sizes are counted twice, for the plan and with the rows, so texts are neither written nor shuffled."""
    names = docs.columns
    rows = common.Numbered(docs, "mix-documents").rows()
    keep = F.struct(*(F.col(f"`{c}`") for c in names)).alias("__tl_doc")
    sized = common.stage(_sized(rows, text_col, id_col, source_col, [], F.col("__tl_row")), "mix-sizes")
    planned = plan_copies(sized, weights, budget, most, _sized(rows, text_col, id_col, source_col, [keep], F.col("__tl_row"))).where("copies > 0")
    return planned.select("__tl_doc.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__tl_copy")).select(*(F.col(f"`{c}`") for c in names))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(common.table(spark, sf_dir, "documents"))
