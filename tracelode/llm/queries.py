"""The queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP4_SQL, op4_exact_dedup
from .lm_bloom import op9_lm_bloom
from .mixing import op5_mixing
from .packing import op6_packing
from .pairwise_quality import op3_pairwise_quality
from .quality_rules import op2_quality_rules
from .simhash import op10_simhash
from .token_store import op1_token_store
from .toxicity_crf import op7_toxicity_crf
from .warc import op8_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_quality_rules, op3_pairwise_quality, op4_exact_dedup, op5_mixing, op6_packing, op7_toxicity_crf, op8_warc, op9_lm_bloom, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL}
