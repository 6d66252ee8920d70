"""The whole check: claims to verdicts, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import discover, evidence
from ..scratch import stage


def check(claims: DataFrame, captures: DataFrame, pages: DataFrame, live: DataFrame | None = None, early_exit: bool = False, compatibility: bool = True, others: int = evidence.ALTERNATES, inclusive_midnight: bool = False) -> DataFrame:
    """A verdict for each claim (claim_id, platform, handle, text, dates).

    Candidates are cut to those compared before pages are joined, so only their pages are parsed. All of them are scored
    unless ``early_exit``; ties go to the better position, so reruns agree. ``others``: alternates kept;
    ``inclusive_midnight``: the window ends with the day and not a second before.
    """
    # Six steps read the claims; their windows and the forms of their texts cost more than to write them.
    asked = stage(evidence.with_forms(discover.with_window(claims, inclusive_midnight), compatibility), "claims")
    ready = asked.where((asked["platform"] == "x") & evidence.is_sufficient(asked))
    # Three steps read the ranked candidates, at most ten a claim; the search behind them runs once.
    ranked = stage(discover.rank(discover.discover(ready, captures), ready), "ranked")
    scored = evidence.scored(ranked, ready, evidence.page_texts(pages, ranked), compatibility)
    if early_exit:
        scored = discover.until_convinced(scored)
    verdicts = evidence.decide(asked, ranked, evidence.best_and_others(scored, others))
    return (verdicts if live is None else evidence.cross_checked(verdicts, live, compatibility)).drop("__said")
