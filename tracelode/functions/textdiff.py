"""Word differences between two texts, for display."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import ship

#: Fixed value: links as they are dropped for display.
DISPLAY_LINKS = r"(?i)https?://\S+|t\.co/[A-Za-z0-9_]+|pic\.(?:twitter|x)\.com/[A-Za-z0-9_]+"
DIFF_SCHEMA = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("text", T.StringType())]))


def without_links(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, DISPLAY_LINKS, ""), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n\s*\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def shortest_edit(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(op, token) of a shortest script from ``a`` to ``b``, by the greedy O(ND) search over diagonals."""
    frontier, history = {1: 0}, []
    for d in range(len(a) + len(b) + 1):
        history.append(dict(frontier))
        for k in range(-d, d + 1, 2):
            x = frontier[k + 1] if k == -d or (k != d and frontier[k - 1] < frontier[k + 1]) else frontier[k - 1] + 1
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            frontier[k] = x
            if x >= len(a) and x - k >= len(b):
                return _trace(a, b, history)
    return []


def _trace(a: list[str], b: list[str], history: list[dict[int, int]]) -> list[tuple[str, str]]:
    out, x, y = [], len(a), len(b)
    for d in range(len(history) - 1, -1, -1):
        v, k = history[d], x - y
        before = k + 1 if k == -d or (k != d and v[k - 1] < v[k + 1]) else k - 1
        px = v[before]
        py = px - before
        while x > max(px, 0) and y > max(py, 0):
            x, y = x - 1, y - 1
            out.append(("eq", a[x]))
        if d:
            if before == k + 1:
                y -= 1
                out.append(("ins", b[y]))
            else:
                x -= 1
                out.append(("del", a[x]))
    return out[::-1]


def diff_words(a: str, b: str) -> list[dict[str, str]]:
    """Runs of equal, deleted and inserted words; a run of white space alone belongs to the run before it."""
    tokens = lambda s: [t for t in re.split(r"(\s+)", s) if t]
    runs: list[dict[str, str]] = []
    for op, token in shortest_edit(tokens(a), tokens(b)):
        if runs and runs[-1]["op"] == op:
            runs[-1]["text"] += token
        else:
            runs.append({"op": op, "text": token})
    out: list[dict[str, str]] = []
    for run in runs:
        if out and run["text"].isspace():
            out[-1]["text"] += run["text"]
        else:
            out.append(run)
    return out or [{"op": "eq", "text": ""}]


@F.pandas_udf(DIFF_SCHEMA)
def _diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else diff_words(x, y) for x, y in zip(a, b)], dtype=object)


def word_diff(a: Column, b: Column) -> Column:
    """array of struct(op, text), ``op`` one of eq, del, ins; null if either text is."""
    ship()
    return _diff(a, b)


def display_diff(a: Column, b: Column) -> Column:
    return word_diff(without_links(a), without_links(b))
