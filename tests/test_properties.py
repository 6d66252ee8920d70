"""Invariants over generated inputs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tracelode.functions import htmlpost, textdiff
from tracelode.functions.dates import date_candidates
from tracelode.operators.screens import mentions_in

WORDS = st.lists(st.sampled_from(["a", "b", "c", " ", "  ", "\n"]), max_size=14).map("".join)


@given(WORDS, WORDS)
@settings(max_examples=200, deadline=None)
def test_edit_script_rebuilds_both(a, b):
    tokens = lambda s: [t for t in re.split(r"(\s+)", s) if t]
    script = textdiff.shortest_edit(tokens(a), tokens(b))
    assert "".join(t for op, t in script if op != "ins") == a and "".join(t for op, t in script if op != "del") == b


@given(WORDS, WORDS)
@settings(max_examples=60, deadline=None)
def test_edit_script_is_shortest(a, b):
    x, y = list(a), list(b)
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
    assert sum(op != "eq" for op, _ in textdiff.shortest_edit(x, y)) == len(x) + len(y) - 2 * table[-1][-1]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text_is_taken(text):
    from datetime import date

    for c in date_candidates(text, date(2024, 1, 1)):
        assert re.fullmatch(r"\d{3,4}-\d{2}-\d{2}", c["iso_date"]) or len(c["iso_date"]) == 10
    mentions_in(text)
    assert htmlpost.extract_post_from(text)["extractor"]


@given(st.text(alphabet='<>/a"={}[]:,', max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_markup_is_taken(text):
    htmlpost.extract_post_from(f'<script type="application/ld+json">{text}</script><p class="tweet-text">{text}')
