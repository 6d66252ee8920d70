"""How alike a claimed and an archived text are, tolerant of misreadings but not of changed numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .textnorm import normal_forms

#: Fixed values of the score.
PARTIAL_WEIGHT, TOKEN_WEIGHT = 0.92, 0.85
NUMBER_CAP, SHORT_CAP, SHORT_LENGTH = 0.89, 0.8, 25
CONTEXT_CAP, TIME_CAP = 0.6, 0.74
MOST_WINDOWS = 400


def full_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b)).cast("double")
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def partial_similarity(a: Column, b: Column) -> Column:
    """The best full similarity of the shorter text with windows of its length in the longer one, which are thinned out in long texts."""
    swap = F.length(a) > F.length(b)
    sides = F.struct(F.when(swap, b).otherwise(a).alias("short"), F.when(swap, a).otherwise(b).alias("long"))

    def best(x: Column) -> Column:
        last = F.length(x["long"]) - F.length(x["short"]) + 1
        step = F.greatest(F.lit(1), F.floor(last / F.lit(float(MOST_WINDOWS))).cast("int"))
        nearest = let(F.length(x["short"]), lambda width: F.array_min(F.transform(F.sequence(F.lit(1), last, step), lambda i: F.levenshtein(x["short"], F.substring(x["long"], i, width)))) / width.cast("double"))
        return F.when(F.contains(x["long"], x["short"]), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - nearest))

    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(let(sides, best))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def token_similarity(a: Column, b: Column) -> Column:
    """Dice's coefficient of the multisets of words."""
    count = lambda all_, t: F.size(F.filter(all_, lambda x: x == t))

    def dice(w: Column) -> Column:
        once = (F.size(F.array_distinct(w["a"])) == F.size(w["a"])) | (F.size(F.array_distinct(w["b"])) == F.size(w["b"]))
        counted = F.aggregate(F.array_distinct(w["a"]), F.lit(0), lambda n, t: n + F.least(count(w["a"], t), count(w["b"], t)))
        shared = F.when(once, F.size(F.array_intersect(w["a"], w["b"]))).otherwise(counted)
        return F.when((F.size(w["a"]) == 0) | (F.size(w["b"]) == 0), 0.0).otherwise(2.0 * shared / (F.size(w["a"]) + F.size(w["b"])).cast("double"))

    return F.when(a == b, 1.0).otherwise(let(F.struct(_tokens(a).alias("a"), _tokens(b).alias("b")), dice))


def number_tokens(text: Column) -> Column:
    """Runs of ASCII digits, sorted as texts."""
    return F.array_sort(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)))


def numbers_differ(a: Column, b: Column) -> Column:
    """Only when both texts have numbers: a digit misread as a letter is no change of number."""
    both = F.struct(number_tokens(a).alias("a"), number_tokens(b).alias("b"))
    return let(both, lambda n: _differ(n["a"], n["b"]))


def _differ(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0) & (a != b)


def compared_forms(text: Column, compatibility: bool = True) -> Column:
    """The normal forms of a text that is compared often, with its numbers."""
    return let(normal_forms(text, compatibility), lambda t: F.struct(t["plain"].alias("plain"), t["folded"].alias("folded"), number_tokens(t["plain"]).alias("numbers")))


def paired(a: Column, b: Column) -> Column:
    """struct(pa, pb, fa, fb) of the normal forms of two texts."""
    return F.struct(a["plain"].alias("pa"), b["plain"].alias("pb"), a["folded"].alias("fa"), b["folded"].alias("fb"))


def similarity_parts(a: Column, b: Column, compatibility: bool = True) -> Column:
    return paired(normal_forms(a, compatibility), normal_forms(b, compatibility))


def _distance(a: Column, b: Column) -> Column:
    """Edit distance. What both texts begin and end with adds nothing to it; most of that goes before the distance, which costs the product of the lengths, is taken."""

    def shared(of: Callable[[Column, Column], Column], x: Column, y: Column) -> Column:
        found = F.when(x == y, F.length(x))
        for k in (64, 48, 32, 24, 20, 16, 12, 8, 4):
            found = found.when((F.length(x) >= k) & (of(x, F.lit(k)) == of(y, F.lit(k))), k)
        return found.otherwise(0)

    def rest(x: Column, y: Column) -> Column:
        return let(shared(F.right, x, y), lambda k: F.levenshtein(F.left(x, F.length(x) - k), F.left(y, F.length(y) - k)))

    def after(k: Column) -> Column:
        return let(F.struct(*(F.substring(t, k + 1, F.length(t)).alias(c) for t, c in ((a, "a"), (b, "b")))), lambda r: rest(r["a"], r["b"]))

    return let(shared(F.left, a, b), after)


def raw_similarity(p: Column) -> Column:
    """The greatest of three measures over two normal forms. What can't be the greatest isn't computed.

    Words count for ``TOKEN_WEIGHT`` at most. A window is the longer text without as many characters as the lengths differ by, so
    its distance is at least that of the whole texts less that many.
    """
    forms = ((p["pa"], p["pb"]), (p["fa"], p["fb"]))
    other = (p["pa"] != p["fa"]) | (p["pb"] != p["fb"])

    def full(d: Column, x: Column, y: Column) -> Column:
        return F.when(x == y, 1.0).when((x == "") | (y == ""), 0.0).otherwise(1.0 - d / F.greatest(F.length(x), F.length(y)).cast("double"))

    def windows(d: Column, x: Column, y: Column, best: Column) -> Column:
        shorter = F.least(F.length(x), F.length(y))
        at_most = 1.0 - (d - F.abs(F.length(x) - F.length(y))) / F.nullif(shorter, F.lit(0)).cast("double")
        return F.when(PARTIAL_WEIGHT * at_most > best - 1e-9, PARTIAL_WEIGHT * partial_similarity(x, y))

    def measured(d: Column) -> Column:
        each = [(d[c], x, y, use) for c, (x, y), use in zip(("plain", "folded"), forms, (F.lit(True), other))]
        whole = F.greatest(*(F.when(use, full(n, x, y)) for n, x, y, use in each))
        words = lambda best: F.greatest(best, *(F.when(use & (best < TOKEN_WEIGHT), TOKEN_WEIGHT * token_similarity(x, y)) for _, x, y, use in each))
        parts = lambda best: F.greatest(best, *(F.when(use, windows(n, x, y, best)) for n, x, y, use in each))
        return F.coalesce(let(whole, lambda b: let(words(b), parts)), F.lit(0.0))

    return let(F.struct(_distance(*forms[0]).alias("plain"), F.when(other, _distance(*forms[1])).alias("folded")), measured)


def _capped(p: Column, raw: Column, mismatch: Column) -> Column:
    def caps(differ: Column) -> Column:
        by_number = differ & (raw > NUMBER_CAP)
        first = F.when(by_number, NUMBER_CAP).otherwise(raw)
        by_length = (F.least(F.length(p["pa"]), F.length(p["pb"])) < SHORT_LENGTH) & (first > SHORT_CAP)
        why = F.concat_ws("+", F.when(by_number, "number"), F.when(by_length, "length"))
        return F.struct(raw.alias("raw"), F.when(by_length, SHORT_CAP).otherwise(first).alias("score"), F.nullif(why, F.lit("")).alias("capped_by"), differ.alias("number_mismatch"))

    return let(mismatch, caps)


def compare(p: Column) -> Column:
    """struct(raw, score, capped_by, number_mismatch) of paired normal forms: changed numbers cap the score, and so does a short text."""
    return let(p, lambda q: let(raw_similarity(q), lambda raw: _capped(q, raw, numbers_differ(q["pa"], q["pb"]))))


def compare_forms(a: Column, b: Column) -> Column:
    """The same of two texts' ``compared_forms``."""
    return let(paired(a, b), lambda q: let(raw_similarity(q), lambda raw: _capped(q, raw, _differ(a["numbers"], b["numbers"]))))


def text_similarity(a: Column, b: Column, compatibility: bool = True) -> Column:
    return compare(similarity_parts(a, b, compatibility))


def gated_score(text: Column, handle_ok: Column, date_ok: Column, time_ok: Column, readable: Column) -> Column:
    """struct(score, text_sim, capped_by) of a text similarity in its context.

    Handle and date must be true, not merely unknown; a time must be known to be wrong to count. No readable text: 0.
    """
    sure = F.coalesce(handle_ok, F.lit(False)) & F.coalesce(date_ok, F.lit(False))
    wrong = time_ok.eqNullSafe(F.lit(False))

    def gate(t: Column) -> Column:
        outside = ~sure & (t["score"] > CONTEXT_CAP)
        first = F.when(outside, CONTEXT_CAP).otherwise(t["score"])
        late = wrong & (first > TIME_CAP)
        why = F.concat_ws("+", t["capped_by"], F.when(outside, "context"), F.when(late, "time"))
        return F.struct(F.when(late, TIME_CAP).otherwise(first).alias("score"), t["score"].alias("text_sim"), F.nullif(why, F.lit("")).alias("capped_by"))

    none = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("text_sim"), F.lit("unreadable").alias("capped_by"))
    return F.when(readable, let(text, gate)).otherwise(none)


def is_readable(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"[\s\x{A0}\x{FEFF}]", "") != "", F.lit(False))
