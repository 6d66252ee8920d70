"""What the similarity of two texts leaves out changes no result."""

import random

from pyspark.sql import functions as F

from tracelode.functions import similarity

WORDS = ["account", "user", "news", "rn", "0o", "vv", "é", "日本", "click", "number", "123", "124", "of", "the", "x"]


def plain(p):
    signals = []
    for x, y in ((p["pa"], p["pb"]), (p["fa"], p["fb"])):
        signals += [similarity.full_similarity(x, y), similarity.PARTIAL_WEIGHT * similarity.partial_similarity(x, y), similarity.TOKEN_WEIGHT * similarity.token_similarity(x, y)]
    return F.greatest(*signals)


def pairs():
    r = random.Random(1)
    said = lambda n: " ".join(r.choice(WORDS) for _ in range(r.randint(0, n)))

    def misread(text):
        out = list(text)
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(out) + 1)
            out[at : at + r.randint(0, 1)] = r.choice(["a", "0", "é", " ", ""])
        return "".join(out)

    for i in range(300):
        a = said(r.choice([3, 12, 40]))
        b = (misread(a), said(30), f"{said(8)} {misread(a)} {said(8)}", None, "")[i % 50 // 12]
        fold = lambda t: t if t is None or i % 3 == 0 else t.replace("0", "o").replace("rn", "m")  # noqa: E731, B023
        yield a, b, fold(a), fold(b)


def test_what_is_left_out_changes_nothing(spark):
    rows = spark.createDataFrame(list(pairs()), "pa string, pb string, fa string, fb string").repartition(4)
    p = F.struct("pa", "pb", "fa", "fb")
    out = rows.select(similarity.let(p, plain).alias("x"), similarity.let(p, similarity.raw_similarity).alias("y"), F.levenshtein("pa", "pb").alias("d"), similarity._distance(F.col("pa"), F.col("pb")).alias("e"))
    assert out.where("NOT (x <=> y) OR NOT (d <=> e)").collect() == []


def test_measures_that_cannot_win_are_not_computed(evaluate, monkeypatch):
    a, b = "account b reported a click as number 12345", "account b reported a click as number 12346"
    p = F.struct(*(F.lit(t).alias(c) for t, c in ((a, "pa"), (b, "pb"), (a, "fa"), (b, "fb"))))
    wanted = evaluate(similarity.raw_similarity(p))
    for measure in ("partial_similarity", "token_similarity"):
        monkeypatch.setattr(similarity, measure, lambda x, y: F.raise_error(F.concat(x, y)).cast("double"))
    assert evaluate(similarity.raw_similarity(p)) == wanted == (1 - 1 / len(a),)
