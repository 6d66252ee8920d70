"""How the whole check is planned: what is costly is computed once, with the same rows."""

from pyspark.sql import functions as F

from tracelode.functions import similarity
from tracelode.operators import evidence
from tracelode.plans import queries

DATA = "/root/testdata/sf0.001"


def test_texts_are_compared_once_a_candidate(spark):
    """A filter on the score must not bring a second comparison below it."""
    plan = queries.crosscheck(spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    held = [line for line in plan if "levenshtein" in line]
    # The candidates' project and the cross-check's.
    assert len(held) == 2 and not any(line.lstrip(" :+-").startswith("Filter") for line in held)


def test_candidates_without_score_come_last(spark):
    rows = [(1, 1, None), (1, 2, 0.5), (1, 3, 0.9), (1, 4, 0.5), (1, 5, 0.1), (1, 6, 0.0), (2, 1, None), (3, 1, 0.0), (3, 2, None)]
    found = spark.createDataFrame(rows, "claim_id long, position int, score double").withColumns({"post_id": F.col("position").cast("long"), "snapshot_ts": F.lit("t"), "url": F.lit("u"), "text_sim": F.col("score")})
    out = {r.claim_id: (r.position, [(a["rank"], a["post_id"]) for a in r.alternates]) for r in evidence.best_and_others(found).collect()}
    assert out == {1: (3, [(2, 2), (3, 4), (4, 5)]), 3: (1, [])}


def test_forms_made_before_change_no_verdict(spark):
    """Claims whose text the live post has, has otherwise, or has not, with and without their forms."""
    said, other, no_text = "account b reported a click as number 12345 of the evening", "Account b reported a cl1ck, as number 12345 of the evening!", None
    rows = [(i, t, "b", "NO_MATCH", 0.1, i) for i, t in enumerate([said, other, "short", said, said, "日本 ａｂｃ"])]
    verdicts = spark.createDataFrame(rows, "claim_id long, text string, handle string, code string, score double, post_id long").select(
        "*", F.array(F.struct(F.lit("2024-01-05").alias("iso_date"), F.lit(None).cast("int").alias("minute"))).alias("dates"), F.struct("post_id", F.lit(1704412800000).alias("id_ms")).alias("capture"), F.lit(True).alias("handle_ok"),
        F.lit(0.1).alias("text_sim"), F.lit(True).alias("date_ok"), F.lit(True).alias("time_ok"), F.struct(F.lit("x").alias("text")).alias("post"),
    )
    live = spark.createDataFrame([(0, "live", said, "b"), (1, "live", said, "b"), (2, "live", "short", "b"), (3, "unavailable", said, "b"), (4, "live", no_text, "b"), (5, "live", "日本 abc", "B")], "post_id long, status string, text string, screen_name string")
    plain = sorted(evidence.cross_checked(verdicts, live).collect())
    ready = sorted(evidence.cross_checked(evidence.with_forms(verdicts), live).drop("__said").collect())
    assert plain == ready
    for r, found in zip(plain, (said, said, "short", None, None, "日本 abc")):
        wanted = verdicts.where(f"claim_id = {r.claim_id}").select(similarity.text_similarity(F.col("text"), F.lit(found)).score).first()[0]
        assert r.cross_check.live_text_sim == (None if found is None else wanted)
