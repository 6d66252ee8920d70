"""From ranked captures to verdicts: page text, scores, the decision, and the check against the live post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import htmlpost, similarity, textdiff, times, urls
from ..scratch import bounded_broadcast, stage

#: Thresholds, limits and texts of the verdicts.
STRONG, LIKELY, PARTIAL = 0.90, 0.75, 0.55
PAGE_BYTES = 600_000
ALTERNATES = 3
COPY = (
    ("MATCH_STRONG", "Archived original found - {}% match.", "A capture of this post says almost exactly what your screenshot says. This shows the text existed then. It can’t confirm everything in the screenshot (replies, counts, images)."),
    ("MATCH_LIKELY", "Likely match - {}%. A few words differ.", "Differences can come from reading mistakes or edited posts."),
    ("MATCH_PARTIAL", "Closest archived post only partly matches ({}%).", "It may be a different post, an edited post, or a reading error. Compare below."),
    ("POST_EXISTS_TEXT_UNREADABLE", "A post from this account was archived at the time shown.", "The timing lines up. We couldn’t read its text - open the capture to compare."),
    ("NO_MATCH", "No archive match found. That does not mean it is not real.", "Most posts are never archived, and accounts get renamed or deleted."),
    ("INSUFFICIENT_INPUT", "We couldn’t read enough to search.", "Fill in the highlighted fields and we’ll re-check."),
    ("ARCHIVE_UNAVAILABLE", "The Wayback Machine didn’t respond, so we couldn’t check.", "This is not a ‘no match’ - try again in a minute."),
    ("UNSUPPORTED_PLATFORM", "We can only check X/Twitter posts right now.", "If this is an X post, use the “this is an X post” override."),
)

STEPS = (
    ("Search the Wayback Machine", "https://web.archive.org/web/*/https://x.com/*", "Browse captures for this account directly on web.archive.org."),
    ("X advanced search", "https://x.com/search-advanced", "Look for the live post or nearby posts from the same account."),
    ("Check the account history", "https://x.com/settings/account", "Renames and deletions break archives - confirm the handle still belongs to the same account."),
    ("Support the Internet Archive", "https://archive.org/donate", "The Wayback Machine is a nonprofit. Donations keep captures free."),
)


def page_texts(pages: DataFrame, needed: DataFrame) -> DataFrame:
    """(snapshot_ts, url, post) of the pages that are needed, after the gates on kind and size.

    What is asked for goes to the pages, not the pages to it, as long as it is small enough; and only extracted texts,
    never markup, are brought together to drop repeated pages.
    """
    fine = F.lower(F.coalesce("content_type", F.lit(""))).rlike("html|json") & (F.octet_length("html") <= PAGE_BYTES) & urls.snapshot_eligible(F.col("url"))
    asked = stage(needed.select("snapshot_ts", "url").distinct(), "asked")
    some = pages.where(fine).join(bounded_broadcast(asked, asked.count(), 256), ["snapshot_ts", "url"], "left_semi")
    texts = some.select("snapshot_ts", "url", htmlpost.extract_post(F.col("html")).alias("post"))
    return texts.groupBy("snapshot_ts", "url").agg(F.max("post").alias("post"))


def with_forms(claims: DataFrame, compatibility: bool = True) -> DataFrame:
    """Claims with the forms in which their texts are compared, for steps that compare them (``scored``, ``cross_checked``)."""
    return claims.withColumn("__said", similarity.compared_forms(F.col("text"), compatibility))


def _said(claims: DataFrame, compatibility: bool) -> Column:
    return F.col("__said") if "__said" in claims.columns else similarity.compared_forms(F.col("text"), compatibility)


def scored(ranked: DataFrame, claims: DataFrame, texts: DataFrame, compatibility: bool = True) -> DataFrame:
    """Ranked candidates with post, score, text_sim, capped_by. A page that can't be had (post null) was compared but has no score."""
    readable = similarity.is_readable(F.col("post.text"))
    # A claim meets several pages and a page several claims: normal forms are made before they meet.
    found = texts.withColumn("__b", similarity.compared_forms(F.when(readable, F.col("post.text")), compatibility))
    asked = claims.select("claim_id", _said(claims, compatibility).alias("__a"))
    joined = ranked.join(found, ["snapshot_ts", "url"], "left").join(asked, "claim_id")
    handle_ok = F.col("repaired_handle").isNull()
    out = joined.withColumn("__t", similarity.compare_forms(F.col("__a"), F.col("__b")))
    out = out.withColumn("__s", similarity.gated_score(F.col("__t"), handle_ok, F.col("date_ok"), F.col("time_ok"), readable))
    have = F.col("post").isNotNull()
    return out.withColumns({c: F.when(have, F.col(f"__s.{c}")) for c in ("score", "text_sim", "capped_by")}).drop("__t", "__s", "__a", "__b")


def best_and_others(candidates: DataFrame, others: int = ALTERNATES) -> DataFrame:
    """One row a claim: its best scored candidate, ties to the better position, and an array of the next ones."""
    # Rows without score come last. A filter below the window would be pushed to where scores are made, and make them twice.
    order = Window.partitionBy("claim_id").orderBy(F.col("score").desc_nulls_last(), "position")
    rows = candidates.withColumn("__rn", F.row_number().over(order)).where((F.col("__rn") <= others + 1) & F.col("score").isNotNull())
    one = [c for c in candidates.columns if c != "claim_id"]
    rest = F.array_sort(F.collect_list(F.when(F.col("__rn") > 1, F.struct(F.col("__rn").alias("rank"), "post_id", "snapshot_ts", "url", "text_sim"))))
    return rows.groupBy("claim_id").agg(F.max(F.when(F.col("__rn") == 1, F.struct(*one))).alias("__best"), rest.alias("alternates")).select("claim_id", "__best.*", "alternates")


def verdict_code(platform: Column, handle_ok: Column, has_dates: Column, archive_error: Column, score: Column, time_ok: Column, extractable: Column) -> Column:
    """The first that holds. ``score`` is null without a best candidate; so are time_ok and extractable."""
    return (
        F.when(platform.eqNullSafe("unknown"), "UNSUPPORTED_PLATFORM")
        .when(handle_ok.isNull() | ~F.coalesce(has_dates, F.lit(False)), "INSUFFICIENT_INPUT")
        .when(archive_error, "ARCHIVE_UNAVAILABLE")
        .when(score >= STRONG, "MATCH_STRONG")
        .when(score >= LIKELY, "MATCH_LIKELY")
        .when(score >= PARTIAL, "MATCH_PARTIAL")
        .when(score.isNotNull() & time_ok & ~extractable, "POST_EXISTS_TEXT_UNREADABLE")
        .otherwise("NO_MATCH")
    )


def is_sufficient(claims: DataFrame) -> Column:
    """Whether a claim has an account, a text and a real date."""
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return given("handle") & given("text") & F.col("from_ms").isNotNull()


def decide(claims: DataFrame, candidates: DataFrame, best: DataFrame) -> DataFrame:
    """A verdict for each claim: code, score, checks, the best capture and alternates.

    A claim without candidates has no match and its account counts as unconfirmed; one whose pages all failed has the
    first candidate as its capture, for the check against the live post.
    """
    first = candidates.where("position = 1").select("claim_id", F.struct("post_id", "id_ms", "snapshot_ts", "url").alias("__first"), F.col("repaired_handle").alias("__repaired"))
    top = best.select("claim_id", F.struct("post_id", "id_ms", "snapshot_ts", "url").alias("__best"), "score", "text_sim", "time_ok", "date_ok", "post", "alternates")
    rows = claims.join(first, "claim_id", "left").join(top, "claim_id", "left")
    enough, found = is_sufficient(claims), F.col("__first").isNotNull()
    repaired = F.col("__repaired").isNotNull()
    code = verdict_code(F.lit("x"), ~repaired, F.lit(True), F.lit(False), F.col("score"), F.col("time_ok"), similarity.is_readable(F.col("post.text")))
    out = rows.withColumn("code", F.when(~F.col("platform").eqNullSafe("x"), "UNSUPPORTED_PLATFORM").when(~enough, "INSUFFICIENT_INPUT").when(~found, "NO_MATCH").otherwise(code))
    searched = F.col("platform").eqNullSafe("x") & enough
    return out.withColumns({"handle_ok": F.when(searched, found & ~repaired), "repaired_handle": F.col("__repaired"), "capture": F.coalesce("__best", "__first")}).drop("__best", "__first", "__repaired")


def cross_checked(verdicts: DataFrame, live: DataFrame, compatibility: bool = True) -> DataFrame:
    """Verdicts held against the live post of their capture (post_id, status, text, screen_name).

    An archived match that the live post shares is verified by both; a claim without one whose account and text the
    live post confirms is decided anew on it. Evidence never takes a match away. No live row: nothing is added.
    """
    # One record a post: a live one if there is any.
    record = F.struct("status", F.col("text").alias("live_text"), "screen_name")
    posts = live.groupBy(F.col("post_id").alias("__id")).agg(F.max_by(record, F.struct(F.col("status") == "live", "text", "screen_name")).alias("__live"))
    rows = verdicts.join(posts, F.col("capture.post_id") == F.col("__id"), "left").drop("__id")
    is_live = F.col("__live.status").eqNullSafe("live") & similarity.is_readable(F.col("__live.live_text"))
    # Where the live post says what the claim says, its forms are the claim's.
    own = F.when(is_live & ~F.col("text").eqNullSafe(F.col("__live.live_text")), F.col("__live.live_text"))
    rows = rows.withColumn("__a", _said(verdicts, compatibility))
    rows = rows.withColumn("__b", F.when(is_live, F.when(F.col("text") == F.col("__live.live_text"), F.col("__a")).otherwise(similarity.compared_forms(own, compatibility))))
    rows = rows.withColumn("__t", similarity.compare_forms(F.col("__a"), F.col("__b")))
    rows = rows.withColumn("__sim", F.when(is_live, F.col("__t.score"))).withColumn("__author", F.when(is_live, F.lower(F.coalesce("__live.screen_name", F.lit(""))) == F.lower(F.trim("handle"))))
    agrees = F.col("__author") & (F.col("__sim") >= LIKELY)
    matched = F.col("code").isin("MATCH_STRONG", "MATCH_LIKELY")
    by = F.when(agrees & matched, "archive+x").when(agrees & ~matched & F.col("handle_ok"), "x-live")
    d = F.try_element_at("dates", F.lit(1))
    date_ok, time_ok = times.date_consistent(d["iso_date"], F.col("capture.id_ms")), times.time_consistent(d["iso_date"], d["minute"], F.col("capture.id_ms"))
    rows = rows.withColumns({"__by": by, "__date": date_ok, "__time": time_ok})
    rows = rows.withColumn("__s", similarity.gated_score(F.col("__t"), F.lit(True), F.col("__date"), F.col("__time"), is_live))
    lifted = F.col("__by").eqNullSafe("x-live")
    again = verdict_code(F.lit("x"), F.lit(True), F.lit(True), F.lit(False), F.col("__s.score"), F.col("__time"), F.lit(True))
    check = F.when(F.col("__live").isNotNull(), F.struct(
        F.when(is_live, "live").otherwise("unavailable").alias("status"), F.col("__live.screen_name").alias("screen_name"), F.col("__sim").alias("live_text_sim"), F.col("__author").alias("author_match"), F.col("__by").isNotNull().alias("verified"), F.col("__by").alias("verified_by"),
    ))
    return rows.withColumns({
        "cross_check": check, "code": F.when(lifted, again).otherwise(F.col("code")), "score": F.when(lifted, F.col("__s.score")).otherwise(F.col("score")), "text_sim": F.when(lifted, F.col("__s.text_sim")).otherwise(F.col("text_sim")),
        "date_ok": F.when(lifted, F.col("__date")).otherwise(F.col("date_ok")), "time_ok": F.when(lifted, F.col("__time")).otherwise(F.col("time_ok")), "evidence_text": F.when(lifted, F.col("__live.live_text")).otherwise(F.col("post.text")),
    }).drop("__live", "__a", "__b", "__t", "__sim", "__author", "__by", "__date", "__time", "__s")


def with_diff(verdicts: DataFrame) -> DataFrame:
    """Verdicts with the word differences between the claimed and the found text."""
    return verdicts.withColumn("diff", textdiff.display_diff(F.col("text"), F.col("evidence_text")))


def verdict_copy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COPY), "code string, title_form string, body string")


def with_copy(verdicts: DataFrame) -> DataFrame:
    """Verdicts with title and body. The texts are a table of eight rows."""
    percent = F.coalesce(F.floor(F.col("score") * 100 + 0.5).cast("string"), F.lit("?"))
    out = verdicts.join(F.broadcast(verdict_copy(verdicts.sparkSession)), "code", "left")
    return out.withColumn("title", F.replace("title_form", F.lit("{}"), percent)).drop("title_form")


def tier(code: Column) -> Column:
    """How much a verdict is made of: default for a match, secondary for a partial one, outline for none."""
    return F.when(code.isin("MATCH_STRONG", "MATCH_LIKELY"), "default").when(code.isin("MATCH_PARTIAL", "POST_EXISTS_TEXT_UNREADABLE"), "secondary").otherwise("outline")


def check_label(value: Column) -> Column:
    """A check as it is shown: Yes, No or Unknown."""
    return F.when(value, "Yes").when(~value, "No").otherwise("Unknown")


def share_label(share: Column) -> Column:
    return F.coalesce(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("% similar")), F.lit("Unknown"))


def general_steps(spark: SparkSession) -> DataFrame:
    """Where to look on whatever the verdict: label, url, blurb."""
    return spark.createDataFrame(list(STEPS), "label string, url string, blurb string")


def next_steps(handle: Column, phrase: Column, iso: Column) -> Column:
    """array of struct(label, url): where to look on; the last two are reminders without a URL."""
    name = F.trim(F.regexp_replace(handle, "^@", ""))
    words = F.array_join(F.slice(F.split(F.regexp_replace(phrase, r"^\s+|\s+$", ""), r"\s+"), 1, 8), " ")
    step = lambda label, url: F.struct(label.alias("label"), url.alias("url"))
    c, q, none = F.concat, urls.uri_component, F.lit(None).cast("string")
    steps = [
        step(c(F.lit("Search X for posts by @"), name, F.lit(" around "), iso), c(F.lit("https://x.com/search?q="), q(c(F.lit("from:"), name, F.lit(" since:"), iso, F.lit(" until:"), times.next_day(iso))), F.lit("&src=typed_query"))),
        step(c(F.lit("Open Wayback captures for @"), name, F.lit(" posts")), c(F.lit("https://web.archive.org/web/*/x.com/"), name, F.lit("/status/*"))),
        F.when(words != "", step(F.lit("Search the web for the exact phrase (site:x.com)"), c(F.lit("https://www.google.com/search?q="), q(c(F.lit("site:x.com "), words))))),
        step(F.lit("Check archive.today for this account"), c(F.lit("https://archive.ph/newest/"), q(c(F.lit("x.com/"), name)))),
        step(F.lit("Check Ghost Archive for this account"), c(F.lit("https://ghostarchive.org/search?term="), q(c(F.lit("x.com/"), name, F.lit("/status"))))),
        step(F.lit("If the account changed its handle, search the old handle - captures stay under the name used at archive time."), none),
        step(F.lit("Deleted or protected posts are rarely archived. A missing capture does not confirm anything about the screenshot."), none),
    ]
    return F.filter(F.array(*steps), lambda s: s.isNotNull())
