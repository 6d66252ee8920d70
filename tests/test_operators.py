"""Operators on small tables, with nulls, ties and empty inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracelode.functions import ids, imaging, urls
from tracelode.operators import discover, evidence, limits, screens, store
from tracelode.plans.check import check
from tracelode.sources import index, records

DATES = "array<struct<iso_date:string,minute:int,year_inferred:boolean,dm_ambiguous:boolean,raw:string>>"
CLAIMS = f"claim_id string, platform string, handle string, text string, dates {DATES}"
CAPTURES = "handle string, post_id long, snapshot_ts string, url string, status int"
PAGES = "snapshot_ts string, url string, html string, content_type string"
CITY = "The city council approved the new downtown transit plan after months of public debate and revisions"
NOON = 1682942400000  # 2023-05-01T12:00Z


def post(ms, n=0):
    return ((ms - ids.CLOCK_START_MS) << 22) + n


def capture(handle, ms, n=0, ts="20230502000000", host="x.com", status=200):
    return handle, post(ms, n), ts, f"https://{host}/{handle}/status/{post(ms, n)}", status


def page(c, text):
    return c[2], c[3], f"<title>Name on X: \"{text}\" / X</title>" if text else "<title>X</title>", "text/html"


def claim(name, handle, day="2023-05-01", minute=None, text=CITY, platform="x"):
    return name, platform, handle, text, [(day, minute, None, None, day)] if day else []


@pytest.fixture(scope="module")
def flow(spark):
    def run(claims, captures, pages, live=None, **options):
        frames = [spark.createDataFrame(rows, schema) for rows, schema in ((claims, CLAIMS), (captures, CAPTURES), (pages, PAGES))]
        posts = spark.createDataFrame(live, "post_id long, status string, text string, screen_name string") if live is not None else None
        return {r.claim_id: r for r in check(*frames, live=posts, **options).collect()}

    return run


def test_check_flow(flow):
    good, other, shell = capture("nasa", NOON), capture("nasa", NOON, 1), capture("ghost", NOON)
    wrong = capture("late", NOON + 3 * 3_600_000)
    v = flow(
        [claim("match", "NASA"), claim("none", "nobody"), claim("nodate", "nasa", None), claim("notext", "nasa", text=" "), claim("bad", "nasa", platform="unknown"), claim("fixed", "na5a"), claim("shell", "ghost", minute=720), claim("time", "late", minute=721), claim("day", "nasa", "2023-02-30"), claim("null", None)],
        [good, other, shell, wrong, capture("nasa", NOON + 10 * 86_400_000, 2)],
        [page(good, CITY), page(other, "Something else entirely about cats and their habits"), page(shell, None), page(wrong, CITY)],
    )
    assert {k: r.code for k, r in v.items()} == {"match": "MATCH_STRONG", "none": "NO_MATCH", "nodate": "INSUFFICIENT_INPUT", "notext": "INSUFFICIENT_INPUT", "bad": "UNSUPPORTED_PLATFORM", "fixed": "MATCH_PARTIAL", "shell": "POST_EXISTS_TEXT_UNREADABLE", "time": "MATCH_STRONG", "day": "INSUFFICIENT_INPUT", "null": "INSUFFICIENT_INPUT"}
    assert v["match"].score == 1.0 and len(v["match"].alternates) == 1 and v["match"].handle_ok
    assert v["fixed"].repaired_handle == "nasa" and v["fixed"].handle_ok is False and v["none"].handle_ok is False


def test_cross_check(flow):
    a, b, c, d = (capture(h, NOON, i) for i, h in enumerate(("agree", "unread", "wrong", "gone")))
    v = flow(
        [claim(x, x) for x in ("agree", "unread", "wrong", "gone")],
        [a, b, c, d],
        [page(a, CITY), page(b, None), page(c, None)],
        [(a[1], "live", CITY, "Agree"), (b[1], "live", CITY, "unread"), (c[1], "live", CITY, "somebody"), (d[1], "unavailable", None, None)],
    )
    assert (v["agree"].code, v["agree"].cross_check.verified_by) == ("MATCH_STRONG", "archive+x")
    assert (v["unread"].code, v["unread"].cross_check.verified_by, v["unread"].score) == ("MATCH_STRONG", "x-live", 1.0)
    assert (v["wrong"].code, v["wrong"].cross_check.verified, v["wrong"].cross_check.author_match) == ("NO_MATCH", False, False)
    assert (v["gone"].code, v["gone"].cross_check.status) == ("NO_MATCH", "unavailable")


def test_early_exit_and_empty(flow, spark):
    scored = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.95), ("a", 3, 0.99), ("b", 1, None), ("b", 2, 0.2)], "claim_id string, position int, score double")
    assert sorted((r.claim_id, r.position) for r in discover.until_convinced(scored).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    assert flow([], [], []) == {}


def test_dedupe(spark):
    rows = [capture("a", NOON, ts="20230101000002"), capture("a", NOON, ts="20230101000001"), capture("a", NOON, ts="20230101000000", status=404), capture("a", NOON, ts="20240101000000", host="twitter.com")]
    df = spark.createDataFrame(rows, CAPTURES)
    assert [r.snapshot_ts for r in discover.earliest_capture(df).collect()] == ["20230101000001"]
    assert [r.url for r in discover.readable_capture(df).collect()] == [rows[3][3]]


def test_search_cap_and_rank(spark):
    claims = discover.with_window(spark.createDataFrame([claim("a", "a", minute=720)], CLAIMS))
    df = spark.createDataFrame([capture("a", NOON + i * 1000, i) for i in range(520)], CAPTURES)
    found = discover.search(claims, df)
    assert found.count() == 500 and found.agg(F.max("seq")).first()[0] == 500
    ranked = discover.rank(found, claims).orderBy("position").collect()
    assert [r.position for r in ranked] == list(range(1, 11)) and all(r.time_ok for r in ranked)


def test_verdict_order(evaluate):
    n = F.lit(None)
    code = lambda p="x", h=True, d=True, e=False, s=None, t=None, x=False: evaluate(evidence.verdict_code(F.lit(p), F.lit(h).cast("boolean"), F.lit(d), F.lit(e), (n if s is None else F.lit(s)).cast("double"), F.lit(t).cast("boolean"), F.lit(x)))[0]
    assert [code(p="unknown", e=True), code(h=None), code(d=False), code(e=True)] == ["UNSUPPORTED_PLATFORM", "INSUFFICIENT_INPUT", "INSUFFICIENT_INPUT", "ARCHIVE_UNAVAILABLE"]
    assert [code(s=0.95), code(s=0.8), code(s=0.6)] == ["MATCH_STRONG", "MATCH_LIKELY", "MATCH_PARTIAL"]
    assert [code(s=0.2, t=True), code(s=0.1, t=False), code(s=0.2, t=True, x=True), code()] == ["POST_EXISTS_TEXT_UNREADABLE", "NO_MATCH", "NO_MATCH", "NO_MATCH"]


def test_copy_has_no_verdict_on_truth(spark):
    text = " ".join(" ".join(r) for r in evidence.COPY).lower()
    assert not any(w in text for w in ("fake", "hoax", "lie ", "fraud"))
    rows = spark.createDataFrame([("MATCH_LIKELY", 0.845), ("NO_MATCH", None), ("MATCH_STRONG", None)], "code string, score double")
    assert {r.code: r.title for r in evidence.with_copy(rows).collect()} == {"MATCH_LIKELY": "Likely match - 85%. A few words differ.", "NO_MATCH": "No archive match found. That does not mean it is not real.", "MATCH_STRONG": "Archived original found - ?% match."}


def test_labels(evaluate, spark):
    assert evaluate(evidence.tier(F.lit("MATCH_LIKELY")), evidence.tier(F.lit("MATCH_PARTIAL")), evidence.tier(F.lit("NO_MATCH")), evidence.check_label(F.lit(False)), evidence.check_label(F.lit(None).cast("boolean")), evidence.share_label(F.lit(0.845))) == ("default", "secondary", "outline", "No", "Unknown", "85% similar")
    assert evidence.general_steps(spark).count() == 4


def test_next_steps(evaluate):
    steps = evaluate(evidence.next_steps(F.lit("@nasa"), F.lit("  one two three four five six seven eight nine "), F.lit("2024-02-28")))[0]
    assert len(steps) == 7 and steps[0].url == "https://x.com/search?q=from%3Anasa%20since%3A2024-02-28%20until%3A2024-02-29&src=typed_query" and steps[2].url.endswith("one%20two%20three%20four%20five%20six%20seven%20eight")
    assert len(evaluate(evidence.next_steps(F.lit("a"), F.lit(" "), F.lit("2024-02-28")))[0]) == 6


def lines_of(spark, shots):
    rows = [(s, i, t, 0.9, (0.1, 0.1 * i, 0.5, 0.05)) for s, ts in shots.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "shot_id string, line_no int, text string, confidence double, bbox struct<x:double,y:double,w:double,h:double>")


def test_screens(spark):
    shots = {
        "nasa": ["NASA", "@nasa", "Mars mission update", "10:30 PM · Dec 5, 2024 · 1.2M Views"],
        "noise": ["Name", "@name", "Replying to @other", "Real body here", "Show more", "10:30 PM · Dec 5, 2024", "5 Likes 3 Views"],
        "hyphen": ["N", "@n", "hel-", "lo   wo  rld"],
        "avatar": ["©ie", "Polymarket ✓", "@Polymarket", "body text", "Dec 5, 2024", "9 Reposts 1 Quotes"],
        "mail": ["contact foo@bar.com today", "views"],
        "reply": ["Replying to @nasa"],
        "inline": ["Some Name @same_line", "text"],
        "blank": ["", None],
    }
    r = {x.shot_id: x for x in screens.read_screens(lines_of(spark, shots), "2025-06-15").collect()}
    n = r["nasa"]
    assert (n.platform, n.display_name.value, n.handle.value, n.text.value, n.dates.value[0].iso_date, n.dates.value[0].minute) == ("x", "NASA", "nasa", "Mars mission update", "2024-12-05", 1350)
    assert n.text.bbox.y == pytest.approx(0.2) and n.text.confidence == pytest.approx(0.9)
    assert r["noise"].text.value == "Real body here" and r["hyphen"].text.value == "hello wo rld" and r["hyphen"].platform == "unknown"
    assert r["avatar"].handle.value == "polymarket" and r["mail"].handle.value is None and r["mail"].display_name.value == "contact foo@bar.com today"
    assert r["reply"].handle.value == "nasa" and r["inline"].display_name.value == "Some Name" and r["blank"].text.value is None and r["blank"].dates.value == []
    flags = {x.shot_id: x for x in screens.field_flags(screens.read_screens(lines_of(spark, shots), "2025-06-15")).collect()}
    assert flags["mail"].missing_handle and flags["mail"].missing_date and not flags["nasa"].missing_text and not flags["nasa"].uncertain_handle
    claims = screens.as_claims(screens.read_screens(lines_of(spark, {"nasa": shots["nasa"]}), "2025-06-15"))
    edited = screens.with_edits(claims, spark.createDataFrame([("nasa", "@ESA", None, "2024-12-05")], "claim_id string, handle string, text string, iso_date string")).first()
    assert (edited.handle, edited.text, edited.dates[0].minute, edited.fields_edited) == ("esa", "Mars mission update", 1350, True)
    assert screens.read_screens(lines_of(spark, {"a": ["x"]}).where("false"), "2025-06-15").count() == 0


def test_attestations(spark, tmp_path):
    c = capture("nasa", NOON)
    request = ("x", "nasa", "2023-05-01", None, CITY, True, c[2], c[3])
    schema = "platform string, handle string, claimed_date_iso string, claimed_minute int, claimed_text string, fields_edited boolean, snapshot_ts string, original_url string"
    bad = [("x", "no handle", *request[2:]), (*request[:2], "05/01/2023", *request[3:]), (*request[:3], 1440, *request[4:]), (*request[:4], "x" * 2001, *request[5:]), (*request[:6], "2023", c[3]), (*request[:7], "http://x.com/a/status/1"), (None,) * 8]
    requests = spark.createDataFrame([request, request, *bad], schema)
    pages = spark.createDataFrame([page(c, CITY)], PAGES)
    issued = store.issue(requests, evidence.page_texts(pages, pages.select("snapshot_ts", "url")), now_ms=5)
    rows = issued.collect()
    assert len(rows) == 1 and (rows[0].verdict_code, rows[0].score, rows[0].archive_snippet, rows[0].fields_edited, rows[0].created_at) == ("MATCH_STRONG", 1.0, CITY[:140], 1, 5)
    path = str(tmp_path / "attestations")
    store.save(issued, path)
    store.save(issued, path)
    kept = spark.read.schema(store.ATTESTATION_DDL).parquet(path)
    assert kept.count() == 1 and store.lookup(kept, rows[0].id).first().handle == "nasa" and store.lookup(kept, "AbC123XyZ9").count() == 0
    with pytest.raises(ValueError):
        store.lookup(kept, "short")
    assert "EqualTo(id" in store.lookup(kept, rows[0].id)._jdf.queryExecution().toString()


def test_caches(spark):
    entries = spark.createDataFrame([("k", "a", 100, 50), ("k", "b", 120, 10), ("z", "c", 0, 1)], "key string, value string, written_at long, ttl_sec long")
    requests = spark.createDataFrame([(1, "k", 99), (2, "k", 100), (3, "k", 125), (4, "k", 131), (5, "q", 1), (6, None, 1)], "request_id int, key string, at long")
    for block in (86_400, 7, 20):
        got = {r.request_id: (r.value, r.hit) for r in store.cache_lookup(requests, entries, block).collect()}
        assert got == {1: (None, False), 2: ("a", True), 3: ("b", True), 4: (None, False), 5: (None, False), 6: (None, False)}
    assert [r.key for r in store.newest_entries(entries, 1).collect()] == ["k"]


def test_rate_limit(spark):
    rows = [("search", "u", t * 1000) for t in (0, 10, 600, 601, 1210)] + [("search", "v", 5), ("search", "u", 0)]
    got = limits.rate_limited(spark.createDataFrame(rows, "kind string, user_id string, ts_ms long"), 600, 3).collect()
    assert sorted((r.user_id, r.ts_ms, r.in_window, r.allowed) for r in got) == [("u", 0, 2, True), ("u", 0, 2, True), ("u", 10_000, 3, True), ("u", 600_000, 4, False), ("u", 601_000, 3, True), ("u", 1_210_000, 1, True), ("v", 5, 1, True)]


def test_index_answers(spark):
    import json

    head = ["urlkey", "timestamp", "original", "mimetype", "statuscode", "digest"]
    good = json.dumps([head, ["k", "20230101", "https://x.com/a/status/20", "text/html", "200", "D"], ["k", "", "u", "", "", ""], ["k", "20230102", "https://x.com/a/status/21", None, "-"]])
    bodies = [good, "[]", json.dumps([head]), "null", "broken", json.dumps([["nothing"], ["x"]]), None]
    rows = index.parse_answers(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")).collect()
    assert [(r.n, r.timestamp, r.statuscode, r.mimetype, r.digest) for r in rows] == [(0, "20230101", 200, "text/html", "D"), (0, "20230102", 0, "", "")]
    found = discover.candidate_columns(spark.createDataFrame(rows)).collect()
    assert [(r.handle, r.post_id, r.id_ms) for r in found] == [("a", 20, ids.CLOCK_START_MS), ("a", 21, ids.CLOCK_START_MS)]


def test_index_fetch(evaluate):
    import io
    import urllib.error

    class Answer(io.BytesIO):
        def __init__(self, body, url):
            super().__init__(body)
            self.geturl = lambda: url

    waits, calls = [], []

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {"Retry-After": "2"} if len(calls) == 1 else {}, None)
        return Answer(b"[]", request.full_url)

    assert index.fetch("https://web.archive.org/x", "a", opener=opener, sleep=waits.append) == b"[]" and waits == [2.0, 1.0]
    def failing(error):
        def run(request, timeout):
            raise error

        with pytest.raises(index.FetchError) as e:
            index.fetch("https://web.archive.org/x", "a", opener=run, sleep=lambda s: None)
        return e.value.code

    gone = urllib.error.HTTPError("u", 404, "no", {}, None)
    assert [failing(gone), failing(urllib.error.HTTPError("u", 429, "no", {}, None)), failing(TimeoutError()), failing(urllib.error.URLError("x"))] == ["ARCHIVE_ERROR", "ARCHIVE_RATE_LIMITED", "ARCHIVE_TIMEOUT", "ARCHIVE_ERROR"]
    assert index.fetch("https://web.archive.org/x", "a", most_bytes=2, opener=lambda r, timeout: Answer(b"12345", r.full_url)) == b"12"
    with pytest.raises(ValueError):
        index.fetch("https://evil.com/", "a", opener=opener)
    with pytest.raises(ValueError):
        index.fetch("https://web.archive.org/", "a", opener=lambda r, timeout: Answer(b"", "https://evil.com/"))
    asked = []

    def hopping(*targets):
        def run(request, timeout):
            asked.append(request.full_url)
            to = dict(zip(("https://web.archive.org/0", *targets), targets)).get(request.full_url)
            if to:
                raise urllib.error.HTTPError(request.full_url, 302, "there", {"Location": to}, None)
            return Answer(b"page", request.full_url)

        return index.fetch("https://web.archive.org/0", "a", opener=run)

    assert hopping("https://web.archive.org/1", "https://web.archive.org/2") == b"page" and len(asked) == 3
    for target in ("https://evil.com/", "http://web.archive.org/1", "https://web.archive.org:8443/", "https://u@web.archive.org/"):
        asked.clear()
        with pytest.raises(ValueError):
            hopping(target)
        assert asked == ["https://web.archive.org/0"]
    assert hopping(*(f"https://web.archive.org/{k}" for k in range(1, 7))) == b"page"
    with pytest.raises(index.FetchError):
        hopping(*(f"https://web.archive.org/{k}" for k in range(1, 8)))
    assert evaluate(index.retry_after_ms(F.lit("3"), F.lit(0)), index.retry_after_ms(F.lit("Thu, 01 Jan 1970 00:00:09 GMT"), F.lit(4000)), index.retry_after_ms(F.lit("x"), F.lit(0))) == (3000, 5000, None)
    assert [index.wait_ms("999", 0), index.wait_ms(None, 3), index.wait_ms("x", 9)] == [10000, 4000, 4000]
    q = evaluate(index.index_query(F.lit("nasa"), F.lit("165"), F.lit("20230430100000")))[0]
    assert q == "https://web.archive.org/cdx/search/cdx?url=x.com%2Fnasa%2Fstatus%2F165&from=20230430100000&matchType=prefix&fl=timestamp,original,statuscode,mimetype,digest&filter=statuscode:200&collapse=urlkey&limit=500&output=json"


def test_records(spark, tmp_path, evaluate):
    live = lambda body: evaluate(records.parse_live(F.lit("1"), F.lit(body)))[0]
    assert live('{"__typename":"Tweet","text":"hi","user":{"screen_name":"a"},"favorite_count":3}').screen_name == "a"
    assert [live(x).status for x in ('{"text":"x"}', '{"__typename":"TweetTombstone","text":"x"}', '{"text":" "}', "broken", "[]")] == ["live"] + ["unavailable"] * 4
    (tmp_path / "one.json").write_text('{\n"handle":{"value":"h"},"text":{"value":"t"},"dates":{"value":[{"isoDate":"2024-01-01","raw":"r"},{"isoDate":"2024-01-02"}]}}')
    example = records.read_examples(spark, str(tmp_path)).first()
    assert (example.platform, example.handle, [d.iso_date for d in example.dates]) == ("x", "h", ["2024-01-01"])
    (tmp_path / "images").mkdir()
    for name in ("a.PNG", "b.heic", "c.webp"):
        (tmp_path / "images" / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in records.read_images(spark, str(tmp_path / "images")).collect()) == ["a.PNG", "c.webp"]


def test_page_gates(spark):
    c = capture("a", NOON)
    rows = [(c[2], c[3], "<title>A readable title of a post</title>", "text/html"), ("1", c[3], "x" * 600_001, "text/html"), ("2", c[3], "x", "image/png"), ("3", c[3].replace("https", "http"), "x", "text/html"), ("4", c[3], "x", None)]
    pages = spark.createDataFrame(rows, PAGES)
    assert [r.snapshot_ts for r in evidence.page_texts(pages, pages.select("snapshot_ts", "url")).collect()] == [c[2]]


def test_canonical_variants(evaluate):
    assert evaluate(urls.canonical_variants(F.lit("https://x.com/a/status/1")))[0] == ["https://x.com/a/status/1", "https://twitter.com/a/status/1"]


def test_geometry(evaluate):
    size = lambda w, h: tuple(evaluate(imaging.target_size(F.lit(w), F.lit(h)))[0])
    assert [size(3000, 2000), size(800, 600), size(800, 3000), size(0, 5)] == [(2400, 1600), (1200, 900), (640, 2400), (0, 0)]
    assert evaluate(imaging.should_invert(F.lit(0.44)), imaging.should_invert(F.lit(0.45)), imaging.top_cut(F.lit(1080)), imaging.stretched(F.lit(128.0)), imaging.clamp_byte(F.lit(300.2)), imaging.stretched(F.lit(0.0))) == (True, False, 64, 128, 255, 0)
    box = F.struct(F.lit(120.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1200.0).alias("w"), F.lit(90.0).alias("h"))
    got = evaluate(imaging.to_source(box, F.lit(1200), F.lit(900), F.lit(54)), imaging.in_unit_square(box))
    assert tuple(got[0]) == pytest.approx((0.1, 0.06, 0.9, 0.1)) and got[1] is False


def test_bands(spark):
    kind = "array<struct<text:string,confidence:double,bbox:struct<x:double,y:double,w:double,h:double>>>"
    lines = [("Name", 0.5, (10.0, 10.0, 200.0, 20.0)), ("", 0.9, (0.0, 0.0, 1.0, 1.0)), ("@name", 0.5, (10.0, 40.0, 150.0, 20.0)), ("10:30 PM", 0.5, (10.0, 300.0, 100.0, 20.0))]
    again = [("better", 0.9, (12.0, 41.0, 100.0, 18.0))]
    df = spark.createDataFrame([(lines, again)], f"lines {kind}, again {kind}")
    w, h = F.lit(500), F.lit(400)
    row = df.select(imaging.header_band(F.col("lines"), w, h).alias("head"), imaging.date_band(F.col("lines"), w, h).alias("date"), imaging.merged_band(F.col("lines"), F.struct(F.lit(0.0).alias("x"), F.lit(35.0).alias("y"), F.lit(300.0).alias("w"), F.lit(40.0).alias("h")), F.col("again")).alias("merged")).first()
    assert row.head.x == 60 and row.date.y == 292 and [x.text for x in row.merged] == ["Name", "", "better", "10:30 PM"]


def test_kernels(spark):
    import numpy as np

    p = np.zeros((40, 60))
    p[5:15, 5:30] = 0.9
    p[5:15, 35:50] = 0.8
    p[25:35, 10:20] = 0.4
    p[38, 3] = 0.9
    boxes = imaging.text_boxes(p)
    assert len(boxes) == 2 and boxes[0][2] > boxes[1][2] and boxes[0][4] == pytest.approx(0.9)
    u = np.zeros((12, 12))
    u[1:11, 1:3] = u[1:11, 8:10] = u[9:11, 1:10] = 0.9  # a U is one component
    assert len(imaging.text_boxes(u)) == 1
    assert [b[0] for b in imaging.reading_order([(50, 10, 5, 10), (10, 12, 5, 10), (0, 40, 5, 10)])] == [10, 50, 0]
    rgb = np.arange(48).reshape(4, 4, 3).astype(float)
    assert np.allclose(imaging.resized(rgb, 4, 4), rgb) and imaging.resized(rgb, 8, 2).shape == (2, 8, 3)
    assert imaging.detector_input(rgb).shape == (1, 3, 32, 32) and imaging.recogniser_input(rgb, (0, 0, 4, 2)).shape == (1, 3, 48, 96)
    assert 10 <= imaging.ink_threshold(np.array([10, 10, 12, 200, 201])) < 200 and 0 < imaging.mean_luminance(rgb) < 1
    assert imaging.prepared_gray(np.full((4, 4, 3), 255.0), True, 1).tolist() == [[0] * 4] * 3
    scores = np.full((6, 4), 0.01)
    for t, c in enumerate((1, 1, 0, 1, 3, 2)):
        scores[t, c] = 0.97
    assert imaging.decode_line(scores, ["a", "b"]) == ("aa b", pytest.approx(97.0)) and imaging.decode_line(np.zeros((0, 4)), ["a"]) == ("", 0.0)
    assert imaging.decode_line(scores * 20, ["a", "b"])[0] == "aa b"
    df = spark.createDataFrame([(scores.ravel().tolist(), 4, p.ravel().tolist(), 60)], "s array<double>, k int, p array<double>, w int")
    row = df.select(imaging.decoded(F.col("s"), F.col("k"), ["a", "b"]).alias("t"), imaging.boxes_of(F.col("p"), F.col("w")).alias("b")).first()
    assert row.t.text == "aa b" and [round(b.score, 2) for b in row.b] == [0.9, 0.8]


def test_streams(spark, tmp_path):
    from tracelode.streaming import flows

    at = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)

    def drain(name, schema, batches, build):
        source = tmp_path / name
        source.mkdir()
        stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    end = [(datetime(2024, 1, 1, 5), "z", "z")]
    seen = drain("dedup", "ts timestamp, query_key string, x string", [[(at(1), "a", "1"), (at(2), "a", "2"), (at(3), "b", "3")], end], flows.distinct_requests)
    assert sorted(r.query_key for r in seen) == ["a", "b", "z"]
    edits = drain("edits", "ts timestamp, claim_id string, value string", [[(datetime(2024, 1, 1, 0, 0, 1, k), "a", v) for k, v in ((0, "x"), (300_000, "xy"), (600_000, "xyz"))] + [(at(9), "a", "last")], end], flows.settled_edits)
    assert sorted(r.value for r in edits) == ["last", "xyz"]
    counts = drain("counts", "ts timestamp, user_id string, x string", [[(at(k), "u", "") for k in range(31)], end], lambda s: flows.sliding_counts(s, "search"))
    assert max(r.n for r in counts) == 31 and any(r.over_limit for r in counts)
    events = [(at(1), "k", "v", 5, None), (at(2), "k", None, None, "hit"), (at(9), "k", None, None, "expired"), (at(3), "q", None, None, "absent")]
    got = drain("cache", "at timestamp, key string, value string, ttl_sec int, request_id string", [events, [(datetime(2024, 1, 1, 5), "z", "z", 1, None)]], flows.cached_values)
    assert sorted((r.request_id, r.value, r.hit) for r in got) == [("absent", None, False), ("expired", None, False), ("hit", "v", True)]
