"""Literal vectors of the functions."""

import pytest
from pyspark.sql import functions as F

from tracelode.functions import dates, handles, htmlpost, ids, lines, livetoken, privacy, similarity, textdiff, textnorm, times, urls

L = F.lit
CITY = "The city council approved the new downtown transit plan after months of public debate and revisions"


def test_ids(evaluate):
    got = evaluate(ids.id_to_ms(L("20")), ids.id_to_ms(L(" 1635000000000000000 ")), ids.id_to_ms(L("x1")), ids.id_to_ms(L("9" * 25)), ids.id_to_ms(L(None).cast("string")))
    assert got == (1288834974657, (1635000000000000000 >> 22) + 1288834974657, None, (int("9" * 25) >> 22) + 1288834974657, None)
    for ms in (1700000000000, 1635000000000, 1288834974658):
        lo, hi = evaluate(ids.first_id(L(ms)), ids.last_id(L(ms)))
        assert hi - lo == 2**22 - 1 and (lo >> 22) + ids.CLOCK_START_MS == ms == (hi >> 22) + ids.CLOCK_START_MS
        assert evaluate(ids.first_id(L(ms + 1)))[0] == hi + 1
    assert evaluate(ids.first_id(L(5)), ids.last_id(L(5))) == (0, 2**22 - 1)


@pytest.mark.parametrize("a,b", [(12345, 12345), (1000, 1005), (1000, 1099), (999, 1005), (10**18, 2 * 10**18 - 1), (1005, 999), (7, 123456), (0, 9)])
def test_prefix_cover(evaluate, a, b):
    cover = evaluate(ids.prefix_cover(L(a).cast("bigint"), L(b).cast("bigint")))[0]
    assert 1 <= len(cover) <= 12 and len(set(cover)) == len(cover)
    lo, hi = min(a, b), max(a, b)
    for x in {lo, hi, (lo + hi) // 2, *range(lo, min(hi, lo + 150) + 1)}:
        assert any(str(x).startswith(p) for p in cover)
    assert a != b or cover == [str(a)]


def test_windows(evaluate):
    day = 1682899200000  # 2023-05-01
    one, two, none, late = evaluate(times.window_of(F.array(L("2023-05-01"))), times.window_of(F.array(L("2023-05-03"), L("2023-05-01"))), times.window_of(F.array(L("2023-02-30"), L("x"))), times.window_of(F.array(L("2023-05-01")), True))
    hour = times.HOUR_MS
    assert tuple(one) == (day - 14 * hour, day + 24 * hour - 1000 + 12 * hour)
    assert tuple(two) == (day - 14 * hour, day + 72 * hour - 1000 + 12 * hour) and none is None and late.to_ms == one.to_ms + 1000


def test_time_consistency(evaluate):
    at = 1682899200000
    for offset in (-420, 330, 345, 570, 840, -720):
        shown = at + offset * 60_000
        iso, minute = evaluate(F.date_format(F.timestamp_millis(L(shown)), "yyyy-MM-dd"), L(shown // 60_000 % 1440))
        assert evaluate(times.time_consistent(L(iso), L(minute), L(at)), times.date_consistent(L(iso), L(at))) == (True, True)
    assert evaluate(times.time_consistent(L("2023-06-15"), L(720), L(at)), times.date_consistent(L("2023-06-15"), L(at)), times.date_consistent(L("2023-02-30"), L(at))) == (False, False, False)
    null = L(None).cast("int")
    assert evaluate(times.time_consistent(L("2023-05-01"), null, L(at)), times.time_consistent(L(None).cast("string"), L(1), L(at)), times.date_consistent(L("05/01/2023"), L(at))) == (None, None, None)


def test_time_consistent_is_near_some_offset(spark):
    rows = spark.range(-1000, 1100).select("id", times.time_consistent(F.lit("1970-01-01"), F.lit(0), -F.col("id") * 60_000).alias("ok")).collect()
    for r in rows:
        assert r.ok == any(abs(r.id - o) <= 2 for o in range(-720, 841, 15))


def test_capture_timestamps(evaluate):
    assert evaluate(times.capture_timestamp(L(1700000000000)), times.next_day(L("2024-02-28")), times.next_day(L("2023-12-31")), times.next_day(L("bad"))) == ("20231114221320", "2024-02-29", "2024-01-01", "bad")


def test_urls(evaluate):
    good = ["https://x.com/a/status/1", "http://www.twitter.com/A_b/status/123/", "https://mobile.twitter.com/a/status/9?s=20"]
    bad = ["https://x.com/a/status/", "https://evil.com/a/status/1", "https://x.com/a/b/status/1", "https://x.com/a/status/1/photo/1", "HTTPS://x.com/a/status/1"]
    assert evaluate(*(urls.is_status_url(L(u)) for u in good + bad)) == (True,) * 3 + (False,) * 5
    assert evaluate(urls.post_id_of(L(good[1])), urls.handle_of(L(good[1])), urls.handle_of(L("HTTPS://X.com/NASA/status/1/x")), urls.snapshot_eligible(L(good[0])), urls.snapshot_eligible(L(good[1]))) == ("123", "a_b", "nasa", True, False)
    replay = urls.replay_url(L("20230101000000"), L(good[0]))
    assert evaluate(replay, urls.framed_url(replay)) == ("https://web.archive.org/web/20230101000000id_/https://x.com/a/status/1", "https://web.archive.org/web/20230101000000if_/https://x.com/a/status/1")
    allowed = ["https://web.archive.org/web/1id_/x", "http://archive.org:80/y", "https://WEB.archive.org/a"]
    hostile = ["https://web.archive.org@evil.com/", "https://evil.com/web.archive.org", "https://web%2earchive.org/", "https://web．archive．org/", "https://web.archive.org.evil.com/", "ftp://web.archive.org/", "https://web.archive.org./", "x"]
    assert evaluate(*(urls.is_allowed_url(L(u)) for u in allowed + hostile)) == (True,) * 3 + (False,) * 8
    assert evaluate(urls.uri_component(L("from:a b (c)!'~*&/")))[0] == "from%3Aa%20b%20(c)!'~*%26%2F"


def test_normalize(evaluate):
    assert evaluate(textnorm.normalize_text(L("“Hello” — world…")), textnorm.normalize_text(L("See https://t.co/abc 😀 now pic.twitter.com/x")), textnorm.normalize_text(L("ﬁne ＡＢＣ①")), textnorm.normalize_text(L(""))) == ("hello world", "see now", "fine abc1", "")
    assert evaluate(textnorm.normalize_folded(L("0 1 | 5 8 rn vv r-n")))[0] == "o l l s b m w r n"


def test_similarity(evaluate):
    score = lambda a, b: evaluate(similarity.text_similarity(L(a), L(b)))[0]
    assert score(CITY, CITY).score >= 0.97
    assert score(CITY, CITY.replace("o", "0").replace("m", "rn")).score >= 0.90
    changed = score(CITY + " 240", CITY + " 241")
    assert changed.score < 0.90 and changed.number_mismatch and changed.capped_by == "number"
    short = score("hello world", "hello world")
    assert short.score <= 0.80 and short.capped_by == "length"
    assert score(CITY, "Completely different words about gardening and soup recipes for winter evenings").score < 0.55
    assert score(CITY, CITY[:70]).score >= 0.90
    assert score(CITY + " https://t.co/abc", CITY + " 🎉").score >= 0.97
    assert score("", "").score <= 0.8


def test_similarity_gates(evaluate):
    t = similarity.text_similarity(L(CITY), L(CITY))
    yes, no, unknown = L(True), L(False), L(None).cast("boolean")
    gate = lambda *a: tuple(evaluate(similarity.gated_score(t, *a))[0])
    assert gate(yes, yes, yes, yes) == (1.0, 1.0, None) and gate(yes, yes, unknown, yes)[0] == 1.0
    assert gate(no, yes, yes, yes) == (0.6, 1.0, "context") and gate(yes, unknown, yes, yes)[0] == 0.6
    assert gate(yes, yes, no, yes) == (0.74, 1.0, "time") and gate(yes, yes, yes, no) == (0.0, 0.0, "unreadable")


def test_partial_similarity_thins_out(evaluate):
    long = "".join(chr(97 + i * i % 26) for i in range(1300))
    a, b = "x" + long[600:640], long
    width, last = len(a), len(b) - len(a) + 1
    step = max(1, last // 400)
    distance = lambda p, q: evaluate(F.levenshtein(L(p), L(q)))[0]
    best = max(1 - distance(a, b[i : i + width]) / width for i in range(0, last, step) if abs(i - 600) < 60)
    assert evaluate(similarity.partial_similarity(L(a), L(b)))[0] >= best - 1e-9


def test_lines(evaluate):
    noise = ["Replying to @nasa", "Show more", "Show more ...", "Translate post", "Show this thread", "Promoted", "Ad", "from New York", "1.2M Views", "Views", "1.2K Reposts 300 Quotes 5K Likes", "12 likes and 3 views today"]
    keep = ["", "Mars mission update", "Adventure time", "I like views", "10 days left", "promotedness"]
    assert evaluate(*(lines.is_chrome_line(L(x)) for x in noise)) == (True,) * len(noise)
    assert evaluate(*(lines.is_chrome_line(L(x)) for x in keep)) == (False,) * len(keep)
    assert evaluate(lines.join_body(F.array(L("hel-"), L("lo   wo  rld"), L(" "))), lines.body_lines(F.array(L(" a "), L("Show more"), L("")))) == ("hello wo rld", ["a"])
    assert evaluate(*(lines.is_junk_text(L(x)) for x in ("X / Home", "Log in", "short", "Something went wrong. Try reloading.", "“x.com”", ""))) == (True,) * 6
    assert evaluate(lines.is_junk_text(L("A real post about the weather")), lines.has_platform_signal(F.array(L("nothing"), L("Postal")))) == (False, True)


def test_handles(evaluate):
    assert evaluate(handles.handle_variants(L("abc")), handles.handle_variants(L(" ")), handles.handle_input(L(" @@NASA "))) == (["abc", "ab"], [], "nasa")
    assert "rnarna" in evaluate(handles.handle_variants(L("mama")))[0] and "masa" in evaluate(handles.repair_variants(L("rnasa")))[0]
    assert evaluate(handles.handle_variants(L("r0n1s5")))[0] == ["r0n1s5", "ronlss", "r0n155", "r0n1s"]


@pytest.mark.parametrize(
    "line,expected",
    [
        ("10:30 PM · Dec 5, 2024", [("2024-12-05", 1350)]), ("10:30 PM - 5 Dec 2024", [("2024-12-05", 1350)]), ("5/12/24", [("2024-12-05", None), ("2024-05-12", None)]), ("25/12/24", [("2024-12-25", None)]), ("5/5/24", [("2024-05-05", None)]),
        ("23:15 · 5 Dec 2024", [("2024-12-05", 1395)]), ("12:00 AM · Jan 1, 2024", [("2024-01-01", 0)]), ("12:00 PM · Jan 1, 2024", [("2024-01-01", 720)]), ("Dec 5", [("2025-12-05", None), ("2024-12-05", None)]), ("3h", []), ("2d", []), ("15m", []),
        ("3 hours ago", []), ("", []), ("Feb 30, 2024", []), ("32/01/24", []), ("December 5th, 2024", [("2024-12-05", None)]), ("10:30 PM", []), ("2024-12-05", [("2024-12-05", None)]), (None, []),
    ],
)
def test_dates(evaluate, line, expected):
    found = evaluate(dates.parse_dates(L(line).cast("string"), "2025-06-15"))[0]
    assert [(d.iso_date, d.minute) for d in found] == expected
    assert all(bool(d.year_inferred) == (line == "Dec 5") and bool(d.dm_ambiguous) == (line == "5/12/24") for d in found)


def test_leap_day_without_year(evaluate):
    assert [d.iso_date for d in evaluate(dates.parse_dates(L("Feb 29"), "2024-06-15"))[0]] == ["2024-02-29"]


def test_edited_date(evaluate):
    d = F.struct(L("2024-01-01").alias("iso_date"), L(30).alias("minute"))
    same, other, none = evaluate(dates.edited_date(d, L("2024-01-01")), dates.edited_date(d, L("2024-01-02")), dates.edited_date(d, L("")))
    assert (same[0].minute, other[0].minute, none) == (30, None, [])


def test_extractors():
    get = lambda html: (lambda p: (p["extractor"], p["text"]))(htmlpost.extract_post_from(html))
    body = "Mars mission update today"
    assert htmlpost.extract_post_from(f'<script type="application/ld+json">[{{"@graph":[{{"@type":["Thing","SocialMediaPosting"],"articleBody":"{body}","author":{{"name":"NASA","alternateName":"@nasa"}},"dateCreated":"2024-01-01"}}]}}]</script>') == {"text": body, "display_name": "NASA", "handle": "nasa", "created_at_iso": "2024-01-01", "extractor": "ldjson"}
    assert get(f'<meta property="og:description" content="“{body}”"><title>x</title>') == ("og", body)
    assert htmlpost.extract_post_from(f"<meta name=twitter:title content='NASA on X: \"{body}\" / X'>")["display_name"] == "NASA"
    assert get(f'<div class="permalink-tweet"><div><p>{body} &amp; <a>more</a></p></div></div>') == ("classic", body + " & more")
    assert get(f'<div data-tweet-text="{body}"></div>') == ("classic", body)
    assert get(f'<script id="__NEXT_DATA__">{{"a":["{body}","b"]}}</script>') == ("embeddedJson", body)
    assert get('<script>var s = {"full_text":"it said \\"hi\\" to all of us"}</script>') == ("embeddedJson", 'it said "hi" to all of us')
    assert get(f'<title>NASA on Twitter: "{body}"</title>') == ("title", body) and get(f"<title>{body}</title>") == ("title", body)
    assert get("<title>Log in to X</title>") == ("none", None) and get("<title>X</title>") == ("none", None) and get(None) == ("none", None) and get("<<<>>>&&&") == ("none", None)
    assert get(f"<title>{body}</title>" + "<p>x" * 700_000)[1] == body
    assert htmlpost.clean("<p class=a>some text</p> here") == "some text here" and htmlpost.unquoted("'“a”'") == "a"


def test_diff(evaluate):
    assert textdiff.diff_words("", "") == [{"op": "eq", "text": ""}] and textdiff.diff_words("same words", "same words") == [{"op": "eq", "text": "same words"}]
    got = textdiff.diff_words("a b c d", "a x c d e")
    assert [(r["op"], r["text"].strip()) for r in got] == [("eq", "a"), ("del", "b"), ("ins", "x"), ("eq", "c d"), ("ins", "e")]
    assert [tuple(r) for r in evaluate(textdiff.display_diff(L("see https://a.b/c now"), L("see now")))[0]] == [("eq", "see now")]


def test_live_token(evaluate):
    assert [livetoken.live_token_of(x) for x in ("957414748881997825", "1256236544704686336")] == ["2bjt21ztkvx", "31ml7rymai"] and livetoken.live_token_of("20")
    assert [livetoken.live_token_of(x) for x in ("", "abc", "12.5", "-1", "1" * 26, None)] == [None] * 6
    assert evaluate(livetoken.live_url(L("957414748881997825")))[0] == "https://cdn.syndication.twimg.com/tweet-result?id=957414748881997825&lang=en&token=2bjt21ztkvx"


def test_privacy(evaluate):
    import hashlib

    assert evaluate(privacy.hashed_address(L("1.2.3.4"), L("2024-01-01")), privacy.client_address(L(None).cast("string"), L(" 9.9.9.9 , 1.1.1.1")), privacy.client_address(L("5.5.5.5"), L("9.9.9.9")), privacy.client_address(L(""), L(""))) == (hashlib.sha256(b"2024-01-01:1.2.3.4").hexdigest(), "9.9.9.9", "5.5.5.5", "unknown")
    fields = F.create_map(*(L(x) for x in ("n", "1", "clientIp", "x", "Description", "y", "ocrMs", "2", "textLen", "3")))
    assert evaluate(privacy.log_line(L("done"), fields))[0] == '{"event":"done","n":"1"}'
    assert evaluate(privacy.error_fields(L(None).cast("string"), L("m"), L(1)))[0].code == "INTERNAL"
