"""Queries over the driver's tables, one or more for each operator, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, handles, htmlpost, ids, lines, livetoken, privacy, similarity, textdiff, textnorm, times, urls
from ..operators import discover, evidence, limits, screens, store
from ..sources import index, records
from . import adapters as A
from .check import check

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- ids, windows, times ------------------------------------------------------------------------------------------


@query(A.with_sql(A.CAPTURES_SQL) + f"SELECT post_id, (post_id >> 22) + {A.CLOCK} AS id_ms, count(*) AS n FROM captures GROUP BY ALL")
def snowflake_decode(spark, sf_dir):
    return A.captures(spark, sf_dir).groupBy("post_id", ids.id_to_ms(F.col("post_id").cast("string")).alias("id_ms")).agg(F.count("*").alias("n"))


@query(A.with_sql(A.BASE_SQL) + f"SELECT event_id, (ms - {A.CLOCK}) << 22 AS first_id, ((ms - {A.CLOCK} + 1) << 22) - 1 AS last_id FROM base")
def snowflake_range(spark, sf_dir):
    return A._base(spark, sf_dir).select("event_id", ids.first_id(F.col("ms")).alias("first_id"), ids.last_id(F.col("ms")).alias("last_id"))


_RANGE = f"(epoch_ms(TIMESTAMP '2024-01-05') - {A.CLOCK}) << 22"


@query(A.with_sql(A.CAPTURES_SQL) + f"SELECT event_id, post_id, url FROM captures WHERE post_id BETWEEN {_RANGE} AND ((epoch_ms(TIMESTAMP '2024-01-06') - {A.CLOCK} + 1) << 22) - 1")
def snowflake_range_filter(spark, sf_dir):
    """A time window as a range of ids, which the scan can prune by."""
    lo, hi = (F.lit(1704412800000 + d * times.DAY_MS) for d in (0, 1))
    return A.captures(spark, sf_dir).where(F.col("post_id").between(ids.first_id(lo), ids.last_id(hi))).select("event_id", "post_id", "url")


_PREFIXES = """
, bounds AS (SELECT claim_id, CAST((from_ms - 1288834974657) << 22 AS VARCHAR) AS lo, CAST(((to_ms - 1288834974657 + 1) << 22) - 1 AS VARCHAR) AS hi FROM windows WHERE from_ms IS NOT NULL),
fits AS (SELECT *, (SELECT max(k) FROM range(1, length(lo) + 1) t(k) WHERE CAST(left(hi, k) AS BIGINT) - CAST(left(lo, k) AS BIGINT) < 12) AS k FROM bounds)
SELECT claim_id, CAST(unnest(range(CAST(left(lo, k) AS BIGINT), CAST(left(hi, k) AS BIGINT) + 1)) AS VARCHAR) AS prefix FROM fits"""


@query(A.with_sql(A.BASE_SQL, A.CLAIMS_SQL, A.WINDOWS_SQL).rstrip() + _PREFIXES)
def prefix_buckets(spark, sf_dir):
    asked = discover.with_window(A.claims(spark, sf_dir)).where("from_ms IS NOT NULL")
    return asked.select("claim_id", F.explode(ids.prefix_cover(F.col("min_id"), F.col("max_id"))).alias("prefix"))


@query(A.with_sql(A.BASE_SQL, A.CLAIMS_SQL, A.WINDOWS_SQL) + "SELECT claim_id, from_ms, to_ms FROM windows")
def claim_window(spark, sf_dir):
    return discover.with_window(A.claims(spark, sf_dir)).select("claim_id", "from_ms", "to_ms")


_SHIFTED = "SELECT claim_id, iso, minute, w.from_ms + 50400000 + (claim_id % 1000) * 131000 - 30000000 AS id_ms FROM windows w"


def _instants(spark, sf_dir):
    asked = discover.with_window(A.claims(spark, sf_dir))
    d = F.try_element_at("dates", F.lit(1))
    return asked.select("claim_id", d["iso_date"].alias("iso"), d["minute"].alias("minute"), (F.col("from_ms") + 50400000 + (F.col("claim_id") % 1000) * 131000 - 30000000).alias("id_ms"))


@query(A.with_sql(A.BASE_SQL, A.CLAIMS_SQL, A.WINDOWS_SQL, f"shifted AS ({_SHIFTED})") + f"SELECT claim_id, {A.OFFSET_SQL} AS implied_offset, {A.TIME_OK_SQL} AS time_ok FROM shifted")
def time_consistent(spark, sf_dir):
    args = (F.col("iso"), F.col("minute"), F.col("id_ms"))
    return _instants(spark, sf_dir).select("claim_id", times.implied_offset(*args).alias("implied_offset"), times.time_consistent(*args).alias("time_ok"))


@query(A.with_sql(A.BASE_SQL, A.CLAIMS_SQL, A.WINDOWS_SQL, f"shifted AS ({_SHIFTED})") + f"SELECT claim_id, {A.DATE_OK_SQL} AS date_ok FROM shifted")
def date_consistent(spark, sf_dir):
    return _instants(spark, sf_dir).select("claim_id", times.date_consistent(F.col("iso"), F.col("id_ms")).alias("date_ok"))


@query(A.with_sql(A.BASE_SQL) + "SELECT event_id, strftime(make_timestamp(ms * 1000), '%Y%m%d%H%M%S') AS capture_ts, strftime(make_timestamp(ms * 1000) + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day FROM base")
def capture_timestamps(spark, sf_dir):
    return A._base(spark, sf_dir).select("event_id", times.capture_timestamp(F.col("ms")).alias("capture_ts"), times.next_day(F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd")).alias("next_day"))


# --- URLs and handles ---------------------------------------------------------------------------------------------

_STATUS = r"'^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/[^/]+/status/([0-9]+)/?(?:\?.*)?$'"


@query(
    A.with_sql(A.CAPTURES_SQL)
    + f"""SELECT url, snapshot_ts, regexp_matches(url, {_STATUS}) AS canonical, nullif(regexp_extract(url, {_STATUS}, 1), '') AS post_id, lower(nullif(regexp_extract(url, '^https?://(?:www\\.|mobile\\.)?(?:x|twitter)\\.com/([^/]+)/status/[0-9]+', 1), '')) AS handle,
    regexp_matches(url, '^https://(x|twitter)\\.com/[A-Za-z0-9_]{{1,15}}/status/[0-9]+$') AS eligible, 'https://web.archive.org/web/' || snapshot_ts || 'id_/' || url AS replay_url, 'https://web.archive.org/web/' || snapshot_ts || 'if_/' || url AS framed_url FROM captures"""
)
def url_parts(spark, sf_dir):
    u = F.col("url")
    replay = urls.replay_url(F.col("snapshot_ts"), u)
    return A.captures(spark, sf_dir).select("url", "snapshot_ts", urls.is_status_url(u).alias("canonical"), urls.post_id_of(u).alias("post_id"), urls.handle_of(u).alias("handle"), urls.snapshot_eligible(u).alias("eligible"), replay.alias("replay_url"), urls.framed_url(replay).alias("framed_url"))


#: What stands before a page's address, and whether the whole leads to an archive host and nowhere else.
_ADDRESSES = (
    ("", False), ("https://web.archive.org/web/2024id_/", True), ("https://user@web.archive.org/", False), ("https://web.archive.org:443/", True), ("https://web.archive.org.evil.com/", False),
    ("https://web.archive.org%2eevil.com/", False), ("HTTPS://WEB.ARCHIVE.ORG/", True), ("ftp://web.archive.org/", False), ("https://evil.com/?u=https://web.archive.org/", False), ("https://web.archive.org:x/", False),
    ("https://web.archive.org\\@evil.com/", False), (" https://web.archive.org/", False),
)


@query(
    "SELECT page_id, a.head || url AS url, a.allowed FROM pages JOIN (VALUES " + ", ".join(f"({k}, '{head}', {allowed})" for k, (head, allowed) in enumerate(_ADDRESSES)) + f") AS a(k, head, allowed) ON page_id % {len(_ADDRESSES)} = a.k"
)
def url_allowlist(spark, sf_dir):
    head = F.element_at(F.array(*(F.lit(h) for h, _ in _ADDRESSES)), (F.col("page_id") % len(_ADDRESSES) + 1).cast("int"))
    return A.read(spark, sf_dir, "pages").select("page_id", F.concat(head, "url").alias("url")).withColumn("allowed", urls.is_allowed_url(F.col("url")))


@query(
    """WITH b AS (SELECT DISTINCT lower(text) AS h FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS text FROM benchmark)),
t AS (SELECT h, [h, translate(h, '015', 'ols'), translate(h, 'ols', '015'), replace(h, 'rn', 'm'), replace(h, 'm', 'rn'), left(h, length(h) - 1)] AS v FROM b),
u AS (SELECT h, list_filter(v, lambda x, i: x <> '' AND list_position(v, x) = i) AS v FROM t)
SELECT h AS handle, array_to_string(v[:6], ',') AS variants, len(list_filter(v[:6], lambda x: x <> h AND regexp_matches(x, '^[a-z0-9_]{1,15}$'))) AS n_tries FROM u"""
)
def handle_variants(spark, sf_dir):
    words = A.read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9_]+)"), F.lit(1))).alias("w")).select(handles.handle_input(F.concat(F.lit(" @"), "w")).alias("handle")).distinct()
    return words.select("handle", F.array_join(handles.handle_variants(F.col("handle")), ",").alias("variants"), F.size(handles.repair_variants(F.col("handle"))).cast("long").alias("n_tries"))


# --- captures and claims ------------------------------------------------------------------------------------------


@query(A.with_sql(A.CAPTURES_SQL) + "SELECT post_id, url, snapshot_ts, status FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY (status = 200) DESC, snapshot_ts, url) AS rn FROM captures) WHERE rn = 1")
def dedupe_by_id(spark, sf_dir):
    return discover.earliest_capture(A.captures(spark, sf_dir)).select("post_id", "url", "snapshot_ts", "status")


@query(A.with_sql(A.CAPTURES_SQL) + f"SELECT post_id, url, snapshot_ts, status FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY {A.READABLE_ORDER}) AS rn FROM captures) WHERE rn = 1")
def pick_readable_capture(spark, sf_dir):
    return discover.readable_capture(A.captures(spark, sf_dir)).select("post_id", "url", "snapshot_ts", "status")


_FOUND = (A.CAPTURES_SQL, A.CLAIMS_SQL, A.WINDOWS_SQL, A.MATCHES_SQL)


@query(A.with_sql(*_FOUND) + "SELECT claim_id, post_id, snapshot_ts, url, status FROM matches")
def claim_capture_join(spark, sf_dir):
    return discover.matches(discover.with_window(A.claims(spark, sf_dir)), A.captures(spark, sf_dir)).select("claim_id", "post_id", "snapshot_ts", "url", "status")


def _ranked(spark, sf_dir, most):
    claims = discover.with_window(A.claims(spark, sf_dir))
    return discover.rank(discover.search(claims, A.captures(spark, sf_dir)), claims, most)


@query(A.with_sql(*_FOUND, A.SEARCH_SQL, A.RANKED_SQL.replace(" WHERE position <= 10", "")) + "SELECT claim_id, post_id, time_ok, date_ok, position FROM ranked")
def rank_time_consistency(spark, sf_dir):
    return _ranked(spark, sf_dir, None).select("claim_id", "post_id", "time_ok", "date_ok", F.col("position").cast("long").alias("position"))


@query(A.with_sql(*_FOUND, A.SEARCH_SQL, A.RANKED_SQL) + "SELECT claim_id, post_id, snapshot_ts, time_ok, date_ok, position FROM ranked")
def topk_candidates(spark, sf_dir):
    """The flagship: of each claim the ten captures that are worth a look."""
    return _ranked(spark, sf_dir, discover.COMPARE_MOST).select("claim_id", "post_id", "snapshot_ts", "time_ok", "date_ok", F.col("position").cast("long").alias("position"))


_REPAIR = f"""empty AS (SELECT * FROM windows WHERE claim_id NOT IN (SELECT claim_id FROM searched)),
tries AS (SELECT e.*, [handle, translate(handle, '015', 'ols'), translate(handle, 'ols', '015'), replace(handle, 'rn', 'm'), replace(handle, 'm', 'rn'), left(handle, length(handle) - 1)] AS v FROM empty e),
named AS (SELECT t.* EXCLUDE (v), p.nth, v[p.nth] AS variant FROM tries t, (SELECT unnest(range(1, 7)) AS nth) p WHERE v[p.nth] <> handle AND list_position(v, v[p.nth]) = p.nth AND regexp_matches(v[p.nth], '^[a-z0-9_]{{1,15}}$')),
again AS (SELECT n.claim_id, n.nth, n.variant, c.* FROM named n JOIN captures c ON n.variant = c.handle AND (c.post_id >> 22) + {A.CLOCK} BETWEEN n.from_ms AND n.to_ms AND c.snapshot_ts >= strftime(make_timestamp(n.from_ms * 1000), '%Y%m%d%H%M%S')
  WHERE n.variant IN (SELECT handle FROM captures WHERE contains(url, '://x.com/'))),
first_hit AS (SELECT *, min(nth) OVER (PARTITION BY claim_id) AS best FROM again),
repaired AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, post_id ORDER BY {A.READABLE_ORDER}) AS rn FROM first_hit WHERE nth = best) WHERE rn = 1)"""


@query(A.with_sql(*_FOUND, A.SEARCH_SQL, _REPAIR) + "SELECT claim_id, variant AS repaired_handle, post_id, snapshot_ts FROM repaired")
def handle_repair(spark, sf_dir):
    claims, captures = discover.with_window(A.claims(spark, sf_dir)), A.captures(spark, sf_dir)
    return discover.repair(claims, discover.search(claims, captures), captures).select("claim_id", "repaired_handle", "post_id", "snapshot_ts")


@query(A.with_sql(A.CAPTURES_SQL, A.CLAIMS_SQL) + "SELECT claim_id, handle FROM claims WHERE handle IN (SELECT handle FROM captures WHERE contains(url, '://x.com/'))")
def existence_probe(spark, sf_dir):
    return discover.has_captures(A.claims(spark, sf_dir).select("claim_id", "handle"), A.captures(spark, sf_dir))


_COVERAGE = (
    ", n AS (SELECT claim_id, count(*) AS found, NULL AS variant FROM searched GROUP BY 1 UNION ALL SELECT claim_id, count(*), any_value(variant) FROM repaired GROUP BY 1), k AS ("
    "SELECT claim_id, (SELECT max(q.k) FROM range(1, 20) q(k) WHERE CAST(left(hi, q.k) AS BIGINT) - CAST(left(lo, q.k) AS BIGINT) < 12) AS k, lo, hi FROM (SELECT claim_id, CAST((from_ms - 1288834974657) << 22 AS VARCHAR) AS lo, CAST(((to_ms - 1288834974657 + 1) << 22) - 1 AS VARCHAR) AS hi FROM windows WHERE from_ms IS NOT NULL)) "
    "SELECT w.claim_id, CAST(2 * (CAST(left(hi, k) AS BIGINT) - CAST(left(lo, k) AS BIGINT) + 1) AS INTEGER) AS buckets, coalesce(n.found, 0) AS captures_found, least(coalesce(n.found, 0), 10) AS captures_compared, coalesce(n.found, 0) >= 500 AS truncated, (w.handle IN (SELECT handle FROM captures WHERE contains(url, '://x.com/')) OR n.variant IS NOT NULL) AS handle_has_any_captures, n.variant AS repaired_handle FROM windows w LEFT JOIN n USING (claim_id) LEFT JOIN k USING (claim_id)"
)


@query(A.with_sql(*_FOUND, A.SEARCH_SQL, _REPAIR).rstrip() + _COVERAGE)
def coverage_counts(spark, sf_dir):
    claims, captures = discover.with_window(A.claims(spark, sf_dir)), A.captures(spark, sf_dir)
    found = discover.discover(claims, captures)
    return discover.coverage(claims, found, discover.rank(found, claims), captures)


@query(A.with_sql(A.CAPTURES_SQL) + "SELECT handle, CAST(post_id AS BIGINT) AS post_id, snapshot_ts, status, 'https://web.archive.org/web/' || snapshot_ts || 'id_/' || url AS replay_url FROM captures")
def index_candidates(spark, sf_dir):
    return discover.candidate_columns(A.index_rows(spark, sf_dir)).select("handle", "post_id", "snapshot_ts", "status", "replay_url")


@query(A.with_sql(A.CAPTURES_SQL) + "SELECT handle, count(*) AS n, count(DISTINCT url) AS n_urls, min(snapshot_ts) AS first_ts FROM captures GROUP BY 1")
def index_answers(spark, sf_dir):
    """Captures as the index answers them, one JSON array an account, and parsed again."""
    one = F.array(F.col("snapshot_ts"), F.col("status").cast("string"), F.col("url"))
    body = F.to_json(F.concat(F.array(F.array(F.lit("timestamp"), F.lit("statuscode"), F.lit("original"))), F.collect_list(one)))
    rows = index.parse_answers(A.captures(spark, sf_dir).groupBy("handle").agg(body.alias("body")))
    return rows.groupBy("handle").agg(F.count("*").alias("n"), F.countDistinct("original").alias("n_urls"), F.min("timestamp").alias("first_ts"))


@query()
def index_queries(spark, sf_dir):
    return index.bucket_queries(discover.with_window(A.claims(spark, sf_dir)))


# --- text ---------------------------------------------------------------------------------------------------------

_LINKS_SQL = r"regexp_replace(regexp_replace(lower({t}), 'https?://\S+|[a-z0-9-]+\.t\.co/\S*|pic\.(?:twitter|x)\.com/\S*', ' ', 'g'), '\bt\.co/\S+', ' ', 'g')"
_FOLD_SQL = "replace(replace(replace({t}, chr(8203), ''), chr(65279), ''), chr(173), '')"
_WORDS_SQL = r"trim(regexp_replace({t}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _plain_sql(t: str) -> str:
    return _WORDS_SQL.format(t=_FOLD_SQL.format(t=_LINKS_SQL.format(t=t)))


def _folded_sql(t: str) -> str:
    return _WORDS_SQL.format(t=f"translate(replace(replace({_FOLD_SQL.format(t=_LINKS_SQL.format(t=t))}, 'rn', 'm'), 'vv', 'w'), '01|58', 'ollsb')")


@query(f"SELECT doc_id, md5({_plain_sql('text')}) AS normalized_md5 FROM documents")
def normalize_text(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", F.md5(textnorm.normalize_text(F.col("text")).cast("binary")).alias("normalized_md5"))


@query(f"SELECT doc_id, md5({_folded_sql('text')}) AS folded_md5 FROM documents")
def normalize_folded(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", F.md5(textnorm.normalize_folded(F.col("text")).cast("binary")).alias("folded_md5"))


def _pairs(spark, sf_dir):
    """Each part's label with that of the next part."""
    p = A.read(spark, sf_dir, "part")
    label = F.concat_ws(" ", "p_name", "p_brand", F.lower("p_type"), F.col("p_size").cast("string"))
    a = p.select("p_partkey", label.alias("a"))
    return a.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), label.alias("b")), "p_partkey")


_LABEL = "concat_ws(' ', p_name, p_brand, lower(p_type), CAST(p_size AS VARCHAR))"
_PAIRS_SQL = f"""pairs AS (SELECT x.p_partkey, {_LABEL.replace('p_', 'x.p_')} AS a, {_LABEL.replace('p_', 'y.p_')} AS b FROM part x JOIN part y ON x.p_partkey = y.p_partkey - 1),
forms AS (SELECT p_partkey, {_plain_sql('a')} AS pa, {_plain_sql('b')} AS pb, {_folded_sql('a')} AS fa, {_folded_sql('b')} AS fb FROM pairs)"""


def _full_sql(x: str, y: str) -> str:
    return f"CASE WHEN {x} = {y} THEN 1.0 WHEN {x} = '' OR {y} = '' THEN 0.0 ELSE 1.0 - levenshtein({x}, {y}) / CAST(greatest(length({x}), length({y})) AS DOUBLE) END"


def _partial_sql(x: str, y: str) -> str:
    short, long = f"(CASE WHEN length({x}) > length({y}) THEN {y} ELSE {x} END)", f"(CASE WHEN length({x}) > length({y}) THEN {x} ELSE {y} END)"
    windows = f"range(1, length({long}) - length({short}) + 2, greatest(1, CAST(floor((length({long}) - length({short}) + 1) / 400.0) AS BIGINT)))"
    return f"CASE WHEN {x} = {y} THEN 1.0 WHEN {x} = '' OR {y} = '' THEN 0.0 WHEN contains({long}, {short}) THEN 1.0 ELSE greatest(0.0, 1.0 - list_min(list_transform({windows}, lambda i: levenshtein({short}, substring({long}, i, length({short}))))) / CAST(length({short}) AS DOUBLE)) END"


def _token_sql(x: str, y: str) -> str:
    tx, ty = f"list_filter(string_split({x}, ' '), lambda t: t <> '')", f"list_filter(string_split({y}, ' '), lambda t: t <> '')"
    shared = f"list_sum(list_transform(list_distinct({tx}), lambda w: least(len(list_filter({tx}, lambda q: q = w)), len(list_filter({ty}, lambda q: q = w)))))"
    return f"CASE WHEN {x} = {y} THEN 1.0 WHEN len({tx}) = 0 OR len({ty}) = 0 THEN 0.0 ELSE 2.0 * {shared} / CAST(len({tx}) + len({ty}) AS DOUBLE) END"


def _forms(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", similarity.similarity_parts(F.col("a"), F.col("b")).alias("p"))


def _round(c, name):
    return F.round(c, 9).alias(name)


@query(A.with_sql(_PAIRS_SQL) + f"SELECT p_partkey, round({_full_sql('pa', 'pb')}, 9) AS similarity FROM forms")
def levenshtein_full(spark, sf_dir):
    return _forms(spark, sf_dir).select("p_partkey", _round(similarity.full_similarity(F.col("p.pa"), F.col("p.pb")), "similarity"))


@query(A.with_sql(_PAIRS_SQL) + f"SELECT p_partkey, round({_partial_sql('pa', 'pb')}, 9) AS similarity FROM forms")
def partial_similarity(spark, sf_dir):
    return _forms(spark, sf_dir).select("p_partkey", _round(similarity.partial_similarity(F.col("p.pa"), F.col("p.pb")), "similarity"))


@query(A.with_sql(_PAIRS_SQL) + f"SELECT p_partkey, round({_token_sql('pa', 'pb')}, 9) AS similarity FROM forms")
def token_dice(spark, sf_dir):
    return _forms(spark, sf_dir).select("p_partkey", _round(similarity.token_similarity(F.col("p.pa"), F.col("p.pb")), "similarity"))


_NUMBERS = "list_sort(regexp_extract_all({x}, '([0-9]+)', 1))"
_DIFFER = f"(len({_NUMBERS.format(x='pa')}) > 0 AND len({_NUMBERS.format(x='pb')}) > 0 AND {_NUMBERS.format(x='pa')} <> {_NUMBERS.format(x='pb')})"


@query(A.with_sql(_PAIRS_SQL) + f"SELECT p_partkey, array_to_string({_NUMBERS.format(x='pa')}, '|') AS numbers, {_DIFFER} AS mismatch FROM forms")
def number_mismatch(spark, sf_dir):
    return _forms(spark, sf_dir).select("p_partkey", F.array_join(similarity.number_tokens(F.col("p.pa")), "|").alias("numbers"), similarity.numbers_differ(F.col("p.pa"), F.col("p.pb")).alias("mismatch"))


_SIGNALS = ", ".join(f"{w} * ({f(x, y)})" for x, y in (("pa", "pb"), ("fa", "fb")) for w, f in ((1.0, _full_sql), (0.92, _partial_sql), (0.85, _token_sql)))
_SIM_SQL = f"""raws AS (SELECT *, greatest({_SIGNALS}) AS raw, {_DIFFER} AS differ FROM forms),
capped AS (SELECT *, CASE WHEN differ AND raw > 0.89 THEN 0.89 ELSE raw END AS one, differ AND raw > 0.89 AS by_number FROM raws),
sims AS (SELECT *, CASE WHEN least(length(pa), length(pb)) < 25 AND one > 0.8 THEN 0.8 ELSE one END AS score, nullif(concat_ws('+', CASE WHEN by_number THEN 'number' END, CASE WHEN least(length(pa), length(pb)) < 25 AND one > 0.8 THEN 'length' END), '') AS capped_by FROM capped)"""


def _sims(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", similarity.text_similarity(F.col("a"), F.col("b")).alias("t"))


@query(A.with_sql(_PAIRS_SQL, _SIM_SQL) + "SELECT p_partkey, round(raw, 9) AS raw, round(score, 9) AS score, capped_by, differ AS number_mismatch FROM sims")
def text_similarity(spark, sf_dir):
    return _sims(spark, sf_dir).select("p_partkey", _round(F.col("t.raw"), "raw"), _round(F.col("t.score"), "score"), "t.capped_by", "t.number_mismatch")


_GATE = """SELECT p_partkey, round(CASE WHEN late THEN 0.74 ELSE first END, 9) AS score, round(score, 9) AS text_sim, nullif(concat_ws('+', capped_by, CASE WHEN outside THEN 'context' END, CASE WHEN late THEN 'time' END), '') AS capped_by FROM (
SELECT *, coalesce(p_partkey % 4 = 0 AND first > 0.74, false) AS late FROM (SELECT *, CASE WHEN outside THEN 0.6 ELSE score END AS first FROM (SELECT *, (p_partkey % 5 = 0 OR p_partkey % 7 = 0) AND score > 0.6 AS outside FROM sims)))"""


@query(A.with_sql(_PAIRS_SQL, _SIM_SQL) + _GATE)
def score_pair(spark, sf_dir):
    k = F.col("p_partkey")
    gated = similarity.gated_score(F.col("t"), k % 5 != 0, F.when(k % 7 != 0, True), F.when(k % 4 == 0, False), F.lit(True))
    return _sims(spark, sf_dir).withColumn("s", gated).select("p_partkey", _round(F.col("s.score"), "score"), _round(F.col("s.text_sim"), "text_sim"), "s.capped_by")


@query()
def word_diff(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.to_json(textdiff.display_diff(F.col("a"), F.col("b"))).alias("diff"))


# --- screenshots --------------------------------------------------------------------------------------------------


def _ocr_lines(spark, sf_dir):
    """Each turn of a conversation as a screenshot: a name, a handle, the lines of its text, a timestamp line and counts."""
    rows = A.read(spark, sf_dir, "conversations")
    n = F.coalesce(F.col("conv_id"), F.lit(0)) * 100 + F.coalesce(F.col("turn"), F.lit(0))
    head = F.array(F.concat(F.lit("Person "), F.col("role")), F.concat(F.lit("@"), F.col("role"), F.lit("_"), F.col("conv_id").cast("string")))
    tail = F.array(F.concat(F.lit("10:"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(" PM · Dec "), (n % 31 + 1).cast("string"), F.lit(", 2023")), F.concat((n % 900).cast("string"), F.lit(" Reposts 12 Likes 3 Views")))
    all_lines = F.concat(head, F.split(F.coalesce("text", F.lit("")), "\n"), tail)
    box = F.struct(F.lit(0.1).alias("x"), (F.col("line_no") * 0.01).alias("y"), F.lit(0.8).alias("w"), F.lit(0.01).alias("h"))
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("shot_id"), F.posexplode(all_lines).alias("line_no", "text")).select("shot_id", "line_no", "text", F.lit(0.9).alias("confidence"), box.alias("bbox"))


_LINES_SQL = """turns AS (SELECT concat_ws('-', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS shot_id, role, conv_id, string_split(coalesce(text, ''), chr(10)) AS body, coalesce(conv_id, 0) * 100 + coalesce(turn, 0) AS n FROM conversations),
stamped AS (SELECT shot_id, role, conv_id, n, ['Person ' || role, '@' || role || '_' || conv_id] || body || ['10:' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || ' PM · Dec ' || (n % 31 + 1) || ', 2023', (n % 900) || ' Reposts 12 Likes 3 Views'] AS all_lines FROM turns),
ocr_lines AS (SELECT shot_id, unnest(range(0, len(all_lines))) AS line_no, unnest(all_lines) AS text FROM stamped)"""
_METRIC_SQL = "(?:reposts?|quotes?|likes?|retweets?|bookmarks?|replies|views?|posts?|tweets?)"
_CHROME_SQL = (
    "(trim(text) <> '' AND ("
    + " OR ".join(f"regexp_matches(trim(text), '(?i){p}')" for p in (r"^\s*replying to\s+@", r"^\s*show more(?:\s*\.\.\.)?\s*$", r"^\s*translate\s+(?:post|tweet)\s*$", r"^\s*show this thread(?:\s*\.\.\.)?\s*$", r"^\s*(?:promoted|sponsored)\b", r"^\s*ad\s*$", r"^\s*from\s+\S", r"^\s*(?:\d[\d\s,.\-–—·•*]*[kmb]?)?\s*views?\s*$"))
    + rf" OR (regexp_matches(text, '[0-9]') AND (regexp_matches(trim(text), '(?i)^[\d\s,._\-–—·•*|kmb]+(?:{_METRIC_SQL}[\d\s,._\-–—·•*|kmb]*)+$') OR len(regexp_extract_all(trim(text), '(?i)\b{_METRIC_SQL}\b')) >= 2))))"
)


@query(A.with_sql(_LINES_SQL) + f"SELECT shot_id, line_no, coalesce({_CHROME_SQL}, false) AS chrome FROM ocr_lines")
def noise_lines(spark, sf_dir):
    return _ocr_lines(spark, sf_dir).select("shot_id", F.col("line_no").cast("long").alias("line_no"), lines.is_chrome_line(F.col("text")).alias("chrome"))


@query(A.with_sql(_LINES_SQL) + "SELECT shot_id, bool_or(regexp_matches(lower(text), 'views|reposts|quotes|retweets|likes|bookmarks|post|tweet|replying to|show this thread')) AS has_signal FROM ocr_lines GROUP BY 1")
def platform_detect(spark, sf_dir):
    return _ocr_lines(spark, sf_dir).groupBy("shot_id").agg(F.collect_list("text").alias("all")).select("shot_id", lines.has_platform_signal(F.col("all")).alias("has_signal"))


@query(
    A.with_sql(_LINES_SQL)
    + """SELECT shot_id, coalesce(string_agg(t, ' ' ORDER BY line_no), '') AS body FROM (SELECT shot_id, line_no, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM ocr_lines) WHERE t <> '' GROUP BY 1"""
)
def merge_body(spark, sf_dir):
    """Lines glued into one text (the test texts break no word, so the plain join is the same)."""
    rows = _ocr_lines(spark, sf_dir).groupBy("shot_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("all"))
    return rows.select("shot_id", lines.join_body(F.transform("all", lambda x: x["text"])).alias("body"))


@query()
def handle_select(spark, sf_dir):
    return screens.read_screens(_ocr_lines(spark, sf_dir), "2024-06-15").select("shot_id", "platform", "handle.value", F.round("handle.confidence", 6).alias("confidence"))


@query(
    A.with_sql(_LINES_SQL)
    + """SELECT s.shot_id, CASE WHEN role IS NOT NULL THEN 'x' ELSE 'unknown' END AS platform, 'Person ' || role AS display_name, role || '_' || conv_id AS handle, strftime(make_date(2023, 12, CAST(n % 31 + 1 AS INTEGER)), '%Y-%m-%d') AS iso_date, CAST(22 * 60 + n % 60 AS INTEGER) AS minute FROM stamped s"""
)
def parse_screenshot(spark, sf_dir):
    d = F.try_element_at("dates.value", F.lit(1))
    return screens.read_screens(_ocr_lines(spark, sf_dir), "2024-06-15").select("shot_id", "platform", F.col("display_name.value").alias("display_name"), F.col("handle.value").alias("handle"), d["iso_date"].alias("iso_date"), d["minute"].alias("minute"))


@query(
    """SELECT o_orderkey, form, CAST(o_orderdate AS VARCHAR)[:10] AS iso_date, 13 * 60 + 5 AS minute FROM orders, (SELECT unnest(['mdy', 'dmy', 'ymd']) AS form)"""
)
def date_parse(spark, sf_dir):
    """Order dates written in three ways, parsed back."""
    day = F.col("o_orderdate").cast("date")
    forms = {"mdy": F.concat(F.lit("1:05 PM · "), F.date_format(day, "MMM d, yyyy")), "dmy": F.concat(F.lit("13:05 - "), F.date_format(day, "d MMMM yyyy")), "ymd": F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 13:05"))}
    rows = A.read(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("line")) for k, v in forms.items()))).alias("f"))
    d = F.try_element_at("d", F.lit(1))
    return rows.select("o_orderkey", "f.form", dates.parse_dates(F.col("f.line"), "2024-06-15").alias("d")).select("o_orderkey", "form", d["iso_date"].alias("iso_date"), d["minute"].alias("minute"))


# --- pages --------------------------------------------------------------------------------------------------------


@query("SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title FROM pages")
def title_extract(spark, sf_dir):
    return A.read(spark, sf_dir, "pages").select("page_id", htmlpost.page_title(F.col("html")).alias("title"))


@query()
def extract_post(spark, sf_dir):
    return A.read(spark, sf_dir, "pages").select("page_id", htmlpost.extract_post(F.col("html")).alias("post")).select("page_id", "post.*")


_JUNK = r"trim(regexp_replace(regexp_replace(lower(text), '[\x{201C}\x{201D}\x22\x27]', '', 'g'), '\s+', ' ', 'g'))"


@query(
    f"""SELECT doc_id, {_JUNK} IN ('x', 'x.com', 'twitter', 'twitter.com', 'home', 'login', 'join x', 'sign in', 'x / home', 'log in', 'log in on x', 'login on x', 'sign up') OR length({_JUNK}) < 10 OR regexp_matches({_JUNK},
    'something went wrong|rate limit exceeded|too many requests|javascript is not available|enable javascript|log in to|sign up to|this post was deleted|post not found|page not found|content is not available') AS junk FROM documents"""
)
def junk_gate(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", lines.is_junk_text(F.col("text")).alias("junk"))


# --- verdicts -----------------------------------------------------------------------------------------------------

_CODES = """CASE WHEN p_partkey % 19 = 0 THEN 'UNSUPPORTED_PLATFORM' WHEN p_partkey % 5 = 0 OR p_partkey % 17 = 0 THEN 'INSUFFICIENT_INPUT' WHEN p_partkey % 23 = 0 THEN 'ARCHIVE_UNAVAILABLE'
WHEN p_partkey % 3 <> 0 AND p_size / 50.0 >= 0.9 THEN 'MATCH_STRONG' WHEN p_partkey % 3 <> 0 AND p_size / 50.0 >= 0.75 THEN 'MATCH_LIKELY' WHEN p_partkey % 3 <> 0 AND p_size / 50.0 >= 0.55 THEN 'MATCH_PARTIAL'
WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 7 = 0 THEN 'POST_EXISTS_TEXT_UNREADABLE' ELSE 'NO_MATCH' END"""


def _codes(spark, sf_dir):
    k = F.col("p_partkey")
    score = F.when(k % 3 != 0, F.col("p_size") / 50.0)
    code = evidence.verdict_code(F.when(k % 19 == 0, "unknown").otherwise("x"), F.when(k % 5 != 0, True), k % 17 != 0, k % 23 == 0, score, k % 2 == 0, k % 7 != 0)
    return A.read(spark, sf_dir, "part").select("p_partkey", code.alias("code"), score.alias("score"))


@query(f"SELECT p_partkey, {_CODES} AS code FROM part")
def verdict_case(spark, sf_dir):
    return _codes(spark, sf_dir).select("p_partkey", "code")


@query()
def verdict_text(spark, sf_dir):
    return evidence.with_copy(_codes(spark, sf_dir)).select("p_partkey", "code", "title", "body")


def _flow(spark, sf_dir, live: bool):
    args = (A.claims(spark, sf_dir), A.captures(spark, sf_dir), A.pages(spark, sf_dir))
    return check(*args, live=A.live_posts(spark, sf_dir) if live else None)


_READY = A.WINDOWS_SQL.replace("windows AS", "all_windows AS") + ",\nwindows AS (SELECT * FROM all_windows WHERE platform = 'x' AND from_ms IS NOT NULL)"
_FOUND_ROWS = """found AS (SELECT claim_id, iso, minute, post_id, id_ms, snapshot_ts, url, event_id, seq, CAST(NULL AS VARCHAR) AS variant FROM searched
  UNION ALL SELECT r.claim_id, w.iso, w.minute, r.post_id, (r.post_id >> 22) + 1288834974657, r.snapshot_ts, r.url, r.event_id, row_number() OVER (PARTITION BY r.claim_id ORDER BY r.post_id), r.variant FROM repaired r JOIN windows w USING (claim_id))"""
_SAID = "'Account ' || e.account || ' reported a ' || e.event_type || ' as number ' || e.event_id || ' of the evening service'"
_GATED = "CASE WHEN coalesce(time_ok = false, false) AND {f} > 0.74 THEN 0.74 ELSE {f} END"
_SCORED_SQL = f"""shown AS (SELECT r.*, c.text AS a, {_SAID} AS b, r.event_id % 5 <> 0 AS readable, e.account AS author, r.event_id % 4 <> 3 AS alive, lower(c.handle) AS claimed_handle FROM ranked r JOIN claims c USING (claim_id) JOIN base e ON e.event_id = r.event_id),
forms AS (SELECT *, {_plain_sql('a')} AS pa, {_plain_sql('b')} AS pb, {_folded_sql('a')} AS fa, {_folded_sql('b')} AS fb FROM shown)"""
_OUTSIDE = "CASE WHEN NOT (variant IS NULL AND coalesce(date_ok, false)) AND score > 0.6 THEN 0.6 ELSE score END"
_ALONE = "CASE WHEN NOT coalesce(date_ok, false) AND score > 0.6 THEN 0.6 ELSE score END"
_VERDICT_SQL = f"""gated AS (SELECT *, CASE WHEN readable THEN {_GATED.format(f=f"({_OUTSIDE})")} ELSE 0.0 END AS final, CASE WHEN readable THEN score ELSE 0.0 END AS text_sim, {_GATED.format(f=f"({_ALONE})")} AS live_final FROM sims),
placed AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY final DESC, position) AS rn, count(*) OVER (PARTITION BY claim_id) AS n FROM gated),
verdicts AS (SELECT w.claim_id, CASE WHEN w.platform <> 'x' THEN 'UNSUPPORTED_PLATFORM' WHEN w.from_ms IS NULL THEN 'INSUFFICIENT_INPUT' WHEN p.claim_id IS NULL THEN 'NO_MATCH' WHEN p.final >= 0.9 THEN 'MATCH_STRONG' WHEN p.final >= 0.75 THEN 'MATCH_LIKELY' WHEN p.final >= 0.55 THEN 'MATCH_PARTIAL'
    WHEN coalesce(p.time_ok, false) AND NOT p.readable THEN 'POST_EXISTS_TEXT_UNREADABLE' ELSE 'NO_MATCH' END AS code, p.final, p.text_sim, CASE WHEN w.platform = 'x' AND w.from_ms IS NOT NULL THEN p.claim_id IS NOT NULL AND p.variant IS NULL END AS handle_ok, p.date_ok, p.time_ok, p.variant AS repaired_handle, p.post_id, p.snapshot_ts,
    CASE WHEN p.n IS NOT NULL THEN least(p.n - 1, 3) END AS n_alternates, p.alive, p.author = p.claimed_handle AS same_author, p.score AS sim, p.live_final FROM all_windows w LEFT JOIN (SELECT * FROM placed WHERE rn = 1) p USING (claim_id))"""
_FLOW_SQL = A.with_sql(A.CAPTURES_SQL, A.CLAIMS_SQL, _READY, A.MATCHES_SQL, A.SEARCH_SQL, _REPAIR, _FOUND_ROWS, A.RANKED_SQL.replace("FROM searched", "FROM found"), _SCORED_SQL, _SIM_SQL, _VERDICT_SQL)


@query(_FLOW_SQL + "SELECT claim_id, code, round(final, 9) AS score, round(text_sim, 9) AS text_sim, handle_ok, date_ok, time_ok, repaired_handle, post_id, snapshot_ts, n_alternates FROM verdicts")
def check_verdicts(spark, sf_dir):
    """The whole check, from claims to verdicts."""
    return _flow(spark, sf_dir, False).select("claim_id", "code", _round(F.col("score"), "score"), _round(F.col("text_sim"), "text_sim"), "handle_ok", "date_ok", "time_ok", "repaired_handle", "capture.post_id", "capture.snapshot_ts", F.when(F.col("alternates").isNotNull(), F.size("alternates")).cast("long").alias("n_alternates"))


_LIVE_SQL = """SELECT claim_id, CASE WHEN how = 'x-live' THEN CASE WHEN live_final >= 0.9 THEN 'MATCH_STRONG' WHEN live_final >= 0.75 THEN 'MATCH_LIKELY' WHEN live_final >= 0.55 THEN 'MATCH_PARTIAL' ELSE 'NO_MATCH' END ELSE code END AS code, round(CASE WHEN how = 'x-live' THEN live_final ELSE final END, 9) AS score, post_id,
  CASE WHEN post_id IS NOT NULL THEN CASE WHEN alive THEN 'live' ELSE 'unavailable' END END AS status, CASE WHEN alive THEN same_author END AS author_match, CASE WHEN post_id IS NOT NULL THEN how IS NOT NULL END AS verified, how AS verified_by, round(CASE WHEN alive THEN sim END, 9) AS live_text_sim
FROM (SELECT *, CASE WHEN alive AND same_author AND sim >= 0.75 THEN CASE WHEN code IN ('MATCH_STRONG', 'MATCH_LIKELY') THEN 'archive+x' WHEN handle_ok THEN 'x-live' END END AS how FROM verdicts)"""


@query(_FLOW_SQL + _LIVE_SQL)
def crosscheck(spark, sf_dir):
    """The whole check, held against the live posts."""
    return _flow(spark, sf_dir, True).select("claim_id", "code", _round(F.col("score"), "score"), "capture.post_id", "cross_check.status", "cross_check.author_match", "cross_check.verified", "cross_check.verified_by", _round(F.col("cross_check.live_text_sim"), "live_text_sim"))


@query(
    """SELECT event_id, CAST(generate_subscripts AS INTEGER) AS nth, CASE generate_subscripts WHEN 1 THEN 'https://x.com/search?q=' || url_encode('from:' || account || ' since:' || iso || ' until:' || strftime(CAST(iso AS DATE) + 1, '%Y-%m-%d')) || '&src=typed_query'
  WHEN 2 THEN 'https://web.archive.org/web/*/x.com/' || account || '/status/*' WHEN 3 THEN 'https://www.google.com/search?q=' || url_encode('site:x.com ' || event_type || ' of the evening') WHEN 4 THEN 'https://archive.ph/newest/' || url_encode('x.com/' || account) WHEN 5 THEN 'https://ghostarchive.org/search?term=' || url_encode('x.com/' || account || '/status') END AS url
FROM (SELECT event_id, event_type, 'user_' || translate(CAST(user_id AS VARCHAR), '0123456789', 'abcdefghij') AS account, strftime(ts, '%Y-%m-%d') AS iso FROM events), (SELECT unnest(range(1, 8)) AS generate_subscripts)"""
)
def next_steps_links(spark, sf_dir):
    steps = evidence.next_steps(F.concat(F.lit("@"), "account"), F.concat("event_type", F.lit(" of the evening")), F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd"))
    return A._base(spark, sf_dir).select("event_id", F.posexplode(steps).alias("nth", "step")).select("event_id", (F.col("nth") + 1).alias("nth"), "step.url")


# --- store, caches, limits ----------------------------------------------------------------------------------------


def _requests(spark, sf_dir):
    base = A._base(spark, sf_dir)
    iso = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd")
    return base.select(
        F.lit("x").alias("platform"), F.when(F.col("event_id") % 29 == 0, "not a handle").otherwise(F.col("account")).alias("handle"), iso.alias("claimed_date_iso"), F.lit(None).cast("int").alias("claimed_minute"),
        A.post_text(F.col("account"), F.col("event_type"), F.col("event_id")).alias("claimed_text"), (F.col("event_id") % 2 == 0).alias("fields_edited"), times.capture_timestamp(F.col("ms") + F.col("event_id") % 90 * times.DAY_MS).alias("snapshot_ts"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "https://x.com/").otherwise("https://twitter.com/"), "account", F.lit("/status/"), F.col("post_id").cast("string")).alias("original_url"),
    )


def _attestations(spark, sf_dir):
    asked = _requests(spark, sf_dir).select("snapshot_ts", F.col("original_url").alias("url"))
    texts = evidence.page_texts(A.pages(spark, sf_dir), asked)
    return store.issue(_requests(spark, sf_dir), texts, now_ms=1_700_000_000_000)


_ATTESTATIONS_SQL = """SELECT account AS handle, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS claimed_date_iso, CASE WHEN event_id % 5 = 0 THEN 'NO_MATCH' ELSE 'MATCH_STRONG' END AS verdict_code, CAST(CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS score,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE 'Account ' || account || ' reported a ' || event_type || ' as number ' || event_id || ' of the evening service' END AS archive_snippet, CAST(event_id % 2 = 0 AS INTEGER) AS fields_edited FROM base WHERE event_id % 29 <> 0"""


@query(A.with_sql(A.BASE_SQL) + _ATTESTATIONS_SQL)
def attestation_issue(spark, sf_dir):
    return _attestations(spark, sf_dir).select("handle", "claimed_date_iso", "verdict_code", "score", "archive_snippet", "fields_edited")


@query()
def attestation_lookup(spark, sf_dir):
    """The attestation of one id, out of all."""
    rows = store.with_defaults(_attestations(spark, sf_dir))
    return store.lookup(rows, rows.agg(F.min("id").alias("id")).first().id)


@query(A.with_sql(A.BASE_SQL) + "SELECT event_id, event_id % 29 <> 0 AS valid FROM base")
def request_validation(spark, sf_dir):
    rows = _requests(spark, sf_dir).select("*", store.request_valid().alias("valid"))
    number = F.regexp_extract("claimed_text", "number ([0-9]+) of", 1).cast("long")
    return rows.select(number.alias("event_id"), "valid")


_ENTRIES = "SELECT 'u' || user_id AS key, event_type || event_id AS value, epoch_us(ts) // 1000000 AS written_at, CASE WHEN event_type = 'error' THEN 600 ELSE 3600 END AS ttl_sec FROM events WHERE event_type IN ('error', 'view')"
_CACHE_SQL = f"""WITH e AS ({_ENTRIES}), r AS (SELECT event_id AS request_id, 'u' || user_id AS key, epoch_us(ts) // 1000000 AS asked_at FROM events WHERE event_type = 'click'),
m AS (SELECT r.request_id, r.key, r.asked_at, arg_max(struct_pack(v := e.value, w := e.written_at, t := e.ttl_sec), struct_pack(w := e.written_at, v := e.value)) AS x FROM r LEFT JOIN e ON r.key = e.key AND e.written_at <= r.asked_at GROUP BY ALL)
SELECT request_id, key, asked_at, CASE WHEN asked_at <= x.w + x.t THEN x.v END AS value, coalesce(asked_at <= x.w + x.t, false) AS hit FROM m"""


@query(_CACHE_SQL)
def cache_asof(spark, sf_dir):
    ev = A.read(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("at"))
    entries = ev.where("event_type IN ('error', 'view')").select("key", F.concat("event_type", F.col("event_id").cast("string")).alias("value"), F.col("at").alias("written_at"), store.live_ttl(F.when(F.col("event_type") == "view", "live")).alias("ttl_sec"))
    return store.cache_lookup(ev.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), "key", "at"), entries).withColumnRenamed("at", "asked_at")


@query(A.with_sql(A.BASE_SQL) + "SELECT event_id, 'cdx:v1:' || lower(account) || ':' || ms || ':' || (ms + 1000) AS cache_key, CASE WHEN event_type = 'error' THEN 21600 ELSE 2592000 END AS ttl_sec FROM base")
def cache_keys(spark, sf_dir):
    key = store.search_cache_key(store.query_key(F.upper("account"), F.col("ms"), F.col("ms") + 1000))
    return A._base(spark, sf_dir).select("event_id", key.alias("cache_key"), store.search_ttl(F.col("event_type") == "error").alias("ttl_sec"))


@query("SELECT event_id, n AS same_key FROM events JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) USING (user_id, event_type)")
def coalesced_requests(spark, sf_dir):
    """Requests of one key share what is computed for it."""
    ev = A.read(spark, sf_dir, "events").select("event_id", F.concat_ws(":", "user_id", "event_type").alias("key"))
    counts = ev.groupBy("key").agg(F.count("*").alias("same_key"))
    return store.coalesced(ev, "key", lambda keys: keys.join(counts, "key")).select("event_id", "same_key")


@query("SELECT event_id, n AS in_window, n <= 3 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type, user_id ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW) AS n FROM events)")
def rate_limit_window(spark, sf_dir):
    ev = A.read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return limits.rate_limited(ev, 86_400, 3).select("event_id", "in_window", "allowed")


@query("SELECT event_id, sha256(strftime(ts, '%Y-%m-%d') || ':' || '10.0.0.' || user_id) AS ip_hash FROM events")
def ip_hash(spark, sf_dir):
    address = privacy.client_address(F.lit(None).cast("string"), F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(", 10.9.9.9")))
    return A.read(spark, sf_dir, "events").select("event_id", privacy.hashed_address(address, F.date_format("ts", "yyyy-MM-dd")).alias("ip_hash"))


@query("""SELECT event_id, '{"event":"' || event_type || '","user":"' || user_id || '"}' AS line FROM events""")
def redact_log_keys(spark, sf_dir):
    fields = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("clientIp"), F.lit("10.0.0.1"), F.lit("description"), F.lit("has ip within"), F.lit("ocrText"), F.lit("secret"))
    return A.read(spark, sf_dir, "events").select("event_id", privacy.log_line(F.col("event_type"), fields).alias("line"))


@query()
def live_tokens(spark, sf_dir):
    return A._base(spark, sf_dir).select("event_id", livetoken.live_token(F.col("post_id").cast("string")).alias("token"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 6 = 0 THEN 'unavailable' ELSE 'live' END AS status, CASE WHEN event_type = 'error' OR event_id % 6 = 0 THEN NULL ELSE 'u' || user_id END AS screen_name FROM events"""
)
def live_answers(spark, sf_dir):
    """Answers of the live endpoint, parsed: a tombstone and a blank text are no evidence."""
    body = F.to_json(F.struct(F.when(F.col("event_type") == "error", "TweetTombstone").otherwise("Tweet").alias("__typename"), F.when(F.col("event_id") % 6 == 0, " ").otherwise("some text").alias("text"), F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("screen_name")).alias("user")))
    rows = A.read(spark, sf_dir, "events").select("event_id", records.parse_live(F.col("event_id").cast("string"), body).alias("live"))
    return rows.select("event_id", "live.status", "live.screen_name")


ENTRY = topk_candidates
