"""Answers of an archive's capture index: parsing, queries, and a Python data source that asks it.

An answer is a JSON array of arrays whose first row names the columns, in any order.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote, urljoin, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import ids, times, urls

#: The index's address and limits.
INDEX_URL = "https://web.archive.org/cdx/search/cdx"
ROW_LIMIT, TIMEOUT_S, RETRIES, LONGEST_WAIT_MS, MOST_HOPS = 500, 6.0, 2, 10_000, 6
FIELDS = ("timestamp", "original", "statuscode", "mimetype", "digest")
HOSTS = ("x.com", "twitter.com")


def parse_answers(answers: DataFrame, body: str = "body") -> DataFrame:
    """Rows of all answers, with the other columns of ``answers``: timestamp, original, statuscode, mimetype, digest, row_no.

    No rows without the first two columns, or from what is no such array. A status that is no number is 0.
    """
    rows = answers.withColumn("__rows", F.from_json(F.col(body), "array<array<string>>"))
    rows = rows.withColumn("__head", F.try_element_at("__rows", F.lit(1))).select(*(c for c in answers.columns if c != body), "__head", F.posexplode("__rows").alias("row_no", "__row")).where("row_no > 0")
    at = lambda name: F.array_position("__head", name).cast("int")
    value = lambda name: F.when(at(name) > 0, F.try_element_at("__row", F.nullif(at(name), F.lit(0))))
    out = rows.withColumns({name: F.coalesce(value(name), F.lit("")) for name in FIELDS})
    status = F.coalesce(F.col("statuscode").try_cast("double"), F.lit(0.0))
    return out.where("timestamp <> '' AND original <> ''").withColumn("statuscode", F.when(F.isnan(status) | (F.abs(status) > 1e9), 0).otherwise(status).cast("int")).drop("__head", "__row")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the answers landed under ``path``, one a file."""
    return parse_answers(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body"))


def index_query(handle: Column, prefix: Column, from_ts: Column, host: str = HOSTS[0]) -> Column:
    """Address of the captures whose URL begins with an account's prefix of ids: filter, projection and limit are the index's."""
    url = F.concat(F.lit(f"{host}/"), handle, F.lit("/status/"), prefix)
    return F.concat(F.lit(f"{INDEX_URL}?url="), urls.uri_component(url), F.lit("&from="), urls.uri_component(from_ts), F.lit(f"&matchType=prefix&fl={','.join(FIELDS)}&filter=statuscode:200&collapse=urlkey&limit={ROW_LIMIT}&output=json"))


def bucket_queries(claims: DataFrame) -> DataFrame:
    """All index queries of claims (claim_id, handle, from_ms, min_id, max_id): claim_id, bucket, host, query."""
    asked = claims.where("from_ms IS NOT NULL").select("claim_id", F.lower(F.trim("handle")).alias("handle"), times.capture_timestamp(F.col("from_ms")).alias("from_ts"), F.posexplode(ids.prefix_cover(F.col("min_id"), F.col("max_id"))).alias("bucket", "prefix"))
    per_host = [asked.select("claim_id", "bucket", F.lit(h).alias("host"), index_query(F.col("handle"), F.col("prefix"), F.col("from_ts"), h).alias("query")) for h in HOSTS]
    return per_host[0].unionByName(per_host[1])


def retry_after_ms(header: Column, now_ms: Column) -> Column:
    """Seconds or an HTTP date as milliseconds from now, at least 0; null if it is neither."""
    seconds = F.trim(header).try_cast("double")
    date = F.unix_millis(F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss")))
    wait = F.coalesce((seconds * 1000).cast("long"), date - now_ms)
    return F.when(wait < 0, 0).otherwise(wait)


def wait_ms(retry_after: str | None, attempt: int) -> int:
    """How long to wait before an attempt is repeated: what the server says, within bounds, else twice as long each time."""
    try:
        return min(LONGEST_WAIT_MS, max(0, int(float(retry_after or "") * 1000)))
    except ValueError:
        return min(4000, 500 * 2**attempt)


class FetchError(RuntimeError):
    """A request that failed for good; ``code`` says how."""

    def __init__(self, code: str, message: str, retry_after_ms: int | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.retry_after_ms = code, retry_after_ms


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    """Redirects come back as errors, so that ``fetch`` looks at each before it is asked."""

    def redirect_request(self, *_):
        return None


def _refuse_others(url: str, allowed: tuple[str, ...]) -> None:
    parts = urlsplit(url)
    if parts.scheme != "https" or parts.hostname not in allowed or parts.username or parts.port not in (None, 443):
        raise ValueError(f"{parts.scheme}://{parts.hostname} is no allowed host over https")


def fetch(url: str, agent: str, allowed: tuple[str, ...] = urls.ALLOWED_HOSTS, most_bytes: int | None = None, opener: Callable = urllib.request.build_opener(_NoRedirect).open, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """A page of an allowed host over https, at most ``most_bytes`` of it; tried again when the server is busy or fails.

    Up to MOST_HOPS redirects are followed, each only after its target has passed the same test as the first address.
    """
    _refuse_others(url, allowed)
    attempt = hops = 0
    while True:
        wait = wait_ms(None, attempt)
        try:
            with opener(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=TIMEOUT_S) as answer:
                _refuse_others(answer.geturl(), allowed)
                return answer.read() if most_bytes is None else answer.read(most_bytes)
        except urllib.error.HTTPError as e:
            to = e.headers.get("Location")
            if e.code in (301, 302, 303, 307, 308) and to:
                hops += 1
                if hops > MOST_HOPS:
                    raise FetchError("ARCHIVE_ERROR", "too many redirects") from e
                url = urljoin(url, to)
                _refuse_others(url, allowed)
                continue
            wait = wait_ms(e.headers.get("Retry-After"), attempt)
            error = FetchError("ARCHIVE_RATE_LIMITED" if e.code in (429, 503) else "ARCHIVE_ERROR", f"status {e.code}", wait)
            if not (e.code in (408, 429) or e.code >= 500):
                raise error from e
        except TimeoutError:
            error = FetchError("ARCHIVE_TIMEOUT", "no answer in time")
        except urllib.error.URLError as e:
            error = FetchError("ARCHIVE_TIMEOUT" if isinstance(e.reason, TimeoutError) else "ARCHIVE_ERROR", str(e.reason))
        if attempt == RETRIES:
            raise error
        sleep(wait / 1000)
        attempt += 1


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class IndexReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.agent = options.get("agent", "tracelode")
        handle, prefixes, since = options["handle"], options["prefixes"].split(","), options["from"]
        self.queries = [f"{INDEX_URL}?url={quote(f'{h}/{handle}/status/{p}', safe='')}&from={since}&matchType=prefix&fl={','.join(FIELDS)}&filter=statuscode:200&collapse=urlkey&limit={ROW_LIMIT}&output=json" for h in HOSTS for p in prefixes]

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries]

    def read(self, partition: _Query) -> Iterator[tuple]:
        head, *rows = json.loads(fetch(partition.query, self.agent)) or [[]]
        for row in rows:
            found = dict(zip(head, row))
            if found.get("timestamp") and found.get("original"):
                status = str(found.get("statuscode") or "")
                yield found["timestamp"], found["original"], int(status) if status.isdigit() else 0, found.get("mimetype") or "", found.get("digest") or ""


class IndexDataSource(DataSource):
    """``spark.read.format("capture-index")`` with options handle, prefixes (comma-separated) and from: a partition for each query."""

    @classmethod
    def name(cls) -> str:
        return "capture-index"

    def schema(self) -> str:
        return "timestamp string, original string, statuscode int, mimetype string, digest string"

    def reader(self, schema) -> IndexReader:
        return IndexReader(self.options)
