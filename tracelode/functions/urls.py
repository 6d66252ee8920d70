"""Status URLs, replay URLs and the allowlist of archive hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of URLs that count.
STATUS_URL = r"^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/[^/]+/status/([0-9]+)/?(?:\?.*)?$"
STRICT_STATUS_URL = r"^https://(?:x|twitter)\.com/[A-Za-z0-9_]{1,15}/status/[0-9]+$"
HANDLE_IN_URL = r"(?i)^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/([^/]+)/status/[0-9]+"
ALLOWED_HOSTS = ("web.archive.org", "archive.org")


def is_status_url(url: Column) -> Column:
    return F.coalesce(url.rlike(STATUS_URL), F.lit(False))


def post_id_of(url: Column) -> Column:
    """The decimal id, as text; null if the URL is no status URL."""
    return F.nullif(F.regexp_extract(url, STATUS_URL, 1), F.lit(""))


def handle_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, HANDLE_IN_URL, 1), F.lit("")))


def snapshot_eligible(url: Column) -> Column:
    """Whether a snapshot may be asked for under this URL; discovery admits more forms than that."""
    return F.coalesce(url.rlike(STRICT_STATUS_URL), F.lit(False))


def replay_url(ts: Column, url: Column) -> Column:
    return F.concat(F.lit("https://web.archive.org/web/"), ts, F.lit("id_/"), url)


def framed_url(replay: Column) -> Column:
    return F.regexp_replace(replay, r"^(.*?)id_/", "$1if_/")


def uri_component(text: Column) -> Column:
    """Percent-encoding that leaves A-Z a-z 0-9 - _ . ! ~ * ' ( ) as they are and writes a space as %20."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for mark, code in (("!", "%21"), ("'", "%27"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def is_allowed_url(url: Column) -> Column:
    """Whether a URL leads to an archive host and nowhere else: http(s), no user, the host exactly as written."""
    authority = F.regexp_extract(url, r"(?i)^https?://([^/?#]+)", 1)
    host = F.regexp_extract(authority, r"^([^:]*)(?::[0-9]*)?$", 1)
    plain = authority.rlike(r"^[A-Za-z0-9.-]+(?::[0-9]{0,5})?$")
    return F.coalesce(plain & F.lower(host).isin(*ALLOWED_HOSTS), F.lit(False))


def canonical_variants(url: Column) -> Column:
    """The same capture URL under either host."""
    other = F.when(url.contains("://x.com/"), F.replace(url, F.lit("://x.com/"), F.lit("://twitter.com/"))).otherwise(F.replace(url, F.lit("://twitter.com/"), F.lit("://x.com/")))
    return F.array_distinct(F.array(url, other))
