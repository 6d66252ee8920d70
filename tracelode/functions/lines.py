"""Recognised lines of a screenshot: chrome, handles, platform, body; and the gate for texts that are page chrome."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wording of the interface, and texts that are never a post's.
_METRIC = r"(?:reposts?|quotes?|likes?|retweets?|bookmarks?|replies|views?|posts?|tweets?)"
_FILL = r"\d\s,._\-\x{2013}\x{2014}\x{B7}\x{2022}*|kmb"
CHROME = (
    r"^\s*replying to\s+@", r"^\s*show more(?:\s*\.\.\.)?\s*$", r"^\s*translate\s+(?:post|tweet)\s*$", r"^\s*show this thread(?:\s*\.\.\.)?\s*$",
    r"^\s*(?:promoted|sponsored)\b", r"^\s*ad\s*$", r"^\s*from\s+\S", r"^\s*(?:\d[\d\s,.\-\x{2013}\x{2014}\x{B7}\x{2022}*]*[kmb]?)?\s*views?\s*$",
)
METRICS_ONLY = rf"(?i)^[{_FILL}]++(?:{_METRIC}[{_FILL}]*)+$"
SIGNALS = ("views", "reposts", "quotes", "retweets", "likes", "bookmarks", "post", "tweet", "replying to", "show this thread")
GENERIC = ("x", "x.com", "twitter", "twitter.com", "home", "login", "join x", "sign in", "x / home", "log in", "log in on x", "login on x", "sign up")
JUNK_PARTS = (
    "something went wrong", "rate limit exceeded", "too many requests", "javascript is not available", "enable javascript", "log in to", "sign up to",
    "this post was deleted", "post not found", "page not found", "content is not available",
)
SHORTEST_POST = 10


def is_metrics_row(line: Column) -> Column:
    """Counts with the words for them: nothing else on the line, or two such words beside a digit."""
    return line.rlike(r"[0-9]") & (line.rlike(METRICS_ONLY) | (F.regexp_count(line, F.lit(rf"(?i)\b{_METRIC}\b")) >= 2))


def is_chrome_line(line: Column) -> Column:
    text = F.trim(line)
    hit = is_metrics_row(text)
    for pattern in CHROME:
        hit = hit | text.rlike(f"(?i){pattern}")
    return F.coalesce((text != "") & hit, F.lit(False))


def body_lines(lines: Column) -> Column:
    """Lines trimmed, without blank ones and chrome."""
    return F.filter(F.transform(lines, lambda t: F.trim(t)), lambda t: (t != "") & ~is_chrome_line(t))


def join_body(parts: Column) -> Column:
    """Lines as one text: white space collapses, and a line that ends in a hyphen goes straight on."""
    clean = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    glue = lambda out, p: F.when(out == "", p).when(out.endswith("-"), F.concat(F.regexp_replace(out, "-$", ""), p)).otherwise(F.concat(out, F.lit(" "), p))
    return F.aggregate(clean, F.lit(""), glue)


def has_platform_signal(lines: Column) -> Column:
    return F.exists(lines, lambda t: F.lower(t).rlike("|".join(SIGNALS)))


def is_junk_text(text: Column) -> Column:
    """Whether an extracted text is the page's chrome (a login wall, an error) and not a post."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[\"'\\x{201C}\\x{201D}]", ""), r"\s+", " "))
    return plain.isin(*GENERIC) | (F.length(plain) < SHORTEST_POST) | plain.rlike("|".join(JUNK_PARTS))
