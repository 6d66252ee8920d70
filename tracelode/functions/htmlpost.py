"""The text of an archived post from its page, by whichever of five kinds of evidence the page has.

One pass of the standard library's parser over a page notes what the extractors need; they then run in order and the
first whose cleaned text counts wins. Malformed markup may nest otherwise than in a browser.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import ship
from .lines import GENERIC as GENERIC_TEXTS
from .lines import JUNK_PARTS, SHORTEST_POST

#: Fixed values of the extractors.
LONGEST_PAGE = 2_000_000
POSTING_TYPES = {"SocialMediaPosting", "Article", "BlogPosting", "NewsArticle"}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»"}
GENERIC_TITLES = {"x", "x.com", "twitter", "twitter.com", "x / home", "twitter / home", "log in on x", "login on x"}
TITLE_FORM = re.compile("^(.*?)\\s+on\\s+(?:X|Twitter)\\s*:\\s*[“\"«']([\\s\\S]*?)[”\"»']\\s*(?:/\\s*X)?\\s*$")
RAW_TEXT_FIELD = re.compile(r'"(?:full_text|note_tweet)"\s*:\s*("(?:\\.|[^"\\])*")')
JSON_DEPTH, JSON_LONGEST, RAW_MOST = 12, 2000, 5
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

POST_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "display_name", "handle", "created_at_iso", "extractor")])


class _Page(HTMLParser):
    """What the extractors need of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, set[str]]] = []
        self.scripts: list[tuple[dict[str, str], str]] = []
        self.metas: list[dict[str, str]] = []
        self.first: dict[str, str] = {}  # first value of the attributes asked for
        self.title: str | None = None
        self.post: str | None = None
        self._into: list | None = None  # where text goes: [kind, depth, parts, attributes]

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        classes = set(a.get("class", "").split())
        if tag == "p" and self.open and self.open[-1][0] == "p":  # a paragraph ends the one before
            self.handle_endtag("p")
        if tag == "meta":
            self.metas.append(a)
        for name in ("data-tweet-text", "data-screen-name", "data-name", "data-time"):
            if name in a:
                self.first.setdefault(name, a[name])
        if tag == "time" and "datetime" in a:
            self.first.setdefault("datetime", a["datetime"])
        if tag in _VOID:
            return
        self.open.append((tag, classes))
        if self._into is None:
            depth = len(self.open)
            inside = any("permalink-tweet" in c for _, c in self.open[:-1])
            if tag == "script":
                self._into = ["script", depth, [], a]
            elif tag == "title" and self.title is None:
                self._into = ["title", depth, [], a]
            elif self.post is None and (classes & {"tweet-text", "js-tweet-text"} or (tag == "p" and inside)):
                self._into = ["post", depth, [], a]

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            depth, (last, _) = len(self.open), self.open.pop()
            if self._into is not None and depth == self._into[1]:
                self._close()
            if last == tag:
                break

    def _close(self) -> None:
        kind, _, parts, a = self._into
        text = "".join(parts)
        if kind == "script":
            self.scripts.append((a, text))
        else:
            setattr(self, kind, text)
        self._into = None

    def handle_data(self, data):
        if self._into is not None and not (self._into[0] == "post" and self.open and self.open[-1][0] in ("script", "style")):
            self._into[2].append(data)

    def close(self):
        super().close()
        if self._into is not None:
            self._close()


def is_junk(text: str) -> bool:
    plain = " ".join(re.sub("[“”\"']", "", text.lower()).split())
    return plain in GENERIC_TEXTS or len(plain) < SHORTEST_POST or any(part in plain for part in JUNK_PARTS)


def clean(text: str) -> str | None:
    """White space collapsed; markup that is left is stripped; page chrome is no text."""
    text = " ".join(text.split())
    if not text:
        return None
    if re.search(r"<[a-z][\s\S]*>", text, re.I) and re.search(r"</(?:p|div|span|a)\s*>", text, re.I):
        return " ".join(re.sub("<[^>]*>", " ", text).split()) or None
    return None if is_junk(text) else text


def unquoted(text: str) -> str:
    text = text.strip()
    for _ in range(3):
        if len(text) < 2 or QUOTES.get(text[0]) != text[-1]:
            break
        text = text[1:-1].strip()
    return text


def title_parts(title: str) -> tuple[str | None, str | None]:
    """Name and text of a title such as ``Name on X: "text" / X``."""
    m = TITLE_FORM.match(title.strip())
    return (m[1].strip() or None, m[2].strip() or None) if m else (None, None)


def _string(value) -> str | None:
    return value if isinstance(value, str) else None


def _nodes(value) -> Iterator[dict]:
    """Objects of a JSON value, outer before inner, in document order."""
    if isinstance(value, list):
        for v in value:
            yield from _nodes(v)
    elif isinstance(value, dict):
        yield value
        for v in value.values():
            yield from _nodes(v)


def _strings(value, depth: int = 0) -> Iterator[str]:
    if depth > JSON_DEPTH:
        return
    if isinstance(value, str):
        yield value
    elif isinstance(value, (list, dict)):
        for v in value.values() if isinstance(value, dict) else value:
            yield from _strings(v, depth + 1)


def from_linked_data(page: _Page, source: str) -> dict | None:
    for attributes, body in page.scripts:
        if attributes.get("type") != "application/ld+json":
            continue
        try:
            value = json.loads(body)
        except ValueError:
            continue
        for node in _nodes(value):
            kinds = node.get("@type")
            text = node.get("articleBody") if node.get("articleBody") is not None else node.get("text")
            if POSTING_TYPES.isdisjoint(k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)) or not isinstance(text, str) or not text.strip():
                continue
            author = node.get("author")
            by = author if isinstance(author, dict) else {"name": author}
            handle = _string(by.get("alternateName"))
            return {"text": text, "display_name": _string(by.get("name")), "handle": handle and handle.removeprefix("@"), "created_at_iso": _string(node.get("datePublished")) or _string(node.get("dateCreated"))}
    return None


def _meta(page: _Page, *names: str) -> str | None:
    for name in names:
        for key in ("property", "name"):
            found = next((m.get("content") for m in page.metas if m.get(key) == name), None)
            if found is not None:
                if found.strip():
                    return found
                break
    return None


def from_open_graph(page: _Page, source: str) -> dict | None:
    description, title = _meta(page, "og:description", "twitter:description"), _meta(page, "og:title", "twitter:title")
    name, quoted = title_parts(title) if title is not None else (None, None)
    text = (unquoted(description) if description is not None else "") or quoted
    return {"text": text, "display_name": name} if text else None


def from_classic_markup(page: _Page, source: str) -> dict | None:
    text = (page.post or "").strip() or page.first.get("data-tweet-text", "").strip()
    if not text:
        return None
    when = page.first.get("datetime", page.first.get("data-time", "")).strip()
    if re.fullmatch("[0-9]{1,11}", when):
        when = datetime.fromtimestamp(int(when), UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    return {"text": text, "display_name": page.first.get("data-name", "").strip() or None, "handle": page.first.get("data-screen-name", "").strip().removeprefix("@") or None, "created_at_iso": when or None}


def from_embedded_json(page: _Page, source: str) -> dict | None:
    body = next((b for a, b in page.scripts if a.get("id") == "__NEXT_DATA__"), "")
    try:
        found = [s for s in _strings(json.loads(body)) if len(s.strip()) >= 2]
    except (ValueError, RecursionError):
        found = []
    longest = max(found, key=len, default="").strip()
    if longest and len(longest) <= JSON_LONGEST:
        return {"text": longest}
    raw = []
    for m in RAW_TEXT_FIELD.finditer(source):
        try:
            text = json.loads(m[1])
        except ValueError:
            continue
        try:  # it may be encoded twice
            text = inner if isinstance(inner := json.loads(text), str) else text
        except ValueError:
            pass
        if text.strip():
            raw.append(text)
        if len(raw) == RAW_MOST:
            break
    return {"text": max(raw, key=len).strip()} if raw else None


def from_title(page: _Page, source: str) -> dict | None:
    title = (page.title or "").strip()
    if not title or title.lower() in GENERIC_TITLES:
        return None
    name, text = title_parts(title)
    if text:
        return {"text": text, "display_name": name}
    return None if re.search(r"log\s*in", title, re.I) and len(title) < 60 else {"text": title}


EXTRACTORS = (("ldjson", from_linked_data), ("og", from_open_graph), ("classic", from_classic_markup), ("embeddedJson", from_embedded_json), ("title", from_title))


def extract_post_from(html: str | None) -> dict:
    if html and html.strip():
        source = html[:LONGEST_PAGE]
        page = _Page()
        page.feed(source)
        page.close()
        for name, extractor in EXTRACTORS:
            found = extractor(page, source)
            text = clean(found["text"]) if found and found["text"] else None
            if text:
                return {"display_name": None, "handle": None, "created_at_iso": None, **found, "text": text, "extractor": name}
    return {"text": None, "display_name": None, "handle": None, "created_at_iso": None, "extractor": "none"}


@F.pandas_udf(POST_SCHEMA)
def _extract(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_post_from(x) for x in html], columns=POST_SCHEMA.names, dtype=object)


def extract_post(html: Column) -> Column:
    """struct(text, display_name, handle, created_at_iso, extractor)."""
    ship()
    return _extract(html)


def page_title(html: Column) -> Column:
    """The title of a page without entities, as a JVM expression; null if it has none."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(""))
