"""Web records from captured pages: URL kinds, text, titles; and a guarded fetch."""

from __future__ import annotations

import urllib.request
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES, MAX_TEXT, CHUNK = 50 << 20, 10 << 20, 64 << 10


def url_type(url: Column) -> Column:
    """Kind of page by ordered rules on the lower-case URL."""
    u = F.lower(url)
    path = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    return (
        F.when(u.contains("twitter.com") | u.contains("x.com"), "tweet").when(u.contains("arxiv.org"), "arxiv").when(u.contains("github.com"), "github")
        .when(u.contains("youtube.com") | u.contains("youtu.be"), "youtube").when(path.endswith(".pdf"), "pdf").when(path.rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image").otherwise("webpage")
    )


def scheme_allowed(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)).isin("http", "https"), F.lit(False))


def html_to_text(html: Column, cap: int = 8000) -> Column:
    """Text of a page: scripts, styles and tags out, white space collapsed, cut to `cap` characters."""
    c = html
    for tag in ("script", "style"):
        c = F.regexp_replace(c, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " ")), 1, cap)


def page_title(html: Column, url: Column) -> Column:
    title = F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<{0}[^>]*>(.*?)</{0}>".format("title"), 1), r"\s+", " "))
    return F.when(title == "", url).otherwise(title)


def _yaml(c: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(c, r"[\r\n]+", " "), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def webpage_records(pages: DataFrame, captured_at: str) -> DataFrame:
    """(url, file_name, markdown): each page as a note with front matter, text cut to 12 000 characters."""
    title, text = page_title(F.col("html"), F.col("url")), F.substring(html_to_text(F.col("html")), 1, 12000)
    name = F.concat(F.substring(F.regexp_replace(F.regexp_replace(F.col("url"), r"^https?://", ""), r"(?U)[^\w.-]+", "_"), 1, 80), F.lit(".md"))
    head = F.concat(F.lit('---\nsource_url: "'), _yaml(F.col("url")), F.lit('"\ntype: webpage\ntitle: "'), _yaml(title), F.lit(f'"\ncaptured_at: {captured_at}\n---\n\n# '), title, F.lit("\n\n"), text, F.lit("\n"))
    return pages.select("url", name.alias("file_name"), head.alias("markdown"))


def arxiv_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "([0-9]{4}[.][0-9]{4,5})", 1), F.lit(""))


def arxiv_records(pages: DataFrame) -> DataFrame:
    """(url, arxiv_id, title, abstract, authors) of abstract pages; pages without an id are left to webpage_records."""
    part = '(?is)class="{0}[^">]*"[^>]*>((?:(?!</{1}>).)*)</{1}>'

    def clean(kind: str, tag: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", part.format(kind, tag), 1), "<[^>]+>", ""), r"\s+", " "))

    return pages.select("url", arxiv_id(F.col("url")).alias("arxiv_id"), clean("title", "h1").alias("title"), clean("abstract", "blockquote").alias("abstract"), clean("authors", "div").alias("authors")).where("arxiv_id is not null")


def tweet_records(captured: DataFrame) -> DataFrame:
    """(url, author, text) from oEmbed answers (url, body); an unreadable answer gives a stub."""
    j = F.from_json("body", "html string, author_name string")
    text = F.trim(F.regexp_replace(F.regexp_replace(j["html"], "<[^>]+>", ""), r"\s+", " "))
    return captured.select("url", F.coalesce(j["author_name"], F.lit("unknown")).alias("author"), F.coalesce(text, F.concat(F.lit("Tweet at "), F.col("url"), F.lit(" (could not fetch content)"))).alias("text"))


def validate_url(url: str) -> str:
    if urlparse(url).scheme.lower() not in ("http", "https"):
        raise ValueError(f"only http and https are allowed: {url!r}")
    return url


class _SafeRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        validate_url(args[-1])
        return super().redirect_request(*args)


def safe_fetch(url: str, most: int = MAX_BYTES, timeout: int = 30) -> bytes:
    """Body of an http(s) answer; redirects must stay http(s), other statuses than 2xx and larger bodies raise OSError."""
    opener = urllib.request.build_opener(_SafeRedirect)
    with opener.open(urllib.request.Request(validate_url(url), headers={"User-Agent": "kgloom"}), timeout=timeout) as answer:
        if not 200 <= answer.status < 300:
            raise OSError(f"status {answer.status}")
        got = b""
        while part := answer.read(CHUNK):
            got += part
            if len(got) > most:
                raise OSError(f"more than {most} bytes")
        return got


def safe_fetch_text(url: str, most: int = MAX_TEXT, timeout: int = 15) -> str:
    return safe_fetch(url, most, timeout).decode("utf-8", "replace")
