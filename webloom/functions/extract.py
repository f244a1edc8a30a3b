"""Links of HTML, CSS, feeds and sitemaps, and their rewriting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import urls

#: These three define which links count, and what a comment is.  The first is
#: a tag and the first of four attributes in it, with a value in double, single or no quotes.
HTML_LINK = r"""(?i)<\s*([a-zA-Z][\w:-]*)\b[^>]*?\b(?:href|src|action|data)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
CSS_LINK = r"""url\(\s*['"]?([^'")\s]+)['"]?\s*\)"""
COMMENT = r"(?s)<!--.*?-->"
FOLLOWED = ("http", "https", "ftp")


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, COMMENT, "")


def html_references(html: Column, *, follow_tags: list[str] | None = None, ignore_tags: list[str] | None = None, strict_comments: bool = False) -> Column:
    """array<struct<tag, href>> in document order, before any joining."""
    text = strip_comments(html) if strict_comments else html
    # the page is searched once; the groups come out of the short matches
    group = lambda x, i: F.regexp_extract(x, HTML_LINK, i)
    found = F.transform(
        F.regexp_extract_all(text, F.lit(HTML_LINK), F.lit(0)),
        lambda x: F.struct(F.lower(group(x, 1)).alias("tag"), F.when(group(x, 2) != "", group(x, 2)).when(group(x, 3) != "", group(x, 3)).otherwise(group(x, 4)).alias("href")),
    )

    def wanted(x: Column) -> Column:
        ok = (x["href"] != "") & ~x["href"].startswith("#") & ~x["href"].startswith("javascript:")
        if follow_tags:
            ok = ok & x["tag"].isin(*[t.lower() for t in follow_tags])
        if ignore_tags:
            ok = ok & ~x["tag"].isin(*[t.lower() for t in ignore_tags])
        return ok

    return F.filter(found, wanted)


def _resolved(base: Column, refs: Column, schemes: tuple[str, ...] = FOLLOWED) -> Column:
    joined = F.transform(refs, lambda r: urls.join(base, r))
    return F.array_sort(F.array_distinct(F.filter(joined, lambda u: u.isNotNull() & urls.scheme(u).isin(*schemes))))


def html_links(base: Column, html: Column, **options) -> Column:
    """The distinct http, https and ftp URLs that a page links, sorted."""
    return _resolved(base, F.transform(html_references(html, **options), lambda x: x["href"]))


def css_links(base: Column, css: Column) -> Column:
    """The distinct URLs of ``url(...)``, sorted."""
    return _resolved(base, F.regexp_extract_all(css, F.lit(CSS_LINK), F.lit(1)))


def _feed_refs(kind: str, xml: str | None) -> list[str]:
    """References of a feed up to its end or first error."""
    from xml.parsers import expat

    out: list[str] = []
    text: list[str] | None = None
    inside = {"rss": "link", "sitemap": "loc"}.get(kind)

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal text
        local = name.rpartition(":")[2].lower()
        given = {k.rpartition(":")[2].lower(): v for k, v in attributes.items()}
        if kind in ("rss", "atom") and local == "link" and given.get("href"):
            out.append(given["href"])
        if kind == "rss" and local == "enclosure" and given.get("url"):
            out.append(given["url"])
        text = [] if local == inside else None

    def end(name: str) -> None:
        nonlocal text
        if text is not None and name.rpartition(":")[2].lower() == inside and (said := "".join(text).strip()):
            out.append(said)
        text = None

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: text.append(s) if text is not None else None
    # entities are not to be expanded
    parser.EntityDeclHandler = lambda *a: (_ for _ in ()).throw(ValueError("entity"))
    try:
        parser.Parse((xml or "").encode(), True)
    except (expat.ExpatError, ValueError):
        pass
    return out


def feed_references(kinds: Column, xml: Column) -> Column:
    """References of a document read as each of ``kinds`` (array<string>): an RSS feed
    (``rss``: link text and href, enclosures), an Atom feed (``atom``: href) or a sitemap
    (``sitemap``: loc).  Spark's own XPath fails a whole query on a malformed document, so
    this is an Arrow-batched parser that keeps what stands before the error."""

    @F.pandas_udf("array<string>")
    def parse(ks: pd.Series, xs: pd.Series) -> pd.Series:
        return pd.Series([[u for k in (k_ if k_ is not None else ()) for u in _feed_refs(k, x)] for k_, x in zip(ks, xs, strict=True)], dtype=object)

    return parse(kinds, xml)


def feed_links(base: Column, kinds: Column, xml: Column) -> Column:
    return _resolved(base, feed_references(kinds, xml), ("http", "https"))


def convert_links(html: Column, mapping: Column, file_only: bool = False) -> Column:
    """Replace each ``from`` of an array<struct<from, to>> by its ``to``, in order, in the
    whole document; with ``file_only`` the last segment of each by the last of the other."""
    name = lambda x: F.element_at(F.split(F.regexp_replace(x, r"[?#].*$", ""), "/"), -1)

    def step(text: Column, m: Column) -> Column:
        a, b = (name(m["from"]), name(m["to"])) if file_only else (m["from"], m["to"])
        return F.when(a != "", F.replace(text, a, b)).otherwise(text)

    return F.aggregate(mapping, html, step)


def sniff(path: Column, content_type: Column, body: Column) -> Column:
    """What kinds of links a body is searched for: struct of booleans."""
    ext, ct = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)), F.lower(F.coalesce(content_type, F.lit("")))
    xml = (ext == "xml") | ct.contains("xml")
    return F.struct(
        (ext.isin("html", "htm") | body.contains("<html") | body.contains("<HTML")).alias("html"),
        (ext == "css").alias("css"),
        (xml & ct.contains("rss")).alias("rss"),
        (xml & ct.contains("atom")).alias("atom"),
        (body.contains("<urlset") | body.contains("<sitemapindex")).alias("sitemap"),
    )
