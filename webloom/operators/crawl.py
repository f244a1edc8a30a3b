"""Recursive retrieval as a loop of DataFrames, one round of the frontier at a time.

A round is anti-joined with what was visited, judged, matched with its bodies (redirects and
mirrors followed) and stored once, in the shared folder as Parquet; the next frontier is made
of its links, of sitemaps that robots files name and of mirrored files.  The loop is on the
driver, the data never is: a round brings back one row of counts.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions import charset, extract, paths, text, urls
from webloom.operators import archive, mirrors, policy, transfer
from webloom.operators import session as sessions
from webloom.operators.session import Session
from webloom.plans.config import CrawlConfig
from webloom.store import observed, shared_folder, stored


def together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def recurses(depth: Column, config: CrawlConfig) -> Column:
    """Whether links of a page at this depth are followed."""
    deep = (depth < config.level) if config.level >= 0 else F.lit(True)
    return (F.lit(config.recursive) & deep) | (F.lit(config.page_requisites) & (depth < 1))


@dataclass
class Crawl:
    """``visited`` (url, depth, parent, reason: null if fetched), ``pages`` (url, used_url:
    the mirror that served it, final_url: where redirects ended, depth, status,
    content_type, body, content: the bytes where the source keeps them, path, bytes, start and
    action: write, append, or keep where the file that is there is as good), ``jobs`` (url, depth, status, cookies: what was sent,
    attempts, error, failure: its kind, ``ok`` without one, code: its exit code) of all that
    was asked for, and ``totals`` (rows, bytes, attempts, code: the worst) over all rounds.
    ``session`` is what was remembered at the end, if anything was to be."""

    visited: DataFrame
    pages: DataFrame
    jobs: DataFrame
    totals: dict[str, int]
    session: Session | None = None


#: What a source adds to the rows it is asked for, and how it is typed; what a source does not
#: know may be missing.
FETCHED = {
    "body": "string", "content_type": "string", "status": "int", "link": "string", "final_url": "string", "set_cookie": "array<string>", "strict_transport": "string",
    "last_modified": "string", "content": "binary", "cookies": "string", "attempts": "int", "error": "string", "failure": "string",
}


def completed(level: DataFrame, got: DataFrame) -> DataFrame:
    """The columns of ``level`` and all of ``FETCHED``."""
    has = set(got.columns)
    return got.select(*[c for c in level.columns if c not in FETCHED], *[F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in FETCHED.items()])


def failure_of(status: Column) -> Column:
    """What a status means for the exit code: a page that is not there is the server's word."""
    return F.when(status.isin(401, 407), "auth").when(F.coalesce(status, F.lit(404)) >= 400, "server").otherwise("ok")


def corpus_source(pages: DataFrame, config: CrawlConfig | None = None) -> Callable[[DataFrame], DataFrame]:
    """A source of bodies from a table url, html [, content_type, status, location, link
    (the Link header), set_cookie (one or an array), strict_transport, last_modified].  A
    BINARY html is read by its charset.  Rows with a redirect status and a location are
    followed, up to ``max_redirect``; more, or an error status, give no body."""
    config = config or CrawlConfig()
    kinds = dict(pages.dtypes)
    given = {"html": F.lit(None), "content_type": F.lit("text/html"), "status": F.lit(200), "link": F.lit(None), "set_cookie": F.lit(None), "strict_transport": F.lit(None), "last_modified": F.lit(None)}
    types = {"html": "string", "status": "int", "set_cookie": "array<string>"}

    def column(name: str, default: Column) -> Column:
        c = F.col(name) if name in kinds else default
        if name == "html" and kinds.get(name) == "binary":
            label = F.lit(config.remote_encoding) if config.remote_encoding else text.charset(F.col("content_type")) if "content_type" in kinds else F.lit(None).cast("string")
            return charset.decode_bytes(c, label)
        if name == "set_cookie" and kinds.get(name) == "string":
            c = F.when(c.isNotNull(), F.array(c))
        return c.cast(types.get(name, "string"))

    own = pages.select(F.col("url").alias("_target"), *[column(c, x).alias(f"_{c}") for c, x in given.items()])
    ends = None
    if "location" in kinds:
        status = F.col("status") if "status" in kinds else F.lit(302)
        hops = pages.where(status.between(300, 399) & (status != 304) & F.col("location").isNotNull()).select(F.col("url").alias("source"), "location")
        # the redirects of the whole corpus, closed once
        ends = stored(redirects(hops.select(F.col("source").alias("url")).distinct(), hops, config.max_redirect).select(F.col("url").alias("_target"), "final", "ok"))

    def fetch(level: DataFrame) -> DataFrame:
        asked = level.withColumn("_target", F.col("target") if "target" in level.columns else F.col("url"))
        if ends is not None:
            asked = asked.join(ends, "_target", "left").withColumn("_target", F.when(F.coalesce("ok", F.lit(True)), F.coalesce("final", "_target"))).drop("final", "ok")
        met = asked.join(own, "_target", "left")
        status = F.col("_status")
        if "since" in level.columns:
            status = F.when((status == 200) & (text.http_date(F.col("_last_modified")) <= text.http_date(F.col("since"))), 304).otherwise(status)
        good = (F.lit(True) if config.content_on_error else status < 400) & (status != 304)
        said = [F.col(f"_{c}").alias(c) for c in given if c not in ("html", "status")]
        return met.select(*level.columns, F.when(good, F.col("_html")).alias("body"), status.alias("status"), *said, F.col("_target").alias("final_url"), F.lit(1).alias("attempts"), failure_of(F.col("_status")).alias("failure"))

    return fetch


@dataclass
class LinkColumns:
    """What ``page_links`` asks of (url, content_type, body): expressions of thousands of parts,
    which a crawl makes once and not each round."""

    plain: Column
    kinds: Column
    found: Column


def link_columns(config: CrawlConfig) -> LinkColumns:
    base, body = F.col("url"), F.col("body")
    opts = {"follow_tags": config.follow_tags, "ignore_tags": config.ignore_tags, "strict_comments": config.strict_comments}
    none = F.array().cast("array<string>")
    html = F.when(F.col("kind.html") | F.lit(config.force_html), extract.html_links(base, body, **opts)).otherwise(none)
    css = F.when(F.col("kind.css") | F.lit(config.force_css), extract.css_links(base, body)).otherwise(none)
    forced = {"rss": config.force_rss, "atom": config.force_atom, "sitemap": config.force_sitemap}
    kinds = F.filter(F.array(*[F.when(F.lit(f) | F.col(f"kind.{k}"), F.lit(k)) for k, f in forced.items()]), lambda k: k.isNotNull())
    return LinkColumns(F.explode(F.array_distinct(F.concat(html, css))).alias("url"), kinds, F.explode(extract.feed_links(base, F.col("kinds"), body)).alias("url"))


def kind_of(config: CrawlConfig) -> Column:
    return extract.sniff(paths.local_path(F.col("url"), CrawlConfig(default_page=config.default_page)), F.col("content_type"), F.col("body"))


def page_links(pages: DataFrame, config: CrawlConfig, *, feeds: bool = True, columns: LinkColumns | None = None, kind: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(parent, url) for every link of every page, by what its body is; ``feeds`` off leaves
    out the parser for feeds, where it is known that there are none.  Columns to ``keep`` come
    first, so that of pages of one URL each has its own links."""
    columns = columns or link_columns(config)
    said = pages.where(F.col("body").isNotNull()).withColumn("kind", kind_of(config) if kind is None else kind)
    plain = said.select(*keep, F.col("url").alias("parent"), columns.plain)
    if not feeds:
        return plain.distinct()
    # only documents that are feeds reach the parser
    read = said.withColumn("kinds", columns.kinds).where(F.size("kinds") > 0)
    return plain.unionByName(read.select(*keep, F.col("url").alias("parent"), columns.found)).distinct()


def _is_feed(config: CrawlConfig) -> Column:
    if config.force_rss or config.force_atom or config.force_sitemap:
        return F.lit(True)
    kind = extract.sniff(F.col("path"), F.col("content_type"), F.col("body"))
    return kind["rss"] | kind["atom"] | kind["sitemap"]


def _is_metalink(config: CrawlConfig) -> Column:
    if config.force_metalink:
        return F.lit(True)
    return F.lit(config.metalink_over_http) & F.coalesce(text.is_metalink_type(F.col("content_type")), F.lit(False))


def mirrored_files(pages: DataFrame, config: CrawlConfig) -> DataFrame:
    """(url, mirrors, hashes) of the files that metalink bodies and Link headers among the
    pages name: what to ask for first, what instead, and what the content must hash to.  A
    document that points on (``metalink_index``, describedby) gives its target alone."""
    nothing = F.array().cast("array<string>"), F.array().cast("array<struct<algo:string,hex:string>>")
    docs = mirrors.documents(pages.where(_is_metalink(config)).select("final_url", F.col("body").alias("xml")))
    onward = mirrors.nth_metaurl(F.col("doc.metaurls"), config.metalink_index)["url"] if config.metalink_index else F.lit(None).cast("string")
    docs = docs.withColumn("onward", onward)
    files = docs.where("onward is null").select(F.explode("doc.files").alias("f")).select(mirrors.ordered_urls(F.col("f.urls"), config.preferred_location).alias("urls"), F.col("f.hashes").alias("hashes"))
    out = files.unionByName(docs.where("onward is not null").select(F.array("onward").alias("urls"), nothing[1].alias("hashes")))
    if config.metalink_over_http:
        said = pages.where(~_is_metalink(config) & F.col("link").isNotNull()).select(mirrors.duplicates(text.link_header(F.col("link")), F.col("final_url")).alias("l"))
        described = F.col("l.describedby").isNotNull()
        out = out.unionByName(said.select(F.when(described, F.array("l.describedby")).otherwise(F.col("l.urls")).alias("urls"), F.when(described, nothing[1]).otherwise(F.col("l.digests")).alias("hashes")))
    out = out.where(F.size("urls") > 0)
    # of documents that name one file differently the least counts, whichever task is first
    return out.select(F.col("urls")[0].alias("url"), F.slice("urls", 2, F.size("urls")).alias("mirrors"), "hashes").groupBy("url").agg(F.min(F.struct("mirrors", "hashes")).alias("m")).select("url", "m.mirrors", "m.hashes")


def retrieve(asked: DataFrame, fetch: Callable[[DataFrame], DataFrame], config: CrawlConfig, files: DataFrame | None = None) -> DataFrame:
    """``asked`` (url and more) with what a source gives, ``used_url`` and ``reason``.

    With a table of mirrored ``files`` a URL's mirrors are tried in order until one gives a
    body that hashes as it should (``hash`` is the reason if none does, or if one does not
    and bad files are kept); only what is still open is asked for again."""
    if files is None:
        return fetch(asked).withColumns({"used_url": F.col("url"), "reason": F.lit(None).cast("string")})
    own = asked.columns
    todo = asked.join(files, "url", "left").withColumn("candidates", F.concat(F.array("url"), F.coalesce("mirrors", F.array().cast("array<string>")))).withColumn("hashes", F.coalesce("hashes", F.array().cast("array<struct<algo:string,hex:string>>")))
    todo = stored(todo.select(F.struct(*own).alias("row"), "candidates", "hashes"))
    done, at = [], 0
    while True:
        got = fetch(todo.withColumn("url", F.col("candidates")[at]))
        right = F.forall("hashes", lambda h: archive.verify(F.encode("body", "UTF-8"), h["algo"], h["hex"]))
        last = F.size("candidates") == at + 1
        got = stored(got.withColumns({"_right": right, "_ends": F.col("body").isNotNull() & (right | F.lit(config.keep_badhash)) | last}))
        reason = F.when(F.col("body").isNotNull() & ~F.col("_right"), F.lit("hash"))
        body = F.when(F.col("_right") | F.lit(config.keep_badhash), F.col("body"))
        done.append(got.where("_ends").select("row.*", body.alias("body"), *[c for c in FETCHED if c != "body"], F.col("url").alias("used_url"), reason.alias("reason")))
        todo = got.where("not _ends").select("row", "candidates", "hashes")
        at += 1
        if not todo.limit(1).count():
            return together(done)


#: The beginning of the type of a listing's text.
LISTING = "text/x-ftp-"


def is_listing() -> Column:
    return F.coalesce(F.col("content_type").startswith(LISTING), F.lit(False))


def listing_links(pages: DataFrame, config: CrawlConfig) -> DataFrame:
    """(url, depth, parent) of what listings among the pages name and the policy lets through:
    the entries of folders where links are followed, and what a pattern matched, which stands
    for the pattern itself."""
    from webloom.sources import ftp

    matched = F.col("final_url") != F.col("url")
    texts = pages.where(is_listing() & (matched | recurses(F.col("depth"), config))).select(F.col("final_url").alias("url"), F.substring("content_type", len(LISTING) + 1, 100).alias("kind"), F.col("body").alias("text"), (F.col("depth") + F.when(matched, 0).otherwise(1)).alias("depth"))
    found = ftp.children(texts, keep=["depth"])
    rules = [r for r in policy.child_rules(F.col("child"), F.col("url"), config) if r[0] not in ("follow-ftp", "no-iri")]
    return found.where(policy.first_reason(rules).isNull()).select(F.col("child").alias("url"), "depth", F.col("url").alias("parent"))


def with_local(got: DataFrame, there: DataFrame, folder: str, config: CrawlConfig) -> DataFrame:
    """``got`` with ``action``; where a file is kept its text stands for the body."""
    from webloom.sources import local

    named = got.withColumn("path", F.when(~is_listing(), paths.local_path(F.col("url"), config)))
    judged = stored(transfer.outcome(named, there, config).drop("mtime"))
    kept = judged.where("action = 'keep'")
    texts = local.contents(kept, folder).select("path", charset.decode_bytes(F.col("content"), F.lit(config.remote_encoding or "utf-8")).alias("_text"))
    again = kept.join(texts, "path", "left").withColumn("body", F.col("_text")).drop("_text")
    return again.unionByName(judged.where("action <> 'keep'")).drop("path", "since")


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    from webloom.sources import local

    return local.files(spark, folder)


def saved(pages: DataFrame) -> DataFrame:
    """(path, action, mtime, start, content) of a crawl's pages, for ``transfer.write_files``."""
    served = text.http_date(F.col("last_modified")) if "last_modified" in pages.columns else F.lit(None).cast("timestamp")
    content = F.coalesce("content", F.encode("body", "UTF-8"))
    return pages.where("path is not null and action <> 'keep'").select("path", "action", served.alias("mtime"), "start", content.alias("content"))


def crawl(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], config: CrawlConfig, *, robots: DataFrame | None = None, session: Session | None = None, local: str | None = None, visited: DataFrame | None = None) -> Crawl:
    """Retrieve from ``seeds`` (url), until nothing is left to ask for.  A URL is visited
    once, fragment and all, at its least depth, and a rejected one is not asked for again.

    ``robots`` (``policy.robots_rules``) forbids pages and names sitemaps, which are asked
    for once for each host and port.  With ``quota`` pages are fetched in the order of depth
    and URL while less than that many bytes have been.  With ``metalink_over_http`` or
    ``force_metalink`` the files that metalinks name are fetched too, from the first mirror
    that serves them right.  With a ``session`` cookies, strict transport and credentials go
    with the requests, and what the responses of a round say holds from the next round on.

    ``local`` is the folder of what was saved before: with ``timestamping`` newer content only
    is asked for, with ``continue_download`` the rest of a file; a file that is kept is read for
    its links.  URLs of a table ``visited`` are not asked for.

    The rounds are parts of one table, so a round's plan does not grow with their number."""
    looks = config.recursive or config.page_requisites
    mirroring = config.metalink_over_http or config.force_metalink
    named = None
    if robots is not None and looks and config.follow_sitemaps:
        named = robots.where(F.size("sitemaps") > 0).groupBy("origin").agg(F.first("sitemaps").alias("sitemaps"))
        named = named if named.limit(1).count() else None
    spark = seeds.sparkSession
    base_folder = f"{shared_folder(spark)}/crawl/{uuid.uuid4().hex}"
    every: DataFrame | None = None
    frontier = seeds.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    seeded: list[DataFrame] = []
    files: list[DataFrame] = []
    taken: list[DataFrame] = []  # mirrors of what was asked for count as visited
    there = None if local is None else stored(files_of(spark, local))
    left, totals = config.quota, {"rows": 0, "bytes": 0, "attempts": 0, "code": 0}

    def asked(level: DataFrame) -> DataFrame:
        dressed = level if session is None else sessions.dressed(level, session, user=config.http_user or config.user, password=config.http_password or config.password)
        return completed(level, fetch(dressed))

    # expressions that all rounds share: making one takes as long as a small job
    url = F.col("url")
    reject, limited = policy.reject_reason(url, config), bool(policy.url_rules(url, config))
    place = paths.local_path(url, config)
    child = policy.first_reason(policy.child_rules(url, F.col("parent"), config)) if looks else None
    columns, kind = (link_columns(config), kind_of(config)) if looks else (None, None)
    found = F.col("body").isNotNull() & F.col("reason").isNull()
    asks = {
        "rows": F.count(F.lit(1)),
        "bytes": F.sum("bytes"),
        "attempts": F.sum("attempts"),
        "worst": F.max(severity(exit_code(F.col("failure")))),
        "looks": F.max((found & recurses(F.col("depth"), config)).cast("int")),
        "feeds": F.max((found & _is_feed(config)).cast("int")),
        "mirrored": F.max((found & (_is_metalink(config) | F.col("link").isNotNull())).cast("int")),
        "odd": F.max((found & F.col("body").rlike(r"//[^/\s\"'<>]*[^\x00-\x7F]")).cast("int")),
        "listings": F.max((found & is_listing()).cast("int")),
        "said": F.max((F.col("set_cookie").isNotNull() | F.col("strict_transport").isNotNull()).cast("int")),
    }

    for number in itertools.count():
        level = frontier.where("url is not null").groupBy("url").agg(F.min(F.struct("depth", "parent")).alias("f")).select("url", "f.depth", "f.parent")
        gone = ([every.select("url")] if every is not None else []) + taken + ([visited.select("url")] if visited is not None else [])
        if gone:
            level = level.join(together(gone), "url", "left_anti")
        judged = level.withColumn("reason", reject)
        if robots is not None and looks:
            judged = policy.robots_allow(judged, robots, config.user_agent).withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(~F.col("allowed"), F.lit("robots"))).drop("allowed")
        if limited or (robots is not None and looks):
            judged = stored(judged)  # urls alone; what is asked for and what is not come from one table
        known = together(files).groupBy("url").agg(F.min(F.struct("mirrors", "hashes")).alias("m")).select("url", "m.mirrors", "m.hashes") if files else None
        wanted = judged.where("reason is null").drop("reason")
        if there is not None:
            wanted = transfer.request_plan(wanted.withColumn("path", place), there, config).drop("path")
        got = retrieve(wanted, asked, config, known)
        if there is not None:
            got = with_local(got, there, local, config)
        else:
            got = got.withColumns({"start": F.lit(None).cast("bigint"), "action": F.lit("write")})
        if config.filter_mime_type:
            wrong = F.col("body").isNotNull() & ~policy.mime_allowed(F.col("content_type"), config.filter_mime_type)
            got = got.withColumn("reason", F.when(wrong, "filter-mime-type").otherwise(F.col("reason")))
        kept = (F.col("reason").isNull() | (F.col("reason") == "hash")) & F.col("body").isNotNull()
        path = F.when(~is_listing(), place)
        if config.keep_listing:
            path = F.when(is_listing(), F.concat(F.regexp_extract(paths.local_path(F.col("final_url"), config), r"^(.*/)?", 0), F.lit(".listing"))).otherwise(path)
        got = got.select(
            "url", "depth", "parent", "reason", "used_url", "final_url", "status", "content_type", "link", F.when(kept, F.col("body")).alias("body"), F.when(kept, path).alias("path"), F.when(F.col("action") == "keep", F.lit(0)).otherwise(F.octet_length(F.coalesce("content", F.col("body").cast("binary")))).cast("bigint").alias("bytes"),
            F.when(kept, F.col("content")).alias("content"), "start", "action", *[c for c in FETCHED if c not in ("body", "content", "content_type", "status", "link", "final_url")],
        )
        none = [F.lit(None).cast(t).alias(c) for c, t in got.dtypes if c not in ("url", "depth", "parent", "reason")]
        table = got.unionByName(judged.where("reason is not null").select("url", "depth", "parent", "reason", *none))
        if left is not None:
            table = stored(table)
            table = within_quota(table.where("bytes is not null"), left, order=("depth", "url")).drop("bytes_before").unionByName(table.where("bytes is null"))
        table, facts = observed(table, asks, f"{base_folder}/round={number}")
        every = spark.read.schema(table.schema).parquet(base_folder)
        for name in ("rows", "bytes", "attempts"):
            totals[name] += facts.get(name, 0)
        totals["code"] = max(totals["code"], code_of(facts.get("worst", 0)), key=lambda c: RANKS[c])
        if left is not None:
            left -= facts.get("bytes", 0)
        if not facts.get("rows") or (left is not None and left <= 0):
            break
        coming = []
        read = table.where(found)
        if session is not None and facts.get("said"):
            session = session.learnt(table.where("final_url is not null"), number)
            session = replace(session, cookies=stored(session.cookies), strict=stored(session.strict))
        if mirroring and facts.get("mirrored"):
            more = stored(mirrored_files(read, config))
            files.append(more)
            taken.append(more.select(F.explode("mirrors").alias("url")))
            coming.append(more.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
        if facts.get("listings"):
            coming.append(listing_links(read, config))
        if facts.get("looks"):
            base = read.where(recurses(F.col("depth"), config))
            base = base.where(~is_listing()) if facts.get("listings") else base
            base = base.where(~_is_metalink(config)) if mirroring else base
            # links are joined to the mirror that served the page
            links = page_links(base.select(F.col("used_url").alias("url"), "content_type", "body"), config, feeds=bool(facts.get("feeds")), columns=columns, kind=kind)
            links = charset.ascii_hosts(links) if facts.get("odd") else links
            ok = links.where(child.isNull())
            depth = base.groupBy(F.col("used_url").alias("parent")).agg((F.min("depth") + 1).alias("depth"))
            coming.append(ok.join(depth, "parent").select("url", "depth", "parent"))
        if named is not None:
            # a host and port is seeded by the file of the origin that is asked first
            origin = urls.origin(F.col("url"))
            port = F.regexp_replace(origin, "^[a-z][a-z0-9+.-]*://", "")
            new = table.where("reason is null or reason in ('hash', 'filter-mime-type')").groupBy(port.alias("port")).agg(F.min("depth").alias("depth"), F.min(origin).alias("origin")).where("port is not null")
            new = stored(new.join(together(seeded), "port", "left_anti") if seeded else new)
            seeded.append(new.select("port"))
            coming.append(new.join(named, "origin").select(F.explode("sitemaps").alias("url"), "depth", F.lit(None).cast("string").alias("parent")))
        if not coming:
            break
        frontier = together(coming)
    asked_for = every.where(F.col("failure").isNotNull() | F.col("status").isNotNull() | F.col("error").isNotNull())
    return Crawl(
        every.select("url", "depth", "parent", "reason"),
        every.where("body is not null").select("url", "used_url", "final_url", "depth", "status", "content_type", "body", "content", "path", "bytes", "start", "action", "last_modified"),
        asked_for.select("url", "depth", "status", "cookies", "attempts", "error", "failure", exit_code(F.col("failure")).alias("code")),
        totals,
        session,
    )


def within_quota(pages: DataFrame, quota: int, *, order: tuple[str, ...] = ("depth", "url"), size: str = "bytes", parts: int = 64) -> DataFrame:
    """The rows that are begun before ``quota`` bytes have been fetched, in this order:
    those before which less than the quota stands.

    Sums of range-partitioned parts come first, so that no task holds the whole order:
    only the running sum of part totals (at most ``parts`` rows) is ordered in one task.
    """
    parts = max(parts, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = pages.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    ranged = stored(ranged)
    totals = ranged.groupBy("_part").agg(F.sum(size).alias("_sum"))
    before = totals.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(size).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("bytes_before", F.col("_before") + F.col("_inside")).where(F.col("bytes_before") < quota).select(*pages.columns, "bytes_before")


def redirects(start: DataFrame, hops: DataFrame, limit: int = 20) -> DataFrame:
    """``url``, ``final``, ``hops`` and ``ok`` for each start URL of a table of redirects
    (source, location): relative locations are joined; more than ``limit`` is an error."""
    now = start.select("url", F.col("url").alias("final"), F.lit(0).alias("hops"), F.lit(False).alias("done"))
    table = hops.groupBy(F.col("source").alias("_from")).agg(F.min("location").alias("_to"))
    for _ in range(limit + 1):
        step = now.join(table, F.col("final") == F.col("_from"), "left")
        moved = F.col("_to").isNotNull() & ~F.col("done")
        now = step.select("url", F.when(moved, urls.join(F.col("final"), F.col("_to"))).otherwise(F.col("final")).alias("final"), (F.col("hops") + moved.cast("int")).alias("hops"), (~moved).alias("done"))
        now = stored(now)
        if not now.where("not done").limit(1).count():
            break
    return now.select("url", "final", "hops", (F.col("hops") <= limit).alias("ok"))


#: Exit codes by severity, least first.  Fixed values.
SEVERITY = {"success": (0, 0), "generic": (1, 1), "parse": (2, 2), "server": (8, 3), "io": (3, 4), "protocol": (7, 5), "network": (4, 6), "ssl": (5, 7), "auth": (6, 8)}


RANKS = dict(SEVERITY.values())


def code_of(rank: int) -> int:
    return next(code for code, r in SEVERITY.values() if r == rank)


def exit_code(failure: Column) -> Column:
    """The exit code of a kind of failure; ``ok`` and unknown kinds have none."""
    out = F.lit(0)
    for name, (code, _) in SEVERITY.items():
        out = F.when(failure == name, F.lit(code)).otherwise(out)
    return out


def severity(code: Column) -> Column:
    out = F.lit(0)
    for number, rank in SEVERITY.values():
        out = F.when(code == number, F.lit(rank)).otherwise(out)
    return out


def worst_status(df: DataFrame, *, code: str = "code") -> DataFrame:
    """The most severe exit code of all rows; 0 without rows."""
    return df.agg(F.coalesce(F.max_by(code, severity(F.col(code))), F.lit(0)).alias("status"), F.count(F.lit(1)).alias("jobs"))


def first_success(attempts: DataFrame, *, key: str = "url", keep_bad: bool = False) -> DataFrame:
    """Mirror failover over (url, pos, downloaded, verified): the first candidate that
    both succeeded; with ``keep_bad`` the first mismatch ends the search, its file kept."""
    ok = F.min(F.when(F.col("downloaded") & F.col("verified"), F.col("pos")))
    bad = F.min(F.when(F.col("downloaded") & ~F.col("verified"), F.col("pos")))
    out = attempts.groupBy(key).agg(ok.alias("ok"), bad.alias("bad"))
    stop = F.col("bad").isNotNull() & (F.col("ok").isNull() | (F.col("bad") < F.col("ok"))) & F.lit(keep_bad)
    return out.select(key, F.when(stop, F.col("bad")).otherwise(F.col("ok")).alias("pos"), (F.col("ok").isNotNull() & ~stop).alias("success"))


def retries(attempts: DataFrame, config: CrawlConfig, *, key: str = "url") -> DataFrame:
    """Over an attempt log (url, attempt, ok, host_error): how many were made until success
    or the end of tries, whether it succeeded, and the seconds waited between them."""
    stop = F.col("ok") | (F.col("host_error") & F.lit(not config.retry_on_host_error))
    if config.tries:
        stop = stop | (F.col("attempt") >= config.tries)
    last = attempts.groupBy(key).agg(F.coalesce(F.min(F.when(stop, F.col("attempt"))), F.max("attempt")).alias("made"))
    wait = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("made") - 1, F.lit(1))), F.lit(0.0), lambda a, i: a + F.least(i.cast("double"), F.lit(float(config.waitretry))))
    done = attempts.join(last, key).where(F.col("attempt") == F.col("made")).select(key, "made", F.col("ok").alias("success"))
    return done.withColumn("waited", F.when(F.col("made") > 1, wait).otherwise(F.lit(0.0)))
