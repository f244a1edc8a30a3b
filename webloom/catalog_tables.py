"""Queries of functions and small operators over the given tables: what they read is made of
each row's URL, text and number, so it grows with the tables.  They join those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.catalog import BASENAME, CHAIN, HOST, ORIGIN, PATH, SCHEME, pages, query, values, values_sql
from webloom.functions import charset, extract, listings, paths, text, urls
from webloom.operators import archive, crawl, mirrors, policy
from webloom.plans.config import CrawlConfig
from webloom.sources import files

FOLDER = f"regexp_extract({PATH}, '^(.*/)', 1)"


def by_page(spark, d, *cases, of: str = "page_id"):
    """The case whose turn it is at a page's number."""
    out = cases[-1]
    for i, c in reversed(list(enumerate(cases[:-1]))):
        out = F.when(F.col(of) % len(cases) == i, c).otherwise(out)
    return out


def by_page_sql(*cases: str, of: str = "page_id") -> str:
    return f"CASE {of} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


def dealt(spark, d, rows: list[tuple], ddl: str) -> DataFrame:
    """Each page with the row of a fixed list whose turn it is."""
    listed = values(spark, [(i, *r) for i, r in enumerate(rows)], f"_case int, {ddl}")
    return pages(spark, d, "page_id").join(F.broadcast(listed), F.col("page_id") % len(rows) == F.col("_case")).drop("_case")


def dealt_sql(rows: list[tuple], ddl: str) -> str:
    listed = values_sql([(i, *r) for i, r in enumerate(rows)], f"_case int, {ddl}")
    return f"(SELECT page_id, c.* EXCLUDE (_case) FROM pages JOIN {listed} c ON page_id % {len(rows)} = _case)"


#: Stands for the page's number in ``said``.
ID = object()


def said(*parts):
    """Text of literals, of columns and of the page's number."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.col("page_id").cast("string") if p is ID else p for p in parts])


@query(f"""SELECT page_id, {by_page_sql(f"{ORIGIN} || '/x/' || page_id", f"{SCHEME} || '://g.example/' || page_id", f"{ORIGIN} || {PATH} || '?y=' || page_id", "regexp_replace(url, '#.*$', '') || '#s' || page_id", f"{ORIGIN} || {FOLDER} || 'g' || page_id",
  f"{ORIGIN} || {FOLDER} || 'g' || page_id || '/'", f"{ORIGIN} || regexp_replace({FOLDER}, '[^/]+/$', '') || 'g' || page_id", "'https://x.example/%41%20' || page_id")} AS joined FROM pages""")
def url_join(spark, d):
    ref = by_page(spark, d, said("/x/", ID), said("//g.example/", ID), said("?y=", ID), said("#s", ID), said("g", ID), said("./g", ID, "/"), said("../g", ID), said("HTTPS://X.Example:443/%41 ", ID))
    return pages(spark, d, "page_id", "url").select("page_id", urls.join(F.col("url"), ref).alias("joined"))


@query(f"SELECT page_id, url FROM pages UNION ALL SELECT page_id, {ORIGIN} || '/i/' || page_id || '.png' FROM pages")
def css_links(spark, d):
    css = said("@import 'no.css'; a{b:url('", F.col("url"), "')} c{d:url( \"/i/", ID, '.png" )} e{f:url(data:image/png;base64,AA)} g{URL(l.png)}')
    return pages(spark, d, "page_id", "url").select("page_id", F.explode(extract.css_links(F.col("url"), css)).alias("url"))


@query(f"SELECT page_id, url FROM pages UNION ALL SELECT page_id, {ORIGIN} || '/m' || page_id FROM pages WHERE page_id % 3 = 0")
def feed_links(spark, d):
    u = F.replace("url", F.lit("&"), F.lit("&amp;"))
    xml = by_page(
        spark, d, said("<rss><channel><item><link>", u, "</link><enclosure url='/m", ID, "'/></item><item><link>cut"), said("<feed xmlns='http://www.w3.org/2005/Atom'><link href='", u, "'/><id>x</id></feed>"), said("<urlset><url><loc> ", u, " </loc></url><url><loc/></url></urlset>")
    )
    kind = by_page(spark, d, F.lit("rss"), F.lit("atom"), F.lit("sitemap"))
    return pages(spark, d, "page_id", "url").select("page_id", F.explode(extract.feed_links(F.col("url"), F.array(kind), xml)).alias("url"))


MIMES = [("text/html; charset=utf-8",), ("image/png",), ("IMAGE/Gif",), (None,), (" ",), ("application/pdf",), ("imagery/x",)]


@query(f"SELECT page_id, coalesce(trim(content_type) <> '' AND (starts_with(lower(content_type), 'image/') OR lower(trim(split_part(content_type, ';', 1))) = 'text/html'), FALSE) AS ok FROM {dealt_sql(MIMES, 'content_type string')}")
def mime_filter(spark, d):
    return dealt(spark, d, MIMES, "content_type string").select("page_id", policy.mime_allowed(F.col("content_type"), ["image/*", "text/html"]).alias("ok"))


STATUSES = [(200, False, False, "ok"), (301, True, False, "follow"), (304, False, False, "keep"), (416, False, True, "complete"), (206, False, True, "append"), (200, False, True, "restart"), (404, False, False, "error"), (503, False, False, "retry"), (302, False, False, "ok")]
STATUS_DDL = "status int, located boolean, resuming boolean, wanted string"


@query(f"SELECT page_id, wanted AS what FROM {dealt_sql(STATUSES, STATUS_DDL)}")
def status_classes(spark, d):
    return dealt(spark, d, STATUSES, STATUS_DDL).select("page_id", policy.status_class(F.col("status"), F.col("located"), F.col("resuming"), retry=[503]).alias("what"))


@query(f"""SELECT page_id, {by_page_sql("url || '.2'", "url || '.1'", "url")} AS path FROM pages""")
def unique_names(spark, d):
    u = F.col("url")
    there = by_page(spark, d, F.array(u, said(u, ".1"), said(u, ".3")), F.array(u, said(u, ".x"), said(u, ".01")), F.array(said(u, ".1")))
    return pages(spark, d, "page_id", "url").select("page_id", paths.destination(u, there, CrawlConfig(unique_names=True))["path"].alias("path"))


@query(f"""SELECT a.url, b.url AS final, CAST(b.depth AS INTEGER) AS hops, b.depth <= 4 AS ok FROM {CHAIN} a JOIN (SELECT *, {HOST} AS h FROM {CHAIN}) b ON b.h = {HOST.replace('(url', '(a.url')} AND a.depth = 0
  WHERE b.depth = least(5, (SELECT max(depth) FROM {CHAIN} c WHERE {HOST.replace('(url', '(c.url')} = b.h))""")
def redirect_chain(spark, d):
    """Each page of a host leads to the next; more than four hops are too many."""
    one = pages(spark, d, "page_id", "url").groupBy("url").agg(F.min("page_id").alias("page_id"))
    w = W.partitionBy(urls.host(F.col("url"))).orderBy("page_id")
    each = one.select("url", F.lead("url").over(w).alias("location"), F.row_number().over(w).alias("n"))
    return crawl.redirects(each.where("n = 1").select("url"), each.where("location is not null").select(F.col("url").alias("source"), "location"), limit=4)


CODES = [0, 1, 8, 3, 4, 2, 7]
RANK_SQL = "CASE code " + " ".join(f"WHEN {c} THEN {r}" for c, r in crawl.SEVERITY.values()) + " END"


@query(f"SELECT arg_max(code, {RANK_SQL}) AS status, count(*) AS jobs FROM (SELECT CAST({by_page_sql(*map(str, CODES), of='user_id')} AS INTEGER) AS code FROM events)")
def exit_status_worst(spark, d):
    return crawl.worst_status(spark.read.parquet(f"{d}/events.parquet").select(by_page(spark, d, *[F.lit(c) for c in CODES], of="user_id").alias("code")))


@query("""WITH log AS (SELECT 'u' || user_id AS url, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt, event_id % 3 = 0 AS ok, event_id % 11 = 0 AS host_error FROM events),
  made AS (SELECT url, CAST(coalesce(min(attempt) FILTER (ok OR host_error OR attempt >= 3), max(attempt)) AS INTEGER) AS made FROM log GROUP BY url)
  SELECT url, made, ok AS success, CASE made WHEN 2 THEN 1.0 WHEN 3 THEN 3.0 ELSE 0.0 END::DOUBLE AS waited FROM made JOIN log USING (url) WHERE attempt = made""")
def retry_log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    log = e.select(said("u", F.col("user_id").cast("string")).alias("url"), n.alias("attempt"), (F.col("event_id") % 3 == 0).alias("ok"), (F.col("event_id") % 11 == 0).alias("host_error"))
    return crawl.retries(log, CrawlConfig(tries=3))


MIRRORS = f"(SELECT {HOST} AS name, url, {by_page_sql(chr(39) + 'de' + chr(39), chr(39) + 'us' + chr(39), chr(39) + 'DE' + chr(39), 'NULL')} AS location, CASE WHEN page_id % 5 > 0 THEN page_id % 7 END AS preference, page_id AS pos FROM pages)"
MIRROR_ORDER = "CASE WHEN lower(location) = 'de' THEN 0 ELSE 1 END, preference DESC NULLS LAST, pos"


def _mirrors(spark, d):
    place = by_page(spark, d, F.lit("de"), F.lit("us"), F.lit("DE"), F.lit(None))
    return pages(spark, d, "page_id", "url").select(urls.host(F.col("url")).alias("name"), "url", place.alias("location"), F.when(F.col("page_id") % 5 > 0, F.col("page_id") % 7).cast("int").alias("preference"), F.col("page_id").cast("int").alias("pos"))


@query(f"SELECT name, url, CAST(row_number() OVER (PARTITION BY name ORDER BY {MIRROR_ORDER}) AS INTEGER) AS rank FROM {MIRRORS}")
def mirror_rank(spark, d):
    return mirrors.rank_mirrors(_mirrors(spark, d), "de").select("name", "url", "rank")


@query(f"SELECT name, url FROM (SELECT name, url, row_number() OVER (PARTITION BY name ORDER BY {MIRROR_ORDER}) AS r FROM {MIRRORS}) WHERE r = 1")
def mirror_pick(spark, d):
    return mirrors.pick_mirror(_mirrors(spark, d), "de")


@query("""SELECT page_id, 'f' || page_id AS name, CASE r WHEN 1 THEN 'http://m.example/' || page_id ELSE url END AS url, CAST(r AS INTEGER) AS rank, 'sha-256=ab' || page_id AS hashes FROM pages, (VALUES (1), (2)) AS v(r) WHERE page_id % 10 <> 9""")
def metalink_parse(spark, d):
    u = F.replace("url", F.lit("&"), F.lit("&amp;"))
    whole = said('<metalink xmlns="urn:ietf:params:xml:ns:metalink"><file name="f', ID, '"><hash type="SHA256">AB', ID, '</hash><hash type="crc">1</hash><url location="de" priority="1">', u, '</url><url preference="7">http://m.example/', ID, "</url><url>nowhere</url></file></metalink>")
    docs = pages(spark, d, "page_id", "url").select("page_id", F.when(F.col("page_id") % 10 == 9, "<metalink><file").otherwise(whole).alias("xml"))
    doc = mirrors.documents(docs).select("page_id", F.explode("doc.files").alias("f"))
    return doc.select("page_id", "f.name", F.posexplode(mirrors.ordered_urls(F.col("f.urls"), None)).alias("pos", "url"), text.encode_hashes(F.col("f.hashes")).alias("hashes")).select("page_id", "name", "url", (F.col("pos") + 1).alias("rank"), "hashes")


@query(f"SELECT page_id, {by_page_sql(*['u'.join((chr(39) + 'http://m.example/', chr(39) + ' || page_id'))] * 2, chr(39) + 'http://m.example/v' + chr(39) + ' || page_id', 'NULL')} AS url FROM pages")
def metaurl_nth(spark, d):
    """The metaurl that was asked for, the first kind that can be read where none was."""
    xml = said('<metalink xmlns="urn:ietf:params:xml:ns:metalink"><file name="g"><metaurl mediatype="torrent">http://m.example/t</metaurl><metaurl>http://m.example/u', ID, '</metaurl><metaurl mediatype="application/metalink4+xml">http://m.example/v', ID, "</metaurl></file></metalink>")
    doc = mirrors.documents(pages(spark, d, "page_id").select("page_id", xml.alias("xml")))
    return doc.select("page_id", by_page(spark, d, *[mirrors.nth_metaurl(F.col("doc.metaurls"), n)["url"] for n in (0, 1, 2, 9)]).alias("url"))


@query(f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN {ORIGIN} || '/a' || page_id ELSE 'http://d.example/b' || page_id END AS url, {ORIGIN} || {FOLDER} || 'm.meta4' AS described FROM pages, (VALUES (0), (1)) AS v(pos)""")
def link_duplicates(spark, d):
    header = said("<http://d.example/b", ID, ">; rel=duplicate; pri=2, </a", ID, '>; rel="duplicate"; pri=1, <m.meta4>; rel=describedby; type="application/metalink4+xml"; digest=SHA-256=qxI=')
    df = pages(spark, d, "page_id", "url").select("page_id", mirrors.duplicates(text.link_header(header), F.col("url")).alias("l"))
    return df.select("page_id", F.posexplode("l.urls").alias("pos", "url"), F.col("l.describedby").alias("described"))


@query("SELECT page_id, page_id % 4 <> 2 AS ok FROM pages")
def hash_verify(spark, d):
    body = F.encode("html", "UTF-8")
    algo = by_page(spark, d, F.lit("md5"), F.lit("sha-1"), F.lit("sha-256"), F.lit("crc"))
    want = by_page(spark, d, F.md5(body), F.upper(F.sha1(body)), F.md5(body), F.lit("0"))
    return pages(spark, d, "page_id", "html").select("page_id", archive.verify(body, algo, want).alias("ok"))


@query(f"""WITH hosts AS (SELECT {HOST} AS host, min(page_id) AS n FROM pages GROUP BY 1), asked AS (SELECT DISTINCT url, {HOST} AS host, {PATH} AS path, {SCHEME} AS scheme FROM pages),
  sent AS (SELECT url, 'a' AS name, n, 1 AS size FROM asked a JOIN hosts h ON a.host = h.host OR ends_with(a.host, '.' || h.host)
    UNION ALL SELECT url, 'b', n, 3 FROM asked a JOIN hosts h ON a.host = h.host WHERE scheme = 'https' AND (path = '/en' OR starts_with(path, '/en/')))
  SELECT url, string_agg(name || '=' || n, '; ' ORDER BY size DESC, name, CAST(n AS VARCHAR)) AS cookies FROM sent GROUP BY url""")
def cookies_sent(spark, d):
    """A cookie of each host for all below it, and one for https and a path alone."""
    hosts = pages(spark, d, "page_id", "url").groupBy(urls.host(F.col("url")).alias("h")).agg(F.min("page_id").cast("string").alias("n"))
    h, n = F.col("h"), F.col("n")
    lines = hosts.select(F.explode(F.array(said(".", h, "\tTRUE\t/\tFALSE\t0\ta\t", n), said(h, "\tFALSE\t/en\tTRUE\t99\tb\t", n), F.lit("# c"), F.lit("short\tx"))).alias("value"))
    return files.cookies_for(pages(spark, d, "url").distinct(), files.cookies(lines))


@query(f"""WITH hosts AS (SELECT {HOST} AS host, min(page_id) AS n FROM pages GROUP BY 1 HAVING min(page_id) % 2 = 0)
  SELECT page_id, CASE WHEN n IS NULL THEN 'anon' ELSE 'u' || n END AS login, CASE WHEN n IS NULL THEN 'p' WHEN n % 4 = 0 THEN NULL ELSE 'p' || n END AS password FROM pages LEFT JOIN hosts ON host = {HOST}""")
def netrc_lookup(spark, d):
    """Entries of every other host, and a default; some have no password."""
    hosts = pages(spark, d, "page_id", "url").groupBy(urls.host(F.col("url")).alias("h")).agg(F.min("page_id").alias("n")).where("n % 2 = 0")
    n = F.col("n").cast("string")
    own = hosts.select(said("# c\nmachine ", F.col("h"), " login u", n, F.when(F.col("n") % 4 == 0, "").otherwise(said("\n password p", n)), "\nmacdef init\ncd /x\n").alias("text"))
    entries = files.netrc(own.union(values(spark, [("default login anon password p",)], "text string")))
    return files.credentials(pages(spark, d, "page_id", "url"), entries).select("page_id", "login", "password")


SIZES = [("10", 10, "10B"), ("1k", 1024, "1.00KB"), (" 1536 ", 1536, "1.50KB"), ("20M", 20971520, "20.0MB"), ("300g", 322122547200, "300GB"), ("x", None, None), ("1.5k", None, None), ("2t", 2199023255552, "2.00TB")]
SIZE_DDL = "said string, n bigint, shown string"


@query(f"SELECT page_id, said, coalesce(n, -1) AS n, shown FROM {dealt_sql(SIZES, SIZE_DDL)}")
def parse_and_format_bytes(spark, d):
    n = text.parse_bytes(F.col("said"))
    return dealt(spark, d, SIZES, SIZE_DDL).select("page_id", "said", F.coalesce(n, F.lit(-1)).alias("n"), text.format_bytes(n).alias("shown"))


@query(f"SELECT page_id, CAST({by_page_sql('page_id', 'page_id * 60', 'page_id * 3600', 'page_id * 86400', 'page_id + 0.25', 'NULL')} AS DOUBLE) AS seconds FROM pages")
def parse_seconds(spark, d):
    written = by_page(spark, d, said(ID), said(ID, "m"), said(ID, "h"), said(ID, "d"), said(ID, ".25s"), F.lit("soon"))
    return pages(spark, d, "page_id").select("page_id", text.parse_seconds(written).alias("seconds"))


@query(f"""SELECT page_id, {by_page_sql("'a ' || page_id || '.txt'", "'€' || page_id || '.txt'", "'pw' || page_id", "NULL", "NULL")} AS name FROM pages""")
def disposition_names(spark, d):
    header = by_page(spark, d, said('attachment; filename="a ', ID, '.txt"'), said("attachment; filename=x; filename*=UTF-8''%e2%82%ac", ID, ".txt"), said("inline; filename=../../etc/pw", ID), F.lit("attachment; filename=.."), F.lit("inline"))
    return pages(spark, d, "page_id").select("page_id", text.disposition_name(header).alias("name"))


@query(f"SELECT page_id, CAST({by_page_sql('page_id + 10', 'page_id + 100', 'page_id + 100')} AS BIGINT) AS total FROM pages")
def resume_totals(spark, d):
    header = by_page(spark, d, said("bytes 5-9/", (F.col("page_id") + 10).cast("string")), F.lit("bytes 5-9/*"), F.lit(None).cast("string"))
    return pages(spark, d, "page_id").select("page_id", text.resume_total(header, F.col("page_id"), F.lit(100).cast("bigint")).alias("total"))


@query(f"""SELECT page_id, {by_page_sql("'b' || page_id || '.txt'", "'sub' || page_id", "'ln' || page_id", "'w' || page_id", "NULL", "NULL", "NULL")} AS name, {by_page_sql("'file'", "'dir'", "'symlink'", "'other'", "NULL", "NULL", "NULL")} AS kind,
  CASE WHEN page_id % 7 = 2 THEN '/t/' || page_id END AS target FROM pages WHERE page_id % 7 < 4""")
def mlsd_entries(spark, d):
    line = by_page(spark, d, said("type=file;size=3; a b", ID, ".txt"), said("Type=dir; sub", ID), said("type=OS.unix.slink:/t/", ID, "; ln", ID), said("type=weird; w", ID), F.lit("type=cdir; ."), said("type=file; a/b", ID), F.lit("nospace"))
    return pages(spark, d, "page_id").select("page_id", listings.mlsd_entry(line).alias("e")).where("e is not null").select("page_id", "e.*")


@query(f"""SELECT page_id, {by_page_sql("'docs' || page_id", "'a b' || page_id", "'ln' || page_id", "'odd' || page_id", "NULL", "NULL")} AS name, {by_page_sql("'dir'", "'file'", "'symlink'", "'file'", "NULL", "NULL")} AS kind,
  CASE WHEN page_id % 6 = 2 THEN 'to/' || page_id END AS target, CAST({by_page_sql('493', '420', '511', '4077', 'NULL', 'NULL')} AS INTEGER) AS mode FROM pages WHERE page_id % 6 < 4""")
def unix_list_entries(spark, d):
    line = by_page(
        spark, d, said("drwxr-xr-x 2 u g 4096 Jan 1 2020 docs", ID), said("-rw-r--r-- 1 u g 5 Jan  1 12:00 a  b", ID), said("lrwxrwxrwx 1 u g 3 Jan 1 2020 ln", ID, " -> to/", ID), said("-rwsr-sr-t 1 u g 3 Jan 1 2020 odd", ID), F.lit("total 8"), F.lit("-rw-r--r-- 1 u g 5 Jan 1 2020 ..")
    )
    df = pages(spark, d, "page_id").select("page_id", listings.unix_entry(line).alias("e"), listings.unix_mode(line).alias("mode"))
    return df.where("e is not null").select("page_id", "e.*", "mode")


@query("SELECT page_id, CASE WHEN page_id % 5 < 4 THEN sha1(html) END AS digest FROM pages")
def decode_charsets(spark, d):
    body = by_page(spark, d, F.encode("html", "UTF-8"), F.encode("html", "ISO-8859-1"), F.encode("html", "UTF-16LE"), F.encode("html", "UTF-16BE"), F.encode("html", "UTF-8"))
    label = by_page(spark, d, F.lit(None).cast("string"), F.lit("latin1"), F.lit(" UTF-16LE"), F.lit("utf-16be"), F.lit("no-such"))
    return pages(spark, d, "page_id", "html").select("page_id", F.sha1(charset.decode_bytes(body, label)).alias("digest"))


HOSTS = [("Bücher.example", "xn--bcher-kva.example"), ("A.example", "a.example"), (None, None), ("日本.example", "xn--wgv71a.example")]


@query(f"SELECT page_id, ascii FROM {dealt_sql(HOSTS, 'host string, ascii string')}")
def idna_hosts(spark, d):
    return dealt(spark, d, HOSTS, "host string, ascii string").select("page_id", charset.idna_host(F.col("host")).alias("ascii"))
