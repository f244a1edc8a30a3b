"""The cases of small functions one by one, against values written beside them."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from webloom.catalog import values, values_sql
from webloom.functions import charset, extract, listings, paths, text, urls
from webloom.operators import archive, crawl, mirrors, policy
from webloom.plans.config import CrawlConfig
from webloom.sources import files

CASES = {}


def query(sql):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


JOINS = [
    ("http://a.example/b/c/d;p?q", r, w)
    for r, w in [
        ("g", "http://a.example/b/c/g"), ("./g", "http://a.example/b/c/g"), ("g/", "http://a.example/b/c/g/"), ("/g", "http://a.example/g"), ("//g.example", "http://g.example/"), ("?y", "http://a.example/b/c/d;p?y"), ("g?y", "http://a.example/b/c/g?y"),
        ("#s", "http://a.example/b/c/d;p?q#s"), ("g#s", "http://a.example/b/c/g#s"), (";x", "http://a.example/b/c/;x"), ("", "http://a.example/b/c/d;p?q"), (".", "http://a.example/b/c/"), ("..", "http://a.example/b/"), ("../g", "http://a.example/b/g"),
        ("../..", "http://a.example/"), ("../../../g", "http://a.example/g"), ("/./g", "http://a.example/g"), ("/../g", "http://a.example/g"), ("g.", "http://a.example/b/c/g."), ("..g", "http://a.example/b/c/..g"), ("HTTPS://X.Example:443/%41 b", "https://x.example/%41%20b"),
        ("café", "http://a.example/b/c/caf%C3%A9"), ("mailto:x@y.example", "mailto:x@y.example"),
    ]
]
CSS = [(1, "http://s.example/c/a.css", "a{background:url('i.png')} b{x:url( \"/j.png\" )}"), (2, "http://s.example/c/b.css", "@import 'no.css'; c{y:url(data:image/png;base64,AA)} d{z:url(https://o.example/k.png)} e{URL(l.png)}")]
CSS_WANTED = [(1, "http://s.example/c/i.png"), (1, "http://s.example/j.png"), (2, "https://o.example/k.png")]
FEEDS = [
    (1, "rss", "<rss><channel><item><link>http://f.example/1</link><enclosure url='/m.mp3'/></item></channel></rss>"),
    (2, "atom", "<feed xmlns='http://www.w3.org/2005/Atom'><link href='e/2'/><id>x</id></feed>"),
    (3, "sitemap", "<urlset><url><loc> http://f.example/3 </loc></url><url><loc/></url><url><loc>ftp://f.example/4</loc></url></urlset>"),
    (4, "rss", "<rss><channel><item><link>http://f.example/5</link></item><item><link>http://f.example/6</"),
    (5, "sitemap", None),
]
FEEDS_WANTED = [(1, "http://f.example/1"), (1, "http://f.example/m.mp3"), (2, "http://f.example/e/2"), (3, "http://f.example/3"), (4, "http://f.example/5")]
MIMES = [(1, "text/html; charset=utf-8"), (2, "image/png"), (3, "IMAGE/Gif"), (4, None), (5, " "), (6, "application/pdf"), (7, "imagery/x")]
STATUSES = [(1, 200, False, False, "ok"), (2, 301, True, False, "follow"), (3, 304, False, False, "keep"), (4, 416, False, True, "complete"), (5, 206, False, True, "append"), (6, 200, False, True, "restart"), (7, 404, False, False, "error"), (8, 503, False, False, "retry"), (9, 302, False, False, "ok")]
EXISTING = [(1, "a", "a,a.1,a.3", "a.2"), (2, "b", "a", "b"), (3, "c", "c,c.x,c.01", "c.1")]
HOPS = [("http://r.example/a", "b"), ("http://r.example/b", "/c"), ("http://r.example/l1", "l2"), ("http://r.example/l2", "l1")]
CODES = [(0,), (1,), (8,), (3,), (4,), (2,)]
MIRRORS = [("f", "u1", "de", 10, 0), ("f", "u2", "us", 90, 1), ("f", "u3", "DE", None, 2), ("f", "u4", None, 90, 3), ("g", "v1", None, None, 0), ("g", "v2", "fr", 1, 1)]
MIRROR_DDL = "name string, url string, location string, preference int, pos int"
MIRROR_ORDER = "CASE WHEN lower(location) = 'de' THEN 0 ELSE 1 END, preference DESC NULLS LAST, pos"
METALINK = """<metalink xmlns="urn:ietf:params:xml:ns:metalink"><file name="f.iso"><hash type="SHA256">AB12</hash><hash type="crc">1</hash><url location="de" priority="1">http://m.example/1</url><url preference="7">http://m.example/2</url><url>nowhere</url></file>
<file name="g"><metaurl mediatype="torrent">http://m.example/t</metaurl><metaurl>http://m.example/u</metaurl><metaurl mediatype="application/metalink4+xml">http://m.example/v</metaurl></file></metalink>"""
DOCS = [(1, METALINK), (2, "<metalink><file"), (3, None)]
LINKS = [(1, '<http://d.example/b>; rel=duplicate; pri=2, </a>; rel="duplicate"; pri=1, <c>; rel=duplicate, <m.meta4>; rel=describedby; type="application/metalink4+xml"; digest=SHA-256=qxI=')]
HASHES = [(1, "abc", "md5", "900150983cd24fb0d6963f7d28e17f72"), (2, "abc", "sha-1", "A9993E364706816ABA3E25717850C26C9CD0D89D"), (3, "abc", "sha-256", "00"), (4, "abc", "crc", "0")]
SIZES = [("10", 10, "10B"), ("1k", 1024, "1.00KB"), (" 1536 ", 1536, "1.50KB"), ("20M", 20971520, "20.0MB"), ("300g", 322122547200, "300GB"), ("x", None, None), ("1.5k", None, None), ("2t", 2199023255552, "2.00TB")]
TIMES = [("30", 30.0), ("1.5m", 90.0), ("2h", 7200.0), ("1d", 86400.0), ("0.25s", 0.25), ("soon", None)]
HEADERS = [
    (1, "attachment; filename=\"a b.txt\"", "a b.txt"), (2, "attachment; filename=x; filename*=UTF-8''%e2%82%ac.txt", "€.txt"), (3, "inline; filename=../../etc/pw", "pw"), (4, "attachment; filename=..", None), (5, "inline", None),
]
RANGES = [(1, "bytes 5-9/10", 10), (2, "bytes 5-9/*", 105), (3, None, 105)]
MLSD = [("type=file;size=3; a b.txt",), ("Type=dir; sub",), ("type=cdir; .",), ("type=OS.unix.slink:/t/x; ln",), ("type=weird; w",), ("type=file; a/b",), ("nospace",)]
LISTING = [("total 8",), ("drwxr-xr-x 2 u g 4096 Jan 1 2020 docs",), ("-rw-r--r-- 1 u g 5 Jan  1 12:00 a  b.txt",), ("lrwxrwxrwx 1 u g 3 Jan 1 2020 ln -> to/x",), ("-rwsr-sr-t 1 u g 3 Jan 1 2020 odd",), ("-rw-r--r-- 1 u g 5 Jan 1 2020 ..",)]
COOKIES = [("# c",), (".c.example\tTRUE\t/\tFALSE\t0\ta\t1",), ("c.example\tFALSE\t/x\tTRUE\t99\tb\t2",), ("short\tx",), ("\tTRUE\t/\tFALSE\t0\te\t5",)]
NETRC = [("# c\nmachine a.example login me password s3\nmacdef init\ncd /x\nmachine b.example login you\ndefault login anon password p",)]
CHARSETS = [(1, "windows-1251", "CFF0E8E2E5F2", "Привет"), (2, None, "C3A9", "é"), (3, "latin1", "80", "€"), (4, "no-such", "41", None)]
HOSTS = [(1, "Bücher.example", "xn--bcher-kva.example"), (2, "A.example", "a.example"), (3, None, None)]
ATTEMPTS = [("a", 1, False, False), ("a", 2, True, False), ("b", 1, False, True), ("b", 2, True, False), ("c", 1, False, False), ("c", 2, False, False), ("c", 3, False, False), ("c", 4, True, False)]


@query(f"SELECT ref, wanted AS joined FROM {values_sql(JOINS, 'base string, ref string, wanted string')}")
def url_join(spark, d):
    return values(spark, JOINS, "base string, ref string, wanted string").select("ref", urls.join(F.col("base"), F.col("ref")).alias("joined"))


@query(f"SELECT id, url FROM {values_sql(CSS_WANTED, 'id int, url string')}")
def css_links(spark, d):
    return values(spark, CSS, "id int, base string, css string").select("id", F.explode(extract.css_links(F.col("base"), F.col("css"))).alias("url"))


@query(f"SELECT id, url FROM {values_sql(FEEDS_WANTED, 'id int, url string')}")
def feed_links(spark, d):
    df = values(spark, FEEDS, "id int, kind string, xml string")
    return df.select("id", F.explode(extract.feed_links(F.lit("http://f.example/"), F.array("kind"), F.col("xml"))).alias("url"))


@query(f"SELECT id, content_type, coalesce(trim(content_type) <> '' AND (starts_with(lower(content_type), 'image/') OR lower(trim(split_part(content_type, ';', 1))) = 'text/html'), FALSE) AS ok FROM {values_sql(MIMES, 'id int, content_type string')}")
def mime_filter(spark, d):
    return values(spark, MIMES, "id int, content_type string").withColumn("ok", policy.mime_allowed(F.col("content_type"), ["image/*", "text/html"]))


@query(f"SELECT id, wanted AS what FROM {values_sql(STATUSES, 'id int, status int, located boolean, resuming boolean, wanted string')}")
def status_classes(spark, d):
    df = values(spark, STATUSES, "id int, status int, located boolean, resuming boolean, wanted string")
    return df.select("id", policy.status_class(F.col("status"), F.col("located"), F.col("resuming"), retry=[503]).alias("what"))


@query(f"SELECT id, wanted AS path FROM {values_sql(EXISTING, 'id int, path string, existing string, wanted string')}")
def unique_names(spark, d):
    df = values(spark, EXISTING, "id int, path string, existing string, wanted string")
    return df.select("id", paths.destination(F.col("path"), F.split("existing", ","), CrawlConfig(unique_names=True))["path"].alias("path"))


@query("SELECT * FROM (VALUES ('http://r.example/a', 'http://r.example/c', 2, TRUE), ('http://r.example/z', 'http://r.example/z', 0, TRUE), ('http://r.example/l1', 'http://r.example/l2', 5, FALSE)) AS v(url, final, hops, ok)")
def redirect_chain(spark, d):
    start = values(spark, [("http://r.example/a",), ("http://r.example/z",), ("http://r.example/l1",)], "url string")
    return crawl.redirects(start, values(spark, HOPS, "source string, location string"), limit=4)


@query("SELECT 4 AS status, CAST(6 AS BIGINT) AS jobs")
def exit_status_worst(spark, d):
    return crawl.worst_status(values(spark, CODES, "code int"))


@query("SELECT * FROM (VALUES ('a', 2, TRUE, 1.0::DOUBLE), ('b', 1, FALSE, 0.0::DOUBLE), ('c', 3, FALSE, 3.0::DOUBLE)) AS v(url, made, success, waited)")
def retry_log(spark, d):
    return crawl.retries(values(spark, ATTEMPTS, "url string, attempt int, ok boolean, host_error boolean"), CrawlConfig(tries=3))


@query(f"SELECT name, url, CAST(row_number() OVER (PARTITION BY name ORDER BY {MIRROR_ORDER}) AS INTEGER) AS rank FROM {values_sql(MIRRORS, MIRROR_DDL)}")
def mirror_rank(spark, d):
    return mirrors.rank_mirrors(values(spark, MIRRORS, MIRROR_DDL), "de").select("name", "url", "rank")


@query(f"SELECT name, url FROM (SELECT name, url, row_number() OVER (PARTITION BY name ORDER BY {MIRROR_ORDER}) AS r FROM {values_sql(MIRRORS, MIRROR_DDL)}) WHERE r = 1")
def mirror_pick(spark, d):
    return mirrors.pick_mirror(values(spark, MIRRORS, MIRROR_DDL), "de")


@query("SELECT * FROM (VALUES (1, 0, 'http://d.example/a', 'http://d.example/x/m.meta4'), (1, 1, 'http://d.example/b', 'http://d.example/x/m.meta4'), (1, 2, 'http://d.example/x/c', 'http://d.example/x/m.meta4')) AS v(id, pos, url, described)")
def link_duplicates(spark, d):
    df = values(spark, LINKS, "id int, header string").select("id", mirrors.duplicates(text.link_header(F.col("header")), F.lit("http://d.example/x/y")).alias("l"))
    return df.select("id", F.posexplode("l.urls").alias("pos", "url"), F.col("l.describedby").alias("described"))


@query("SELECT * FROM (VALUES (1, TRUE), (2, TRUE), (3, FALSE), (4, TRUE)) AS v(id, ok)")
def hash_verify(spark, d):
    return values(spark, HASHES, "id int, body string, algo string, hex string").select("id", archive.verify(F.encode("body", "UTF-8"), F.col("algo"), F.col("hex")).alias("ok"))


@query("SELECT * FROM (VALUES ('https://c.example/x/y', 'b=2; a=1'), ('http://w.c.example/', 'a=1')) AS v(url, cookies)")
def cookies_sent(spark, d):
    asked = values(spark, [("https://c.example/x/y",), ("http://w.c.example/",), ("http://other.example/",)], "url string")
    return files.cookies_for(asked, files.cookies(values(spark, COOKIES, "value string")))


@query("SELECT * FROM (VALUES ('http://a.example/x', 'me', 's3'), ('http://b.example/', 'you', NULL), ('http://z.example/', 'anon', 'p')) AS v(url, login, password)")
def netrc_lookup(spark, d):
    asked = values(spark, [("http://a.example/x",), ("http://b.example/",), ("http://z.example/",)], "url string")
    return files.credentials(asked, files.netrc(values(spark, NETRC, "text string")))


@query("SELECT * FROM (VALUES (1, 'f.iso', 'http://m.example/2', 1, 'sha-256=ab12'), (1, 'f.iso', 'http://m.example/1', 2, 'sha-256=ab12')) AS v(id, name, url, rank, hashes)")
def metalink_parse(spark, d):
    doc = mirrors.documents(values(spark, DOCS, "id int, xml string")).select("id", F.explode("doc.files").alias("f"))
    return doc.select("id", "f.name", F.posexplode(mirrors.ordered_urls(F.col("f.urls"), None)).alias("pos", "url"), text.encode_hashes(F.col("f.hashes")).alias("hashes")).select("id", "name", "url", (F.col("pos") + 1).alias("rank"), "hashes")


@query("SELECT * FROM (VALUES (0, 'http://m.example/u'), (1, 'http://m.example/u'), (2, 'http://m.example/v'), (9, NULL)) AS v(n, url)")
def metaurl_nth(spark, d):
    doc = mirrors.documents(values(spark, DOCS[:1], "id int, xml string"))
    each = [doc.select(F.lit(n).alias("n"), mirrors.nth_metaurl(F.col("doc.metaurls"), n)["url"].alias("url")) for n in (0, 1, 2, 9)]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query(f"SELECT said, coalesce(n, -1) AS n, shown FROM {values_sql(SIZES, 'said string, n bigint, shown string')}")
def parse_and_format_bytes(spark, d):
    n = text.parse_bytes(F.col("said"))
    return values(spark, SIZES, "said string, n bigint, shown string").select("said", F.coalesce(n, F.lit(-1)).alias("n"), text.format_bytes(n).alias("shown"))


@query(f"SELECT said, seconds FROM {values_sql(TIMES, 'said string, seconds double')}")
def parse_seconds(spark, d):
    return values(spark, TIMES, "said string, seconds double").select("said", text.parse_seconds(F.col("said")).alias("seconds"))


@query(f"SELECT id, name FROM {values_sql(HEADERS, 'id int, header string, name string')}")
def disposition_names(spark, d):
    return values(spark, HEADERS, "id int, header string, name string").select("id", text.disposition_name(F.col("header")).alias("name"))


@query(f"SELECT id, total FROM {values_sql(RANGES, 'id int, header string, total bigint')}")
def resume_totals(spark, d):
    return values(spark, RANGES, "id int, header string, total bigint").select("id", text.resume_total(F.col("header"), F.lit(5).cast("bigint"), F.lit(100).cast("bigint")).alias("total"))


@query("SELECT * FROM (VALUES ('b.txt', 'file', NULL), ('sub', 'dir', NULL), ('ln', 'symlink', '/t/x'), ('w', 'other', NULL)) AS v(name, kind, target)")
def mlsd_entries(spark, d):
    return values(spark, MLSD, "line string").select(listings.mlsd_entry(F.col("line")).alias("e")).where("e is not null").select("e.*")


@query("SELECT * FROM (VALUES ('docs', 'dir', NULL, 493), ('a b.txt', 'file', NULL, 420), ('ln', 'symlink', 'to/x', 511), ('odd', 'file', NULL, 4077)) AS v(name, kind, target, mode)")
def unix_list_entries(spark, d):
    df = values(spark, LISTING, "line string").select(listings.unix_entry(F.col("line")).alias("e"), listings.unix_mode(F.col("line")).alias("mode"))
    return df.where("e is not null").select("e.*", "mode")


@query(f"SELECT id, wanted AS said FROM {values_sql(CHARSETS, 'id int, label string, data string, wanted string')}")
def decode_charsets(spark, d):
    df = values(spark, CHARSETS, "id int, label string, data string, wanted string")
    return df.select("id", charset.decode_bytes(F.unhex("data"), F.col("label")).alias("said"))


@query(f"SELECT id, ascii FROM {values_sql(HOSTS, 'id int, host string, ascii string')}")
def idna_hosts(spark, d):
    return values(spark, HOSTS, "id int, host string, ascii string").select("id", charset.idna_host(F.col("host")).alias("ascii"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_cases(spark, name):
    f, sql = CASES[name]
    df = f(spark, None)
    cols = ", ".join(sorted(df.columns))
    cell = lambda v: int(v) if isinstance(v, (bool, int)) else v
    assert Counter(tuple(map(cell, r)) for r in df.select(*sorted(df.columns)).collect()) == Counter(tuple(map(cell, r)) for r in duckdb.sql(f"SELECT {cols} FROM ({sql})").fetchall())
