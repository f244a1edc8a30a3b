"""Queries of whole crawls, archives and transfers; they join those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.catalog import ENCODED, HEAD, HOST, ORIGIN, PATH, RESOLVED, TOP_HOST, links_sql, pages, query, values, values_sql
from webloom.functions import extract, listings, narrative, paths, protocol, text, urls
from webloom.operators import archive, crawl, mirrors, policy, report, schedule, transfer
from webloom.plans import config as settings
from webloom.plans.config import CrawlConfig
from webloom.sources import fetch, files

# -------------------------------------------------------------------------- crawls
#: Pages of a host in order; each links the next, every fourth but one redirects to it, and a
#: host below example.com has a robots file that forbids paths and names a sitemap.
ONE = f"(SELECT url, {HOST} AS host, {ORIGIN} AS origin, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) AS n, lead(url) OVER (PARTITION BY {HOST} ORDER BY page_id) AS next FROM (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url))"
FULL = f"""WITH RECURSIVE one AS MATERIALIZED {ONE},
  -- where the links of what is asked for lead: those of the next page, if it redirects
  body AS MATERIALIZED (SELECT a.url, CASE WHEN a.n % 4 = 2 AND a.next IS NOT NULL THEN b.next ELSE a.next END AS link FROM one a LEFT JOIN one b ON b.url = a.next),
  maps AS MATERIALIZED (SELECT DISTINCT origin || '/sitemap.xml' AS url, origin || '/extra' AS extra FROM one WHERE n = 1 AND {TOP_HOST} = 'example.com'),
  go AS (SELECT url, 0 AS depth FROM one WHERE n = 1
    UNION ALL SELECT url, 0 FROM maps WHERE EXISTS (SELECT 1 FROM one WHERE n = 1 AND origin || '/sitemap.xml' = maps.url AND NOT ({TOP_HOST} = 'example.com' AND starts_with({PATH}, '/fr/')))
    UNION ALL SELECT x.url, go.depth + 1 FROM go JOIN (SELECT url AS parent, link AS url FROM body WHERE link IS NOT NULL UNION ALL SELECT url, extra FROM maps) x ON x.parent = go.url
      WHERE go.depth < 6 AND NOT ({TOP_HOST.replace('(url', '(go.url')} = 'example.com' AND starts_with({PATH.replace('(url', '(go.url')}, '/fr/')))
  SELECT url, CAST(min(depth) AS INTEGER) AS depth, CASE WHEN {TOP_HOST} = 'example.com' AND starts_with({PATH}, '/fr/') THEN 'robots' END AS reason FROM go GROUP BY url"""


def _site(spark, d):
    one = pages(spark, d, "page_id", "url").groupBy("url").agg(F.min("page_id").alias("page_id"))
    w = W.partitionBy(urls.host(F.col("url"))).orderBy("page_id")
    each = one.select("url", F.lead("url").over(w).alias("next"), F.row_number().over(w).alias("n"), urls.origin(F.col("url")).alias("origin"))
    moved = (F.col("n") % 4 == 2) & F.col("next").isNotNull()
    html = F.concat(F.lit("<html>"), F.coalesce(F.concat(F.lit('<a href="'), "next", F.lit('">x</a>')), F.lit("")))
    corpus = each.select("url", html.alias("html"), F.lit("text/html").alias("content_type"), F.when(moved, 301).otherwise(200).alias("status"), F.when(moved, F.col("next")).alias("location"))
    listed = F.col("origin").rlike(r"[./]example\.com$")
    first = each.where("n = 1")
    none = F.lit(None).cast("string").alias("location")
    maps = first.where(listed).select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<urlset><url><loc>"), "origin", F.lit("/extra</loc></url></urlset>")).alias("html"), F.lit("text/xml").alias("content_type"), F.lit(200).alias("status"), none)
    extra = first.where(listed).select(F.concat("origin", F.lit("/extra")).alias("url"), F.lit("end").alias("html"), F.lit("text/plain").alias("content_type"), F.lit(200).alias("status"), none)
    said = F.when(listed, F.concat(F.lit("User-agent: *\nDisallow: /fr/\nSitemap: "), "origin", F.lit("/sitemap.xml"))).otherwise("")
    robots = policy.robots_rules(each.select("origin").distinct().select("origin", said.alias("body"), F.lit(True).alias("ok")))
    return first.select("url"), corpus.unionByName(maps).unionByName(extra), robots


@query(FULL)
def crawl_full(spark, d):
    """Redirects, robots rules, sitemaps and depth in one crawl."""
    seeds, corpus, robots = _site(spark, d)
    config = CrawlConfig(recursive=True, level=6)
    return crawl.crawl(seeds, crawl.corpus_source(corpus, config), config, robots=robots).visited.select("url", "depth", "reason")


CHAINED = f"(SELECT url, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS depth, lead(url) OVER (PARTITION BY {HOST} ORDER BY page_id) AS next FROM (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url))"


@query(f"""SELECT url, CAST(depth AS INTEGER) AS depth FROM (SELECT url, depth, coalesce(sum(6 + coalesce(octet_length(encode(next)) + 16, 0)) OVER (ORDER BY depth, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {CHAINED}) WHERE before < 5000""")
def crawl_quota(spark, d):
    """No page is begun once 5,000 bytes have been fetched, in the order of depth and URL."""
    from webloom.catalog import chain

    seeds, corpus = chain(spark, d)
    return crawl.crawl(seeds, crawl.corpus_source(corpus), CrawlConfig(recursive=True, level=-1, quota=5000)).pages.select("url", "depth")


META = """<metalink xmlns="urn:ietf:params:xml:ns:metalink"><file name="f"><hash type="sha-256">ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad</hash><url preference="9">http://one.example/f</url><url preference="5">http://two.example/f</url><url preference="1">http://three.example/f</url></file>
<file name="g"><url>http://one.example/g</url></file><file name="h"><hash type="md5">00</hash><url>http://one.example/h</url><url>http://two.example/h</url></file></metalink>"""
SERVED = [
    ("http://m.example/all.meta4", META, "application/metalink4+xml", None), ("http://m.example/page", "see", "text/plain", "<http://two.example/p>; rel=duplicate; pri=2, <http://three.example/p>; rel=duplicate; pri=1"),
    ("http://one.example/f", "not it", "text/plain", None), ("http://three.example/f", "abc", "text/plain", None), ("http://one.example/g", "g", "text/plain", None), ("http://one.example/h", "h", "text/plain", None), ("http://two.example/h", "h", "text/plain", None),
    ("http://two.example/p", "p", "text/plain", None),
]


@query("""SELECT * FROM (VALUES ('http://m.example/all.meta4', 'http://m.example/all.meta4', NULL, TRUE), ('http://m.example/page', 'http://m.example/page', NULL, TRUE), ('http://one.example/f', 'http://three.example/f', NULL, TRUE),
  ('http://one.example/g', 'http://one.example/g', NULL, TRUE), ('http://three.example/p', 'http://two.example/p', NULL, TRUE)) AS v(url, used_url, reason, fetched)""")
def crawl_mirrors(spark, d):
    """Files that a metalink and a Link header name, each from the first mirror whose content
    hashes as it should; one has none."""
    corpus = values(spark, SERVED, "url string, html string, content_type string, link string")
    config = CrawlConfig(metalink_over_http=True)
    found = crawl.crawl(values(spark, [("http://m.example/all.meta4",), ("http://m.example/page",)], "url string"), crawl.corpus_source(corpus, config), config)
    return found.pages.join(found.visited.select("url", "reason"), "url").select("url", "used_url", "reason", F.lit(True).alias("fetched"))


ATTEMPTS = [("a", 0, False, False), ("a", 1, True, False), ("a", 2, True, True), ("b", 0, True, True), ("c", 0, True, False), ("d", 0, False, False)]


@query("SELECT * FROM (VALUES ('a', 2, TRUE, 1, FALSE), ('b', 0, TRUE, 0, TRUE), ('c', NULL, FALSE, 0, FALSE), ('d', NULL, FALSE, NULL, FALSE)) AS v(url, pos, success, kept_pos, kept_success)")
def mirror_failover(spark, d):
    log = values(spark, ATTEMPTS, "url string, pos int, downloaded boolean, verified boolean")
    kept = crawl.first_success(log, keep_bad=True).select("url", F.col("pos").alias("kept_pos"), F.col("success").alias("kept_success"))
    return crawl.first_success(log).join(kept, "url")


@query(f"""WITH saved AS (SELECT url, './' || regexp_extract(url, '([^/?#]*)$', 1) || '.sav' AS path FROM (SELECT DISTINCT url FROM {CHAINED})),
  hit AS (SELECT c.url, c.next, min_by(struct_pack(u := s.url, p := s.path), s.url) AS h FROM {CHAINED} c LEFT JOIN saved s ON starts_with(c.next, s.url) GROUP BY c.url, c.next)
  SELECT url, '<html>' || CASE WHEN next IS NULL THEN '' ELSE '<a href="' || coalesce(replace(next, h.u, h.p), next) || '">x</a>' END AS html FROM hit""")
def convert_links(spark, d):
    """The URLs of saved pages in a page, by an equi-join on what it holds."""
    from webloom.catalog import chain

    _, corpus = chain(spark, d)
    path = F.concat(F.lit("./"), F.regexp_extract("url", "([^/?#]*)$", 1), F.lit(".sav"))
    each = corpus.select("url", F.col("html").alias("body"), path.alias("named"))
    # the paths repeat, so documents are known by their URL
    saved = each.select("url", "body", F.concat("named", F.lit("\n"), "url", F.lit("\n")).alias("path"))
    done = transfer.converted(saved, CrawlConfig())
    return done.select(F.regexp_extract("path", "\n([^\n]*)\n", 1).alias("url"), F.regexp_replace("html", "\n[^\n]*\n", "").alias("html"))


# ------------------------------------------------------------------- lists and files
@query("SELECT page_id, url FROM pages")
def url_list_lines(spark, d):
    """URLs of list files with comments, blank lines and spaces."""
    lists = pages(spark, d, "page_id", "url").select("page_id", F.concat(F.lit("# urls\n\n  "), "url", F.lit(" \r\n#"), "url").alias("text"))
    return transfer.input_links(lists, CrawlConfig(), keep=("page_id",))


@query(f"SELECT DISTINCT 'http://in.example' || {ENCODED.format('href')} AS url FROM ({links_sql()}) UNION SELECT 'http://in.example/b.png'")
def input_file_links(spark, d):
    """Input files read as HTML and as style sheets against a base."""
    texts = pages(spark, d, "html").select(F.concat("html", F.lit("<style>a{b:url(b.png)}</style>")).alias("text"))
    return transfer.input_links(texts, CrawlConfig(force_html=True, force_css=True, base="http://in.example/a")).distinct()


RC_TEXT = "# rc\nNo_Clobber = on\nrec-level = inf\nquota = 2k\ntimeout=3m\nrobots = off\nuser_agent = x y\n"
RC_WANTED = [("level", "-1"), ("no_clobber", "True"), ("quota", "2048"), ("read_timeout", "180.0"), ("user_agent", "x y")]


@query(f"SELECT name, value FROM {values_sql(RC_WANTED, 'name string, value string')}")
def rc_settings(spark, d):
    got = settings.load_rc(CrawlConfig(), [RC_TEXT])
    return values(spark, [(n, str(getattr(got, n))) for n, _ in RC_WANTED], "name string, value string")


ARGV = ["-r", "-l", "0", "-A", "*.a,*.b", "--header=A: 1", "--header", "B: 2", "-A*.c", "-m", "http://x/", "--", "-y"]
ARGV_WANTED = [("accept", "*.c"), ("headers", "A: 1|B: 2"), ("level", "-1"), ("recursive", "True"), ("timestamping", "True"), ("urls", "http://x/|-y")]


@query(f"SELECT name, value FROM {values_sql(ARGV_WANTED, 'name string, value string')}")
def command_line(spark, d):
    """Lists given again replace those before, headers add up; the mirror preset; seeds."""
    got = settings.parse_args(ARGV)
    said = lambda x: "|".join(x) if isinstance(x, list) else str(x)
    return values(spark, [(n, said(getattr(got, n))) for n, _ in ARGV_WANTED], "name string, value string")


SEED = f"(CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '#.*$', '') ELSE 'http://base.example' || regexp_extract(url, '^[^/]*//[^/?#]*([^#]*)', 1) END)"


@query(f"SELECT page_id, CASE WHEN {PATH} = '/' AND page_id % 2 = 1 THEN {SEED} ELSE {SEED} END AS url FROM pages")
def argument_seeds(spark, d):
    """Seeds as given: whole URLs, and paths that a base completes."""
    p = pages(spark, d, "page_id", "url")
    line = F.when(F.col("page_id") % 2 == 0, urls.without_fragment(F.col("url"))).otherwise(F.regexp_extract("url", "^[^/]*//[^/?#]*([^#]*)", 1))
    return p.select("page_id", urls.resolve_input(line, "http://base.example/x/y").alias("url"))


@query(f"SELECT CASE WHEN page_id % 2 = 0 THEN '.' ELSE '' END || {HOST} || chr(9) || CASE WHEN page_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END || chr(9) || '/' || chr(9) || CASE WHEN starts_with(url, 'https') THEN 'TRUE' ELSE 'FALSE' END || chr(9) || page_id || chr(9) || 'id' || chr(9) || 'v' AS value FROM pages WHERE page_id % 3 > 0")
def cookie_file_lines(spark, d):
    """Cookies to keep; those of a session are left out."""
    u = F.col("url")
    jar = pages(spark, d, "page_id", "url").select(
        F.concat(F.when(F.col("page_id") % 2 == 0, ".").otherwise(""), urls.host(u)).alias("domain"), F.lit("/").alias("path"), (urls.scheme(u) == "https").alias("secure"), F.when(F.col("page_id") % 3 > 0, F.col("page_id")).alias("expiry"), F.lit("id").alias("name"), F.lit("v").alias("value")
    )
    return files.cookie_lines(jar)


@query(f"SELECT host, max_by(page_id % 2 = 0, page_id) AS include_sub, 1000 + max(page_id) AS expiry FROM (SELECT {HOST} AS host, page_id FROM pages) GROUP BY host HAVING max(page_id) % 5 > 0")
def hsts_file(spark, d):
    """The last header of a host holds, one of age 0 ends it; written as lines and read again."""
    age = F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.col("page_id"))
    said = F.concat(F.lit("max-age="), age.cast("string"), F.when(F.col("page_id") % 2 == 0, "; includeSubDomains").otherwise(""))
    seen = pages(spark, d, "page_id", "url").select(urls.host(F.col("url")).alias("host"), F.col("page_id").alias("ts"), text.hsts_header(said).alias("h"))
    log = seen.select("host", "ts", F.col("h.include_sub").alias("include_sub"), (F.col("ts") + 1000).alias("expiry"), (F.col("h.max_age") == 0).alias("deleted"))
    return files.hsts(files.hsts_lines(files.latest(log, ["host"]).select("host", "include_sub", "expiry")))


@query(f"SELECT 'domains,' || url || ',' AS value FROM pages WHERE {TOP_HOST} <> 'example.org' UNION ALL SELECT 'exclude-directories,' || url || ',' FROM pages WHERE {TOP_HOST} = 'example.org' AND starts_with({PATH}, '/en')")
def rejected_log(spark, d):
    config = CrawlConfig(domains=["example.org"], exclude_directories=["/en"])
    return report.reject_log(pages(spark, d, "url").withColumn("reason", policy.reject_reason(F.col("url"), config)))


# ------------------------------------------------------------------------ archives
SAID = len(archive.info_body(["operator: x"]))


@query(f"""WITH RECURSIVE r AS (SELECT page_id, octet_length(encode(html)) AS size, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS n, page_id % 7 AS part FROM pages),
  g AS (SELECT page_id, part, n, 0 AS segment, CAST({SAID} AS BIGINT) AS "offset", CAST({SAID} + size AS BIGINT) AS written FROM r WHERE n = 1
    UNION ALL SELECT r.page_id, r.part, r.n, CASE WHEN g.written > {SAID} AND g.written + r.size > 50000 THEN g.segment + 1 ELSE g.segment END,
      CASE WHEN g.written > {SAID} AND g.written + r.size > 50000 THEN {SAID} ELSE g.written END, CASE WHEN g.written > {SAID} AND g.written + r.size > 50000 THEN {SAID} + r.size ELSE g.written + r.size END
    FROM g JOIN r ON r.part = g.part AND r.n = g.n + 1)
  SELECT part, CAST(segment AS INTEGER) AS segment, page_id, 'response' AS type, "offset" FROM g UNION ALL SELECT part, CAST(segment AS INTEGER), min(page_id), 'warcinfo', 0 FROM g GROUP BY part, segment""")
def warc_segments(spark, d):
    """Every segment begins with a warcinfo record, and has that much less room."""
    rows = pages(spark, d).select("page_id", (F.col("page_id") % 7).alias("part"), F.lit("response").alias("type"), F.octet_length("html").cast("bigint").alias("size"))
    return archive.with_warcinfo(rows, ["operator: x"], 50_000, order="page_id").select("part", "segment", "page_id", "type", "offset")


@query("SELECT 'resource' AS type, 'metadata://webloom/log' AS url, sha1('a line') AS block_digest, 'a line' AS body")
def warc_log(spark, d):
    return archive.log_record("a line", "2024-01-02 03:04:05", spark).select("type", "url", "block_digest", F.col("body").cast("string").alias("body"))


@query(f"SELECT page_id, kind FROM (SELECT page_id, unnest(['request', 'response']) AS kind FROM pages)")
def warc_pairs(spark, d):
    """A request and a response record for each exchange, the one naming the other."""
    message = archive.http_message(F.lit(200), F.lit("OK"), F.array().cast("array<struct<name:string,value:string>>"), F.encode("html", "UTF-8"))
    own = pages(spark, d).select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"), message.alias("message"), archive.http_request(F.lit("GET"), F.lit("/"), F.lit("x"), F.array().cast("array<struct<name:string,value:string>>")).alias("request"), F.timestamp_seconds("page_id").alias("ts"), F.lit("response").alias("record_type"))
    got = archive.warc_records(archive.with_digests(own))
    named = got.where("type = 'request'").select(F.col("concurrent_to").alias("record_id"), "url")
    right = got.where("type = 'response'").join(named, ["record_id", "url"]).select("url", "type").unionByName(got.where("type = 'request'").select("url", "type"))
    return right.select(F.regexp_extract("url", "#([0-9]+)$", 1).cast("bigint").alias("page_id"), F.col("type").alias("kind"))


# ----------------------------------------------------------------------- transfers
def _local(spark, d):
    p = pages(spark, d, "page_id", "html").where("page_id % 2 = 0")
    return p.select(F.col("page_id").cast("string").alias("path"), F.octet_length("html").cast("bigint").alias("size"), F.timestamp_seconds("page_id").alias("mtime"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 AND octet_length(encode(html)) > 0 THEN CAST(octet_length(encode(html)) AS BIGINT) END AS start FROM pages")
def resume_offsets(spark, d):
    want = pages(spark, d, "page_id").select("page_id", F.col("page_id").cast("string").alias("path"))
    return transfer.request_plan(want, _local(spark, d), CrawlConfig(continue_download=True)).select("page_id", "start")


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN strftime(make_timestamp(page_id * 1000000), '%a, %d %b %Y %H:%M:%S GMT') END AS since FROM pages")
def conditional_requests(spark, d):
    want = pages(spark, d, "page_id").select("page_id", F.col("page_id").cast("string").alias("path"))
    return transfer.request_plan(want, _local(spark, d), CrawlConfig(timestamping=True)).select("page_id", "since")


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 OR (page_id % 2 = 0 AND page_id % 5 <> 1 AND page_id % 3 < 2) THEN 'keep' WHEN page_id % 5 = 1 THEN 'append' ELSE 'write' END AS action,
  make_timestamp((page_id + CASE WHEN page_id % 3 = 2 THEN 1 ELSE 0 END) * 1000000) AS mtime FROM pages""")
def transfer_actions(spark, d):
    """Kept if not modified or, without conditional requests, no newer; a rest is appended."""
    i = F.col("page_id")
    later = F.timestamp_seconds(i + F.when(i % 3 == 2, 1).otherwise(0))
    got = pages(spark, d, "page_id").select("page_id", i.cast("string").alias("path"), F.when(i % 5 == 0, 304).when(i % 5 == 1, 206).otherwise(200).alias("status"), F.when(i % 5 == 1, F.lit(7)).cast("bigint").alias("start"), transfer.http_date_of(later).alias("last_modified"))
    done = transfer.outcome(got, _local(spark, d), CrawlConfig(timestamping=True, if_modified_since=False))
    return done.select("page_id", "action", F.col("mtime").cast("timestamp_ntz").alias("mtime"))


def _bodies(spark, d):
    i = F.col("page_id")
    headers = F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html").alias("value")))
    return pages(spark, d).select(i.cast("string").alias("path"), F.when(i % 3 == 0, "append").when(i % 3 == 1, "keep").otherwise("write").alias("action"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(200).alias("status"), F.lit("OK").alias("reason"), headers.alias("headers"), F.encode("html", "UTF-8").alias("body"))


@query(f"SELECT CAST(page_id AS VARCHAR) AS path, sha1(CASE WHEN page_id % 3 = 0 THEN '' ELSE {HEAD} END || html) AS digest FROM pages WHERE page_id % 3 <> 1")
def saved_contents(spark, d):
    """What goes to disk with heads saved: none before what is appended, nothing where a file is kept."""
    return transfer.contents(_bodies(spark, d), CrawlConfig(save_headers=True)).select("path", F.sha1("content").alias("digest"))


@query("SELECT count(*) AS pages, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS left_over FROM pages")
def delete_after(spark, d):
    """Pages are fetched and counted, and none is left."""
    rows = _bodies(spark, d)
    left = transfer.contents(rows, CrawlConfig(delete_after=True)).agg(F.count(F.lit(1)).alias("left_over"))
    return rows.agg(F.count(F.lit(1)).alias("pages"), F.sum(F.octet_length("body").cast("bigint")).alias("bytes")).join(F.broadcast(left))


@query("SELECT CAST(page_id AS VARCHAR) AS path, url || '#f' AS origin_url, url AS referrer_url, 'text/html' AS mime_type FROM pages")
def file_attributes(spark, d):
    return transfer.attributes(pages(spark, d, "page_id", "url").select(F.col("page_id").cast("string").alias("path"), "url", F.concat("url", F.lit("#f")).alias("final_url"), F.lit("text/html; charset=x").alias("content_type")))


@query(f"SELECT DISTINCT regexp_extract({PATH}, '^(.*/)', 1) || '.listing' AS path, TRUE AS kept FROM pages")
def listing_files(spark, d):
    return transfer.listings(pages(spark, d, "url").select(urls.path(F.col("url")).alias("path")), CrawlConfig(keep_listing=True)).distinct()


FTP_SIZES = [(1, None, 10, "retr", None), (2, 4, 10, "rest", 4), (3, 10, 10, "complete", None), (4, 12, 10, "complete", None), (5, 4, None, "rest", 4), (6, 0, 10, "retr", None)]
FTP_DDL = "id int, start bigint, size bigint, action string, rest bigint"


@query(f"SELECT id, action, rest FROM {values_sql(FTP_SIZES, FTP_DDL)}")
def ftp_resume(spark, d):
    return values(spark, FTP_SIZES, FTP_DDL).select("id", transfer.ftp_plan(F.col("start"), F.col("size")).alias("p")).select("id", "p.action", "p.rest")


@query("SELECT page_id, page_id % 3 = 0 AND page_id % 2 = 0 AS bad FROM pages")
def length_mismatches(spark, d):
    i = F.col("page_id")
    size = F.octet_length("html").cast("bigint")
    return pages(spark, d).select("page_id", policy.length_mismatch(size + F.when(i % 3 == 0, 1).otherwise(0), size, i % 2 == 1).alias("bad"))


BOUNDS = [(0, 268435456), (8388608, 268435456), (8388609, 268435488), (1 << 30, 32 << 30)]


@query(f"SELECT length, most FROM {values_sql(BOUNDS, 'length bigint, most bigint')}")
def inflate_bounds(spark, d):
    return values(spark, [(n, fetch.inflate_bound(n)) for n, _ in BOUNDS], "length bigint, most bigint")


PASV = [(1, "227 Entering Passive Mode (127,0,0,1,195,80).", "127.0.0.1:50000"), (2, "227 no address", None), (3, "227 (1,2,3)", None), (4, "227 (1,2,3,4,999,1)", None)]


@query(f"SELECT id, address FROM {values_sql(PASV, 'id int, reply string, address string')}")
def passive_replies(spark, d):
    return values(spark, PASV, "id int, reply string, address string").select("id", protocol.passive_address(F.col("reply")).alias("address"))


PORTS = [("10.0.0.9", 50001, "PORT 10,0,0,9,195,81"), ("2001:db8::1", 21, "EPRT |2|2001:db8::1|21|")]


@query(f"SELECT ip, command FROM {values_sql(PORTS, 'ip string, port int, command string')}")
def port_commands(spark, d):
    return values(spark, PORTS, "ip string, port int, command string").select("ip", protocol.port_command(F.col("ip"), F.col("port")).alias("command"))


@query("SELECT page_id, lower(sha256(html)) || CASE WHEN page_id % 2 = 0 THEN ',' || lower(sha256(url)) ELSE '' END AS pins, TRUE AS refused FROM pages")
def pinned_keys(spark, d):
    """Pins of 32 bytes in base64; of another length they are refused."""
    pin = lambda c: F.concat(F.lit("sha256//"), F.base64(F.unhex(F.sha2(c, 256))))
    spec = F.concat(pin(F.col("html")), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("; "), F.replace(pin(F.col("url")), F.lit("sha256"), F.lit("SHA256")))).otherwise(";"))
    return pages(spark, d).select("page_id", F.array_join(protocol.pinned_keys(spec), ",").alias("pins"), protocol.pinned_keys(F.concat(spec, F.lit(";sha256//QQ=="))).isNull().alias("refused"))


ADDRESSES = [(1, "::1 1.1.1.1 ::2 2.2.2.2", "ipv4", "1.1.1.1 2.2.2.2 ::1 ::2", "::1 ::2"), (2, "1.1.1.1 ::1", "ipv6", "::1 1.1.1.1", "::1"), (3, "", "ipv6", "", "")]


@query(f"SELECT id, ordered, six FROM {values_sql(ADDRESSES, 'id int, given string, family string, ordered string, six string')}")
def address_order(spark, d):
    df = values(spark, ADDRESSES, "id int, given string, family string, ordered string, six string")
    given = F.filter(F.split("given", " "), lambda a: a != "")
    said = lambda c: F.array_join(c, " ")
    chosen = F.when(F.col("family") == "ipv4", said(protocol.ordered_addresses(given, "IPv4"))).otherwise(said(protocol.ordered_addresses(given, "IPv6")))
    return df.select("id", chosen.alias("ordered"), said(protocol.ordered_addresses(given, only="ipv6")).alias("six"))


@query("SELECT page_id, greatest((octet_length(encode(html)) - 2000) / 1000.0::DOUBLE, 0.0::DOUBLE) AS seconds FROM pages")
def limited_rate(spark, d):
    return pages(spark, d).select("page_id", schedule.transfer_seconds(F.octet_length("html"), 1000).cast("double").alias("seconds"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'ISO-8859-1' END AS charset FROM pages")
def charset_labels(spark, d):
    i = F.col("page_id")
    header = F.when(i % 3 == 0, "text/html; Charset=utf-8").when(i % 3 == 1, 'text/html;a=b; charset="ISO-8859-1"').otherwise("text/html")
    return pages(spark, d, "page_id").select("page_id", text.charset(header).alias("charset"))


@query("SELECT page_id, strftime(make_timestamp(page_id * 86400000000), '%a, %d %b %Y %H:%M:%S GMT') AS http, make_timestamp(page_id * 86400000000) AS again FROM pages")
def http_dates(spark, d):
    said = pages(spark, d, "page_id").select("page_id", transfer.http_date_of(F.timestamp_seconds(F.col("page_id") * 86400)).alias("http"))
    return said.select("page_id", "http", text.http_date(F.col("http")).cast("timestamp_ntz").alias("again"))


STS = [(1, "max-age=31536000; includeSubDomains", 31536000, True), (2, 'Max-Age="5"', 5, False), (3, "includeSubDomains", None, None), (4, "a=b; max-age=0", 0, False)]


@query(f"SELECT id, max_age, include_sub FROM {values_sql(STS, 'id int, header string, max_age bigint, include_sub boolean')}")
def transport_headers(spark, d):
    return values(spark, STS, "id int, header string, max_age bigint, include_sub boolean").select("id", text.hsts_header(F.col("header")).alias("h")).select("id", "h.max_age", "h.include_sub")


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS target, 'CONNECT h:443 HTTP/1.1' || chr(13) || chr(10) || 'Host: h:443' || chr(13) || chr(10) || 'Proxy-Authorization: Basic bWU6cHc=' || chr(13) || chr(10) || chr(13) || chr(10) AS connect FROM pages")
def proxy_requests(spark, d):
    secret = F.concat(F.regexp_extract("url", "^([^:]*://)", 1), F.lit("me:pw@"), F.regexp_extract("url", "^[^:]*://(.*)$", 1))
    return pages(spark, d, "page_id", "url").select("page_id", narrative.proxy_target(secret).alias("target"), narrative.connect_request(F.lit("h"), F.lit(443), "me", "pw").alias("connect"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'ftp://f.example/d/' || page_id END AS url FROM pages")
def ftp_injection(spark, d):
    """A name with a line end never becomes a URL."""
    name = F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 1, "\r\nDELE x").otherwise(""))
    return pages(spark, d, "page_id").select("page_id", listings.child_url(F.lit("ftp://f.example/d/"), name).alias("url"))


@query("SELECT domain, name, value FROM (SELECT 'd' || (page_id % 10) AS domain, 'n' || (page_id % 3) AS name, max_by(page_id, page_id) AS last, CAST(max(page_id) AS VARCHAR) AS value FROM pages GROUP BY 1, 2) WHERE last % 4 > 0")
def cookie_upserts(spark, d):
    i = F.col("page_id")
    log = pages(spark, d, "page_id").select(F.concat(F.lit("d"), (i % 10).cast("string")).alias("domain"), F.concat(F.lit("n"), (i % 3).cast("string")).alias("name"), i.cast("string").alias("value"), i.alias("ts"), (i % 4 == 0).alias("deleted"))
    return files.latest(log, ["domain", "name"]).select("domain", "name", "value")


@query(f"SELECT page_id, url FROM ({RESOLVED})")
def links_once_searched(spark, d):
    """The links that a crawl would follow: those of page_links, without feeds."""
    p = pages(spark, d, "page_id", "url", F.col("html").alias("body"), F.lit("text/html").alias("content_type"))
    return crawl.page_links(p, CrawlConfig(), feeds=False, keep=("page_id",)).select("page_id", "url")
