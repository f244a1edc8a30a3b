"""Queries of what a crawl remembers, how it ends, and archives that are read back; they join
those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.catalog import CHAIN, HEAD, HOST, SCHEME, TOP_HOST, _responses, chain, pages, query
from webloom.functions import urls
from webloom.operators import archive, crawl, session, transfer
from webloom.plans.config import CrawlConfig
from webloom.sources import warc_files
from webloom.store import new_folder

# ------------------------------------------------------------------------- sessions
#: Each page of a host says: the last page here; the last page of its kind below the domain;
#: a cookie that even pages take back; one for https alone; one for a path.
SESSION = f"""WITH one AS MATERIALIZED (SELECT c.*, {HOST} AS host, {TOP_HOST} AS top, {SCHEME} AS scheme FROM {CHAIN} c WHERE depth <= 3),
  kinds AS (SELECT a.url, 'k' || (w.page_id % 3) AS name, arg_max(w.page_id, (w.depth, w.url)) AS value FROM one a JOIN one w ON w.top = a.top AND w.depth < a.depth GROUP BY ALL),
  said AS (
    SELECT url, name, CAST(value AS VARCHAR) AS value, -1 AS n FROM kinds
    UNION ALL SELECT a.url, 'last', CAST(w.page_id AS VARCHAR), -1 FROM one a JOIN one w ON w.host = a.host AND w.depth = a.depth - 1
    UNION ALL SELECT a.url, 'gone', CAST(w.page_id AS VARCHAR), -1 FROM one a JOIN one w ON w.host = a.host AND w.depth = a.depth - 1 WHERE w.page_id % 2 = 1
    UNION ALL SELECT a.url, 'sec', CAST(w.page_id AS VARCHAR), -1 FROM one a JOIN one w ON w.host = a.host AND w.depth = a.depth - 1 WHERE a.scheme = 'https'
    UNION ALL SELECT a.url, 'en', CAST(w.page_id AS VARCHAR), -3 FROM one a JOIN one w ON w.host = a.host AND w.depth = a.depth - 1 WHERE regexp_matches(a.url, '^[^/]*//[^/?#]*/en(/|$|[?#])'))
  SELECT one.url, CAST(depth AS INTEGER) AS depth, string_agg(name || '=' || value, '; ' ORDER BY n, name) AS cookies FROM one LEFT JOIN said ON said.url = one.url GROUP BY one.url, depth"""


@query(SESSION)
def crawl_session(spark, d):
    """What the pages of a round say is sent with the requests of the next: host and domain
    cookies, the last word on each, taken back, for https alone, and for a path."""
    seeds, corpus = chain(spark, d)
    ids = pages(spark, d, "page_id", "url").groupBy("url").agg(F.min("page_id").cast("string").alias("id"))
    top = F.regexp_extract(urls.host(F.col("url")), r"([^.]*\.[^.]*)$", 1)
    say = lambda name, rest: F.concat(F.lit(f"{name}="), "id", F.lit(rest))
    even = F.col("id").cast("bigint") % 2 == 0
    kind = F.concat(F.lit("k"), (F.col("id").cast("bigint") % 3).cast("string"), F.lit("="), "id", F.lit("; Domain=."), top, F.lit("; Path=/"))
    said = F.array(say("last", "; Path=/"), kind, F.when(even, say("gone", "; Path=/; Max-Age=0")).otherwise(say("gone", "; path=/; Expires=Sun, 06-Nov-2094 08:49:37 GMT")), say("sec", "; Path=/; Secure; HttpOnly"), say("en", "; Path=/en"), say("far", "; Domain=elsewhere.test"))
    site = corpus.join(ids, "url").withColumn("set_cookie", said)
    config = CrawlConfig(recursive=True, level=3)
    found = crawl.crawl(seeds, crawl.corpus_source(site, config), config, session=session.Session(now=1_700_000_000))
    return found.jobs.select("url", "depth", "cookies")


@query(f"""SELECT url, depth, CASE WHEN scheme = 'http' AND depth > 0 AND bool_or(was) OVER w THEN 'https' || substr(url, 5) ELSE url END AS asked FROM (
    SELECT url, CAST(depth AS INTEGER) AS depth, {SCHEME} AS scheme, {HOST} AS host, page_id % 2 = 0 AND {SCHEME} = 'https' AS was FROM {CHAIN}) WHERE depth <= 3
  WINDOW w AS (PARTITION BY host ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def crawl_strict_transport(spark, d):
    """A host that was heard over https to want it is asked over https from the next round on."""
    seeds, corpus = chain(spark, d)
    ids = pages(spark, d, "page_id", "url").groupBy("url").agg(F.min("page_id").alias("id"))
    said = corpus.join(ids, "url").withColumn("strict_transport", F.when(F.col("id") % 2 == 0, "max-age=1000"))
    # the same page under both schemes, as a host serves it
    https = said.where(urls.scheme(F.col("url")) == "http").select(F.concat(F.lit("https"), F.substr("url", F.lit(5))).alias("url"), "html", "id", F.lit(None).cast("string").alias("strict_transport"))
    both = said.unionByName(https.join(said.select("url"), "url", "left_anti").dropDuplicates(["url"]))
    config = CrawlConfig(recursive=True, level=3)
    found = crawl.crawl(seeds, crawl.corpus_source(both, config), config, session=session.Session(now=1_700_000_000))
    return found.pages.select("url", "depth", F.col("final_url").alias("asked"))


@query("SELECT url, sha1(html) AS digest FROM (SELECT min_by(html, page_id) AS html, url FROM pages GROUP BY url)")
def crawl_charsets(spark, d):
    """Bodies in four charsets, read by what their type says."""
    one = pages(spark, d).groupBy("url").agg(F.min_by("html", "page_id").alias("text"), F.min("page_id").alias("page_id"))
    kinds = ["UTF-8", "ISO-8859-1", "UTF-16LE", "UTF-16BE"]
    label, body = F.lit(None).cast("string"), F.lit(None).cast("binary")
    for i, kind in enumerate(kinds):
        mine = F.col("page_id") % len(kinds) == i
        label, body = F.when(mine, F.lit(kind)).otherwise(label), F.when(mine, F.encode("text", kind)).otherwise(body)
    kind = F.concat(F.lit("text/html; charset="), label)
    corpus = one.select("url", body.alias("html"), F.when(F.col("page_id") % 8 == 0, "text/html").otherwise(kind).alias("content_type"))
    return crawl.crawl(one.select("url"), crawl.corpus_source(corpus), CrawlConfig()).pages.select("url", F.sha1("body").alias("digest"))


@query(f"""WITH RECURSIVE one AS MATERIALIZED (SELECT url, depth, lead(url) OVER (PARTITION BY {HOST} ORDER BY depth) AS next, CASE page_id % 9 WHEN 4 THEN 404 WHEN 7 THEN 401 WHEN 8 THEN 503 ELSE 200 END AS status FROM {CHAIN}),
  go AS (SELECT one.* FROM one WHERE depth = 0 UNION ALL SELECT one.* FROM go JOIN one ON one.url = go.next WHERE go.status = 200 AND go.depth < 5),
  jobs AS (SELECT url, CAST(depth AS INTEGER) AS depth, status, CASE status WHEN 200 THEN 0 WHEN 401 THEN 6 ELSE 8 END AS code FROM go)
  SELECT url, depth, status, code, (SELECT count(*) FROM jobs) AS attempts, (SELECT CASE WHEN bool_or(code = 6) THEN 6 WHEN bool_or(code = 8) THEN 8 ELSE 0 END FROM jobs) AS worst FROM jobs""")
def crawl_outcomes(spark, d):
    """How each request ended, and the totals that come with the writing of the rounds."""
    seeds, corpus = chain(spark, d)
    ids = pages(spark, d, "page_id", "url").groupBy("url").agg((F.min("page_id") % 9).alias("kind"))
    status = F.when(F.col("kind") == 4, 404).when(F.col("kind") == 7, 401).when(F.col("kind") == 8, 503).otherwise(200)
    site = corpus.join(ids, "url").withColumn("status", status)
    config = CrawlConfig(recursive=True, level=5)
    found = crawl.crawl(seeds, crawl.corpus_source(site, config), config)
    return found.jobs.select("url", "depth", "status", "code", F.lit(found.totals["attempts"]).cast("bigint").alias("attempts"), F.lit(found.totals["code"]).alias("worst"))


# ------------------------------------------------------------------------- archives
def _archive(spark, d) -> str:
    """Archive files of all pages in the shared folder; the folder."""
    own = archive.with_digests(_responses(spark, d)).withColumns({"record_type": F.when(F.col("page_id") % 5 == 0, "revisit").otherwise("response"), "request": F.encode(F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), urls.host(F.col("url")), F.lit("\r\n\r\n")), "UTF-8")})
    folder = new_folder(spark)
    warc_files.write(archive.warc_records(own).repartition(4, "url"), folder, most=200_000)
    return folder


@query(f"""SELECT url, CASE WHEN page_id % 5 = 0 THEN 'revisit' ELSE 'response' END AS type, strftime(make_timestamp(page_id * 1000000), '%Y%m%d%H%M%S') AS stamp, 'text/html' AS content_type, 200 AS status,
  CAST(octet_length(encode({HEAD} || html)) AS BIGINT) AS size, 'sha1:' || sha1({HEAD} || html) AS digest, sha1({HEAD} || html) AS block_digest, sha1(html) AS payload FROM pages""")
def cdx_offsets(spark, d):
    """Each index row, and what its record holds when it is read at the row's offset."""
    folder = _archive(spark, d)
    index = warc_files.read_index(spark, folder)
    found = warc_files.records_at(index, folder).select("file", "offset", "type", "block_digest", F.sha1(archive.payload(F.col("body"))).alias("payload"), F.col("url").alias("_url"))
    met = index.join(found, ["file", "offset"]).where(F.col("url") == F.col("_url"))
    return met.select("url", "type", "stamp", "content_type", "status", "size", "digest", "block_digest", "payload")


@query(f"""SELECT type, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes FROM (
    SELECT CASE WHEN page_id % 5 = 0 THEN 'revisit' ELSE 'response' END AS type, octet_length(encode({HEAD} || html)) AS size FROM pages
    UNION ALL SELECT 'request', octet_length(encode({HOST})) + 26 FROM pages) GROUP BY type""")
def warc_scan(spark, d):
    """The records of archive files by type, with the type pushed into the reading."""
    every = warc_files.read(spark, _archive(spark, d))
    return every.where(F.col("type").isin("request", "response", "revisit")).groupBy("type").agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("bytes"))


@query("""WITH RECURSIVE r AS (SELECT page_id, octet_length(encode(html)) AS size, row_number() OVER (ORDER BY page_id) AS n FROM pages),
  g AS (SELECT page_id, n, 0 AS segment, CAST(0 AS BIGINT) AS "offset", CAST(size AS BIGINT) AS written FROM r WHERE n = 1
    UNION ALL SELECT r.page_id, r.n, CASE WHEN g.written > 0 AND g.written + r.size > 40000 THEN g.segment + 1 ELSE g.segment END,
      CASE WHEN g.written > 0 AND g.written + r.size > 40000 THEN 0 ELSE g.written END, CASE WHEN g.written > 0 AND g.written + r.size > 40000 THEN r.size ELSE g.written + r.size END
    FROM g JOIN r ON r.n = g.n + 1)
  SELECT page_id, CAST(segment AS INTEGER) AS segment, "offset" FROM g""")
def warc_rotation_long(spark, d):
    """All pages as one group, by pointer doubling."""
    rows = pages(spark, d).select("page_id", F.lit("all").alias("part"), F.octet_length("html").cast("bigint").alias("size"))
    return archive.rotate_long(rows, 40_000, order="page_id").select("page_id", F.col("segment").cast("int").alias("segment"), "offset")


# --------------------------------------------------------------------- destinations
NAMED = "'p' || (page_id % 7) || CASE WHEN page_id % 11 = 0 THEN '.2' ELSE '' END"


@query(f"""WITH want AS (SELECT page_id, {NAMED} AS path FROM pages),
  there AS (SELECT DISTINCT path FROM want WHERE page_id % 3 = 0 UNION SELECT DISTINCT path || '.' || (3 + page_id % 4) FROM want WHERE page_id % 5 = 0),
  taken AS (SELECT path FROM there UNION SELECT path FROM want),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_id) AS r FROM want),
  free AS (SELECT path, n, row_number() OVER (PARTITION BY path ORDER BY n) AS r FROM (
    SELECT p.path, n FROM (SELECT path, count(*) AS c FROM want GROUP BY path) p, generate_series(0, (SELECT count(*) + 20 FROM want)) AS s(n)
    WHERE CASE WHEN n = 0 THEN p.path NOT IN (SELECT path FROM there) ELSE p.path || '.' || n NOT IN (SELECT path FROM taken) END))
  SELECT page_id, path, CASE WHEN n = 0 THEN path ELSE path || '.' || n END AS dest FROM ranked JOIN free USING (path, r)""")
def unique_destinations(spark, d):
    """Names for a whole batch that collides with itself and with existing files."""
    i = F.col("page_id")
    name = F.concat(F.lit("p"), (i % 7).cast("string"), F.when(i % 11 == 0, ".2").otherwise(""))
    want = pages(spark, d, "page_id").select("page_id", name.alias("path"))
    there = want.where("page_id % 3 = 0").select("path").union(want.where("page_id % 5 = 0").select(F.concat("path", F.lit("."), (3 + i % 4).cast("string"))))
    return transfer.destinations(want, there, order="page_id").select("page_id", "path", "dest")
