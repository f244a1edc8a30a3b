"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.functions import charset, extract, listings, narrative, paths, text, urls
from webloom.operators import archive, crawl, mirrors, policy, report, schedule
from webloom.plans.config import CrawlConfig
from webloom.sources import files, ftp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "accepted_links_by_host"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return df.select(*columns) if columns else df


def values(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, int | float):
        return str(x)
    parts = str(x).replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")" if len(parts) > 1 else f"'{parts[0]}'"


def values_sql(rows: list[tuple], ddl: str) -> str:
    """A subquery with the same rows, typed by its columns."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    cols = [c.split() for c in ddl.split(", ")]
    body = ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in rows)
    said = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in cols)
    return f"(SELECT {said} FROM (VALUES {body}) AS v({', '.join(n for n, _ in cols)}))"


# ---------------------------------------------------------------------------- URLs
SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*)', 1))"
PATH = "(CASE WHEN regexp_extract(url, '^[^/?#]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^/?#]*://[^/?#]*([^?#]*)', 1) END)"
BASENAME = f"regexp_extract({PATH}, '([^/]*)/*$', 1)"
ORIGIN = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
ENCODED = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x00-\\x7F]') THEN url_encode(c) ELSE c END), '')"


@query(f"""SELECT page_id, {SCHEME} AS scheme, {HOST} AS host, {PATH} AS path,
  CASE WHEN regexp_matches(url, '^[^#]*\\?') THEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) END AS query,
  CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages""")
def url_components(spark, d):
    u = F.col("url")
    return pages(spark, d, "page_id", "url").select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"))


@query("SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages")
def url_defragment_distinct(spark, d):
    return pages(spark, d, "url").select(urls.without_fragment(F.col("url")).alias("url")).distinct()


@query("SELECT page_id, url AS normal FROM pages")
def url_normalise(spark, d):
    """Case, default ports and dot segments are put in and must come out again."""
    u = F.col("url")
    port = F.when(urls.scheme(u) == "https", ":443").otherwise(":80")
    odd = F.concat(F.upper(urls.scheme(u)), F.lit("://"), F.upper(urls.host(u)), port, F.lit("/x/.."), F.regexp_extract(u, r"^[^:]*://[^/?#]*(.*)$", 1))
    return pages(spark, d, "page_id", "url").select("page_id", urls.normalise(odd).alias("normal"))


@query("SELECT page_id, regexp_replace(url, '\\?[^#]*', '') AS url FROM pages")
def strip_query_all(spark, d):
    return pages(spark, d, "page_id", "url").select("page_id", urls.strip_query(F.col("url"), []).alias("url"))


@query("SELECT page_id, regexp_replace(url, '\\?utm_source=[^&#]*', '') AS url FROM pages")
def strip_query_named(spark, d):
    return pages(spark, d, "page_id", "url").select("page_id", urls.strip_query(F.col("url"), ["utm_source"]).alias("url"))


# --------------------------------------------------------------------- extraction
LINK_RX = r"(?i)<\s*([a-zA-Z][\w:-]*)\b[^>]*?\b(?:href|src|action|data)\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s>]+))"


def links_sql(html: str = "html", where: str = "TRUE") -> str:
    group = lambda i: f"regexp_extract_all({html}, '{LINK_RX}', {i})"
    return f"""SELECT page_id, url, lower(tag) AS tag, href FROM (
      SELECT page_id, url, unnest({group(1)}) AS tag, unnest(list_transform(list_zip({group(2)}, {group(3)}, {group(4)}),
        lambda z: coalesce(nullif(z[1], ''), nullif(z[2], ''), z[3], ''))) AS href FROM pages)
      WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:') AND {where}"""


#: Test pages behind a comment with a link and two tags that the pages do not have.
EXTRA = '<!-- <a href="/hidden">x</a> --><link href="/s.css"><img src="/p.png">'


def _links(spark, d, **options):
    df = pages(spark, d, "page_id", "html").select("page_id", F.explode(extract.html_references(F.concat(F.lit(EXTRA), "html"), **options)).alias("x"))
    return df.select("page_id", "x.tag", "x.href")


MORE_HTML = f"('{EXTRA}' || html)"


@query(f"SELECT page_id, tag, href FROM ({links_sql(MORE_HTML)})")
def html_links(spark, d):
    return _links(spark, d)


@query(f"SELECT page_id, tag, href FROM ({links_sql(MORE_HTML, where="lower(tag) IN ('link', 'img')")})")
def html_links_follow_tags(spark, d):
    return _links(spark, d, follow_tags=["LINK", "img"])


@query(f"SELECT page_id, tag, href FROM ({links_sql(MORE_HTML, where="lower(tag) <> 'link'")})")
def html_links_ignore_tags(spark, d):
    return _links(spark, d, ignore_tags=["link"])


@query(f"SELECT page_id, tag, href FROM ({links_sql(f"regexp_replace({MORE_HTML}, '(?s)<!--.*?-->', '', 'g')")})")
def html_links_strict_comments(spark, d):
    return _links(spark, d, strict_comments=True)


#: Links of the test pages are root-relative, so a join is origin and reference.
RESOLVED = f"SELECT DISTINCT page_id, url AS parent, {ORIGIN} || {ENCODED.format('href')} AS url FROM ({links_sql()})"


def resolved(spark, d, config: CrawlConfig | None = None) -> DataFrame:
    links = extract.html_links(F.col("url"), F.col("html"))
    return pages(spark, d).select("page_id", F.col("url").alias("parent"), F.explode(links).alias("url"))


@query(f"SELECT page_id, url FROM ({RESOLVED})")
def links_resolved_sorted(spark, d):
    return resolved(spark, d).select("page_id", "url")


FLAG_CONFIG = CrawlConfig(reject=["*a"], exclude_domains=["example.net"])


@query(f"""SELECT host, count(*) AS links FROM (SELECT {HOST} AS host FROM (SELECT DISTINCT url FROM ({RESOLVED}))
  WHERE NOT regexp_matches({BASENAME}, 'a$') AND NOT ({HOST} = 'example.net' OR ends_with({HOST}, '.example.net'))) GROUP BY host""")
def accepted_links_by_host(spark, d):
    """The links that pages expose and that survive policy, by host."""
    accepted, _ = policy.split_by_policy(resolved(spark, d).select("url").distinct(), FLAG_CONFIG)
    return accepted.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("links"))


@query(f"""SELECT page_id, regexp_matches({PATH}, '(?i)(\\.html?|/)$') OR contains(html, '<html') OR contains(html, '<HTML') AS is_html,
  contains(html, '<urlset') OR contains(html, '<sitemapindex') AS is_sitemap FROM pages""")
def content_sniff(spark, d):
    kind = extract.sniff(paths.local_path(F.col("url"), CrawlConfig()), F.lit("text/html"), F.col("html"))
    return pages(spark, d).select("page_id", kind["html"].alias("is_html"), kind["sitemap"].alias("is_sitemap"))


# ------------------------------------------------------------------------- policy
def _accepted(name: str, config: CrawlConfig, where: str) -> None:
    @query(f"SELECT page_id, url FROM pages WHERE {where}", name)
    def run(spark, d):
        accepted, _ = policy.split_by_policy(pages(spark, d, "page_id", "url"), config)
        return accepted


DOMAIN = "({0} = '{1}' OR ends_with({0}, '.{1}'))"
_accepted("accept_glob", CrawlConfig(accept=["*.html", "[1-4]??"]), f"regexp_matches({BASENAME}, '^(.*\\.html|[1-4]..)$')")
_accepted("reject_glob", CrawlConfig(reject=["*[!0-9]", "1*"]), f"NOT regexp_matches({BASENAME}, '^(.*[^0-9]|1.*)$')")
_accepted("accept_regex", CrawlConfig(accept_regex="/(en|de)/[[:digit:]]+"), "regexp_matches(url, '/(en|de)/[0-9]+')")
_accepted("reject_regex", CrawlConfig(reject_regex="UTM_|#TOP$", ignore_case=True), "NOT regexp_matches(url, '(?i)UTM_|#TOP$')")
_accepted("invalid_regex", CrawlConfig(reject_regex="(", accept_regex="[[:digit:]]$"), "regexp_matches(url, '[0-9]$')")
_accepted("domain_filter", CrawlConfig(domains=["example.org", "m.example.com"]), f"{DOMAIN.format(HOST, 'example.org')} OR {DOMAIN.format(HOST, 'm.example.com')}")
_accepted("exclude_domains", CrawlConfig(exclude_domains=["example.com"]), f"NOT {DOMAIN.format(HOST, 'example.com')}")
_accepted("include_dirs", CrawlConfig(include_directories=["/en", "/fr/1"]), f"starts_with({PATH}, '/en') OR starts_with({PATH}, '/fr/1')")
_accepted("exclude_dirs", CrawlConfig(exclude_directories=["/en/"]), f"NOT starts_with({PATH}, '/en/')")

REASONS = CrawlConfig(reject=["*.html"], reject_regex="utm_", domains=["example.com", "example.org"], exclude_directories=["/es"])


@query(f"""SELECT reason, count(*) AS urls FROM (SELECT CASE WHEN ends_with({BASENAME}, '.html') THEN 'reject' WHEN contains(url, 'utm_') THEN 'reject-regex'
  WHEN NOT ({DOMAIN.format(HOST, 'example.com')} OR {DOMAIN.format(HOST, 'example.org')}) THEN 'domains'
  WHEN starts_with({PATH}, '/es') THEN 'exclude-directories' END AS reason FROM pages) WHERE reason IS NOT NULL GROUP BY reason""")
def reject_reasons(spark, d):
    return report.reject_summary(pages(spark, d, "url").withColumn("reason", policy.reject_reason(F.col("url"), REASONS)))


@query(f"SELECT page_id, url FROM pages WHERE {DOMAIN.format(HOST, 'example.org')} OR {DOMAIN.format(HOST, 'tionsh.example.net')}")
def domain_join(spark, d):
    listed = values(spark, [("example.org",), ("tionsh.example.net",)], "domain string")
    return policy.domain_join(pages(spark, d, "page_id", "url"), listed)


#: A page and another as its child, to judge pairs of urls by.
PAIRS = "(SELECT a.page_id, a.url AS parent, b.url AS url FROM pages a JOIN pages b ON b.page_id = a.page_id // 2)"


def _child(name: str, config: CrawlConfig, where: str) -> None:
    @query(f"SELECT page_id, url FROM {PAIRS} WHERE {where}", name)
    def run(spark, d):
        p = pages(spark, d, "page_id", "url")
        kids = p.select(F.col("page_id").alias("k"), F.col("url").alias("child"))
        pairs = p.withColumn("k", F.floor(F.col("page_id") / 2).cast("bigint")).join(kids, "k")
        reason = policy.first_reason(policy.child_rules(F.col("child"), F.col("url"), config))
        return pairs.where(reason.isNull()).select("page_id", F.col("child").alias("url"))


PARENT_HOST, PARENT_PATH = HOST.replace("(url", "(parent"), PATH.replace("(url", "(parent")
_child("https_only", CrawlConfig(https_only=True, span_hosts=True, follow_ftp=True), f"{SCHEME} = 'https'")
_child("span_hosts", CrawlConfig(follow_ftp=True), f"{HOST} = {PARENT_HOST}")
_child("no_parent", CrawlConfig(no_parent=True, span_hosts=True), f"{SCHEME} <> 'ftp' AND starts_with({PATH}, regexp_extract({PARENT_PATH}, '^(.*/)', 1))")
_child("relative_only", CrawlConfig(relative_only=True, span_hosts=True, follow_ftp=True), f"{HOST} = {PARENT_HOST}")


def _strange(name: str, config: CrawlConfig, where: str) -> None:
    """Children beyond ASCII, of ftp, and as they are, by page_id modulo 3."""

    @query(f"SELECT page_id, url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ftp://' || split_part(url, '://', 2) WHEN 1 THEN url || 'é' ELSE url END AS url FROM pages) WHERE {where}", name)
    def run(spark, d):
        u, third = F.col("url"), F.col("page_id") % 3
        child = F.when(third == 0, F.concat(F.lit("ftp://"), F.regexp_extract(u, "://(.*)$", 1))).when(third == 1, F.concat(u, F.lit("é"))).otherwise(u)
        pairs = pages(spark, d, "page_id", "url").withColumn("child", child)
        return pairs.where(policy.first_reason(policy.child_rules(F.col("child"), u, config)).isNull()).select("page_id", F.col("child").alias("url"))


_strange("non_ascii_reject", CrawlConfig(iri=False, follow_ftp=True), "NOT regexp_matches(url, '[^\\x00-\\x7F]')")
_strange("ftp_children_reject", CrawlConfig(), "NOT starts_with(url, 'ftp:')")
_accepted("domains_without_host", CrawlConfig(domains=["example.org"], exclude_domains=["example.com"]), f"({HOST} = '' OR {DOMAIN.format(HOST, 'example.org')}) AND NOT {DOMAIN.format(HOST, 'example.com')}")


ROBOTS = [("example.com", "User-agent: other\nDisallow: /de\n# note\nUser-agent: *\nDisallow: /fr/ # rest\nAllow: /fr/1\nSitemap: http://s.example/m.xml", True), ("example.org", "Disallow:\nDisallow: /en/1", True), ("example.net", "", False)]
TOP_HOST = f"regexp_extract({HOST}, '([^.]*\\.[^.]*)$', 1)"


@query(f"""SELECT page_id, CASE {TOP_HOST} WHEN 'example.com' THEN NOT (starts_with({PATH}, '/fr/')) WHEN 'example.org' THEN NOT starts_with({PATH}, '/en/1')
  ELSE FALSE END AS allowed FROM pages""")
def robots_allowed(spark, d):
    """A robots file for each origin of three domains; one of them could not be read."""
    p = pages(spark, d, "page_id", "url")
    top = F.regexp_extract(urls.host(F.col("url")), r"([^.]*\.[^.]*)$", 1)
    fetched = p.select(urls.origin(F.col("url")).alias("origin"), top.alias("domain")).distinct().join(F.broadcast(values(spark, ROBOTS, "domain string, body string, ok boolean")), "domain")
    return policy.robots_allow(p, policy.robots_rules(fetched), "webloom/1").select("page_id", "allowed")


@query(f"SELECT DISTINCT {ORIGIN} || '/sitemap.xml' AS url FROM pages WHERE {TOP_HOST} = 'example.com'")
def sitemap_seed_once(spark, d):
    """Sitemaps named by robots files are asked for once for each host and port."""
    p = pages(spark, d, "url").select(urls.origin(F.col("url")).alias("origin")).distinct().where(F.col("origin").rlike(r"[./]example\.com$"))
    body = F.concat(F.lit("User-agent: *\nDisallow: /x\nSitemap: "), "origin", F.lit("/sitemap.xml"))
    rules = policy.robots_rules(p.select("origin", body.alias("body"), F.lit(True).alias("ok")))
    return rules.select("origin", F.explode("sitemaps").alias("url")).dropDuplicates(["origin", "url"]).select("url")


HSTS = [("example.com", True, 2_000), ("m.ththth.example.net", False, 2_000), ("example.org", True, 10), ("net", True, 2_000)]


@query(f"""SELECT page_id, CASE WHEN {SCHEME} = 'http' AND ({DOMAIN.format(HOST, 'example.com')} OR {HOST} = 'm.ththth.example.net') THEN regexp_replace(url, '^http:', 'https:') ELSE url END AS url FROM pages""")
def hsts_upgrade(spark, d):
    store = values(spark, HSTS, "host string, include_sub boolean, expiry bigint")
    return policy.hsts_upgrade(pages(spark, d, "page_id", "url"), store, 1_000).select("page_id", F.col("upgraded").alias("url"))


@query(f"SELECT page_id, {DOMAIN.format(HOST, 'example.org')} OR {DOMAIN.format(HOST, 'ththth.example.net')} AS direct FROM pages")
def no_proxy_bypass(spark, d):
    return pages(spark, d, "page_id", "url").select("page_id", policy.no_proxy(urls.host(F.col("url")), ".Example.org, ththth.example.net").alias("direct"))


# -------------------------------------------------------------------------- paths
FILE = f"(CASE WHEN ends_with({PATH}, '/') THEN 'index.html' ELSE {BASENAME} END)"


def _path(name: str, config: CrawlConfig, sql: str) -> None:
    @query(f"SELECT page_id, {sql} AS path FROM pages", name)
    def run(spark, d):
        return pages(spark, d, "page_id", "url").select("page_id", paths.local_path(F.col("url"), config).alias("path"))


DIRS = f"regexp_replace(regexp_extract({PATH}, '^/(.*/)?', 1), '', '')"
_path("local_path_flat", CrawlConfig(), f"'./' || {FILE}")
_path("local_path_tree", CrawlConfig(recursive=True, directory_prefix="out"), f"'out/' || {HOST} || '/' || coalesce({DIRS}, '') || {FILE}")
_path("local_path_cut_dirs", CrawlConfig(force_directories=True, cut_dirs=1, host_directories=False, protocol_directories=True), f"'./' || {SCHEME} || '/' || (CASE WHEN regexp_matches({PATH}, '^/[^/]+/[0-9]+/$') THEN {BASENAME} || '/' ELSE '' END) || {FILE}")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(upper(url), '[<>:"\\|?*]', '_', 'g'), '[/\n]', '_', 'g') AS name FROM pages""")
def sanitize_windows(spark, d):
    return pages(spark, d, "page_id", "url").select("page_id", paths.sanitise(F.col("url"), ["unix", "windows", "uppercase"]).alias("name"))


@query(f"SELECT page_id, CASE WHEN ends_with({FILE}, '.html') THEN {FILE} ELSE {FILE} || '.html' END AS path FROM pages")
def adjust_extension(spark, d):
    path = F.regexp_replace(paths.local_path(F.col("url"), CrawlConfig()), r"^\./", "")
    return pages(spark, d, "page_id", "url").select("page_id", paths.with_extension(path, paths.extension_for(F.lit("text/html; charset=utf-8"))).alias("path"))


# -------------------------------------------------------------------------- crawl
CHAIN = f"(SELECT page_id, url, row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1 AS depth FROM (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url))"


def chain(spark, d) -> tuple[DataFrame, DataFrame]:
    """Seeds and a corpus in which each page links the next of its host."""
    one = pages(spark, d, "page_id", "url").groupBy("url").agg(F.min("page_id").alias("page_id"))
    w = W.partitionBy(urls.host(F.col("url"))).orderBy("page_id")
    each = one.select("url", F.lead("url").over(w).alias("next"), F.row_number().over(w).alias("n"))
    html = F.concat(F.lit("<html>"), F.coalesce(F.concat(F.lit('<a href="'), "next", F.lit('">x</a>')), F.lit("")))
    return each.where("n = 1").select("url"), each.select("url", html.alias("html"))


@query(f"SELECT url, CAST(depth AS INTEGER) AS depth FROM {CHAIN} WHERE depth <= 3")
def crawl_bfs(spark, d):
    seeds, corpus = chain(spark, d)
    return crawl.crawl(seeds, crawl.corpus_source(corpus), CrawlConfig(recursive=True, level=3)).visited.select("url", "depth")


@query(f"SELECT url, CAST(depth AS INTEGER) AS depth FROM {CHAIN} WHERE depth <= 1")
def page_requisites(spark, d):
    seeds, corpus = chain(spark, d)
    return crawl.crawl(seeds, crawl.corpus_source(corpus), CrawlConfig(page_requisites=True)).visited.select("url", "depth")


@query("""SELECT page_id, before AS bytes_before FROM (SELECT page_id, CAST(coalesce(sum(octet_length(encode(html))) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM pages)
  WHERE before < 1000000""")
def quota_prefix(spark, d):
    sized = pages(spark, d).select("page_id", F.octet_length("html").cast("bigint").alias("bytes"))
    return crawl.within_quota(sized, 1_000_000, order=("page_id",)).select("page_id", "bytes_before")


@query(f"SELECT DISTINCT url FROM ({RESOLVED}) WHERE url NOT IN (SELECT url FROM ({RESOLVED}) WHERE page_id % 2 = 0)")
def visited_anti_join(spark, d):
    links = resolved(spark, d)
    return links.select("url").distinct().join(links.where("page_id % 2 = 0").select("url"), "url", "left_anti")


@query(f"""SELECT {HOST} AS host, count(*) AS pages, CAST(sum(octet_length(encode(html))) AS BIGINT) AS bytes FROM pages GROUP BY 1""")
def bytes_by_host(spark, d):
    return report.by_host(pages(spark, d).select("url", F.octet_length("html").cast("bigint").alias("bytes")))


# ------------------------------------------------------------------------ archive
def _responses(spark, d) -> DataFrame:
    message = archive.http_message(F.lit(200), F.lit("OK"), F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("text/html").alias("value"))), F.encode("html", "UTF-8"))
    return pages(spark, d).select("page_id", "url", message.alias("message"), F.timestamp_seconds("page_id").alias("ts"))


HEAD = "'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || chr(13) || chr(10)"


@query(f"SELECT page_id, sha1({HEAD} || html) AS block_digest, sha1(html) AS payload_digest FROM pages")
def payload_digest(spark, d):
    return archive.with_digests(_responses(spark, d)).select("page_id", "block_digest", "payload_digest")


@query("SELECT page_id, CASE WHEN sha1(html) IN (SELECT sha1(html) FROM pages WHERE page_id % 3 = 0) THEN 'revisit' ELSE 'response' END AS record_type FROM pages")
def warc_revisit(spark, d):
    lines = pages(spark, d).where("page_id % 3 = 0").select(F.concat(F.lit("http://x/ 2020 sha1:"), F.upper(F.sha1("html"))).alias("value"))
    own = archive.with_digests(_responses(spark, d))
    return archive.mark_revisits(own, archive.digests_of_index(lines)).select("page_id", "record_type")


@query(f"""SELECT url || ' ' || strftime(make_timestamp(page_id * 1000000), '%Y%m%d%H%M%S') || ' ' || url || ' text/html 200 sha1:' || sha1({HEAD} || html) || ' - - ' ||
  octet_length(encode({HEAD} || html)) || ' 0 out.warc.gz' AS value FROM pages""")
def cdx_rows(spark, d):
    own = archive.with_digests(_responses(spark, d))
    return archive.cdx_lines(own.withColumns({"content_type": F.lit("text/html; charset=utf-8"), "status": F.lit(200), "size": F.octet_length("message"), "offset": F.lit(0), "file": F.lit("out.warc.gz")}))


@query("""WITH RECURSIVE r AS (SELECT page_id, octet_length(encode(html)) AS size, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS n, page_id % 7 AS part FROM pages),
  g AS (SELECT page_id, part, n, 0 AS segment, CAST(0 AS BIGINT) AS "offset", CAST(size AS BIGINT) AS written FROM r WHERE n = 1
    UNION ALL SELECT r.page_id, r.part, r.n, CASE WHEN g.written > 0 AND g.written + r.size > 50000 THEN g.segment + 1 ELSE g.segment END,
      CASE WHEN g.written > 0 AND g.written + r.size > 50000 THEN 0 ELSE g.written END, CASE WHEN g.written > 0 AND g.written + r.size > 50000 THEN r.size ELSE g.written + r.size END
    FROM g JOIN r ON r.part = g.part AND r.n = g.n + 1)
  SELECT page_id, CAST(segment AS INTEGER) AS segment, "offset" FROM g""")
def warc_rotation(spark, d):
    rows = pages(spark, d).select("page_id", (F.col("page_id") % 7).alias("part"), F.octet_length("html").cast("bigint").alias("size"))
    return archive.rotate(rows, 50_000, order="page_id").select("page_id", "segment", "offset")


# ------------------------------------------------------------------------ mirrors


# -------------------------------------------------------------------- small texts


RATES = [(1, 1048576, 1.0, "1.00MB/s", "8.39Mb/s", "eta 10s"), (2, 5000, 10.0, "500B/s", "4.00Kb/s", "eta 5h49m"), (3, 200000, 1.0, "195KB/s", "1.60Mb/s", "eta 53s")]
RATES_DDL = "id int, n bigint, seconds double, rate string, bits string, eta string"


@query(f"SELECT id, rate, bits, eta FROM {values_sql(RATES, RATES_DDL)}")
def format_rates(spark, d):
    n, s = F.col("n"), F.col("seconds")
    return values(spark, RATES, RATES_DDL).select("id", text.format_rate(n, s).alias("rate"), text.format_rate(n, s, True).alias("bits"), text.format_eta(F.lit(10 * 1048576), n / s).alias("eta"))


BARS = [(1, 50, 0, 100, "[█████░░░░░]"), (2, 70, 30, 100, "[▓▓▓████░░░]"), (3, 0, 0, 0, "[░░░░░░░░░░]"), (4, 300, 0, 100, "[██████████]")]


@query(f"SELECT id, bar FROM {values_sql(BARS, 'id int, now bigint, prior bigint, total bigint, bar string')}")
def progress_bars(spark, d):
    df = values(spark, BARS, "id int, now bigint, prior bigint, total bigint, bar string")
    return df.select("id", text.render_bar(F.col("now"), F.col("prior"), F.col("total"), 10).alias("bar"))


@query("SELECT page_id, 'http://' || regexp_extract(url, '^[^:]*://(.*)$', 1) AS url FROM pages")
def redact_urls(spark, d):
    secret = F.concat(F.lit("http://me:pw@"), F.regexp_extract("url", r"^[^:]*://(.*)$", 1))
    return pages(spark, d, "page_id", "url").select("page_id", urls.redact(secret).alias("url"))


LENGTHS = [(1, 2048, 1024, "text/html", "  length 2048 (2.00KB), 1024 (1.00KB) remaining  text/html"), (2, 10, None, None, "  length 10 (10B)"), (3, None, None, "a/b", "  type a/b"), (4, None, None, None, None)]


@query(f"SELECT id, line FROM {values_sql(LENGTHS, 'id int, total bigint, already bigint, kind string, line string')}")
def length_lines(spark, d):
    df = values(spark, LENGTHS, "id int, total bigint, already bigint, kind string, line string")
    return df.select("id", narrative.length(F.col("total"), F.col("already"), F.col("kind")).alias("line"))


@query(f"""SELECT page_id, CAST(2.5 * (row_number() OVER (PARTITION BY {HOST} ORDER BY page_id) - 1) AS DOUBLE) AS at FROM pages""")
def request_schedule(spark, d):
    jobs = pages(spark, d, "page_id", "url").select("page_id", urls.host(F.col("url")).alias("host"))
    return schedule.request_times(jobs, 2.5, order="page_id").select("page_id", "at")


TREE = [("ftp://f.example/", "a.txt", "file", None), ("ftp://f.example/", "sub", "dir", None), ("ftp://f.example/", "up", "symlink", "../x"), ("ftp://f.example/sub/", "b.bin", "file", None), ("ftp://f.example/sub/", "ok", "symlink", "b.bin")]


@query("SELECT * FROM (VALUES ('ftp://f.example/a.txt', 1), ('ftp://f.example/sub/b.bin', 2), ('ftp://f.example/sub/ok', 2)) AS v(url, depth)")
def ftp_walk(spark, d):
    return ftp.walk(values(spark, [("ftp://f.example/",)], "url string"), values(spark, TREE, "url string, name string, kind string, target string"), CrawlConfig(recursive=True))


GLOBS = [("ftp://f.example/p/", "-rw-r--r-- 1 u g 5 Jan 1 2020 a.txt\nb.txt\nc.bin\nb.txt")]


@query("SELECT * FROM (VALUES ('ftp://f.example/p/a.txt'), ('ftp://f.example/p/b.txt')) AS v(url)")
def ftp_glob(spark, d):
    return ftp.expand_glob(values(spark, GLOBS, "url string, text string"), "?.txt")


BACKUPS = [(1, "f", "f,f.1", "f.1>f.2,f>f.1"), (2, "g", "f", "")]


@query(f"SELECT id, plan FROM {values_sql(BACKUPS, 'id int, path string, existing string, plan string')}")
def backup_plans(spark, d):
    df = values(spark, BACKUPS, "id int, path string, existing string, plan string")
    plan = paths.backup_plan(F.col("path"), F.split("existing", ","), 2)
    return df.select("id", F.array_join(F.transform(plan, lambda s: F.concat(s["from"], F.lit(">"), s["to"])), ",").alias("plan"))


FINAL = [(1, "http://x.example/a", "http://x.example/b/c", "./a", "text/html", None, 200, "./c.html"), (2, "http://x.example/a", "http://x.example/a", "./a", "text/css", "attachment; filename=n", 200, "./n.css"), (3, "http://x.example/a", "http://x.example/b", "./a", "text/html", None, 304, "./a")]
FINAL_DDL = "id int, request string, final string, dest string, ct string, cd string, status int, wanted string"


@query(f"SELECT id, wanted AS path FROM {values_sql(FINAL, FINAL_DDL)}")
def final_paths(spark, d):
    config = CrawlConfig(trust_server_names=True, content_disposition=True, adjust_extension=True)
    c = F.col
    return values(spark, FINAL, FINAL_DDL).select("id", paths.final_path(c("request"), c("final"), c("dest"), c("ct"), c("cd"), c("status"), F.array().cast("array<string>"), config).alias("path"))
