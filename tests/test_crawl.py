"""A small site: three levels, a cycle, another host, a style sheet, a sitemap, robots."""

import http.server
import threading

from pyspark.sql import functions as F

from webloom.operators import archive, crawl, policy, transfer
from webloom.plans.config import CrawlConfig
from webloom.sources import local, warc_files, web
from webloom.streaming import live
from webloom.streaming.frontier import crawl_stream

SITE = [
    ("http://s.example/", "<html><a href='a.html'>a</a><a href='/b/'>b</a><a href='http://o.example/'>o</a><link href='s.css'><img src=x.png>"),
    ("http://s.example/a.html", "<html><a href='/'>back</a><a href='c.html#f'>c</a>"),
    ("http://s.example/b/", "<html><a href='../private/p.html'>p</a>"),
    ("http://s.example/s.css", "a{b:url(i.png)}"),
    ("http://s.example/c.html#f", "<html>end"),
    ("http://o.example/", "<html>other"),
]
ROBOTS = [("http://s.example", "User-agent: *\nDisallow: /private", True), ("http://o.example", "", True)]


def site(spark):
    return crawl.corpus_source(spark.createDataFrame(SITE, "url string, html string"))


def seed(spark):
    return spark.createDataFrame([("http://s.example/",)], "url string")


def visited(c):
    return {(r.url, r.depth, r.reason) for r in c.visited.collect()}


def test_levels_cycles_and_robots(spark):
    robots = policy.robots_rules(spark.createDataFrame(ROBOTS, "origin string, body string, ok boolean"))
    got = visited(crawl.crawl(seed(spark), site(spark), CrawlConfig(recursive=True, level=2, reject=["*.png"]), robots=robots))
    assert got == {
        ("http://s.example/", 0, None), ("http://s.example/a.html", 1, None), ("http://s.example/b/", 1, None), ("http://s.example/s.css", 1, None),
        ("http://s.example/c.html#f", 2, None), ("http://s.example/private/p.html", 2, "robots"),
    }


def test_spans_hosts(spark):
    got = visited(crawl.crawl(seed(spark), site(spark), CrawlConfig(page_requisites=True, span_hosts=True)))
    assert ("http://o.example/", 1, None) in got and not any(d > 1 for _, d, _ in got)


def test_empty_seeds(spark):
    got = crawl.crawl(seed(spark).limit(0), site(spark), CrawlConfig(recursive=True))
    assert got.visited.count() == 0 and got.pages.count() == 0


def test_records(spark):
    df = spark.createDataFrame([("http://x/", b"GET / HTTP/1.1\r\n\r\n", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", "response")], "url string, request binary, message binary, record_type string").withColumn("ts", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    rows = warc_files.encoded(archive.warc_records(archive.with_digests(df)), compressed=False).collect()
    text = b"".join(bytes(r.bytes) for r in rows)
    assert text.count(b"WARC/1.0\r\n") == 2 and b"WARC-Date: 2024-01-02T03:04:05Z" in text and b"\r\n\r\nbody\r\n\r\n" in text


def test_fetches(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/r":
                self.send_response(302)
                self.send_header("Location", "/ok")
                self.end_headers()
                return
            self.send_response(200 if self.path == "/ok" else 404)
            self.send_header("Content-Type", "text/plain")
            self.end_headers()
            self.wfile.write(b"hello")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    df = spark.createDataFrame([(f"{base}/r",), (f"{base}/no",), ("http://127.0.0.1:1/",)], "url string")
    got = {r.url: r for r in web.fetch(df, CrawlConfig(tries=1), tasks=2).collect()}
    server.shutdown()
    assert got[f"{base}/r"].status == 200 and got[f"{base}/r"].final_url == f"{base}/ok" and bytes(got[f"{base}/r"].body) == b"hello"
    assert got[f"{base}/no"].status == 404 and got["http://127.0.0.1:1/"].error


def test_stream(spark, tmp_path):
    seed(spark).write.parquet(str(tmp_path / "seeds"))
    stream = spark.readStream.schema("url string").parquet(str(tmp_path / "seeds"))
    crawl_stream(stream, site(spark), CrawlConfig(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.url for r in spark.read.parquet(str(tmp_path / "out/visited")).collect()] == ["http://s.example/"]


def test_batches_fetch_no_page_twice(spark, tmp_path):
    """Links of a later batch are not asked for again, and a replayed batch changes nothing."""
    asked = []
    source = site(spark)

    def fetch(level):
        asked.extend(r.url for r in level.select("url").collect())
        return source(level)

    config, out = CrawlConfig(recursive=True, level=2), str(tmp_path / "out")

    def run(url):
        spark.createDataFrame([(url,)], "url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "seeds"))
        stream = spark.readStream.schema("url string").parquet(str(tmp_path / "seeds"))
        crawl_stream(stream, fetch, config, out, str(tmp_path / "ck")).awaitTermination(300)

    run("http://s.example/b/")
    first = list(asked)
    run("http://s.example/")
    rows = spark.read.parquet(f"{out}/visited").collect()
    assert len(set(asked)) == len(asked) > len(first) and len({r.url for r in rows}) == len(rows)
    assert set(first) == {"http://s.example/b/", "http://s.example/private/p.html"} == {r.url for r in rows if r.batch == 0}
    assert "http://s.example/a.html" in {r.url for r in rows if r.batch == 1}
    # the last batch again, as after a failure before its commit
    (tmp_path / "ck" / "commits" / "1").unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema("url string").parquet(str(tmp_path / "seeds"))
    crawl_stream(stream, fetch, config, out, str(tmp_path / "ck")).awaitTermination(300)
    again = spark.read.parquet(f"{out}/visited").collect()
    assert len(asked) > len(set(asked)) and sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_a_mirror_run_twice_fetches_nothing_the_second_time(spark, tmp_path):
    dated = [(u, h, "Sun, 06 Nov 1994 08:49:37 GMT") for u, h in SITE]
    config = CrawlConfig(span_hosts=True).mirrored()
    assert local.files(spark, f"{tmp_path}/none").count() == 0

    def mirror(rows):
        source = crawl.corpus_source(spark.createDataFrame(rows, "url string, html string, last_modified string"), config)
        got = crawl.crawl(seed(spark), source, config, local=str(tmp_path))
        transfer.write_files(crawl.saved(got.pages), str(tmp_path)).collect()
        return got

    one = mirror(dated)
    there = {r.path: r.size for r in local.files(spark, str(tmp_path)).collect()}
    assert one.totals["bytes"] == sum(there.values()) > 0 and "./s.example/index.html" in there
    two = mirror(dated)
    # the links of kept files are followed all the same
    assert visited(two) == visited(one) and two.totals["bytes"] == 0
    assert {r.action for r in two.pages.collect()} == {"keep"}
    changed = [(u, h + "<a href=/new.html>n</a>" if u.endswith("a.html") else h, d.replace("1994", "1995") if u.endswith("a.html") else d) for u, h, d in dated]
    three = mirror(changed)
    assert [r.url for r in three.pages.where("action = 'write'").collect()] == ["http://s.example/a.html"] and ("http://s.example/new.html", 2, None) in visited(three)


def test_a_live_crawl_asks_each_page_once(spark, tmp_path):
    """Hosts' state drops what was asked for, in this run and in those before; the pages are
    those of a crawl in rounds."""
    asked, source, out = [], site(spark), str(tmp_path / "live")
    config = CrawlConfig(recursive=True, level=2, span_hosts=True, wait=0.5)

    def fetch(level):
        asked.extend(r.url for r in level.select("url").collect())
        return source(level)

    live.ask_for(spark, seed(spark), out)
    made = live.crawl_live(spark, fetch, config, out)
    want = visited(crawl.crawl(seed(spark), source, config))
    rows = spark.read.parquet(f"{out}/visited").collect()
    assert {(r.url, r.depth, r.reason) for r in rows} == want and len(rows) == len(want) == made
    assert sorted(asked) == sorted(u for u, _, _ in want)
    # requests of a host are apart by the wait
    dues = sorted(r.due for r in rows if r.url.startswith("http://s.example/"))
    assert all(b - a >= 0.499 for a, b in zip(dues, dues[1:], strict=False))
    # later seeds: only what is new
    live.ask_for(spark, spark.createDataFrame([("http://s.example/a.html",), ("http://n.example/",)], "url string"), out)
    assert live.crawl_live(spark, fetch, config, out) == 1 and asked[-1] == "http://n.example/"
