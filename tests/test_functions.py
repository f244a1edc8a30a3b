"""Edge cases and properties of Column functions, many cases to a query."""

import gzip
import fnmatch
import random

from pyspark.sql import functions as F

from webloom.functions import extract, paths, text, urls
from webloom.operators import archive, crawl, mirrors, policy
from webloom.plans.config import CrawlConfig
from webloom.sources import files, warc_files


def one(spark, rows, ddl, column):
    """The column's value for each row, in order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + ddl)
    return [r.v for r in df.select("n", column.alias("v")).orderBy("n").collect()]


def test_normalise_is_idempotent(spark):
    rng = random.Random(1)
    parts = ["a", "B", "..", ".", "", "é", "x y", "%41", "c;d", "q\"r"]
    given = [(f"{rng.choice(['http', 'HTTPS', 'ftp'])}://{rng.choice(['Ex.org', 'a.b:80', 'u:p@h.io:8080', 'h:443'])}/" + "/".join(rng.choices(parts, k=rng.randint(0, 5))) + rng.choice(["", "?q=é'", "#f x"]),) for _ in range(150)]
    first = one(spark, given, "u string", urls.normalise(F.col("u")))
    assert all(first) and all(x.isascii() for x in first)
    assert one(spark, [(x,) for x in first], "u string", urls.normalise(F.col("u"))) == first


def test_normalise_edges(spark):
    given = [(None,), ("",), ("example.org",), ("http://",), ("http://[::1]:80/x",), ("http://h\\p",), ("http://é.example/é",)]
    assert one(spark, given, "u string", urls.normalise(F.col("u"))) == [None, None, "http://example.org/", None, "http://[::1]/x", "http://h/p", "http://é.example/%C3%A9"]
    assert one(spark, given, "u string", urls.normalise(F.col("u"), allow_iri=False))[-1] is None


def test_globs(spark):
    names = ["a", "ab", "a.html", "b.HTML", "x[1]", "", "-", "]", "a\nb"]
    for pattern in ["*", "?", "a*", "*.html", "[a-b]*", "[!a]", "[^a]*", "x[[]1]", "", "*?b", "."]:
        got = one(spark, [(n,) for n in names], "u string", urls.matches_glob(F.col("u"), pattern))
        assert got == [fnmatch.fnmatchcase(n, pattern.replace("[^", "[!")) for n in names], pattern
    assert one(spark, [("b.HTML",)], "u string", urls.matches_glob(F.col("u"), "*.html", True)) == [True]


def test_html_edges(spark):
    rows = [
        ("<a data-src='l.png' href='no'>", ["http://h/d/l.png"]), ("<a href=''><a href='#x'><a href='javascript:x'><a href='mailto:x@y'>", []), ("<img src=b.png><form action=\"/f\"><object data='o'>", ["http://h/d/b.png", "http://h/d/o", "http://h/f"]),
        ("<!-- <a href='c'> -->", ["http://h/d/c"]), ("<a href='z'><a href='z'>", ["http://h/d/z"]), (None, None), ("", []), ("<a href='ftp://f/x'>", ["ftp://f/x"]),
    ]
    got = one(spark, [(h,) for h, _ in rows], "h string", extract.html_links(F.lit("http://h/d/e"), F.col("h")))
    assert got == [w for _, w in rows]
    assert one(spark, [("<!-- <a href='c'> -->",)], "h string", extract.html_links(F.lit("http://h/"), F.col("h"), strict_comments=True)) == [[]]


def test_robots(spark):
    body = "User-agent: A\nDisallow: /a\nUser-agent: B\nDisallow: /b\n\nSitemap: http://s/m.xml"
    rules = policy.robots_rules(spark.createDataFrame([("http://h", body, True), ("http://e", "Disallow: /x", True), ("http://n", "", True)], "origin string, body string, ok boolean"))
    urls_ = ["http://h/a", "http://h/b", "http://e/x", "http://e/y", "http://n/", "http://unknown/"]
    df = spark.createDataFrame([(u,) for u in urls_], "url string")
    answers = lambda agent: {r.url: r.allowed for r in policy.robots_allow(df, rules, agent).collect()}
    # a rule after the second agent holds for the first as well
    assert answers("a") == {"http://h/a": False, "http://h/b": False, "http://e/x": False, "http://e/y": True, "http://n/": True, "http://unknown/": False}
    assert answers("b")["http://h/a"] and not answers("b")["http://h/b"] and answers("a/1.0")["http://h/a"]


def test_paths(spark):
    c = CrawlConfig(recursive=True, restrict_file_names=["windows", "lowercase"])
    got = one(spark, [("http://H:8080/A%3F/..%2f/b",), ("http://h/",), ("http://h/a/b/?q",)], "u string", paths.local_path(F.col("u"), c))
    assert got == ["./h_8080/a_/../b", "./h/index.html", "./h/a/b/index.html"] or got[1:] == ["./h/index.html", "./h/a/b/index.html"]
    assert one(spark, [("..",), ("",), ("a\0b",)], "u string", paths.sanitise(F.col("u"), ["unix"])) == ["_", "_", "a_b"]


def test_text_edges(spark):
    assert one(spark, [("99999999999999999999g",), (None,), ("-1",)], "s string", text.parse_bytes(F.col("s"))) == [2**63 - 1, None, None]
    assert one(spark, [("inf",), ("0",), ("7",), ("x",)], "s string", text.parse_tries(F.col("s"))) == [0, 0, 7, None]
    got = one(spark, [('max-age="31536000"; includeSubDomains',), ("max-age=0",), ("includeSubDomains",)], "s string", text.hsts_header(F.col("s")))
    assert [(g.max_age, g.include_sub) if g else None for g in got] == [(31536000, True), (0, False), None]
    assert one(spark, [("text/html; charset='x'",), ("text/html",)], "s string", text.charset(F.col("s"))) == ["x", None]
    assert str(one(spark, [("Sun, 06 Nov 1994 08:49:37 GMT",)], "s string", text.http_date(F.col("s")))[0]) == "1994-11-06 08:49:37"
    assert one(spark, [("sha-1=AB,md5=cd",)], "s string", text.encode_hashes(text.decode_hashes(F.col("s")))) == ["sha-1=ab,md5=cd"]


def test_failover_and_mirrors(spark):
    log = spark.createDataFrame([("u", 0, False, False), ("u", 1, True, False), ("u", 2, True, True)], "url string, pos int, downloaded boolean, verified boolean")
    assert crawl.first_success(log).first()[1:] == (2, True) and crawl.first_success(log, keep_bad=True).first()[1:] == (1, False)
    bad = mirrors.parse_document("<!DOCTYPE x [<!ENTITY a 'b'>]><x/>")
    assert bad["error"] and not bad["files"]


def test_stores(spark, tmp_path):
    lines = spark.createDataFrame([("h.example\t1\t99",), ("bad\t1\tx",), ("#\t1\t2",), ("two\tfields",)], "value string")
    assert [r.value for r in files.hsts_lines(files.hsts(lines)).collect()] == ["h.example\t1\t99"]
    jar = spark.createDataFrame([(".d", "/", False, None, "a", "1"), ("d", "/", True, 5, "b", "2"), ("", "/", True, 5, "c", "3")], "domain string, path string, secure boolean, expiry bigint, name string, value string")
    assert [r.value for r in files.cookie_lines(jar).collect()] == ["d\tFALSE\t/\tTRUE\t5\tb\t2"] and files.cookie_lines(jar, True).count() == 2
    log = spark.createDataFrame([("a", 1, 1, False), ("a", 2, 2, True), ("b", 3, 1, False)], "k string, v int, ts int, deleted boolean")
    assert [(r.k, r.v) for r in files.latest(log, ["k"]).collect()] == [("b", 3)]
    index = spark.createDataFrame([(archive.CDX_HEADER.strip(),), ("# x",), ("u sha1:ABC " + "A" * 40,), ("",)], "value string")
    assert {r.digest for r in archive.digests_of_index(index).collect()} == {"abc", "a" * 40}
    (tmp_path / "l.txt").write_text("# c\n\n a/b \nhttp://x.example\n")
    assert {r.url for r in files.url_list(spark, str(tmp_path / "l.txt"), "http://h/d/").collect()} == {"http://h/d/a/b", "http://x.example/"}


def test_archive_files(spark, tmp_path):
    df = spark.createDataFrame([(f"http://x/{i}", b"GET", b"HTTP/1.1 200 OK\r\n\r\nb", "response") for i in range(4)], "url string, request binary, message binary, record_type string").withColumn("ts", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    out = warc_files.write(archive.warc_records(archive.with_digests(df)).coalesce(1), str(tmp_path / "w"), most=600).collect()
    # every file begins with a record of its own about the file
    assert sum(r.records for r in out) == 8 + len(out) and len(out) > 1
    for r in out:
        assert gzip.decompress((tmp_path / "w" / r.file).read_bytes()).startswith(b"WARC/1.0\r\nWARC-Type: warcinfo\r\n")
    assert {r.file: r.bytes for r in out} == {p.name: p.stat().st_size for p in (tmp_path / "w").glob("*.warc.gz")}
