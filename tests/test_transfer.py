"""Bodies beyond bounds, files on disk, and crawls that redirect, mirror and end by quota."""

import gzip
import io
import random
from http.client import HTTPException

import pytest
from pyspark.sql import functions as F

from webloom.functions import charset
from webloom.operators import crawl, transfer
from webloom.plans.config import CrawlConfig
from webloom.sources import fetch


class Response(io.BytesIO):
    def __init__(self, body, encoding="gzip"):
        super().__init__(body)
        self.encoding = encoding

    def getheader(self, name):
        return self.encoding


def test_bodies_are_whole_or_errors(monkeypatch):
    text = b"abc" * 100_000
    assert fetch._body(Response(gzip.compress(text)), None) == text
    assert fetch._body(Response(gzip.compress(text) + gzip.compress(b"more")), None) == text + b"more"
    assert fetch._body(Response(text, None), 5) == text
    for cut, length in ((gzip.compress(text)[: -5], None), (gzip.compress(text)[:300], 5), (text[:7], 8), (gzip.compress(text) + gzip.compress(b"more")[:5], None)):
        with pytest.raises(HTTPException):
            fetch._body(Response(cut, None if cut == text[:7] else "gzip"), length)
    assert fetch._body(Response(text[:7], None), 8, ignore_length=True) == text[:7]
    monkeypatch.setattr(fetch, "INFLATED", 1000)
    small = gzip.compress(text)
    with pytest.raises(HTTPException):
        fetch._body(Response(small), len(small) // 100)
    assert fetch._body(Response(small), len(text), ignore_length=True) == text  # 32 times the length allows it


def test_files_are_written_whole(spark, tmp_path):
    ddl = "path string, action string, mtime timestamp, content binary"
    first = spark.createDataFrame([("a/b.txt", "write", None, b"one"), ("../out.txt", "write", None, b"no")], ddl)
    got = {r.path: r.bytes for r in transfer.write_files(first, str(tmp_path / "w")).collect()}
    assert got == {"a/b.txt": 3, "../out.txt": -1} and not (tmp_path / "out.txt").exists()
    rest = spark.createDataFrame([("a/b.txt", "append", None, b" two", 3)], ddl + ", start bigint").withColumn("mtime", F.timestamp_seconds(F.lit(86400)))
    there = tmp_path / "w" / "a" / "b.txt"
    for _ in range(2):  # a task may run again
        assert [r.bytes for r in transfer.write_files(rest, str(tmp_path / "w")).collect()] == [4]
        assert there.read_bytes() == b"one two" and there.stat().st_mtime == 86400 and len(list(there.parent.iterdir())) == 1
    # a rest that is not known to follow what is there is not written
    lost = spark.createDataFrame([("a/b.txt", "append", None, b"x", 99), ("a/b.txt", "append", None, b"x", None), ("a/none.txt", "append", None, b"x", 1)], ddl + ", start bigint")
    assert [r.bytes for r in transfer.write_files(lost, str(tmp_path / "w")).collect()] == [-1] * 3
    assert there.read_bytes() == b"one two" and len(list(there.parent.iterdir())) == 1


def test_prefixes(spark):
    """A sorted sweep finds what every text begins with, across ranges too."""
    rng = random.Random(4)
    word = lambda: "http://" + "".join(rng.choice("ab/") for _ in range(rng.randint(1, 9)))
    texts, keys = {word() for _ in range(400)} | {"http://é/日本"}, {word() for _ in range(150)} | {"http://", "http://é"}
    table = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string").repartition(5)
    got = {r.text: r.found for r in transfer.prefixes(table(texts, "text"), table(keys, "url")).collect()}
    assert got == {t: f for t in texts if (f := sorted((k for k in keys if t.startswith(k)), key=len))}
    assert transfer.prefixes(table(texts, "text"), table(keys, "url").limit(0)).count() == 0
    # every text a key as well, so that ranges begin with texts whose key is in the one before
    assert {r.text: len(r.found) for r in transfer.prefixes(table(texts, "text"), table(texts, "url")).collect()} == {t: sum(t.startswith(k) for k in texts) for t in texts}


def test_destinations_of_a_batch(spark):
    """Free numbers in order, past existing files and past what other rows want."""
    wanted = [("a", i) for i in range(40)] + [("b", 1), ("b.1", 2), ("b", 3), ("c.2", 1), ("c.2", 2), (None, 9), ("d", 5)]
    there = ["a.1", "a.2", "a.5", "a.40", "a.x", "c.2", "c.2.1", "z", "d.1", "a.01", None]
    rows = spark.createDataFrame(wanted, "path string, url int").withColumn("more", F.lit("x"))
    got = {(r.path, r.url): r.dest for r in transfer.destinations(rows, spark.createDataFrame([(x,) for x in there], "path string")).collect()}
    taken, want = set(there) | {p for p, _ in wanted}, {}
    for path, n in sorted((x for x in wanted if x[0]), key=lambda x: x):
        bare = path not in there and not any(k[0] == path for k in want)
        if bare:
            want[path, n] = path
            continue
        number = next(i for i in range(1, 999) if f"{path}.{i}" not in taken)
        taken.add(f"{path}.{number}")
        want[path, n] = f"{path}.{number}"
    assert got == want | {(None, 9): None}
    assert len({x for x in got.values() if x}) == len(wanted) - 1


def test_redirects_beyond_the_limit_have_no_body(spark):
    rows = [(f"http://r.example/{i}", None, 301, f"/{i + 1}") for i in range(6)] + [("http://r.example/6", "<html>end", 200, None), ("http://r.example/e", "gone", 404, None)]
    pages = spark.createDataFrame(rows, "url string, html string, status int, location string")
    config = CrawlConfig(max_redirect=4)
    seeds = spark.createDataFrame([(f"http://r.example/{x}",) for x in (0, 3, "e")], "url string")
    got = crawl.crawl(seeds, crawl.corpus_source(pages, config), config)
    assert [(r.url, r.final_url, r.body) for r in got.pages.collect()] == [("http://r.example/3", "http://r.example/6", "<html>end")]
    assert got.visited.count() == 3


def test_hosts_beyond_ascii(spark):
    df = spark.createDataFrame([("http://Bücher.example:8/x?y#z", 1), ("http://a.example/é", 2), (None, 3)], "url string, n int")
    assert {r.n: r.url for r in charset.ascii_hosts(df).collect()} == {1: "http://xn--bcher-kva.example:8/x?y#z", 2: "http://a.example/é", 3: None}
