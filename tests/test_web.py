"""The network as a data source: servers on the loopback for each scheme, and crawls over them."""

import gzip
import http.server
import socket
import socketserver
import ssl
import subprocess
import threading
import time

import pytest
from pyspark.sql import functions as F

from webloom.operators import crawl
from webloom.operators.session import Session
from webloom.plans.config import CrawlConfig
from webloom.sources import web

BIG = bytes(range(256)) * 4000


class Pages(http.server.BaseHTTPRequestHandler):
    """A site whose pages say what they were asked with."""

    protocol_version = "HTTP/1.1"

    def reply(self, status, body=b"", headers=(), length=None):
        self.send_response(status)
        for k, v in headers:
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body) if length is None else length))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        seen = self.server.seen
        with self.server.lock:
            seen.append((self.path, self.headers.get("Cookie"), self.headers.get("Authorization"), self.headers.get("Range")))
            self.server.now += 1
            self.server.most = max(self.server.most, self.server.now)
        try:
            self.page()
        finally:
            with self.server.lock:
                self.server.now -= 1

    def page(self):
        html = [("Content-Type", "text/html")]
        if self.path == "/":
            self.reply(200, "<a href='/café.html'>b</a><a href=/old>o</a><a href=/cut>c</a><a href=/private>p</a>".encode("cp1252"), [("Content-Type", "text/html; charset=iso-8859-1"), ("Set-Cookie", "id=1; Path=/"), ("Set-Cookie", "far=2; Domain=other.example")])
        elif self.path == "/old":
            self.reply(302, b"", [("Location", "/new")])
        elif self.path == "/cut":
            self.close_connection = True
            self.reply(200, b"short", html, length=500)
        elif self.path == "/cutzip":
            self.close_connection = True
            whole = gzip.compress(BIG)
            self.reply(200, whole[: len(whole) // 2], [("Content-Encoding", "gzip")])
        elif self.path == "/private":
            ok = self.headers.get("Authorization") == "Basic bWU6cHc="
            self.reply(200 if ok else 401, b"<html><a href=/deep/x>x</a>", html)
        elif self.path == "/big":
            start = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            self.reply(206 if start else 200, BIG[start:], [("Content-Type", "application/octet-stream")])
        elif self.path.startswith("/slow"):
            time.sleep(0.2)
            self.reply(200, b"x", html)
        elif self.path == "/secret":
            self.reply(200, b"s", [*html, ("Strict-Transport-Security", "max-age=100")])
        else:
            self.reply(200, b"<p>end", html)

    def log_message(self, *a):
        pass


FILES = {"/": ["d sub", "f a.txt", "f b.dat", "l out ../../etc", "l in a.txt"], "/sub/": ["f c.txt"]}
CONTENT = {"/a.txt": b"alpha", "/b.dat": BIG, "/sub/c.txt": b"gamma", "/in": b"alpha"}


class Ftp(socketserver.StreamRequestHandler):
    """As much of a file server as the client needs."""

    def say(self, line):
        self.wfile.write((line + "\r\n").encode())

    def data(self, blob):
        self.say("150 here it comes")
        conn, _ = self.listen.accept()
        if self.private:
            conn = self.server.context.wrap_socket(conn, server_side=True)
        conn.sendall(blob)
        if self.private:
            conn.unwrap()
        conn.close()
        self.listen.close()
        self.say("226 done")

    def handle(self):
        self.private, rest, user = False, 0, None
        self.say("220 hello")
        while line := self.rfile.readline().decode().strip():
            command, _, arg = line.partition(" ")
            command = command.upper()
            with self.server.lock:
                self.server.seen.append(line)
            if command == "AUTH":
                if self.server.context is None:
                    self.say("502 no")
                    continue
                self.say("234 go on")
                self.connection = self.server.context.wrap_socket(self.connection, server_side=True)
                self.rfile, self.wfile = self.connection.makefile("rb"), self.connection.makefile("wb", buffering=0)
            elif command == "USER":
                user = arg
                self.say("331 password")
            elif command == "PASS":
                self.say("530 no" if user == "bad" else "230 in")
            elif command == "PROT":
                self.private = arg == "P"
                self.say("200 ok")
            elif command == "PASV":
                self.listen = socket.create_server(("127.0.0.1", 0))
                port = self.listen.getsockname()[1]
                self.say(f"227 ok (127,0,0,1,{port >> 8},{port & 255})")
            elif command == "SIZE":
                self.say(f"213 {len(CONTENT[arg])}" if arg in CONTENT else "550 no")
            elif command == "REST":
                rest = int(arg)
                self.say("350 ok")
            elif command == "RETR":
                if arg in CONTENT:
                    self.data(CONTENT[arg][rest:])
                else:
                    self.listen.close()
                    self.say("550 no")
                rest = 0
            elif command == "MLSD":
                self.listen.close()
                self.say("500 not known")
            elif command == "LIST" and arg in FILES:
                form = lambda kind, name, to="": f"{ {'d': 'd', 'f': '-', 'l': 'l'}[kind] }rw-r--r-- 1 u g 5 Jan 1 2024 {name}" + (f" -> {to}" if to else "")
                self.data("\r\n".join(form(*x.split()) for x in FILES[arg]).encode() + b"\r\n")
            elif command == "NLST" and arg in FILES:
                self.data("\r\n".join(x.split()[1] for x in FILES[arg]).encode() + b"\r\n")
            elif command == "QUIT":
                self.say("221 bye")
                break
            else:
                self.say("200 ok" if command in ("TYPE", "PBSZ") else "550 no")


@pytest.fixture(scope="module")
def certificate(tmp_path_factory):
    at = tmp_path_factory.mktemp("tls")
    made = subprocess.run(["openssl", "req", "-x509", "-newkey", "rsa:2048", "-nodes", "-days", "2", "-subj", "/CN=127.0.0.1", "-keyout", str(at / "k.pem"), "-out", str(at / "c.pem")], capture_output=True)
    if made.returncode:
        pytest.skip("no certificate can be made here")
    context = ssl.SSLContext(ssl.PROTOCOL_TLS_SERVER)
    context.load_cert_chain(str(at / "c.pem"), str(at / "k.pem"))
    return context


def serve(server, context=None):
    server.seen, server.lock, server.now, server.most, server.context = [], threading.Lock(), 0, 0, context
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


@pytest.fixture()
def http_site():
    server = serve(http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages))
    yield server, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.fixture()
def ftp_site():
    server = serve(socketserver.ThreadingTCPServer(("127.0.0.1", 0), Ftp))
    yield server, f"ftp://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def urls_of(spark, *given):
    return spark.createDataFrame([(u,) for u in given], "url string")


def test_http(spark, http_site):
    server, base = http_site
    asked = spark.createDataFrame([(f"{base}/big", 1_000_000, "a=b"), (f"{base}/big", 1_000_000, "a=b"), (f"{base}/old", None, None), (f"{base}/cut", None, None), (f"{base}/cutzip", None, None), ("http://127.0.0.1:1/", None, None), ("gopher://x/", None, None), (None, None, None)], "url string, start bigint, cookies string")
    got = {r.url.removeprefix(base): r for r in web.fetch(asked, CrawlConfig(tries=2, waitretry=0), tasks=3).collect()}
    assert len(got) == 6
    assert got["/big"].status == 206 and bytes(got["/big"].body) == BIG[1_000_000:] and got["/big"].scheme == "http" and got["/big"].host == "127.0.0.1"
    assert got["/old"].final_url == f"{base}/new" and bytes(got["/old"].body) == b"<p>end"
    # what is cut is an error, asked for again where the connection may be to blame
    assert got["/cut"].error.startswith("IncompleteRead") and got["/cut"].attempts == 2 and got["/cut"].body is None and got["/cut"].failure == "protocol"
    assert "too soon" in got["/cutzip"].error and got["/cutzip"].body is None
    assert got["http://127.0.0.1:1/"].failure == "network" and got["gopher://x/"].failure == "protocol"
    assert ("/big", "a=b", None, "bytes=1000000-") in server.seen and sum(x[0] == "/big" for x in server.seen) == 1


def test_filters_are_pushed_into_the_frontier(spark, http_site):
    server, base = http_site
    df = web.fetch(urls_of(spark, f"{base}/one", f"{base}/two", "http://127.0.0.1:1/"), CrawlConfig(tries=1))
    assert [r.url for r in df.where(F.col("url").startswith(base) & (F.col("scheme") == "http") & (F.col("status") == 200) & F.col("url").isin(f"{base}/two", "x")).collect()] == [f"{base}/two"]
    assert [x[0] for x in server.seen] == ["/two"]


def test_hosts_are_asked_side_by_side(spark, http_site):
    server, base = http_site
    many = urls_of(spark, *[f"{base}/slow{i}" for i in range(8)])
    assert web.fetch(many, CrawlConfig(max_threads=4, max_threads_per_host=2), tasks=2).count() == 8
    assert server.most == 2
    server.most = 0
    assert web.fetch(many, CrawlConfig(), tasks=2).count() == 8 and server.most == 1


def test_https(spark, certificate):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    server.socket = certificate.wrap_socket(server.socket, server_side=True)
    serve(server)
    url = f"https://127.0.0.1:{server.server_port}/x"
    bad, good = (web.fetch(urls_of(spark, url), CrawlConfig(tries=1, check_certificate=c)).collect()[0] for c in (True, False))
    server.shutdown()
    assert bad.failure == "ssl" and bad.body is None
    assert good.status == 200 and bytes(good.body) == b"<p>end"


def test_ftp(spark, ftp_site):
    server, base = ftp_site
    asked = spark.createDataFrame([(f"{base}/a.txt", None), (f"{base}/b.dat", 1_000_000), (f"{base}/sub/c.txt", 5), (f"{base}/", None), (f"{base}/no", None), (f"{base}/*.txt", None), (base.replace("//", "//bad:x@") + "/a.txt", None)], "url string, start bigint")
    got = {r.url.removeprefix(base): r for r in web.fetch(asked, CrawlConfig(tries=1), tasks=2).collect()}
    assert (got["/a.txt"].kind, bytes(got["/a.txt"].body)) == ("file", b"alpha")
    assert bytes(got["/b.dat"].body) == BIG[1_000_000:] and "REST 1000000" in server.seen
    assert got["/sub/c.txt"].kind == "complete" and got["/"].kind == "list" and b"-> ../../etc" in bytes(got["/"].body)
    assert got["/no"].failure == "protocol" and (got["/*.txt"].kind, bytes(got["/*.txt"].body)) == ("nlst", b"a.txt")
    assert next(r for u, r in got.items() if "bad" in u).failure == "auth"


def test_ftps(spark, certificate):
    server = serve(socketserver.ThreadingTCPServer(("127.0.0.1", 0), Ftp), certificate)
    plain = serve(socketserver.ThreadingTCPServer(("127.0.0.1", 0), Ftp))
    asked = urls_of(spark, *[f"ftps://127.0.0.1:{s.server_address[1]}/a.txt" for s in (server, plain)])
    config = CrawlConfig(tries=1, check_certificate=False, ftps_resume_ssl=False)
    for fallback in (False, True):
        got = {r.url: r for r in web.fetch(asked, CrawlConfig(**{**config.__dict__, "ftps_fallback_to_ftp": fallback}), tasks=1).collect()}
        one, two = (got[f"ftps://127.0.0.1:{s.server_address[1]}/a.txt"] for s in (server, plain))
        assert bytes(one.body) == b"alpha" and ((bytes(two.body) == b"alpha") if fallback else two.failure == "protocol")
    server.shutdown()
    plain.shutdown()
    assert "AUTH TLS" in server.seen and "PROT P" in server.seen


def test_crawl_over_http(spark, http_site):
    server, base = http_site
    netrc = spark.createDataFrame([("127.0.0.1", "me", "pw")], "machine string, login string, password string")
    config = CrawlConfig(recursive=True, level=3, tries=1)
    got = crawl.crawl(urls_of(spark, f"{base}/"), web.network_source(config, tasks=2), config, session=Session(1000, netrc=netrc))
    jobs = {r.url.removeprefix(base): r for r in got.jobs.collect()}
    # links of a page in another charset, a redirect, a page that wants a password, one that is cut
    assert set(jobs) == {"/", "/caf%C3%A9.html", "/old", "/cut", "/private", "/deep/x"}
    assert jobs["/cut"].code == 7 and jobs["/private"].code == 0 and got.totals["code"] == 7 and got.totals["attempts"] == 6
    seen = {path: (cookie, auth) for path, cookie, auth, _ in server.seen}
    assert seen["/"] == (None, "Basic bWU6cHc=") and seen["/deep/x"] == ("id=1", "Basic bWU6cHc=")
    assert {r.path for r in got.pages.collect()} and {(r.domain, r.name, r.value) for r in got.session.cookies.collect()} == {("127.0.0.1", "id", "1")}
    refused = crawl.crawl(urls_of(spark, f"{base}/private"), web.network_source(config), config)
    assert refused.totals["code"] == 6 and refused.pages.count() == 0


def test_crawl_over_ftp(spark, ftp_site):
    _, base = ftp_site
    config = CrawlConfig(recursive=True, level=5, tries=1, keep_listing=True)
    got = crawl.crawl(urls_of(spark, f"{base}/"), web.network_source(config), config)
    assert {(r.url.removeprefix(base), r.depth) for r in got.visited.collect()} == {("/", 0), ("/sub/", 1), ("/a.txt", 1), ("/b.dat", 1), ("/in", 1), ("/sub/c.txt", 2)}
    kept = {r.url.removeprefix(base): r.path for r in got.pages.collect()}
    assert kept["/"].endswith(".listing") and kept["/sub/c.txt"].endswith("sub/c.txt")
    flat = CrawlConfig(tries=1)
    globbed = crawl.crawl(urls_of(spark, f"{base}/*.txt"), web.network_source(flat), flat)
    assert {r.url.removeprefix(base) for r in globbed.pages.collect() if r.path} == {"/a.txt"}
