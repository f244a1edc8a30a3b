"""One HTTP request at a time, for where there is a network; ``sources.web`` has them made by
the tasks of a table."""

from __future__ import annotations

import time

from webloom.plans.config import CrawlConfig

#: A compressed body may grow to this, or to 32 times its length.  Fixed values.
INFLATED = 256 << 20


def inflate_bound(length: int | None) -> int:
    """The most bytes that a compressed body may grow to."""
    return max(INFLATED, 32 * (length or 0))


def _body(r, length: int | None, ignore_length: bool = False) -> bytes:
    """The whole body, in pieces; compressed ones are inflated up to ``inflate_bound``.  What
    would go beyond it is an error, and so is a body that ends before its stated length or a
    compressed one that ends inside a member: neither is ever cut."""
    import http.client
    import zlib

    parts, size, got, most = [], 0, 0, inflate_bound(length)
    zipped = r.getheader("Content-Encoding") == "gzip"
    inflater = zlib.decompressobj(47) if zipped else None
    while piece := r.read(1 << 16):
        got += len(piece)
        if inflater is None:
            parts.append(piece)
            continue
        while piece:
            out = inflater.decompress(piece, 1 << 20)
            parts.append(out)
            size += len(out)
            if size > most:
                raise http.client.HTTPException(f"a compressed body of more than {most} bytes")
            piece = inflater.unconsumed_tail
            if inflater.eof and inflater.unused_data:  # a further member
                piece, inflater = inflater.unused_data, zlib.decompressobj(47)
    if length is not None and got < length and not ignore_length:
        raise http.client.IncompleteRead(b"", length - got)
    if inflater is not None and got and not inflater.eof:
        raise http.client.HTTPException("a compressed body that ends too soon")
    return b"".join(parts)


def _get(url: str, config: CrawlConfig, pool: dict, *, since: str | None = None, start: int | None = None, cookies: str | None = None, authorization: str | None = None) -> dict:
    """One response, redirects followed.  ``pool`` keeps open connections by scheme, host and
    port; ``since`` asks for newer content only, ``start`` for the rest of it; cookies and
    authorization go to the first host alone."""
    import http.client
    import ssl
    from urllib.parse import urljoin, urlsplit

    now, hops = url, 0
    while True:
        u = urlsplit(now)
        if config.https_only and u.scheme != "https":
            raise http.client.HTTPException("only https is allowed")
        if u.scheme not in ("http", "https"):
            raise http.client.HTTPException(f"scheme {u.scheme} is not fetched here")
        place = (u.scheme, u.hostname, u.port)
        first = place if not hops else first  # noqa: F821
        conn, used = pool.pop(place, None), True
        if conn is None:
            used, timeout = False, config.connect_timeout or config.timeout or 30
            if u.scheme == "https":
                context = ssl.create_default_context() if config.check_certificate else ssl._create_unverified_context()
                conn = http.client.HTTPSConnection(u.hostname, u.port, timeout=timeout, context=context)
            else:
                conn = http.client.HTTPConnection(u.hostname, u.port, timeout=timeout)
        whole = False
        try:
            headers = {"User-Agent": config.user_agent, "Accept-Encoding": "gzip"} | dict(h.split(":", 1) for h in config.headers if ":" in h)
            offset = config.start_pos if start is None else start
            if config.referer:
                headers["Referer"] = config.referer
            if offset:
                headers |= {"Range": f"bytes={offset}-", "Accept-Encoding": "identity"}
            elif since:
                headers["If-Modified-Since"] = since
            if place == first:
                headers |= {k: v for k, v in (("Cookie", cookies), ("Authorization", authorization)) if v}
            method = config.method or ("HEAD" if config.spider else "POST" if config.post_data else "GET")
            conn.request(method, (u.path or "/") + (f"?{u.query}" if u.query else ""), body=config.body_data or config.post_data, headers={k.strip(): v.strip() for k, v in headers.items()})
            r = conn.getresponse()
            length = r.getheader("Content-Length")
            none = method == "HEAD" or r.status in (204, 304)
            body = _body(r, int(length) if length and length.isdigit() and not none else None, config.ignore_length)
            whole = not r.will_close
            location = r.getheader("Location")
            if 300 <= r.status < 400 and r.status != 304 and location:
                hops += 1
                if hops > config.max_redirect:
                    raise http.client.HTTPException("too many redirects")
                now = urljoin(now, location)
                continue
            return {"final_url": now, "kind": "response", "status": r.status, "reason": r.reason, "content_type": r.getheader("Content-Type"), "headers": [{"name": k, "value": v} for k, v in r.getheaders()], "body": body, "bytes": len(body)}
        except (http.client.BadStatusLine, ConnectionError):
            if not used:  # an old connection may have been closed in the meantime
                raise
        finally:
            if whole:
                pool[place] = conn
            else:
                conn.close()


#: Exit codes of failures.  Fixed values, as in ``operators.crawl.SEVERITY``.
CODES = {"ok": 0, "server": 8, "io": 3, "protocol": 7, "network": 4, "ssl": 5, "auth": 6}


def failure(e: BaseException) -> str:
    """What kind of failure an exception is."""
    import ftplib
    import http.client
    import ssl

    if isinstance(e, ssl.SSLError):
        return "ssl"
    if isinstance(e, ftplib.error_perm) and str(e).startswith("530"):
        return "auth"
    if isinstance(e, (http.client.HTTPException, ftplib.Error, ValueError)):
        return "protocol"
    return "network" if isinstance(e, (OSError, EOFError)) else "io"


def ask(url: str, config: CrawlConfig, pool: dict, **extra) -> dict:
    """What a URL gives after at most ``tries`` attempts, with waits between them; a failure is
    a row with ``error`` and ``failure``, never an exception.  A body that came short is asked
    for again."""
    import http.client

    from webloom.sources import ftp

    scheme = url.split(":", 1)[0].lower()
    row: dict = {"url": url, "attempts": 0, "error": None, "failure": "ok"}
    while not config.tries or row["attempts"] < config.tries:
        row["attempts"] += 1
        again = True
        try:
            if scheme in ("ftp", "ftps"):
                row |= ftp.ask(url, config, start=extra.get("start"))
            else:
                row |= _get(url, config, pool, **extra)
            row |= {"error": None, "failure": "ok"}
            status = row.get("status")
            if status in config.retry_on_http_error:
                row["failure"] = "server"
            else:
                row["failure"] = "auth" if status in (401, 407) else "server" if status and status >= 400 else "ok"
                break
        except Exception as e:  # noqa: BLE001  a bad response is a row too
            row |= {"error": f"{type(e).__name__}: {e}", "failure": failure(e)}
            again = (isinstance(e, (OSError, EOFError)) and row["failure"] == "network") or isinstance(e, http.client.IncompleteRead)
            if type(e).__name__ == "gaierror" and not config.retry_on_host_error:
                again = False
        if not again:
            break
        if not config.tries or row["attempts"] < config.tries:
            time.sleep(min(row["attempts"], config.waitretry))
    return row
