"""FTP requests one at a time, with or without TLS, and walks of listing tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import listings, urls
from webloom.operators import policy
from webloom.plans.config import CrawlConfig
from webloom.store import stored

#: Characters that make the last segment of a path a pattern.
PATTERN = "*?["


def _secure(config: CrawlConfig):
    """A client whose connections are encrypted; data connections go on with the session of
    the control connection, as many servers demand."""
    import ftplib
    import socket
    import ssl

    class Client(ftplib.FTP_TLS):
        def connect(self, *args, **kwargs):
            if not config.ftps_implicit:
                return super().connect(*args, **kwargs)
            self.host, self.port = args[0], args[1]
            plain = socket.create_connection((self.host, self.port), self.timeout)
            self.af = plain.family
            self.sock = self.context.wrap_socket(plain, server_hostname=self.host)
            self.file = self.sock.makefile("r", encoding=self.encoding)
            self.welcome = self.getresp()
            return self.welcome

        def ntransfercmd(self, cmd, rest=None):
            conn, size = ftplib.FTP.ntransfercmd(self, cmd, rest)
            if self._prot_p:
                session = self.sock.session if config.ftps_resume_ssl else None
                conn = self.context.wrap_socket(conn, server_hostname=self.host, session=session)
            return conn, size

    context = ssl.create_default_context() if config.check_certificate else ssl._create_unverified_context()
    return Client(timeout=config.timeout or 30, context=context)


def _session(url: str, config: CrawlConfig):
    import ftplib
    from urllib.parse import unquote, urlsplit

    u = urlsplit(url)
    user = (unquote(u.username) if u.username else None) or config.ftp_user or config.user or "anonymous"
    password = (unquote(u.password) if u.password else None) or config.ftp_password or config.password or "-webloom@"
    secure = u.scheme == "ftps"
    ftp = _secure(config) if secure else ftplib.FTP(timeout=config.timeout or 30)
    ftp.connect(u.hostname, u.port or (990 if secure and config.ftps_implicit else 21))
    if secure and not config.ftps_implicit:
        try:
            ftp.auth()
        except ftplib.error_perm:
            if not config.ftps_fallback_to_ftp:
                raise
            ftp.close()
            secure, ftp = False, ftplib.FTP(timeout=config.timeout or 30)
            ftp.connect(u.hostname, u.port or 21)
    if secure:
        ftplib.FTP.login(ftp, user, password)
        ftp.prot_c() if config.ftps_clear_data_connection else ftp.prot_p()
    else:
        ftp.login(user, password)
    ftp.set_pasv(config.passive_ftp)
    return ftp, unquote(u.path) or "/"


def _size(ftp, path: str) -> int | None:
    import ftplib

    try:
        return ftp.size(path)
    except ftplib.error_perm:
        return None


def _lines(ftp, path: str, commands: tuple[tuple[str, str], ...]) -> tuple[str, list[str]] | None:
    """The first of these listings that the server knows."""
    import ftplib

    for kind, command in commands:
        lines: list[str] = []
        try:
            ftp.retrlines(f"{command} {path}", lines.append)
        except ftplib.error_perm:
            continue
        return kind, lines
    return None


def ask(url: str, config: CrawlConfig, *, start: int | None = None) -> dict:
    """A listing's text (kind mlsd, list or nlst) of a path that ends with a slash, the names
    that match a pattern (kind nlst, under the folder's URL), else the file's bytes, from
    ``start`` on; kind ``complete`` where the server has no more.  A body shorter than the
    server said is an error."""
    import fnmatch

    if any(c in url for c in "\r\n\0"):
        raise ValueError("a line end in a path")
    start = config.start_pos if start is None else start
    ftp, path = _session(url, config)
    if any(c in path for c in "\r\n\0"):
        raise ValueError("a line end in a path")
    with ftp:
        folder, _, name = path.rpartition("/")
        if config.ftp_glob and name and any(c in name for c in PATTERN):
            found = _lines(ftp, folder + "/", (("nlst", "NLST"), ("list", "LIST")))
            names = sorted({line.strip().split("/")[-1].split(" ")[-1] for line in (found[1] if found else [])})
            listed = "\n".join(x for x in names if fnmatch.fnmatchcase(x, name))
            return {"kind": "nlst", "final_url": url.rpartition("/")[0] + "/", "body": listed.encode(), "bytes": 0}
        if path.endswith("/"):
            found = _lines(ftp, path, (("mlsd", "MLSD"), ("list", "LIST"), ("nlst", "NLST")))
            kind, lines = found or ("nlst", [])
            return {"kind": kind, "final_url": url, "body": "\n".join(lines).encode(), "bytes": 0}
        ftp.voidcmd("TYPE I")
        size = _size(ftp, path)
        if start and size is not None and start >= size:
            return {"kind": "complete", "final_url": url, "body": b"", "bytes": 0}  # all of it is there
        parts: list[bytes] = []
        ftp.retrbinary(f"RETR {path}", parts.append, rest=start or None)
        body = b"".join(parts)
        if size is not None and len(body) + (start or 0) < size and not config.ignore_length:
            raise EOFError(f"{len(body) + (start or 0)} of {size} bytes")
        return {"kind": "file", "final_url": url, "body": body, "bytes": len(body)}


def entries(texts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(url, name, kind, target, and those to keep) of listing texts (url, kind, text); bare
    names are files."""
    own = ["url", *(keep or [])]
    each = texts.where(F.col("kind").isin("mlsd", "list", "nlst")).select(*own, "kind", F.explode(F.split("text", r"\r?\n")).alias("line"))
    bare = listings.safe_name(listings.name_of_line(F.col("line")))
    named = F.when(bare.isNotNull(), F.struct(bare.alias("name"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("target")))
    entry = F.when(F.col("kind") == "mlsd", listings.mlsd_entry(F.col("line"))).when(F.col("kind") == "list", listings.unix_entry(F.col("line"))).otherwise(named)
    return each.select(*own, entry.alias("e")).where("e is not null").select(*own, "e.*")


def children(texts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(url, child, kind, and those to keep) of the entries of listing texts: folders with a
    slash at their end, links only where they stay in their folder's tree."""
    found = entries(texts, keep).where((F.col("kind") != "symlink") | listings.safe_link(F.col("name"), F.coalesce("target", F.lit(""))))
    child = listings.child_url(F.col("url"), F.col("name"))
    return found.select("url", F.when(F.col("kind") == "dir", F.concat(child, F.lit("/"))).otherwise(child).alias("child"), "kind", *(keep or [])).where("child is not null").distinct()


def expand_glob(texts: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Distinct URLs of listing lines whose last token matches."""
    lines = texts.select("url", F.explode(F.split("text", r"\r?\n")).alias("line"))
    names = lines.select("url", listings.name_of_line(F.col("line")).alias("name")).where(listings.safe_name(F.col("name")).isNotNull())
    return names.where(urls.matches_glob(F.col("name"), pattern, ignore_case)).select(listings.child_url(F.col("url"), F.col("name")).alias("url")).where("url is not null").distinct()


def walk(seeds: DataFrame, listing: DataFrame, config: CrawlConfig) -> DataFrame:
    """(url, depth) of files and links below the seeds, over a table of entries (url, name,
    kind, target); folders are followed while the level allows, to any depth without one."""
    frontier, found = seeds.select("url", F.lit(0).alias("depth")).distinct(), None
    seen = stored(frontier.select("url"))
    for depth in itertools.count():
        if config.level >= 0 and depth >= config.level:
            break
        kids = frontier.join(listing, "url").where((F.col("kind") != "symlink") | listings.safe_link(F.col("name"), F.coalesce("target", F.lit(""))))
        child = listings.child_url(F.col("url"), F.col("name"))
        child = F.when(F.col("kind") == "dir", F.concat(child, F.lit("/"))).otherwise(child)
        kids = kids.select(child.alias("child"), F.col("url").alias("parent"), "kind").where("child is not null")
        rules = [r for r in policy.child_rules(F.col("child"), F.col("parent"), config) if r[0] not in ("follow-ftp", "no-iri")]
        kids = stored(kids.where(policy.first_reason(rules).isNull()).select(F.col("child").alias("url"), "kind").distinct().join(seen, "url", "left_anti"))
        files = kids.where("kind <> 'dir'").select("url", F.lit(depth + 1).alias("depth"))
        found = files if found is None else found.unionByName(files)
        frontier = kids.where("kind = 'dir'").select("url", F.lit(depth + 1).alias("depth"))
        seen = seen.unionByName(kids.select("url"))
        if not frontier.limit(1).count():
            break
    return found if found is not None else seeds.select("url", F.lit(0).alias("depth")).limit(0)
