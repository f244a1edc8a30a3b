"""What a crawl remembers of the hosts that it asks: cookies, strict transport, credentials.

State is a table of rows with the round in which each was said.  After a round what its
responses say is merged into it, the last word on a key counting, and the result is stored; the
requests of the next round are joined with it.  Of a request only what decides is joined: its
host's suffixes and its path's prefixes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text, urls
from webloom.operators import policy

COOKIE = "domain string, host_only boolean, path string, name string, value string, secure boolean, expiry bigint, round int, gone boolean"
STRICT = "host string, include_sub boolean, expiry bigint, round int, gone boolean"


def _value(part: Column) -> Column:
    return F.trim(F.regexp_extract(part, r"^[^=]*=(.*)$", 1))


def _attribute(parts: Column, name: str) -> Column:
    """The value of the last attribute of a name; null without one."""
    found = F.filter(parts, lambda p: F.lower(F.trim(F.regexp_extract(p, r"^([^=]*)", 1))) == name)
    return F.when(F.size(found) > 0, F.trim(F.regexp_extract(F.element_at(found, -1), r"^[^=]*=?(.*)$", 1)))


def default_path(path: Column) -> Column:
    """The folder of a request's path, without the slash at its end."""
    folder = F.regexp_extract(path, r"^(.*)/", 1)
    return F.when(~path.startswith("/") | (folder == ""), "/").otherwise(folder)


def said_cookies(responses: DataFrame, now: int, number: int | Column) -> DataFrame:
    """Cookies of responses (final_url, set_cookie: an array of header values), in the form of
    ``COOKIE`` with ``place``, which orders what one response says.

    Without a Domain a cookie is for its host alone; with one that the host is not in, or that
    has no dot, it is not taken.  Max-Age goes before Expires; a time that is over deletes.
    """
    each = responses.select("final_url", F.posexplode("set_cookie").alias("place", "header"))
    u = F.col("final_url")
    parts = F.split("header", ";")
    attributes = F.slice(parts, 2, F.size(parts))
    pair = F.trim(parts[0])
    domain = F.lower(F.regexp_replace(_attribute(attributes, "domain"), r"^\.", ""))
    path, age = _attribute(attributes, "path"), _attribute(attributes, "max-age").try_cast("bigint")
    until = F.unix_timestamp(text.http_date(F.regexp_replace(_attribute(attributes, "expires"), r"^(\w+), (\d\d)-(\w{3})-(\d{4})", "$1, $2 $3 $4")))
    given = F.coalesce(domain, F.lit("")) != ""
    rows = each.select(
        F.when(given, domain).otherwise(urls.host(u)).alias("domain"),
        (~given).alias("host_only"),
        F.when(path.startswith("/"), path).otherwise(default_path(urls.path(u))).alias("path"),
        F.trim(F.regexp_extract(pair, r"^([^=]*)=", 1)).alias("name"),
        _value(pair).alias("value"),
        _attribute(attributes, "secure").isNotNull().alias("secure"),
        F.when(age.isNotNull(), F.lit(now) + age).otherwise(until).alias("expiry"),
        (F.lit(number) if isinstance(number, int) else number).cast("int").alias("round"),
        "place", "final_url",
    )
    host = urls.host(u)
    inside = F.col("host_only") | (host == F.col("domain")) | (F.endswith(host, F.concat(F.lit("."), F.col("domain"))) & F.col("domain").contains("."))
    return rows.where((F.col("name") != "") & F.coalesce(inside, F.lit(False))).withColumn("gone", F.coalesce(F.col("expiry") <= now, F.lit(False)))


def said_strict(responses: DataFrame, now: int, number: int | Column) -> DataFrame:
    """Strict-transport rows of responses (final_url, strict_transport) over https, in the form
    of ``STRICT``; an age of zero deletes."""
    u, said = F.col("final_url"), text.hsts_header(F.col("strict_transport"))
    rows = responses.where((urls.scheme(u) == "https") & said.isNotNull()).select(urls.host(u).alias("host"), said.alias("s"), "final_url")
    return rows.select("host", F.col("s.include_sub").alias("include_sub"), (F.lit(now) + F.col("s.max_age")).alias("expiry"), (F.lit(number) if isinstance(number, int) else number).cast("int").alias("round"), (F.col("s.max_age") == 0).alias("gone"), "final_url")


def merged(state: DataFrame | None, said: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: of the latest round, then of the greatest URL and place in it,
    so that it does not depend on which task was first.  Deleted rows stay until the next
    merge, which they outlast nothing of."""
    kept = [c for c in said.columns if c not in order]
    last = said.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in kept if c not in keys]), F.struct("round", *order)).alias("s")).select(*keys, "s.*")
    if state is None:
        return last.where("not gone")
    return state.select(*kept).unionByName(last.select(*kept)).groupBy(*keys).agg(F.max_by(F.struct(*[c for c in kept if c not in keys]), "round").alias("s")).select(*keys, "s.*").where("not gone")


COOKIE_KEY, STRICT_KEY = ["domain", "path", "name"], ["host"]


@dataclass(frozen=True)
class Session:
    """``cookies`` (``COOKIE``), ``strict`` (``STRICT``) and ``netrc`` (machine, login,
    password) of a crawl that begins at ``now`` (seconds); each may be missing."""

    now: int
    cookies: DataFrame | None = None
    strict: DataFrame | None = None
    netrc: DataFrame | None = None

    @staticmethod
    def of_files(now: int, cookies: DataFrame | None = None, strict: DataFrame | None = None, netrc: DataFrame | None = None) -> Session:
        """From tables of ``sources.files`` (cookies, hsts, netrc)."""
        jar = None if cookies is None else cookies.select(F.regexp_replace(F.lower("domain"), r"^\.", "").alias("domain"), F.lit(False).alias("host_only"), "path", "name", "value", "secure", F.lit(None).cast("bigint").alias("expiry"), F.lit(-1).alias("round"), F.lit(False).alias("gone"))
        hosts = None if strict is None else strict.select("host", "include_sub", "expiry", F.lit(-1).alias("round"), F.lit(False).alias("gone"))
        return Session(now, jar, hosts, netrc)

    def learnt(self, responses: DataFrame, number: int) -> Session:
        """With what the responses of a round say (final_url, set_cookie, strict_transport);
        neither table is stored."""
        return replace(self, cookies=merged(self.cookies, said_cookies(responses, self.now, number), COOKIE_KEY, ["final_url", "place"]), strict=merged(self.strict, said_strict(responses, self.now, number), STRICT_KEY, ["final_url"]))


def path_prefixes(path: Column) -> Column:
    """The cookie paths that a request's path is in: itself, and with and without a slash at
    their end those of the folders above."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.array_distinct(F.filter(F.concat(F.array(path), above, F.transform(above, lambda p: F.concat(p, F.lit("/")))), lambda p: p != ""))


def cookies_sent(requests: DataFrame, jar: DataFrame, now: int, *, url: str = "url") -> DataFrame:
    """(url, cookies): the Cookie header of each URL that has any, longer paths first, then by
    name.  Domains and paths are matched by an equi-join on suffixes and prefixes."""
    u = F.col(url)
    asked = requests.select(url).distinct().select(url, urls.host(u).alias("_h"), urls.scheme(u).alias("_s"), F.explode(urls.host_suffixes(urls.host(u))).alias("domain"), urls.path(u).alias("_p"))
    asked = asked.select(url, "_h", "_s", "domain", F.explode(path_prefixes(F.col("_p"))).alias("path"))
    live = jar.where(F.col("expiry").isNull() | (F.col("expiry") > now)).select("domain", "host_only", "path", "name", "value", "secure")
    met = asked.join(live, ["domain", "path"]).where((~F.col("host_only") | (F.col("_h") == F.col("domain"))) & (~F.col("secure") | (F.col("_s") == "https")))
    sent = met.groupBy(url).agg(F.array_sort(F.collect_list(F.struct((-F.length("path")).alias("n"), "name", "domain", "value"))).alias("c"))
    return sent.select(url, F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("="), x["value"])), "; ").alias("cookies"))


def dressed(level: DataFrame, session: Session, *, user: str | None = None, password: str | None = None) -> DataFrame:
    """``level`` (url and more) with ``target``, the URL to ask for (https where strict
    transport wants it), ``cookies`` and ``authorization``: given credentials first, else the
    URL's own, else those of its host in the netrc, else of its default."""
    from webloom.sources import files

    out = level.withColumn("target", F.col("url"))
    if session.strict is not None:
        out = policy.hsts_upgrade(out, session.strict, session.now).drop("target").withColumnRenamed("upgraded", "target")
    if session.cookies is not None:
        sent = cookies_sent(out, session.cookies, session.now, url="target")
        out = out.join(sent, "target", "left")
    else:
        out = out.withColumn("cookies", F.lit(None).cast("string"))
    own = F.split(urls.userinfo(F.col("url")), ":", 2)
    login = F.coalesce(F.lit(user), F.when(own[0] != "", urls.percent_decode(own[0])))
    secret = F.coalesce(F.lit(password), F.when(F.size(own) > 1, urls.percent_decode(F.element_at(own, -1))))
    if session.netrc is not None:
        out = files.credentials(out, session.netrc)
        login, secret = F.coalesce(login, "login"), F.coalesce(secret, "password")
    basic = F.concat(F.lit("Basic "), F.replace(F.base64(F.encode(F.concat_ws(":", login, F.coalesce(secret, F.lit(""))), "UTF-8")), F.lit("\r\n"), F.lit("")))
    return out.select(*level.columns, "target", "cookies", F.when(login.isNotNull() & secret.isNotNull(), basic).alias("authorization"))
