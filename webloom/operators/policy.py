"""Which URLs are fetched: accept and reject rules with reasons, robots, MIME types,
strict transport and proxies.  All rules are Column expressions; lists too long for one
are joined (``domain_join``)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text, urls
from webloom.plans.config import CrawlConfig


def _regex(url: Column, pattern: str, config: CrawlConfig) -> Column:
    """An invalid pattern never matches.  POSIX character classes are the same in Java."""
    pattern = re.sub(r"\[:(\w+):\]", lambda m: "\\p{" + {"alnum": "Alnum", "alpha": "Alpha", "digit": "Digit", "lower": "Lower", "upper": "Upper", "space": "Space", "punct": "Punct", "xdigit": "XDigit"}.get(m[1], "Alnum") + "}", pattern)
    try:
        re.compile(re.sub(r"\\p\{\w+\}", "a", pattern))
    except re.error:
        return F.lit(False)
    fold = config.ignore_case and config.regex_type.lower() != "pcre"
    return url.rlike(("(?i)" if fold else "") + pattern)


def url_rules(url: Column, config: CrawlConfig) -> list[tuple[str, Column]]:
    """(reason, whether it rejects) in the order in which they are asked."""
    name, host, path = urls.basename(urls.path(url)), urls.host(url), urls.path(url)
    any_glob = lambda globs: F.greatest(*[urls.matches_glob(name, g, config.ignore_case) for g in globs], F.lit(False))
    rules: list[tuple[str, Column]] = []
    if config.accept:
        rules.append(("accept", ~any_glob(config.accept)))
    if config.reject:
        rules.append(("reject", any_glob(config.reject)))
    if config.accept_regex is not None:
        rules.append(("accept-regex", ~_regex(url, config.accept_regex, config)))
    if config.reject_regex is not None:
        rules.append(("reject-regex", _regex(url, config.reject_regex, config)))
    if config.domains:
        rules.append(("domains", host.isNotNull() & ~urls.host_in(host, config.domains)))
    if config.exclude_domains:
        rules.append(("exclude-domains", host.isNotNull() & urls.host_in(host, config.exclude_domains)))
    starts = lambda dirs: F.exists(F.array(*map(F.lit, dirs)), lambda d: F.startswith(path, d))
    if config.include_directories:
        rules.append(("include-directories", ~starts(config.include_directories)))
    if config.exclude_directories:
        rules.append(("exclude-directories", starts(config.exclude_directories)))
    return rules


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    out = F.lit(None).cast("string")
    for reason, rejects in reversed(rules):
        out = F.when(rejects, F.lit(reason)).otherwise(out)
    return out


def reject_reason(url: Column, config: CrawlConfig) -> Column:
    """The first rule that rejects the URL, or null."""
    return first_reason(url_rules(url, config))


def child_rules(child: Column, parent: Column, config: CrawlConfig, raw: Column | None = None) -> list[tuple[str, Column]]:
    """The rules for a link found on a page, before those of its URL."""
    rules: list[tuple[str, Column]] = []
    same = urls.host(child).eqNullSafe(urls.host(parent))
    if not config.iri:
        rules.append(("no-iri", (child if raw is None else raw).rlike(r"[^\x00-\x7F]")))
    if config.https_only:
        rules.append(("https-only", urls.scheme(child) != "https"))
    if not config.span_hosts:
        rules.append(("span-hosts", ~same))
    if config.no_parent:
        rules.append(("no-parent", ~F.startswith(urls.path(child), urls.folder(urls.path(parent)))))
    if config.relative_only:
        rules.append(("relative", ~same))
    if not config.follow_ftp:
        rules.append(("follow-ftp", urls.scheme(child) == "ftp"))
    return rules + url_rules(child, config)


def split_by_policy(df: DataFrame, config: CrawlConfig, *, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with ``reason``."""
    judged = df.withColumn("reason", reject_reason(F.col(url), config))
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def domain_join(df: DataFrame, domains: DataFrame, *, url: str = "url", domain: str = "domain", keep: bool = True) -> DataFrame:
    """Rows whose host is one of the domains or below one (or, with ``keep`` off, the
    others), by an equi-join on the host's suffixes; for lists of any length.  Rows
    without a host pass."""
    hosts = df.select(urls.host(F.col(url)).alias("h")).where("h is not null").distinct()
    found = hosts.select("h", F.explode(urls.host_suffixes(F.col("h"))).alias("suffix")).join(domains.select(F.col(domain).alias("suffix")), "suffix", "left_semi").select("h").distinct()
    own = df.withColumn("_h", urls.host(F.col(url)))
    if keep:
        wanted = own.join(found.withColumnRenamed("h", "_h").withColumn("_hit", F.lit(True)), "_h", "left").where(F.col("_hit") | F.col("_h").isNull())
    else:
        wanted = own.join(found.withColumnRenamed("h", "_h"), "_h", "left_anti")
    return wanted.select(*df.columns)


def robots_rules(files: DataFrame) -> DataFrame:
    """Rules of robots files (origin, body, ok): origin, agent, prefixes, sitemaps, ok.

    An agent named once stays named to the end of the file, so a later rule holds for
    every agent so far; a rule before any agent is for ``*``; Allow lines do nothing.
    The running set is an expression over each body's own lines, so no window or shuffle
    of lines is needed.
    """
    line = lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), r"\r?\n"), line)
    pairs = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.array().cast("array<struct<agent:string,prefix:string>>").alias("rules"))

    def step(acc: Column, x: Column) -> Column:
        agents = F.when((x["k"] == "user-agent") & (x["v"] != ""), F.array_distinct(F.concat(acc["agents"], F.array(F.lower(x["v"]))))).otherwise(acc["agents"])
        to = F.when(F.size(acc["agents"]) == 0, F.array(F.lit("*"))).otherwise(acc["agents"])
        added = F.transform(to, lambda a: F.struct(a.alias("agent"), x["v"].alias("prefix")))
        return F.struct(agents.alias("agents"), F.when((x["k"] == "disallow"), F.concat(acc["rules"], added)).otherwise(acc["rules"]).alias("rules"))

    done = F.aggregate(pairs, start, step)
    sitemaps = F.transform(F.filter(pairs, lambda x: (x["k"] == "sitemap") & (x["v"] != "")), lambda x: x["v"])
    parsed = files.select("origin", "ok", done["agents"].alias("agents"), done["rules"].alias("rules"), sitemaps.alias("sitemaps"))
    names = F.array_distinct(F.concat("agents", F.transform("rules", lambda r: r["agent"])))
    exploded = parsed.select("origin", "ok", "rules", "sitemaps", F.explode_outer(names).alias("agent"))
    return exploded.select("origin", "agent", F.transform(F.filter("rules", lambda r: r["agent"] == F.col("agent")), lambda r: r["prefix"]).alias("prefixes"), "sitemaps", "ok")


def robots_allow(df: DataFrame, rules: DataFrame, user_agent: str, *, url: str = "url") -> DataFrame:
    """Adds ``allowed``.  The rules of the whole lower-cased agent string hold, else those
    of ``*``; an empty prefix forbids nothing; an origin without a file that could be read
    is denied."""
    mine = F.max_by("prefixes", F.when(F.col("agent") == user_agent.lower(), 2).when(F.col("agent") == "*", 1).otherwise(F.lit(None)))
    by_origin = rules.groupBy("origin").agg(F.bool_and("ok").alias("_ok"), mine.alias("_prefixes"), F.max(F.col("agent").isin(user_agent.lower(), "*").cast("int")).alias("_any"))
    joined = df.withColumn("origin", urls.origin(F.col(url))).join(by_origin, "origin", "left")
    path = urls.path(F.col(url))
    blocked = F.coalesce(F.when(F.col("_any") == 1, F.exists("_prefixes", lambda p: (p != "") & F.startswith(path, p))), F.lit(False))
    return joined.select(*df.columns, (F.coalesce("_ok", F.lit(False)) & ~blocked).alias("allowed"))


def mime_allowed(content_type: Column, filters: list[str]) -> Column:
    """``type/*``, ``type`` or a whole type; with filters a missing type is rejected."""
    if not filters:
        return F.lit(True)
    kind, ok = text.media_type(content_type), F.lit(False)
    for f in (x.strip().lower() for x in filters):
        if f.endswith("/*") or (f and "/" not in f):
            ok = ok | F.startswith(kind, F.lit(f.removesuffix("/*") + "/"))
        elif f:
            ok = ok | (kind == f)
    return F.coalesce((F.trim(content_type) != "") & ok, F.lit(False))


def no_proxy(host: Column, listed: str) -> Column:
    """Whether a host bypasses the proxy: ``*``, equal or below an entry."""
    entries = [e.lstrip(".").lower() for e in re.split(r"[,\s]+", listed) if e]
    if "*" in entries:
        return F.lit(True)
    return urls.host_in(F.lower(F.regexp_replace(host, r"^\[|\]$", "")), [e for e in entries if e])


def hsts_upgrade(df: DataFrame, store: DataFrame, now: int, *, url: str = "url") -> DataFrame:
    """Adds ``upgraded``: http URLs of hosts in a strict-transport store (host,
    include_sub, expiry) as https.  A domain with include_sub covers hosts below it if it
    has a dot."""
    live = store.where(F.col("expiry") > now).groupBy(F.lower("host").alias("_s")).agg(F.max("include_sub").alias("_sub"))
    hosts = df.select(urls.host(F.col(url)).alias("_h")).where("_h is not null").distinct()
    hit = hosts.select("_h", F.explode(urls.host_suffixes(F.col("_h"))).alias("_s")).join(live, "_s").where((F.col("_s") == F.col("_h")) | (F.col("_sub") & F.col("_s").contains("."))).select("_h").distinct()
    joined = df.withColumn("_h", urls.host(F.col(url))).join(hit.withColumn("_hit", F.lit(True)), "_h", "left")
    https = F.regexp_replace(F.regexp_replace(F.col(url), r"^(?i)http://([^/?#]*):80(?=[/?#]|$)", "http://$1"), r"^(?i)http:", "https:")
    return joined.select(*df.columns, F.when(F.col("_hit") & (urls.scheme(F.col(url)) == "http"), https).otherwise(F.col(url)).alias("upgraded"))


def status_class(status: Column, has_location: Column, resuming: Column, content_on_error: bool = False, retry: list[int] | None = None) -> Column:
    """What a response means: follow, keep, complete, restart, append, ok, retry, error."""
    return (
        F.when(status.isin(*(retry or [-1])), "retry")
        .when((status == 304), "keep")
        .when(status.between(300, 399) & has_location, "follow")
        .when((status == 416) & resuming, "complete")
        .when((status == 206) & resuming, "append")
        .when((status == 200) & resuming, "restart")
        .when(status >= 400, F.lit("ok" if content_on_error else "error"))
        .otherwise("ok")
    )


def length_mismatch(declared: Column, written: Column, gzip: Column, ignore_length: bool = False) -> Column:
    return F.lit(False) if ignore_length else F.coalesce((declared != written) & ~gzip, F.lit(False))


def keep_local(local_mtime: Column, server_mtime: Column) -> Column:
    """Time-stamping without conditional requests: keep a local file no older."""
    return F.coalesce(server_mtime <= local_mtime, F.lit(False))
