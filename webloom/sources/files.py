"""Readers and writers of list, cookie, strict-transport, netrc and index files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import urls

COOKIE_HEADER = "# Netscape HTTP Cookie File"


def seeds(spark: SparkSession, given: list[str], base: str | None = None, allow_iri: bool = True) -> DataFrame:
    df = spark.createDataFrame([(u,) for u in given], "line string")
    return df.select(urls.resolve_input(F.col("line"), base, allow_iri).alias("url"))


def url_list(spark: SparkSession, path: str, base: str | None = None, allow_iri: bool = True) -> DataFrame:
    """URLs of a list file: blank lines and ``#`` comments skipped."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(urls.resolve_input(line, base, allow_iri).alias("url"))


def cookies(lines: DataFrame) -> DataFrame:
    """Cookies of lines (value) of seven tab fields; all count as session cookies, as the
    expiry is not read back."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size(f) >= 7) & (f[0] != ""))
    return rows.select(f[0].alias("domain"), (F.upper(f[1]) == "TRUE").alias("include_sub"), f[2].alias("path"), (F.upper(f[3]) == "TRUE").alias("secure"), f[5].alias("name"), f[6].alias("value"))


def cookie_lines(jar: DataFrame, keep_session: bool = False) -> DataFrame:
    """Lines to save of (domain, path, secure, expiry, name, value): session cookies
    (no expiry) only on demand, with expiry 0."""
    rows = jar.where((F.col("domain") != "") & (F.col("expiry").isNotNull() | F.lit(keep_session)))
    flag = lambda c: F.when(c, "TRUE").otherwise("FALSE")
    return rows.select(F.concat_ws("\t", "domain", flag(F.startswith("domain", F.lit("."))), "path", flag(F.col("secure")), F.coalesce("expiry", F.lit(0)).cast("string"), "name", "value").alias("value"))


def cookies_for(requests: DataFrame, jar: DataFrame, *, url: str = "url") -> DataFrame:
    """(url, cookies) with the Cookie header of each URL: domain suffixes by an equi-join,
    then path and security."""
    asked = requests.select(F.col(url)).distinct()
    each = asked.select(url, F.explode(urls.host_suffixes(urls.host(F.col(url)))).alias("_d"), urls.path(F.col(url)).alias("_p"), urls.host(F.col(url)).alias("_h"), urls.scheme(F.col(url)).alias("_s"))
    own = jar.select(F.regexp_replace(F.lower("domain"), r"^\.", "").alias("_d"), F.col("path").alias("_cp"), "secure", "name", "value", F.coalesce("include_sub", F.lit(True)).alias("_sub"))
    path_fits = (F.col("_p") == F.col("_cp")) | (F.startswith("_p", F.col("_cp")) & (F.endswith("_cp", F.lit("/")) | (F.substr("_p", F.length("_cp") + 1, F.lit(1)) == "/")))
    met = each.join(own, "_d").where(path_fits & (~F.col("secure") | (F.col("_s") == "https")) & (F.col("_sub") | (F.col("_h") == F.col("_d"))))
    sent = met.groupBy(url).agg(F.array_sort(F.collect_list(F.struct((-F.length("_cp")).alias("n"), "name", "value"))).alias("c"))
    return sent.select(url, F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("="), x["value"])), "; ").alias("cookies"))


def latest(changes: DataFrame, keys: list[str], *, order: str = "ts", delete: str = "deleted") -> DataFrame:
    """The last state of each key of a log of changes, deleted ones gone."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_s"))
    return last.select(*keys, "_s.*").where(~F.col(delete))


def hsts(lines: DataFrame) -> DataFrame:
    """(host, include_sub, expiry) of lines of three tab fields; others are skipped."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 3)).select(F.lower(f[0]).alias("host"), (f[1] == "1").alias("include_sub"), F.trim(f[2]).try_cast("bigint").alias("expiry"))
    return rows.where("expiry is not null")


def hsts_lines(store: DataFrame) -> DataFrame:
    return store.select(F.concat_ws("\t", "host", F.when(F.col("include_sub"), "1").otherwise("0"), F.col("expiry").cast("string")).alias("value"))


def parse_netrc(text: str) -> list[tuple[str | None, str | None, str | None]]:
    """(machine, login, password); machine is None for the default.  Comments only begin a
    line; a macro goes on to the next machine; a later entry of a machine replaces one
    before."""
    tokens: list[str] = []
    for line in text.splitlines():
        if not line.lstrip().startswith("#"):
            tokens += line.split()
    out: dict[str | None, list] = {}
    now: list | None = None
    i = 0

    def value() -> str:
        nonlocal i
        i += 1
        if i >= len(tokens):
            raise ValueError("netrc: a value is missing")
        return tokens[i]

    while i < len(tokens):
        t = tokens[i]
        if t == "machine":
            now = out[value()] = [None, None]
        elif t == "default":
            now = out[None] = [None, None]
        elif t in ("login", "password") and now is not None:
            now[t == "password"] = value()
        elif t == "account":
            value()
        elif t == "macdef":
            while i + 1 < len(tokens) and tokens[i + 1] not in ("machine", "default"):
                i += 1
        i += 1
    return [(m, a, b) for m, (a, b) in out.items()]


def netrc(files: DataFrame, *, text: str = "text") -> DataFrame:
    """(machine, login, password) rows of netrc texts, by an Arrow-batched parser; a text
    that does not parse gives none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for t in pdf[text]:
                try:
                    rows += parse_netrc(t or "")
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["machine", "login", "password"])

    return files.select(text).mapInPandas(run, "machine string, login string, password string")


def credentials(requests: DataFrame, entries: DataFrame, *, url: str = "url") -> DataFrame:
    """Adds login and password of the URL's host, else of the default entry."""
    default = entries.where("machine is null").agg(F.first("login").alias("_dl"), F.first("password").alias("_dp"))
    own = entries.where("machine is not null").select(F.col("machine").alias("_h"), "login", "password", F.lit(True).alias("_own"))
    # one row of defaults
    joined = requests.withColumn("_h", urls.host(F.col(url))).join(own, "_h", "left").join(F.broadcast(default))
    pick = lambda a, b: F.when(F.col("_own"), F.col(a)).otherwise(F.col(b)).alias(a)
    return joined.select(*requests.columns, pick("login", "_dl"), pick("password", "_dp"))
