"""Sizes, durations, rates and headers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 2**63 - 1


def parse_bytes(text: Column) -> Column:
    """``10k`` as 10240; suffixes k, m, g, t of 1024; whole numbers only; saturating; null
    if it does not parse."""
    t = F.lower(F.trim(text))
    n, unit = F.regexp_extract(t, r"^([0-9]+)\s*([kmgt]?)b?$", 1), F.regexp_extract(t, r"^([0-9]+)\s*([kmgt]?)b?$", 2)
    power = F.when(unit == "k", 1024).when(unit == "m", 1024**2).when(unit == "g", 1024**3).when(unit == "t", 1024**4).otherwise(1).cast("decimal(20,0)")
    value = n.try_cast("decimal(18,0)") * power
    return F.when(n != "", F.when(F.length(n) > 18, F.lit(TOP)).otherwise(F.least(value, F.lit(TOP).cast("decimal(38,0)")).cast("bigint")))


def parse_seconds(text: Column) -> Column:
    """``1.5m`` as 90.0; suffixes s, m, h, d; null if it does not parse."""
    t = F.lower(F.trim(text))
    rx = r"^([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([smhd]?)$"
    n, unit = F.regexp_extract(t, rx, 1), F.regexp_extract(t, rx, 2)
    return F.when(n != "", n.try_cast("double") * F.when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0).otherwise(1.0))


def parse_tries(text: Column) -> Column:
    """A count; ``inf`` and 0 are 0, for no end."""
    t = F.lower(F.trim(text))
    return F.when(t == "inf", F.lit(0)).otherwise(F.when(t.rlike("^[0-9]+$"), t.try_cast("int")))


def _scaled(value: Column, step: float, units: list[str], whole_first: bool) -> Column:
    v = value.cast("double")
    out = None
    for i, unit in reversed(list(enumerate(units))):
        x = v / step**i
        shown = F.when(x >= 100, F.format_string("%.0f", F.bround(x, 0))).when(x >= 10, F.format_string("%.1f", F.bround(x, 1))).otherwise(F.format_string("%.2f", F.bround(x, 2)))
        if i == 0:
            shown = F.format_string("%.0f", F.bround(x, 0))
        part = F.concat(shown, F.lit(unit))
        out = part if out is None else F.when(v >= step ** (i + 1), out).otherwise(part)
    return F.when(value.isNotNull(), out)


def format_bytes(n: Column) -> Column:
    """``1.50KB``: steps of 1024 to TB, two decimals below 10, one below 100, then none."""
    return _scaled(n, 1024.0, ["B", "KB", "MB", "GB", "TB"], True)


def format_bits(n: Column) -> Column:
    return _scaled(n, 1000.0, ["b", "Kb", "Mb", "Gb", "Tb"], True)


def format_rate(n: Column, seconds: Column, bits: bool = False) -> Column:
    rate = n / F.greatest(seconds, F.lit(1e-6))
    return F.concat(format_bits(rate * 8) if bits else format_bytes(F.floor(rate)), F.lit("/s"))


def format_eta(remaining: Column, rate: Column) -> Column:
    """Null below one byte a second."""
    s = F.ceil(remaining / rate).cast("bigint")
    part = lambda x: x.cast("bigint").cast("string")
    text = (
        F.when(s < 60, F.concat(part(s), F.lit("s")))
        .when(s < 3600, F.concat(part(F.floor(s / 60)), F.lit("m"), part(s % 60), F.lit("s")))
        .otherwise(F.concat(part(F.floor(s / 3600)), F.lit("h"), part(F.floor(s % 3600 / 60)), F.lit("m")))
    )
    return F.when(rate >= 1, F.concat(F.lit("eta "), text))


def render_bar(now: Column, before: Column, total: Column, width: int) -> Column:
    """A bar of what was there before, what came since, and the rest."""
    width = max(1, width)
    share = lambda x: F.floor(F.least(x, total) * width / total).cast("int")
    prior = F.least(share(before), F.lit(width))
    filled = F.least(F.greatest(share(now), prior), F.lit(width))
    bar = F.concat(F.repeat(F.lit("▓"), prior), F.repeat(F.lit("█"), filled - prior), F.repeat(F.lit("░"), width - filled))
    return F.concat(F.lit("["), F.when(total == 0, F.lit("░" * width)).otherwise(bar), F.lit("]"))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))


def charset(content_type: Column) -> Column:
    """The first ``charset=``, without quotes; null if there is none."""
    found = F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*([^;]*)", 1)
    out = F.trim(F.regexp_replace(F.trim(found), r"""^["']|["']$""", ""))
    return F.when(out != "", out)


def disposition_name(header: Column) -> Column:
    """The file name of a Content-Disposition: its last name parameter (``filename*`` is
    percent-decoded), without directories; null if there is none to use."""
    rx = r"""(?i)(?:^|;)\s*filename(\*?)\s*=\s*(?:"([^"]*)"|([^;]*))"""
    star, quoted, bare = (F.regexp_extract_all(header, F.lit(rx), F.lit(i)) for i in (1, 2, 3))
    last = lambda a: F.element_at(a, -1)
    value = F.trim(F.when(last(quoted) != "", last(quoted)).otherwise(last(bare)))
    extended = F.regexp_extract(value, r"^[^']*'[^']*'(.*)$", 1)
    plain = F.when(last(star) == "*", F.coalesce(F.try_url_decode(F.replace(F.when(extended != "", extended).otherwise(value), F.lit("+"), F.lit("%2B"))), value)).otherwise(value)
    name = F.element_at(F.split(plain, r"[/\\]", -1), -1)
    return F.when((F.size(star) > 0) & ~name.isin("", ".", ".."), name)


def content_range_total(header: Column) -> Column:
    return F.regexp_extract(header, r"(?i)^\s*bytes\s+[^/]*/\s*([0-9]+)\s*$", 1).try_cast("bigint")


def resume_total(header: Column, start: Column, length: Column) -> Column:
    """The whole size of a resumed transfer."""
    return F.coalesce(content_range_total(header), start + length)


def hsts_header(header: Column) -> Column:
    """struct<max_age, include_sub>; null without a max-age."""
    age = F.regexp_extract(header, r'(?i)(?:^|;)\s*max-age\s*=\s*"?\s*([0-9]+)', 1).try_cast("bigint")
    return F.when(age.isNotNull(), F.struct(age.alias("max_age"), header.rlike(r"(?i)(?:^|;)\s*includeSubDomains\s*(?:;|$)").alias("include_sub")))


def hash_name(algo: Column) -> Column:
    a = F.replace(F.lower(F.trim(algo)), F.lit("_"), F.lit("-"))
    return F.when(a.isin("sha256", "sha-256"), "sha-256").when(a.isin("sha1", "sha-1"), "sha-1").when(a.isin("sha512", "sha-512"), "sha-512").otherwise(a)


def is_metalink_type(content_type: Column) -> Column:
    return F.coalesce(media_type(content_type).isin("application/metalink4+xml", "application/metalink+xml"), F.lit(False))


def encode_hashes(hashes: Column) -> Column:
    """``algo=hex,…`` of an array<struct<algo, hex>>."""
    return F.array_join(F.transform(hashes, lambda h: F.concat(h["algo"], F.lit("="), h["hex"])), ",")


def decode_hashes(text: Column) -> Column:
    parts = F.filter(F.split(text, ","), lambda p: p.contains("="))
    return F.transform(parts, lambda p: F.struct(hash_name(F.regexp_extract(p, r"^([^=]*)=", 1)).alias("algo"), F.lower(F.trim(F.regexp_extract(p, r"=(.*)$", 1))).alias("hex")))


def http_date(text: Column) -> Column:
    """``Sun, 06 Nov 1994 08:49:37 GMT`` as a timestamp; null if it does not parse."""
    return F.try_to_timestamp(F.regexp_extract(text, r"^\w+, (\d\d \w{3} \d{4} \d\d:\d\d:\d\d) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))


def link_header(header: Column) -> Column:
    """array<struct<url, rel, media_type, pri, digests>> of a Link header: parts between
    commas outside angle brackets that have a URL and a rel; digests as algo=hex."""
    rx = r"<([^>]*)>([^,<]*(?:=[^,<]*)*)"
    refs, params = (F.regexp_extract_all(header, F.lit(rx), F.lit(i)) for i in (1, 2))
    get = lambda p, name: F.trim(F.regexp_replace(F.trim(F.regexp_extract(p, rf"(?i);\s*(?:{name})\s*=\s*([^;]*)", 1)), r'^"|"$', ""))

    def one(x: Column) -> Column:
        p = x["p"]
        given = F.regexp_extract_all(p, F.lit(r'(?i);\s*digest\s*=\s*"?([A-Za-z0-9_-]+=[A-Za-z0-9+/_=-]+)"?'), F.lit(1))
        coded = lambda d: F.translate(F.rtrim(F.lit("="), F.regexp_extract(d, r"^[^=]*=(.*)$", 1)), "-_", "+/")
        digests = F.filter(
            F.transform(given, lambda d: F.struct(hash_name(F.regexp_extract(d, r"^([^=]*)=", 1)).alias("algo"), F.lower(F.hex(F.try_to_binary(F.concat(coded(d), F.repeat(F.lit("="), (4 - F.length(coded(d)) % 4) % 4)), F.lit("base64")))).alias("hex"))),
            lambda d: d["hex"].isNotNull() & d["algo"].isin("md5", "sha-1", "sha-256", "sha-512"),
        )
        kind = get(p, "type")
        return F.struct(F.trim(x["u"]).alias("url"), F.lower(get(p, "rel")).alias("rel"), F.when(kind != "", kind).alias("media_type"), get(p, "pri|priority").try_cast("int").alias("pri"), digests.alias("digests"))

    return F.filter(F.transform(F.arrays_zip(refs.alias("u"), params.alias("p")), one), lambda x: (x["url"] != "") & (x["rel"] != ""))
