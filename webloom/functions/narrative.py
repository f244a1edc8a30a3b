"""Lines that tell of a retrieval, and text that goes to proxies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import text, urls


def redirects(hops: Column) -> Column:
    """Of an array of URLs: nothing, the hop, or their number and the last."""
    last = urls.redact(F.element_at(hops, -1))
    return F.when(F.size(hops) == 1, F.concat(F.lit("  -> "), last)).when(F.size(hops) > 1, F.concat(F.lit("  -> "), F.size(hops).cast("string"), F.lit(" redirects, final "), last))


def dns(host: Column, addresses: Column) -> Column:
    return F.concat(F.lit("  dns "), host, F.lit("  "), F.array_join(addresses, ", "))


def connected(address: Column) -> Column:
    return F.concat(F.lit("  connected "), address)


def reusing(host: Column, port: Column) -> Column:
    return F.concat(F.lit("  reusing connection "), host, F.lit(":"), port.cast("string"))


def status(code: Column, reason: Column) -> Column:
    r = F.trim(reason)
    return F.concat(F.lit("  HTTP "), code.cast("string"), F.when(r != "", F.concat(F.lit(" "), r)).otherwise(F.lit("")))


def length(total: Column, already: Column, content_type: Column) -> Column:
    """Size, what remains of it, and type; null if nothing is known."""
    ct = F.trim(content_type)
    left = F.when((already > 0) & (already < total), F.concat(F.lit(", "), (total - already).cast("string"), F.lit(" ("), text.format_bytes(total - already), F.lit(") remaining"))).otherwise(F.lit(""))
    known = F.concat(F.lit("  length "), total.cast("string"), F.lit(" ("), text.format_bytes(total), F.lit(")"), left, F.when(ct != "", F.concat(F.lit("  "), ct)).otherwise(F.lit("")))
    return F.coalesce(known, F.when(ct != "", F.concat(F.lit("  type "), ct)))


def saving_as(name: Column) -> Column:
    return F.concat(F.lit("  saving as "), name)


def proxy_target(url: Column) -> Column:
    """The absolute form of a request through a proxy."""
    return urls.without_fragment(urls.redact(url))


def connect_request(host: Column, port: Column, user: str | None = None, password: str | None = None) -> Column:
    to = F.concat(host, F.lit(":"), port.cast("string"))
    auth = F.lit("") if user is None else F.concat(F.lit("Proxy-Authorization: Basic "), basic_token(F.lit(user), F.lit(password or "")), F.lit("\r\n"))
    return F.concat(F.lit("CONNECT "), to, F.lit(" HTTP/1.1\r\nHost: "), to, F.lit("\r\n"), auth, F.lit("\r\n"))


def basic_token(user: Column, password: Column) -> Column:
    return F.base64(F.encode(F.concat(user, F.lit(":"), password), "UTF-8"))
