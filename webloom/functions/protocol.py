"""Replies, addresses and pins of transfer protocols as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def passive_address(reply: Column) -> Column:
    """``h1.h2.h3.h4:port`` of a reply to PASV; null if it has no six numbers in brackets or
    one above 255."""
    n = F.split(F.regexp_extract(reply, r"\(([^)]*)\)", 1), ",")
    numbers = F.transform(n, lambda x: F.when(F.trim(x).rlike(r"^[0-9]{1,3}$"), F.trim(x).cast("int")))
    good = (F.size(n) >= 6) & ~F.exists(F.slice(numbers, 1, 6), lambda x: x.isNull() | (x > 255))
    return F.when(F.coalesce(good, F.lit(False)), F.concat(F.array_join(F.transform(F.slice(numbers, 1, 4), lambda x: x.cast("string")), "."), F.lit(":"), (numbers[4] * 256 + numbers[5]).cast("string")))


def port_command(ip: Column, port: Column) -> Column:
    """The command that names an address to an FTP server: PORT, or EPRT for IPv6."""
    old = F.concat(F.lit("PORT "), F.replace(ip, F.lit("."), F.lit(",")), F.lit(","), F.floor(port / 256).cast("string"), F.lit(","), (port % 256).cast("string"))
    return F.when(ip.contains(":"), F.concat(F.lit("EPRT |2|"), ip, F.lit("|"), port.cast("string"), F.lit("|"))).otherwise(old)


def pinned_keys(spec: Column) -> Column:
    """array<string>: the digests (hex) of ``sha256//base64`` parts between semicolons; null
    if a part is of another form, does not decode to 32 bytes, or there is none."""
    parts = F.filter(F.transform(F.split(spec, ";"), lambda p: F.trim(p)), lambda p: p != "")
    coded = F.transform(parts, lambda p: F.when(p.rlike("^(sha256|SHA256)//"), F.try_to_binary(F.substr(p, F.lit(9)), F.lit("base64"))))
    good = (F.size(parts) > 0) & F.forall(coded, lambda b: F.coalesce(F.octet_length(b) == 32, F.lit(False)))
    return F.when(good, F.transform(coded, lambda b: F.lower(F.hex(b))))


def ordered_addresses(addresses: Column, prefer: str | None = None, only: str | None = None) -> Column:
    """Addresses with those of the preferred family (``ipv4``, ``ipv6``) first, otherwise in
    their order; with ``only`` no others."""
    six = lambda a: a.contains(":")
    fits = lambda a, family: six(a) if family.lower() == "ipv6" else ~six(a)
    if only:
        return F.filter(addresses, lambda a: fits(a, only))
    if not prefer:
        return addresses
    return F.concat(F.filter(addresses, lambda a: fits(a, prefer)), F.filter(addresses, lambda a: ~fits(a, prefer)))
