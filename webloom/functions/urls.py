"""URLs as Columns: parts, joining, normal form, query variables, hosts and globs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Generic URI syntax: scheme, authority, path, query, fragment.
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#\\]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
AUTHORITY = r"^(?:([^@]*)@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
DEFAULT_PORT = {"http": "80", "https": "443", "ftp": "21", "ftps": "990"}
#: Characters that are percent-encoded in a path and in a query: controls, space, quotes
#: and brackets of the URL standard's sets, and everything that is not ASCII.
PATH_BAD = r"[\x00-\x20\"<>`{}\x7f-\x{10FFFF}]"
FRAGMENT_BAD = r"[\x00-\x20\"<>`\x7f-\x{10FFFF}]"
QUERY_BAD = r"[\x00-\x20\"<>'\x7f-\x{10FFFF}]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once: expressions that use a part many times
    would otherwise grow with every level of nesting."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def _opt(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def _present(value: Column) -> Column:
    return F.when(value != "", value)


def scheme(url: Column) -> Column:
    return _present(F.lower(_opt(url, 1)))


def authority(url: Column) -> Column:
    return _opt(url, 3)


def userinfo(url: Column) -> Column:
    return _present(F.regexp_extract(authority(url), AUTHORITY, 1))


def host(url: Column) -> Column:
    """The lower-cased host; null if there is none."""
    return _present(F.lower(F.regexp_extract(authority(url), AUTHORITY, 2)))


def port(url: Column) -> Column:
    return _present(F.regexp_extract(authority(url), AUTHORITY, 3)).cast("int")


def path(url: Column) -> Column:
    """The path; ``/`` where an authority is followed by none."""
    p = _opt(url, 4)
    return F.when((p == "") & (_opt(url, 2) != ""), F.lit("/")).otherwise(p)


def query(url: Column) -> Column:
    """The query without its mark; null if there is no mark."""
    return F.when(_opt(url, 5) != "", _opt(url, 6))


def fragment(url: Column) -> Column:
    return F.when(_opt(url, 7) != "", _opt(url, 8))


def components(url: Column) -> Column:
    return F.struct(
        scheme(url).alias("scheme"), userinfo(url).alias("userinfo"), host(url).alias("host"), port(url).alias("port"), path(url).alias("path"), query(url).alias("query"), fragment(url).alias("fragment")
    )


def origin(url: Column) -> Column:
    """``scheme://host[:port]``, the key of a robots file."""
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(port(url).isNotNull(), F.concat(F.lit(":"), port(url).cast("string"))).otherwise(F.lit("")))


def host_port(url: Column) -> Column:
    return F.concat(host(url), F.when(port(url).isNotNull(), F.concat(F.lit(":"), port(url).cast("string"))).otherwise(F.lit("")))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def percent_encode(text: Column, bad: str) -> Column:
    """Percent-encode the UTF-8 bytes of the characters of a class; nothing is done to a
    text without any."""

    def encode(t: Column) -> Column:
        each = F.transform(F.split(t, ""), lambda c: F.when(c.rlike(bad), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c))
        return F.when(t.rlike(bad), F.array_join(each, "")).otherwise(t)

    return let(text, encode)


def percent_decode(text: Column) -> Column:
    """Decode percent escapes (``+`` stays); a text that does not decode stays as it is."""
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)


def remove_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def step(acc: Column, s: Column) -> Column:
        up = F.lower(s).isin("..", "%2e%2e", ".%2e", "%2e.")
        here = F.lower(s).isin(".", "%2e")
        return F.when(up, F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(here, acc).otherwise(F.concat(acc, F.array(s)))

    def close(segments: Column) -> Column:
        kept = F.aggregate(segments, F.array().cast("array<string>"), step)
        last = F.lower(F.element_at(segments, -1)).isin(".", "..", "%2e", "%2e%2e", ".%2e", "%2e.")
        return F.array_join(F.concat(kept, F.when(last, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/")

    return let(p, lambda x: F.when(x.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), close(F.split(x, "/", -1))).otherwise(x))


def _tidy(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def _fields(url: Column) -> Column:
    a = authority(url)
    return F.struct(
        scheme(url).alias("scheme"), host(url).alias("host"), F.regexp_extract(a, AUTHORITY, 1).alias("user"), F.regexp_extract(a, AUTHORITY, 3).alias("port"), a.alias("authority"), path(url).alias("path"), _opt(url, 4).alias("rest"),
        query(url).alias("query"), fragment(url).alias("fragment"),
    )


def _written(f: Column) -> Column:
    special = f["scheme"].isin(*DEFAULT_PORT)
    default = F.coalesce(*[F.when(f["scheme"] == k, F.lit(v)) for k, v in DEFAULT_PORT.items()], F.lit(""))
    some = lambda mark, x, bad: F.when(x.isNotNull(), F.concat(F.lit(mark), percent_encode(x, bad))).otherwise(F.lit(""))
    raw = F.when(special, F.replace(f["path"], F.lit("\\"), F.lit("/"))).otherwise(f["path"])
    tail = F.concat(some("?", f["query"], QUERY_BAD), some("#", f["fragment"], FRAGMENT_BAD))
    whole = F.concat(
        f["scheme"], F.lit("://"), F.when(f["user"] != "", F.concat(f["user"], F.lit("@"))).otherwise(F.lit("")), f["host"], F.when((f["port"] != "") & (f["port"] != default), F.concat(F.lit(":"), f["port"])).otherwise(F.lit("")), percent_encode(remove_dots(raw), PATH_BAD), tail
    )
    good = f["host"].isNotNull() & ~(special & f["host"].rlike(r"[\s<>^|%]"))
    return F.when(f["scheme"].isNotNull(), F.when(good, whole).when(~special & f["host"].isNull(), F.concat(f["scheme"], F.lit(":"), f["rest"], tail)))


def serialise(url: Column) -> Column:
    """The serialised form of an absolute hierarchical URL: lower-case scheme and host, no
    default port, dot segments resolved, and unsafe or non-ASCII characters encoded; null
    if it does not parse.  (Hosts beyond ASCII stay as they are.)"""
    return let(url, lambda u: let(_fields(u), _written))


def join(base: Column, ref: Column) -> Column:
    """Resolve a reference against an absolute URL and serialise it; null if either does
    not parse."""

    def against(b: Column, r: Column) -> Column:
        root = F.concat(b["scheme"], F.lit("://"), b["authority"])
        own = F.concat(root, b["path"], F.when(b["query"].isNotNull(), F.concat(F.lit("?"), b["query"])).otherwise(F.lit("")))
        return (
            F.when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r)
            .when(r.rlike(r"^[/\\]{2}"), F.concat(b["scheme"], F.lit(":"), F.replace(r, F.lit("\\"), F.lit("/"))))
            .when(r.rlike(r"^[/\\]"), F.concat(root, F.regexp_replace(r, r"^\\", "/")))
            .when((r == "") | r.startswith("#"), F.concat(own, r))
            .when(r.startswith("?"), F.concat(root, b["path"], r))
            .otherwise(F.concat(root, folder(b["path"]), r))
        )

    return let(F.struct(_fields(base).alias("b"), _tidy(ref).alias("r")), lambda x: serialise(against(x["b"], x["r"])))


def normalise(url: Column, allow_iri: bool = True) -> Column:
    """A typed URL in serialised form: ``http://`` is put before one without ``://``; with
    ``allow_iri`` off one beyond ASCII is null."""
    tidy = _tidy(url)
    full = F.when(tidy.contains("://"), tidy).otherwise(F.concat(F.lit("http://"), tidy))
    out = serialise(full)
    return out if allow_iri else F.when(~url.rlike(r"[^\x00-\x7F]"), out)


def resolve_input(url: Column, base: str | None, allow_iri: bool = True) -> Column:
    """A line of a URL list: joined to ``base`` only where it has no ``://``."""
    if base is None:
        return normalise(url, allow_iri)
    return F.when(url.contains("://"), normalise(url, allow_iri)).otherwise(join(F.lit(base), url))


def form_encode(text: Column) -> Column:
    """application/x-www-form-urlencoded: all but letters, digits and ``*-._`` encoded,
    space as ``+``."""
    return F.replace(percent_encode(text, r"[^A-Za-z0-9*\-._ ]"), F.lit(" "), F.lit("+"))


def strip_query(url: Column, names: list[str] | None) -> Column:
    """None leaves the URL; an empty list drops the query; a list drops these keys (case
    counts) and writes the others again in form encoding."""
    if names is None:
        return url
    before, after = F.regexp_extract(url, r"^[^?#]*", 0), F.regexp_extract(url, r"#.*$", 0)
    if not names:
        return F.concat(before, after)
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(
        F.filter(F.split(query(url), "&"), lambda x: x != ""),
        lambda x: F.struct(decode(F.regexp_extract(x, r"^[^=]*", 0)).alias("k"), decode(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.filter(pairs, lambda x: ~x["k"].isin(*names))
    again = F.array_join(F.transform(kept, lambda x: F.concat(form_encode(x["k"]), F.lit("="), form_encode(x["v"]))), "&")
    return F.when(query(url).isNull(), url).when(F.size(kept) == 0, F.concat(before, after)).otherwise(F.concat(before, F.lit("?"), again, after))


def redact(url: Column) -> Column:
    """The URL without user name and password."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^@/?#]*@", "$1")


def host_suffixes(h: Column) -> Column:
    """A host and the domains above it, longest first."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_in(h: Column, domains: list[str]) -> Column:
    """Equal to a domain or below one; case counts."""
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d))) if domains else F.lit(False)


def folder(p: Column) -> Column:
    """A path up to its last slash."""
    f = F.regexp_extract(p, r"^(.*/)", 1)
    return F.when(f == "", F.lit("/")).otherwise(f)


def basename(p: Column) -> Column:
    """The last non-empty segment of a path; empty for the root."""
    return F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.filter(F.split(p, "/"), lambda s: s != "")), -1), F.lit(""))


def glob_regex(pattern: str, ignore_case: bool = False) -> str:
    """A shell glob (``*``, ``?``, ``[a-z]``, ``[!x]``) as an anchored regular expression.
    An unclosed bracket stands for itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(r"[\s\S]*")
        elif c == "?":
            out.append(r"[\s\S]")
        elif c == "[" and end > 0:
            body = pattern[i + 1 : end]
            negated = body[0] in "!^"
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        i += 1
    return ("(?i)" if ignore_case else "") + "^" + "".join(out) + r"\z"


def matches_glob(name: Column, pattern: str, ignore_case: bool = False) -> Column:
    return name.rlike(glob_regex(pattern, ignore_case))
