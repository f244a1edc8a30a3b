"""FTP listings: machine lists, Unix lists, file modes and safe names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    """The name without quotes around it; null where it is empty, ``.``, ``..`` or could
    lead elsewhere."""
    n = F.regexp_replace(F.trim(name), r"""^["']+|["']+$""", "")
    return F.when(~n.isin("", ".", "..") & ~n.rlike(r"[/\\\x00]"), n)


def _entry(name: Column, kind: Column, target: Column) -> Column:
    return F.when(safe_name(name).isNotNull(), F.struct(safe_name(name).alias("name"), kind.alias("kind"), target.alias("target")))


def mlsd_entry(line: Column) -> Column:
    """struct<name, kind, target> of a machine-listing line; null if it has no usable name.
    Facts end at the last space."""
    facts, name = F.lower(F.regexp_extract(line, r"^(.*) ", 1)), F.regexp_extract(line, r"^.* (.*)$", 1)
    kind = F.regexp_extract(facts, r"(?:^|;)\s*type=([^;]*)", 1)
    target = F.regexp_extract(F.regexp_extract(line, r"^(.*) ", 1), r"(?i)(?:os\.)?unix\.s(?:ym)?link:([^;]*)", 1)
    link = kind.rlike(r"unix\.s(ym)?link") | (kind == "symlink")
    out = F.when(link, "symlink").when(kind == "file", "file").when(kind.isin("dir", "cdir", "pdir"), "dir").otherwise("other")
    return _entry(name, out, F.when(link & (target != ""), target))


def unix_entry(line: Column) -> Column:
    """struct<name, kind, target> of an ``ls -l`` line of at least nine fields."""
    fields = F.split(F.trim(line), r"\s+")
    first = F.left(F.trim(line), F.lit(1))
    rest = F.array_join(F.slice(fields, 9, F.greatest(F.size(fields) - 8, F.lit(1))), " ")
    kind = F.when(first == "d", "dir").when(first == "l", "symlink").when(first == "-", "file").otherwise("other")
    name = F.when(first == "l", F.regexp_extract(F.concat(rest, F.lit(" -> ")), r"^(.*?) -> ", 1)).otherwise(rest)
    target = F.when((first == "l") & rest.contains(" -> "), F.regexp_extract(rest, r"^.*? -> (.*)$", 1))
    return F.when(F.size(fields) >= 9, _entry(name, kind, target))


def unix_mode(line: Column) -> Column:
    """The permission bits of an ``ls -l`` line as an integer; null if it has none."""
    bits = F.regexp_extract(F.trim(line), r"^[-dlbcps]([-r][-w][-xsS][-r][-w][-xsS][-r][-w][-xtT])", 1)
    total = F.lit(0)
    for i in range(9):
        c = F.substring(bits, i + 1, 1)
        total = total + F.when(c.isin(*(("r", "w", "x")[i % 3 : i % 3 + 1]), "s", "t"), 1 << (8 - i)).otherwise(0)
        if i % 3 == 2:
            total = total + F.when(F.lower(c).isin("s", "t"), {2: 0o4000, 5: 0o2000, 8: 0o1000}[i]).otherwise(0)
    return F.when(bits != "", total)


def mlst_mode(facts: Column) -> Column:
    """The octal ``unix.mode`` fact as an integer."""
    return F.conv(F.regexp_extract(facts, r"(?i)unix\.mode=0*([0-7]{1,6})", 1), 8, 10).try_cast("int")


def child_url(listing: Column, name: Column) -> Column:
    """The URL of an entry in the folder of a listing's URL; null for unsafe names."""
    ok = ~name.contains("/") & ~name.contains("://") & (name != "") & ~has_injection(name)
    return F.when(ok, F.concat(F.regexp_extract(listing, r"^(.*/)", 1), name))


def safe_link(name: Column, target: Column) -> Column:
    """Whether a symbolic link stays within its folder's tree."""
    return ~name.rlike(r"[/\\]") & ~target.startswith("/") & ~target.rlike(r"(^|/)\.\.(/|$)")


def has_injection(text: Column) -> Column:
    """Line ends or NUL, which would smuggle a command."""
    return text.rlike(r"[\r\n\x00]")


def name_of_line(line: Column) -> Column:
    """The last token between spaces, tabs or slashes, as a glob sees a listing."""
    return F.element_at(F.split(F.trim(line), r"[ \t/]"), -1)
