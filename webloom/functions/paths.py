"""Local paths: from URLs, safe components, extensions, collisions and backups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions import text, urls
from webloom.plans.config import CrawlConfig


def sanitise(name: Column, modes: tuple[str, ...] | list[str]) -> Column:
    """A path component without characters that the modes forbid (each becomes ``_``);
    empty, ``.`` and ``..`` become ``_``."""
    bad = [r"\x00"]
    if "nocontrol" in modes:
        bad.append(r"\x00-\x1f\x7f")
    if "unix" in modes:
        bad.append(r"/\n")
    if "windows" in modes:
        bad.append(r"<>:\"\\|?*")
    if "ascii" in modes:
        bad.append(r"\x{80}-\x{10FFFF}")
    out = F.regexp_replace(name, f"[{''.join(bad)}]", "_")
    if "lowercase" in modes:
        out = F.lower(out)
    elif "uppercase" in modes:
        out = F.upper(out)
    return F.when(out.isin("", ".", ".."), F.lit("_")).otherwise(out)


def _under(prefix: str, parts: Column) -> Column:
    return F.concat(F.lit("" if prefix == "" else prefix.rstrip("/") + "/"), F.array_join(parts, "/"))


def local_path(url: Column, config: CrawlConfig) -> Column:
    """Where a URL is saved.  One retrieval gives a base name; recursion, page requisites
    or forced directories give host and path directories."""
    if config.output_document is not None:
        return F.lit(config.output_document)
    u = urls.strip_query(url, config.cut_file_get_vars)
    p = urls.path(u)
    segments = F.filter(F.split(p, "/"), lambda s: s != "")
    cut = config.cut_dirs
    segments = F.when(F.size(segments) > cut, F.slice(segments, cut + 1, F.greatest(F.size(segments) - cut, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    folder_like = F.endswith(p, F.lit("/")) | (F.size(segments) == 0)
    name = F.when(folder_like, F.lit(config.default_page)).otherwise(urls.percent_decode(F.try_element_at(segments, F.lit(-1))))
    modes = config.restrict_file_names
    if not (config.force_directories or (config.directories and (config.recursive or config.page_requisites))):
        return _under(config.directory_prefix, F.array(sanitise(name, modes)))
    # the last segment is the file unless the path ends with a slash
    middle = F.when(F.endswith(p, F.lit("/")), segments).otherwise(F.when(F.size(segments) > 1, F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(1)))).otherwise(F.array().cast("array<string>")))
    parts = []
    if config.protocol_directories:
        parts.append(F.array(urls.scheme(u)))
    if config.host_directories:
        parts.append(F.when(urls.host(u).isNotNull(), F.array(sanitise(urls.host_port(u), modes))).otherwise(F.array().cast("array<string>")))
    parts += [F.transform(middle, lambda s: sanitise(urls.percent_decode(s), modes)), F.array(sanitise(name, modes))]
    return _under(config.directory_prefix, F.concat(*parts))


def extension_for(content_type: Column) -> Column:
    m = text.media_type(content_type)
    return F.when(m.isin("text/html", "application/xhtml+xml"), ".html").when(m == "text/css", ".css")


def with_extension(path: Column, extension: Column) -> Column:
    low = F.lower(path)
    has = ((extension == ".html") & (F.endswith(low, F.lit(".html")) | F.endswith(low, F.lit(".htm")))) | ((extension == ".css") & F.endswith(low, F.lit(".css")))
    return F.when(extension.isNull() | has, path).otherwise(F.concat(path, extension))


def with_name(path: Column, name: Column) -> Column:
    return F.concat(F.regexp_extract(path, r"^(.*/)?", 0), name)


def free_path(path: Column, existing: Column) -> Column:
    """The path, or the first of ``path.1``, ``path.2``, … not among the existing."""
    taken = F.transform(F.filter(existing, lambda e: F.startswith(e, F.concat(path, F.lit("."))) & F.substr(e, F.length(path) + 2).rlike(r"^[1-9][0-9]*$")), lambda e: F.substr(e, F.length(path) + 2).cast("int"))
    first = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(taken) + 1), taken))
    return F.when(F.array_contains(existing, path), F.concat(path, F.lit("."), first.cast("string"))).otherwise(path)


def destination(path: Column, existing: Column, config: CrawlConfig) -> Column:
    """struct<action, path>: skip or write, by the collision policy."""
    there = F.array_contains(existing, path)
    write = lambda p: F.struct(F.lit("write").alias("action"), p.alias("path"))
    if config.output_document is not None:
        return write(path)
    if config.no_clobber:
        return F.when(there, F.struct(F.lit("skip").alias("action"), path.alias("path"))).otherwise(write(path))
    if config.unique_names and not config.continue_download:
        return write(free_path(path, existing))
    return write(path)


def final_path(request: Column, final: Column, dest: Column, content_type: Column, disposition: Column, status: Column, existing: Column, config: CrawlConfig) -> Column:
    """The path after the transfer: the server's names, then the extension, then the
    collision policy; no change for one output document, standard output or a 304."""
    if config.output_document is not None:
        return dest
    name = text.disposition_name(disposition) if config.content_disposition else F.lit(None).cast("string")
    path = F.when((final != request) & F.lit(config.trust_server_names), local_path(final, config)).otherwise(dest)
    path = F.when(name.isNotNull(), with_name(path, sanitise(name, config.restrict_file_names))).otherwise(path)
    if config.adjust_extension:
        path = with_extension(path, extension_for(content_type))
    chosen = destination(path, existing, config)
    return F.when((dest == "-") | (status == 304) | (path == dest), dest).otherwise(F.when(chosen["action"] == "skip", dest).otherwise(chosen["path"]))


def backup_plan(path: Column, existing: Column, backups: int) -> Column:
    """array<struct<from, to>>: the renames, last first, that shift ``path`` to ``.1`` and
    each ``.n`` to ``.n+1``."""
    if backups <= 0:
        return F.array().cast("array<struct<from:string,to:string>>")
    name = lambda i: F.when(i == 0, path).otherwise(F.concat(path, F.lit("."), i.cast("string")))
    steps = F.transform(F.sequence(F.lit(backups), F.lit(1), F.lit(-1)), lambda i: F.struct(name(i - 1).alias("from"), name(i).alias("to")))
    return F.when(F.array_contains(existing, path), F.filter(steps, lambda s: F.array_contains(existing, s["from"]))).otherwise(F.array().cast("array<struct<from:string,to:string>>"))
