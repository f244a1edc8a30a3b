"""From responses to files: what to ask for given what is there, what to write, and the
writing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import extract, text, urls
from webloom.operators import ranges
from webloom.plans.config import CrawlConfig
from webloom.store import stored


def request_plan(wanted: DataFrame, local: DataFrame, config: CrawlConfig) -> DataFrame:
    """Adds ``start`` (the byte to go on from) and ``since`` (a date for a conditional
    request) to rows (url, path), from a table (path, size, mtime) of the files there are:
    a given start first, else the size of a file to continue; a date only where nothing is
    resumed."""
    there = local.groupBy("path").agg(F.max("size").alias("_size"), F.max("mtime").alias("_mtime"))
    met = wanted.join(there, "path", "left")
    fixed = F.lit(config.start_pos).cast("bigint")
    start = fixed if config.start_pos is not None else F.col("_size") if config.continue_download else F.lit(None).cast("bigint")
    start = F.when(start > 0, start)
    dated = F.lit(config.timestamping and config.if_modified_since and not config.spider) & start.isNull()
    return met.select(*wanted.columns, start.alias("start"), F.when(dated, http_date_of(F.col("_mtime"))).alias("since"))


def destinations(rows: DataFrame, existing: DataFrame, *, order: str = "url") -> DataFrame:
    """Adds ``dest`` to a whole batch (path, ``order`` and more): the rows that want one path
    take it and then ``path.1``, ``path.2`` and so on, in order, without the numbers that
    existing files (path) or other rows' own paths have.  ``order`` is a key of its path; a null
    path stays null.

    A row of rank r takes the r-th free number: r and as many more as there are taken numbers
    t_j (from the least, j from 0) with t_j - j <= r.  Ranks and counts are running sums over
    ranges, so a path that very many rows want is spread like any other."""
    wanted = rows.where("path is not null")
    names = wanted.select("path").distinct()
    there = existing.select("path").where("path is not null").distinct()
    number = F.regexp_extract("path", r"^(.*)\.([1-9][0-9]{0,17})$", 2)
    used = there.unionByName(names).distinct().where(number != "").select(F.regexp_extract("path", r"^(.*)\.([1-9][0-9]{0,17})$", 1).alias("path"), number.cast("bigint").alias("n"))
    used = used.unionByName(there.select("path", F.lit(0).cast("bigint").alias("n"))).join(names, "path", "left_semi")
    taken = ranges.running(ranges.ranged(used, "path", "n"), "path", ["n"], j=F.lit(1)).select("path", (F.col("n") - F.col("j")).alias("v"))
    placed = stored(ranges.running(ranges.ranged(wanted, "path", order), "path", [order], _rank=F.lit(1)).drop("_part"))
    marks = placed.select("path", F.col("_rank").alias("v"), F.lit(1).alias("kind"), F.lit(0).alias("one")).unionByName(taken.select("path", "v", F.lit(0).alias("kind"), F.lit(1).alias("one")))
    counts = ranges.running(ranges.ranged(marks, "path", "v", "kind"), "path", ["v", "kind"], _more=F.col("one")).where("kind = 1").select("path", F.col("v").alias("_rank"), "_more")
    at = F.col("_rank") + F.col("_more")
    done = placed.join(counts, ["path", "_rank"]).withColumn("dest", F.when(at == 0, F.col("path")).otherwise(F.concat("path", F.lit("."), at.cast("string"))))
    return done.select(*rows.columns, "dest").unionByName(rows.where("path is null").withColumn("dest", F.lit(None).cast("string")))


def http_date_of(time: Column) -> Column:
    """``Sun, 06 Nov 1994 08:49:37 GMT`` of a timestamp in a session of UTC."""
    return F.date_format(time, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def outcome(responses: DataFrame, local: DataFrame, config: CrawlConfig) -> DataFrame:
    """Adds ``action`` (keep, append, write) and ``mtime`` (of the server, unless not wanted)
    to responses (path, status, start, last_modified): a 304 keeps the file, and so does,
    without conditional requests, a server's file no newer than the local one; a rest is
    appended only to a 206, all else is written anew."""
    there = local.groupBy("path").agg(F.max("mtime").alias("_mtime"))
    met = responses.join(there, "path", "left")
    served = text.http_date(F.col("last_modified"))
    old = F.lit(config.timestamping and not config.if_modified_since and not config.spider) & F.col("start").isNull() & (served <= F.col("_mtime"))
    action = F.when((F.col("status") == 304) | F.coalesce(old, F.lit(False)), "keep").when((F.col("status") == 206) & F.col("start").isNotNull(), "append").otherwise("write")
    return met.select(*responses.columns, action.alias("action"), (served if config.use_server_timestamps else F.lit(None).cast("timestamp")).alias("mtime"))


def ftp_plan(start: Column, size: Column) -> Column:
    """struct<action, rest>: complete where all is there, else the commands' offset; an
    unknown size does not stop a resumption."""
    done = F.coalesce((start > 0) & (start >= size), F.lit(False))
    return F.struct(F.when(done, "complete").when(start > 0, "rest").otherwise("retr").alias("action"), F.when(~done & (start > 0), start).alias("rest"))


def response_head(status: Column, reason: Column, headers: Column) -> Column:
    """The head of a response as text, from an array<struct<name, value>>."""
    lines = F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    return F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" "), F.coalesce(reason, F.lit("")), F.lit("\r\n"), lines, F.lit("\r\n"))


def contents(responses: DataFrame, config: CrawlConfig) -> DataFrame:
    """(path, action, mtime, start, content) of what goes to disk, from responses (path, action,
    mtime, start, status, reason, headers, body BINARY): with ``save_headers`` the head goes
    before a body that is not appended; with ``delete_after`` or in a spider nothing is left."""
    body = F.col("body")
    if config.save_headers:
        head = F.encode(response_head(F.col("status"), F.col("reason"), F.col("headers")), "UTF-8")
        body = F.when(F.col("action") == "append", body).otherwise(F.concat(head, body))
    rows = responses.where((F.col("action") != "keep") & ~F.lit(config.delete_after or config.spider))
    start = F.col("start") if "start" in responses.columns else F.lit(None)
    return rows.select("path", "action", "mtime", start.cast("bigint").alias("start"), body.alias("content"))


def attributes(pages: DataFrame) -> DataFrame:
    """(path, origin_url, referrer_url, mime_type) of saved pages (path, url, final_url,
    content_type): the referrer only where it is another URL."""
    mime = F.trim(F.element_at(F.split("content_type", ";"), 1))
    return pages.select("path", F.col("final_url").alias("origin_url"), F.when(F.col("url") != F.col("final_url"), F.col("url")).alias("referrer_url"), F.when(mime != "", mime).alias("mime_type"))


def listings(folders: DataFrame, config: CrawlConfig) -> DataFrame:
    """(path, kept): the listing file of each listed folder (path), and whether it stays."""
    return folders.select(F.concat(F.regexp_extract("path", r"^(.*/)?", 0), F.lit(".listing")).alias("path"), F.lit(config.keep_listing).alias("kept"))


def input_links(files: DataFrame, config: CrawlConfig, *, body: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """URLs that input files (``text``) hold: with force flags the links of the text read as
    each of the kinds, against ``base``; else its lines.  Columns of the file to ``keep`` come
    first."""
    base = F.lit(config.base or "file:///")
    none = F.array().cast("array<string>")
    options = {"follow_tags": config.follow_tags, "ignore_tags": config.ignore_tags, "strict_comments": config.strict_comments}
    kinds = [k for k, on in (("rss", config.force_rss), ("atom", config.force_atom), ("sitemap", config.force_sitemap)) if on]
    if not (config.force_html or config.force_css or kinds):
        lines = files.select(*keep, F.explode(F.split(F.col(body), r"\r?\n")).alias("_line")).select(*keep, F.trim("_line").alias("_line")).where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
        return lines.select(*keep, urls.resolve_input(F.col("_line"), config.base, config.iri).alias("url"))
    found = [extract.html_links(base, F.col(body), **options)] if config.force_html else []
    found += [extract.css_links(base, F.col(body))] if config.force_css else []
    plain = files.select(*keep, F.explode(F.concat(*found) if found else none).alias("url"))
    if not kinds:
        return plain
    return plain.unionByName(files.select(*keep, F.explode(F.concat(*[extract.feed_links(base, F.array(F.lit(k)), F.col(body)) for k in kinds])).alias("url")))


def prefixes(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(text, found): for each of the texts (text) the keys (url) that it begins with, where
    there are any.  Both are distinct.

    Texts and keys are sorted together in ranges; a key stands before all texts that begin with
    it, and the keys that are prefixes of the row at hand are a stack, as prefixes of one text
    are prefixes of each other.  What is open where a range begins is looked up once: the
    prefixes of the ranges' first rows, joined to the keys, come to every task (a row for each
    range).  So each text and key is sent once, whatever their lengths."""
    both = keys.select(F.col("url").alias("text"), F.lit(0).alias("kind")).unionByName(texts.select("text", F.lit(1).alias("kind"))).where("text is not null")
    rows = ranges.ranged(both, "text", "kind")
    firsts = rows.groupBy("_part").agg(F.min("text").alias("first"))
    each = firsts.select("_part", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("first"), F.lit(1))), lambda n: F.left("first", n))).alias("url"))
    opened = {r["_part"]: sorted(r["found"], key=len) for r in each.join(keys.select("url"), "url").groupBy("_part").agg(F.collect_set("url").alias("found")).collect()}
    begin = rows.sparkSession.sparkContext.broadcast(opened)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []
        for pdf in batches:
            out = []
            for part, text_, kind in zip(pdf["_part"], pdf["text"], pdf["kind"], strict=True):
                if part != at:
                    at, stack = part, list(begin.value.get(part, []))
                while stack and not text_.startswith(stack[-1]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1] != text_:
                        stack.append(text_)
                elif stack:
                    out.append((text_, list(stack)))
            yield pd.DataFrame(out, columns=["text", "found"])

    # a range may be read in pieces, so the order is made again where they meet
    return rows.repartition("_part").sortWithinPartitions("_part", "text", "kind").mapInPandas(run, "text string, found array<string>")


def converted(pages: DataFrame, config: CrawlConfig) -> DataFrame:
    """(path, html, original) of fetched pages (url, path, body) with the URLs of all saved
    pages replaced by their paths, in the order of url; ``original`` is the text before.

    A document meets only what it holds: the URLs written in it meet the saved ones that they
    begin with in a sorted sweep (``prefixes``), or, with ``convert_file_only``, its links are
    joined to the saved pages."""
    saved = pages.where("path is not null").groupBy("url").agg(F.min("path").alias("path"))
    docs = pages.where("body is not null").select(F.col("path").alias("doc"), F.col("body").alias("html"), F.col("url").alias("base"))
    if config.convert_file_only:
        each = docs.select("doc", F.explode(extract.html_links(F.col("base"), F.col("html"))).alias("url"))
    else:
        said = F.array_distinct(F.regexp_extract_all("html", F.lit(r"(?:https?|ftp)://[^\s\"'<>]+"), F.lit(0)))
        written = stored(docs.select("doc", F.explode(said).alias("said")))
        each = written.join(prefixes(written.select(F.col("said").alias("text")).distinct(), saved.select("url")), F.col("said") == F.col("text")).select("doc", F.explode("found").alias("url")).distinct()
    found = each.join(saved, "url").groupBy("doc").agg(F.array_sort(F.collect_set(F.struct(F.col("url").alias("from"), F.col("path").alias("to")))).alias("mapping"))
    met = docs.join(found, "doc", "left")
    none = F.array().cast("array<struct<from:string,to:string>>")
    return met.select(F.col("doc").alias("path"), extract.convert_links(F.col("html"), F.coalesce("mapping", none), config.convert_file_only).alias("html"), F.col("html").alias("original"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write (path, action, mtime, start, content) below a folder that all executors mount, and
    give (path, bytes).  A file is written under a hidden name and renamed when it is whole.
    What is appended goes to its place ``start``, and what stands behind that is cut off, so a
    task that runs again leaves the same file.  Paths that lead out of the folder are left out,
    with -1 bytes, and so is a rest whose place is not known or beyond the file's end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import shutil

        from pyspark import TaskContext

        root, attempt = os.path.realpath(folder), TaskContext.get().taskAttemptId()
        for pdf in batches:
            done = []
            for path, action, mtime, start, content in zip(pdf["path"], pdf["action"], pdf["mtime"], pdf["start"], pdf["content"], strict=True):
                to = os.path.normpath(os.path.join(root, path))
                at = 0 if action != "append" else -1 if pd.isna(start) else int(start)
                if not to.startswith(root + os.sep) or at < 0 or at > (os.path.getsize(to) if at and os.path.exists(to) else 0):
                    done.append((path, -1))
                    continue
                os.makedirs(os.path.dirname(to), exist_ok=True)
                hidden = os.path.join(os.path.dirname(to), f".{os.path.basename(to)}.{attempt}")
                if at:
                    shutil.copyfile(to, hidden)
                    os.truncate(hidden, at)
                with open(hidden, "ab" if at else "wb") as f:
                    f.write(bytes(content or b""))
                if not pd.isna(mtime):
                    os.utime(hidden, (mtime.timestamp(), mtime.timestamp()))
                os.replace(hidden, to)
                done.append((path, len(content or b"")))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    start = F.col("start").cast("bigint") if "start" in rows.columns else F.lit(None).cast("bigint")
    return rows.select("path", "action", "mtime", start.alias("start"), "content").mapInPandas(run, "path string, bytes bigint")
