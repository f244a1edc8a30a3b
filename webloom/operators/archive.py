"""Archive records as tables: digests, revisits, index rows, rotation and record bytes."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.operators import ranges
from webloom.store import stored

CDX_HEADER = " CDX N b a m s k r M S V g"


def payload(message: Column) -> Column:
    """What follows the first empty line of an HTTP message (BINARY); null without one."""
    # one character for each byte, so that places are those of the bytes
    at = F.instr(F.decode(message, "ISO-8859-1"), "\r\n\r\n")
    return F.when(at > 0, F.substr(message, at + 4))


def sha1_digest(data: Column) -> Column:
    """``sha1:`` and the base-16 digest; null for null."""
    return F.concat(F.lit("sha1:"), F.sha1(data))


def verify(body: Column, algo: Column, expected: Column) -> Column:
    """Whether a digest holds; an unknown algorithm is no evidence and passes."""
    want = F.lower(F.trim(expected))
    return (
        F.when(algo == "md5", F.md5(body) == want)
        .when(algo == "sha-1", F.sha1(body) == want)
        .when(algo == "sha-256", F.sha2(body, 256) == want)
        .when(algo == "sha-512", F.sha2(body, 512) == want)
        .otherwise(F.lit(True))
    )


def http_message(status: Column, reason: Column, headers: Column, body: Column) -> Column:
    """A response as bytes, from an array<struct<name, value>> of headers."""
    lines = F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    head = F.concat(F.lit("HTTP/1.1 "), status.cast("string"), F.lit(" "), reason, F.lit("\r\n"), lines, F.lit("\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body)


def http_request(method: Column, target: Column, host: Column, headers: Column) -> Column:
    lines = F.array_join(F.transform(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"], F.lit("\r\n"))), "")
    return F.encode(F.concat(method, F.lit(" "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n"), lines, F.lit("\r\n")), "UTF-8")


def digests_of_index(lines: DataFrame, *, line: str = "value") -> DataFrame:
    """Digests (bare, lower case) of index lines: every token ``sha1:…`` or of 40 hex
    digits; headers, comments and blank lines are skipped."""
    text = F.trim(F.col(line))
    tokens = lines.where((text != "") & ~text.startswith("CDX") & ~text.startswith("#")).select(F.explode(F.split(text, r"\s+")).alias("t"))
    return tokens.where(F.col("t").rlike(r"^(?:sha1:\S+|[0-9A-Fa-f]{40})$")).select(F.lower(F.regexp_replace("t", "^sha1:", "")).alias("digest")).distinct()


def with_digests(responses: DataFrame, *, message: str = "message") -> DataFrame:
    return responses.withColumns({"block_digest": F.sha1(F.col(message)), "payload_digest": F.sha1(payload(F.col(message)))})


def mark_revisits(responses: DataFrame, prior: DataFrame) -> DataFrame:
    """Adds ``record_type``: ``revisit`` where the payload's or the block's digest is in
    the prior index, else ``response``.  The index is joined to digests alone; the records
    with their bodies are joined once, to the pairs of digests that it holds."""
    known = prior.select(F.col("digest").alias("_d")).distinct()
    pairs = responses.select(F.col("payload_digest").alias("_p"), F.col("block_digest").alias("_b")).distinct()
    either = pairs.select("_p", "_b", F.explode(F.array_distinct(F.array_compact(F.array("_p", "_b")))).alias("_d"))
    hits = either.join(known, "_d", "left_semi").select("_p", "_b").distinct().withColumn("_hit", F.lit(True))
    met = responses.join(hits, F.col("block_digest").eqNullSafe(F.col("_b")) & F.col("payload_digest").eqNullSafe(F.col("_p")), "left")
    return met.select(*responses.columns, F.when(F.col("_hit"), "revisit").otherwise("response").alias("record_type"))


def cdx_lines(records: DataFrame) -> DataFrame:
    """Index lines of responses and revisits (url, ts, content_type, status, block_digest,
    size, offset, file)."""
    mime = F.trim(F.element_at(F.split("content_type", ";"), 1))
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    field = lambda c: F.coalesce(F.when(c != "", c), F.lit("-"))
    return records.select(
        F.concat_ws(
            " ", F.col("url"), stamp, F.col("url"), field(mime), F.col("status").cast("string"), F.concat(F.lit("sha1:"), "block_digest"), F.lit("-"), F.lit("-"), F.col("size").cast("string"), F.col("offset").cast("string"), F.col("file")
        ).alias("value")
    )


#: Rows of a group up to which one task fills its segments as a stream.
STREAM = 1 << 20


def rotate(records: DataFrame, most: int | None, *, group: str = "part", order: str = "seq", size: str = "size", stream: int = STREAM) -> DataFrame:
    """Adds ``segment`` and ``offset``: within a group, in order, a record that would lift
    a segment's body bytes above ``most`` begins the next (a first record never does).

    Greedy filling depends on order.  Groups of at most ``stream`` rows pass a task each, as a
    stream of batches with two numbers of state; longer ones are spread over all tasks
    (``rotate_long``).  ``order`` is a key of its group."""
    slim = records.select(group, order, size)
    counts = slim.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    long = counts.where(F.col("_n") > stream).select(group)
    if most is None or not long.limit(1).count():
        return records.join(_rotate_stream(slim, most, group, order, size), [group, order])
    far = F.broadcast(long)  # each of these groups has more than ``stream`` rows
    placed = _rotate_stream(slim.join(far, group, "left_anti"), most, group, order, size).unionByName(rotate_long(slim.join(far, group, "left_semi"), most, group=group, order=order, size=size).select(group, order, "segment", "offset"))
    return records.join(placed, [group, order])


def _rotate_stream(slim: DataFrame, most: int | None, group: str, order: str, size: str) -> DataFrame:
    kinds = dict(slim.dtypes)
    ddl = f"{group} {kinds[group]}, {order} {kinds[order]}, segment int, offset bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, segment, written = None, 0, 0
        for pdf in batches:
            out = []
            for g, n in zip(pdf[group], pdf[size], strict=True):
                if g != now:
                    now, segment, written = g, 0, 0
                if most is not None and written and written + n > most:
                    segment, written = segment + 1, 0
                out.append((segment, written))
                written += n
            yield pd.DataFrame({group: pdf[group], order: pdf[order], "segment": [x for x, _ in out], "offset": [x for _, x in out]})

    return slim.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, ddl)


def rotate_long(records: DataFrame, most: int, *, group: str = "part", order: str = "seq", size: str = "size") -> DataFrame:
    """``rotate`` of (group, order, size) for groups of any length, by pointer doubling.

    Prefix sums over ranges give each row its place and the bytes before it; a search among
    ranges of bytes gives the row at which the next segment would begin if one began here.
    From the first row on, starts are doubled: round k joins the starts known with where 2^k
    segments later begins, and that table with itself; so there are as many rounds as the
    longest group's segments have binary digits.  All tables are rows of a few numbers, spread
    by place; only one row for each range is broadcast."""
    rows = ranges.ranged(records.select(group, order, size), group, order)
    placed = stored(ranges.running(rows, group, [order], pos=F.lit(1), at=F.col(size)))
    # a segment from row i on ends before the first row j of more bytes before it than i has, and
    # of more than ``most`` up to its end: both grow with j, and so does the less of them
    bound = F.least(F.col("at"), F.col("at") + F.col(size) - most)
    marks = placed.select(group, bound.alias("v"), F.lit(0).alias("kind"), "pos").unionByName(placed.select(group, F.col("at").alias("v"), F.lit(1).alias("kind"), "pos"))
    marks = ranges.ranged(marks, group, "v", "kind", "pos")
    back = W.partitionBy("_part", group).orderBy(F.desc("v"), F.desc("kind"), F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    place = F.when(F.col("kind") == 0, F.col("pos"))
    beyond = ranges.from_other_parts(marks, group, F.min(place), later=True)
    near = marks.withColumn("_next", F.last(place, ignorenulls=True).over(back)).where("kind = 1").join(F.broadcast(beyond), ["_part", group], "left")
    jump = stored(near.select(group, "pos", F.coalesce("_next", "_carried").alias("to")).where("to is not null"))
    known = placed.where("pos = 0").select(group, "pos", F.lit(0).alias("segment"))
    step = 1
    while True:
        reached = stored(known.join(jump, [group, "pos"]).select(group, F.col("to").alias("pos"), (F.col("segment") + step).alias("segment")))
        if not reached.limit(1).count():
            break
        known, step = stored(known.unionByName(reached)), 2 * step
        jump = stored(jump.join(jump.select(group, F.col("pos").alias("to"), F.col("to").alias("_far")), [group, "to"]).select(group, "pos", F.col("_far").alias("to")))
    # each row belongs to the last start before it
    met = stored(placed.join(known, [group, "pos"], "left").withColumn("_start", F.when(F.col("segment").isNotNull(), F.struct("segment", "at"))))
    upto = W.partitionBy("_part", group).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    before = ranges.from_other_parts(met, group, F.max("_start"), later=False)
    of = F.coalesce(F.last("_start", ignorenulls=True).over(upto), F.col("_carried"))
    whole = met.join(F.broadcast(before), ["_part", group], "left").withColumn("_of", of)
    return whole.select(group, order, size, F.col("_of.segment").alias("segment"), (F.col("at") - F.col("_of.at")).alias("offset"))


SOFTWARE = "webloom"


def info_body(headers: list[str]) -> str:
    """What a file says of itself: software, format, and the given lines."""
    return "".join(f"{x}\r\n" for x in (f"software: {SOFTWARE}", "format: WARC file version 1.0", *headers))


def with_warcinfo(records: DataFrame, headers: list[str] | None = None, most: int | None = None, *, group: str = "part", order: str = "seq", size: str = "size") -> DataFrame:
    """Records (group, order, type, size) with ``segment`` and ``offset``, and a ``warcinfo``
    record of its own before the first of each segment; ``size`` counts bodies, the
    warcinfo's among them, so that a segment has room for less."""
    said = len(info_body(headers or []).encode())
    placed = rotate(records, None if most is None else max(1, most - said), group=group, order=order, size=size).withColumn("offset", F.col("offset") + said)
    first = placed.groupBy(group, "segment").agg(F.min(order).alias(order))
    kinds = dict(placed.dtypes)
    given = {group: F.col(group), "segment": F.col("segment"), order: F.col(order), "type": F.lit("warcinfo"), size: F.lit(said), "offset": F.lit(0)}
    info = first.select(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in placed.columns])
    return placed.unionByName(info)


def segment_name(stem: str, segment: Column, compressed: bool = True) -> Column:
    suffix = ".warc.gz" if compressed else ".warc"
    return F.when(segment == 0, F.lit(stem + suffix)).otherwise(F.concat(F.lit(stem + "-"), segment.cast("string"), F.lit(suffix)))


def record_bytes(kind: str, uri: str, ts: str, body: bytes, *, record_id: str, content_type: str, block: str | None = None, payload_: str | None = None, extra: list[tuple[str, str]] | None = None, compressed: bool = True) -> bytes:
    """One record: head, body and two line ends, as a gzip member of its own."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", ts)]
    if uri:
        head.append(("WARC-Target-URI", uri))
    head += [(n, f"sha1:{d}") for n, d in (("WARC-Block-Digest", block), ("WARC-Payload-Digest", payload_)) if d]
    if kind == "revisit":
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
    head += [*(extra or []), ("Content-Type", content_type), ("Content-Length", str(len(body)))]
    whole = b"WARC/1.0\r\n" + b"".join(f"{n}: {v}\r\n".encode() for n, v in head) + b"\r\n" + body + b"\r\n\r\n"
    return gzip.compress(whole, mtime=0) if compressed else whole


def warc_records(responses: DataFrame) -> DataFrame:
    """Rows of archive records (record_id, type, url, ts, content_type, concurrent_to, ip,
    block_digest, payload_digest, body) from responses with request and response messages
    and record_type; ids are made from url and time, so they are the same when a task runs
    again."""
    rid = lambda kind: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(F.sha2(F.concat_ws("\0", F.lit(kind), "url", F.col("ts").cast("string")), 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    ip = F.col("peer_ip") if "peer_ip" in responses.columns else F.lit(None).cast("string")
    reply = responses.select(
        rid("response").alias("record_id"), F.col("record_type").alias("type"), "url", "ts", F.lit("application/http;msgtype=response").alias("content_type"), F.lit(None).cast("string").alias("concurrent_to"), ip.alias("ip"), "block_digest", "payload_digest", F.col("message").alias("body")
    )
    asked = responses.select(
        rid("request").alias("record_id"), F.lit("request").alias("type"), "url", "ts", F.lit("application/http;msgtype=request").alias("content_type"), rid("response").alias("concurrent_to"), ip.alias("ip"), F.sha1("request").alias("block_digest"), F.lit(None).cast("string").alias("payload_digest"), F.col("request").alias("body")
    )
    return reply.unionByName(asked)


def log_record(text: str, ts: str, spark) -> DataFrame:
    """A log kept with the archive, as a resource record."""
    ddl = "record_id string, type string, url string, ts timestamp, content_type string, concurrent_to string, ip string, block_digest string, payload_digest string, body binary"
    row = spark.createDataFrame([(text, ts)], "log string, t string")
    return row.select(
        F.lit("<urn:uuid:00000000-0000-0000-0000-000000000001>").alias("record_id"), F.lit("resource").alias("type"), F.lit("metadata://webloom/log").alias("url"), F.to_timestamp("t").alias("ts"), F.lit("text/plain").alias("content_type"),
        F.lit(None).cast("string").alias("concurrent_to"), F.lit(None).cast("string").alias("ip"), F.sha1(F.encode("log", "UTF-8")).alias("block_digest"), F.lit(None).cast("string").alias("payload_digest"), F.encode("log", "UTF-8").alias("body"),
    ).select(*[c.split()[0] for c in ddl.split(", ")])
