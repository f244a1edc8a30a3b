"""Archive files as a data source: ``format("warc")`` writes records with an index and reads
them back.

Writing has two phases.  A task writes its files, and the index lines of what it wrote, under a
hidden folder of its own; its commit message names them.  Only when all tasks are done does the
driver rename them, so a task that ran twice leaves one copy and a job that failed leaves none.
Index lines are written by the tasks as well: nothing but names and counts comes to the driver.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from webloom.operators.archive import CDX_HEADER, info_body, record_bytes
from webloom.store import filesystem

#: Columns of ``archive.warc_records`` as they are written; ``date`` stands for its ``ts``.
WRITTEN = "record_id string, type string, url string, date string, content_type string, concurrent_to string, ip string, block_digest string, payload_digest string, body binary"
DDL = "file string, offset bigint, size bigint, record_id string, type string, url string, date string, content_type string, concurrent_to string, ip string, block_digest string, payload_digest string, body binary"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
SCHEMA = pa.schema([pa.field(c.split()[0], _KINDS[c.split()[1]]) for c in DDL.split(", ")])
#: Header names by column.  Fixed values: a file format.
NAMES = {"record_id": "WARC-Record-ID", "type": "WARC-Type", "url": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "concurrent_to": "WARC-Concurrent-To", "ip": "WARC-IP-Address", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest"}
BATCH = 8 << 20


def dated(records: DataFrame) -> DataFrame:
    return records.withColumn("date", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("ts")


def encode_row(r: dict, compressed: bool) -> bytes:
    extra = [(NAMES[c], r[c]) for c in ("concurrent_to", "ip") if r.get(c)]
    return record_bytes(r["type"], r["url"] or "", r["date"], bytes(r["body"] or b""), record_id=r["record_id"], content_type=r["content_type"], block=r["block_digest"], payload_=r["payload_digest"], extra=extra, compressed=compressed)


def encoded(records: DataFrame, compressed: bool = True) -> DataFrame:
    """record_id and the bytes of each record of ``archive.warc_records``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"record_id": pdf["record_id"], "bytes": [encode_row(r, compressed) for r in pdf.to_dict("records")]})

    return dated(records).mapInPandas(run, "record_id string, bytes binary")


def index_line(r: dict, offset: int, file: str) -> str:
    """The index line of a response or a revisit, with status and type from its message."""
    head = bytes(r["body"] or b"").split(b"\r\n\r\n", 1)[0].decode("iso-8859-1").split("\r\n")
    words = head[0].split(" ")
    status = words[1] if len(words) > 1 and head[0].startswith("HTTP/") else "-"
    mime = next((h.split(":", 1)[1].split(";")[0].strip() for h in head[1:] if h.lower().startswith("content-type:")), "") or "-"
    stamp = "".join(c for c in r["date"] if c.isdigit())
    digest = f"sha1:{r['block_digest']}" if r["block_digest"] else "-"
    return f"{r['url']} {stamp} {r['url']} {mime} {status} {digest} - - {len(r['body'] or b'')} {offset} {file}"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: hidden folder, and (file, records, bytes) of each file."""

    hidden: str
    files: list[tuple[str, int, int]]
    index: str | None


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.stem = options["path"], options.get("stem", "out")
        self.compressed = options.get("compressed", "true") == "true"
        self.most = int(options["most"]) if options.get("most") else None
        self.headers = json.loads(options.get("headers", "[]"))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.indexed = options.get("index", "true") == "true"
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, folder = filesystem(self.folder)
        hidden = f"{folder}/_temporary-{self.job}/{part}-{attempt}"
        suffix, info = ".warc.gz" if self.compressed else ".warc", info_body(self.headers).encode()
        files: list[tuple[str, int, int]] = []
        out, index, count, size, head = None, None, 0, 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                files.append((name, count, size))
                out = None

        for batch in iterator:
            if batch.num_rows:
                store.create_dir(hidden, recursive=True)
            for r in batch.to_pylist():
                blob = encode_row(r, self.compressed)
                if out is not None and self.most is not None and size > head and size + len(blob) > self.most:
                    close()
                if out is None:
                    name = f"{self.stem}-{part:05d}" + (f"-{len(files)}" if files else "") + suffix
                    out = store.open_output_stream(f"{hidden}/{name}", compression=None)
                    own = uuid.uuid5(uuid.NAMESPACE_URL, name)
                    first = record_bytes("warcinfo", "", self.date, info, record_id=f"<urn:uuid:{own}>", content_type="application/warc-fields", compressed=self.compressed)
                    out.write(first)
                    count, size, head = 1, len(first), len(first)
                if self.indexed and r["type"] in ("response", "revisit"):
                    if index is None:
                        index = store.open_output_stream(f"{hidden}/{self.stem}-{part:05d}.cdx", compression=None)
                        index.write(f"{CDX_HEADER}\n".encode())
                    index.write(f"{index_line(r, size, name)}\n".encode())
                out.write(blob)
                count, size = count + 1, size + len(blob)
        close()
        if index is not None:
            index.close()
        return Written(hidden, files, f"{self.stem}-{part:05d}.cdx" if index is not None else None)

    def _drop(self) -> None:
        from pyarrow import fs

        store, folder = filesystem(self.folder)
        if store.get_file_info(f"{folder}/_temporary-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/_temporary-{self.job}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, folder = filesystem(self.folder)
        store.create_dir(folder, recursive=True)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(folder)):
                if x.is_file and x.base_name.startswith(f"{self.stem}-") and x.base_name.endswith((".warc", ".warc.gz", ".cdx")):
                    store.delete_file(x.path)
        done = [m for m in messages if isinstance(m, Written)]
        for m in done:
            for name in [f for f, _, _ in m.files] + ([m.index] if m.index else []):
                store.move(f"{m.hidden}/{name}", f"{folder}/{name}")
        with store.open_output_stream(f"{folder}/{self.stem}.files.json") as out:
            for name, count, size in sorted(f for m in done for f in m.files):
                out.write((json.dumps({"file": name, "records": count, "bytes": size}) + "\n").encode())
        self._drop()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop()


def members(stream, compressed: bool) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record of a file, one at a time."""
    if not compressed:
        at = 0
        while head := _head(stream):
            size = next((int(line.split(b":", 1)[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")), 0)
            yield at, head + stream.read(size + 4)
            at += len(head) + size + 4
        return
    at, left = 0, b""
    while True:
        inflater, parts, used = zlib.decompressobj(31), [], 0
        while not inflater.eof:
            piece = left or stream.read(1 << 20)
            left = b""
            if not piece:
                if used:
                    raise EOFError("an archive file that ends inside a record")
                return
            parts.append(inflater.decompress(piece))
            used += len(piece)
        left = inflater.unused_data
        yield at, b"".join(parts)
        at += used - len(left)


def _head(stream) -> bytes:
    out = b""
    while not out.endswith(b"\r\n\r\n"):
        c = stream.read(1)
        if not c:
            return b""
        out += c
    return out


def parsed(record: bytes) -> dict:
    """Columns of a record's bytes."""
    head, _, body = record.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    size = int(fields.get("content-length", 0))
    row = {c: fields.get(n.lower()) for c, n in NAMES.items()}
    for c in ("block_digest", "payload_digest"):
        row[c] = row[c].removeprefix("sha1:") if row[c] else None
    return row | {"body": body[:size], "size": size}


@dataclass
class ArchiveFile(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.types: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("type",):
                wanted = list(f.value) if isinstance(f, In) else [f.value]
                self.types = wanted if self.types is None else [t for t in self.types if t in wanted]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = filesystem(self.folder)
        found = [x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]
        return [ArchiveFile(p) for p in sorted(found)] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = filesystem(self.folder)
        held, size = [], 0
        with store.open_input_stream(partition.path, compression=None) as stream:
            for offset, record in members(stream, partition.path.endswith(".gz")):
                row = parsed(record)
                if self.types is not None and row["type"] not in self.types:
                    continue
                held.append(row | {"file": partition.path.rsplit("/", 1)[1], "offset": offset})
                size += len(record)
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, SCHEMA)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)


class WarcSource(DataSource):
    """Options: ``path``, and for writing ``stem``, ``compressed``, ``most`` (bytes of a file),
    ``headers`` (JSON, of the warcinfo record), ``date`` and ``index``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write(records: DataFrame, folder: str, stem: str = "out", compressed: bool = True, most: int | None = None, headers: list[str] | None = None, date: str = "1970-01-01T00:00:00Z", mode: str = "append") -> DataFrame:
    """Write archive files (``stem-<task>[-n]``) and their index to a folder that all executors
    reach, and give (file, records, bytes).  Every file begins with a warcinfo record
    (``headers`` are its further lines); one of more than ``most`` bytes is followed by the
    next.  With mode ``overwrite`` what the stem had before goes."""
    spark = records.sparkSession
    register(spark)
    options = {"path": folder, "stem": stem, "compressed": str(compressed).lower(), "headers": json.dumps(headers or []), "date": date} | ({"most": str(most)} if most is not None else {})
    dated(records).select(*[c.split()[0] for c in WRITTEN.split(", ")]).write.format("warc").options(**options).mode(mode).save()
    return spark.read.schema("file string, records bigint, bytes bigint").json(f"{folder}/{stem}.files.json")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a folder's archive files, with file and offset."""
    register(spark)
    return spark.read.format("warc").option("path", folder).load()


def read_index(spark: SparkSession, folder: str, stem: str = "out") -> DataFrame:
    """(url, stamp, content_type, status, digest, size, offset, file) of a folder's index."""
    f = F.split("value", " ")
    lines = spark.read.text(f"{folder}/{stem}-*.cdx").where(~F.col("value").startswith(" CDX"))
    dash = lambda c: F.when(c != "-", c)
    return lines.select(f[0].alias("url"), f[1].alias("stamp"), dash(f[3]).alias("content_type"), f[4].try_cast("int").alias("status"), dash(f[5]).alias("digest"), f[8].cast("bigint").alias("size"), f[9].cast("bigint").alias("offset"), f[10].alias("file"))


def records_at(index: DataFrame, folder: str) -> DataFrame:
    """The records (``DDL``) that index rows (file, offset) name, each read at its place; a
    file's rows are one task's work, in the order of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        name, stream = None, None
        try:
            for batch in batches:
                held, size = [], 0
                for file, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if file != name:
                        if stream is not None:
                            stream.close()
                        name, stream = file, store.open_input_file(f"{base}/{file}")
                    stream.seek(offset)
                    _, record = next(members(stream, file.endswith(".gz")))
                    held.append(parsed(record) | {"file": file, "offset": offset})
                    size += len(record)
                    if size >= BATCH:
                        yield pa.RecordBatch.from_pylist(held, SCHEMA)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, SCHEMA)
        finally:
            if stream is not None:
                stream.close()

    return index.select("file", "offset").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, DDL)
