"""The network as a data source: ``spark.read.format("web")`` over a frontier.

A frontier is a folder of Parquet files of requests (url, and what goes with each), laid out by
host (``stage``).  A partition is a file, so a host's requests are one task's work, and the
folder is listed but never read when the partitions are planned.  In a task, hosts are asked
side by side: at most ``max_threads`` requests at once and ``max_threads_per_host`` of a host,
with waits between those of a host, so that no host waits for another's pauses.

Filters on url, host and scheme are pushed into the reading of the frontier: what they reject
is never asked for.
"""

from __future__ import annotations

import dataclasses
import json
import queue
import threading
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from webloom.functions import urls
from webloom.plans.config import CrawlConfig
from webloom.store import filesystem, new_folder

DDL = (
    "url string, scheme string, host string, final_url string, kind string, status int, reason string, content_type string, headers array<struct<name:string,value:string>>, "
    "body binary, text string, bytes bigint, attempts int, error string, failure string"
)
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
SCHEMA = pa.schema([pa.field("headers", _HEADERS) if "headers array" in c else pa.field(c.split()[0], _KINDS[c.split()[1]]) for c in DDL.split(", ")])
#: What a request may carry beside its URL.
CARRIED = {"since": "string", "start": "bigint", "cookies": "string", "authorization": "string"}
#: Bytes of bodies that a batch holds.
BATCH = 8 << 20


@dataclasses.dataclass
class FrontierFile(InputPartition):
    path: str


def asked_all(requests: list[dict], config: CrawlConfig) -> Iterator[dict]:
    """The answers to requests (url, host and more), in the order in which they come."""
    from webloom.sources.fetch import ask

    waiting: dict[str, deque] = defaultdict(deque)
    for r in requests:
        waiting[r["host"] or ""].append(r)
    done: queue.Queue = queue.Queue(maxsize=4 * max(1, config.max_threads))
    stop = threading.Event()

    def put(item) -> None:
        while not stop.is_set():
            try:
                return done.put(item, timeout=0.5)
            except queue.Full:
                continue

    def lane(line: deque) -> None:
        pool: dict = {}
        try:
            while not stop.is_set():
                try:
                    r = line.popleft()
                except IndexError:
                    break
                put(ask(r["url"], config, pool, **{c: r[c] for c in CARRIED if r.get(c) is not None}) | {"scheme": r["scheme"], "host": r["host"]})
                if config.wait and line:
                    stop.wait(config.wait)
        except BaseException as e:  # noqa: BLE001  handed to the task
            put(e)
        finally:
            for conn in pool.values():
                conn.close()
            put(None)

    lanes = [line for line in waiting.values() for _ in range(min(len(line), max(1, config.max_threads_per_host)))]
    with ThreadPoolExecutor(max(1, min(config.max_threads, len(lanes) or 1))) as threads:
        try:
            for line in lanes:
                threads.submit(lane, line)
            left = len(lanes)
            while left:
                item = done.get()
                if item is None:
                    left -= 1
                elif isinstance(item, BaseException):
                    raise item
                else:
                    yield item
        finally:
            stop.set()


class WebReader(DataSourceReader):
    def __init__(self, options: dict):
        self.frontier = options["frontier"]
        self.config = CrawlConfig(**json.loads(options.get("config", "{}")))
        self.bodies = options.get("bodies", "bytes")
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("url", "host", "scheme") and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.wanted.append((column, type(f).__name__, list(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, folder = filesystem(self.frontier)
        found = store.get_file_info(fs.FileSelector(folder))
        return [FrontierFile(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name.endswith(".parquet")] or [FrontierFile("")]

    def _requests(self, path: str) -> list[dict]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, _ = filesystem(self.frontier)
        test = None
        for column, kind, value in self.wanted:
            c = pc.field(column)
            one = c == value if kind == "EqualTo" else c.isin(value) if kind == "In" else pc.starts_with(c, value)
            test = one if test is None else test & one
        return pq.read_table(path, filesystem=store, filters=test).to_pylist()

    def read(self, partition: FrontierFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held, size = [], 0
        for row in asked_all(self._requests(partition.path), self.config):
            if self.bodies != "bytes" and row.get("body") is not None:
                row["text"] = decoded(row["body"], self.config.remote_encoding or label_of(row.get("content_type")))
                row["body"] = row["body"] if self.bodies == "both" else None
            held.append({c: row.get(c) for c in SCHEMA.names})
            size += row.get("bytes") or 0
            if size >= BATCH or len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, SCHEMA)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)


def label_of(content_type: str | None) -> str | None:
    """As ``text.charset``."""
    import re

    m = re.search(r";\s*charset\s*=\s*([^;]*)", content_type or "", re.I)
    name = m[1].strip().strip("\"'").strip() if m else ""
    return name or None


def decoded(data: bytes, label: str | None) -> str | None:
    """A body as text; null where the label is not known, so that it is searched for nothing."""
    from webloom.functions import charset

    return charset.text_of(data, label)


class WebSource(DataSource):
    """Options: ``frontier``, a folder of ``stage``; ``config``, the settings as JSON;
    ``bodies``, bytes, text or both."""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> DataSourceReader:
        return WebReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebSource)


def stage(level: DataFrame, folder: str, *, tasks: int | None = None) -> None:
    """Store the distinct requests of a table (url, and any of ``CARRIED``) by host, as many
    files as there are tasks; with as many hosts as tasks or more, tasks have hosts of their
    own to go on with."""
    more = [c for c in CARRIED if c in level.columns]
    kinds = [F.col(c).cast(CARRIED[c]).alias(c) for c in more]
    asked = level.where("url is not null").select("url", *kinds).dropDuplicates(["url"])
    asked = asked.withColumns({"scheme": F.coalesce(urls.scheme(F.col("url")), F.lit("")), "host": F.coalesce(urls.host(F.col("url")), F.lit(""))})
    tasks = tasks or int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked.repartition(tasks, "host").write.parquet(folder)


def fetch(level: DataFrame, config: CrawlConfig, *, tasks: int | None = None, bodies: str = "bytes") -> DataFrame:
    """One row per distinct URL of ``level`` (url, and what it carries: ``since``, ``start``,
    ``cookies``, ``authorization``), for http, https, ftp and ftps; errors are rows.  ``kind``
    says what came: response, file, complete, or a listing (mlsd, list, nlst).  A null URL
    gives no row."""
    spark = level.sparkSession
    register(spark)
    folder = new_folder(spark)
    stage(level, folder, tasks=tasks)
    return spark.read.format("web").option("frontier", folder).option("config", json.dumps(dataclasses.asdict(config))).option("bodies", bodies).load()


def header(name: str, sep: str | None = None):
    """A header's values, as an array or joined; null without it."""
    found = F.transform(F.filter("headers", lambda h: F.lower(h["name"]) == name), lambda h: h["value"])
    return F.when(F.size(found) > 0, found if sep is None else F.array_join(found, sep))


def network_source(config: CrawlConfig, *, tasks: int | None = None, keep_bytes: bool = False):
    """For ``operators.crawl.crawl``: bodies as text by their charset (and with ``keep_bytes``
    as they came, to be saved), what headers say, and how the request went.  Listings of
    folders are bodies of a type of their own."""
    from webloom.operators.crawl import LISTING

    def source(level: DataFrame) -> DataFrame:
        good = F.col("error").isNull() & (F.lit(config.content_on_error) | F.coalesce(F.col("status") < 400, F.lit(True)))
        listing = F.col("kind").isin("mlsd", "list", "nlst")
        asked = level.select(F.coalesce("target", "url").alias("url"), *[c for c in CARRIED if c in level.columns]) if "target" in level.columns else level
        got = fetch(asked, config, tasks=tasks, bodies="both" if keep_bytes else "text").select(
            F.col("url").alias("_asked"), F.when(good & (F.coalesce("status", F.lit(200)) != 304), F.col("text")).alias("body"), F.when(listing, F.concat(F.lit(LISTING), "kind")).otherwise(F.col("content_type")).alias("content_type"),
            "status", header("link", ", ").alias("link"), F.coalesce("final_url", "url").alias("final_url"), header("set-cookie").alias("set_cookie"), header("strict-transport-security", ", ").alias("strict_transport"),
            header("last-modified", ", ").alias("last_modified"), F.when(good, F.col("body")).alias("content"), "attempts", "error", "failure",
        )
        key = F.coalesce("target", "url") if "target" in level.columns else F.col("url")
        new = [c for c in got.columns if c != "_asked"]
        return level.withColumn("_key", key).join(got, F.col("_key") == F.col("_asked"), "left").select(*level.columns, *new)

    return source

