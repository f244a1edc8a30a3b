"""A crawl that is a stream: its frontier is a folder of requests, its memory the state of hosts.

Each micro-batch takes what has come to the frontier, drops per host what was asked for before
(a map in the state store, on the executors' disks and in the checkpoint, never in a table that
is read again), says when each request is due, fetches, and adds the links that it finds to the
frontier.  Rows of a batch are kept under its number and the state goes with the checkpoint, so
a batch that is replayed leaves the same rows, and links that it adds once more are dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from webloom.functions import urls
from webloom.operators.crawl import crawl, page_links, recurses
from webloom.operators.policy import child_rules, first_reason
from webloom.plans.config import CrawlConfig
from webloom.store import stored

REQUEST = "url string, depth int, parent string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HostState(StatefulProcessor):
    """Of a host: the URLs asked for, and when the next request may be made.  Of rows of one
    batch the least depth of a URL counts; requests are due in the order of depth and URL."""

    def __init__(self, wait: float):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "url string", "depth int")
        self.due = handle.getValueState("due", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = time.time()  # with timers an ended trigger would go on to run empty batches
        new: dict[str, tuple[int, str | None]] = {}
        for pdf in rows:
            for url, depth, parent in zip(pdf["url"], pdf["depth"], pdf["parent"], strict=True):
                at = (int(depth), parent or "")
                if (url not in new or at < new[url]) and not (url not in new and self.seen.containsKey((url,))):
                    new[url] = at
        if not new:
            return
        due = max(now, self.due.get()[0]) if self.due.exists() else now
        out = []
        for url, (depth, parent) in sorted(new.items(), key=lambda x: (x[1][0], x[0])):
            self.seen.updateValue((url,), (depth,))
            out.append((url, depth, parent or None, due))
            due += self.wait
        self.due.update((due,))
        yield pd.DataFrame(out, columns=["url", "depth", "parent", "due"]).astype({"depth": "int32"})

    def close(self) -> None:
        pass


def ask_for(spark: SparkSession, seeds: DataFrame, out: str) -> None:
    """Add seeds (url) to the frontier of a crawl under ``out``."""
    seeds.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).write.mode("append").parquet(f"{out}/frontier")


def crawl_live(spark: SparkSession, fetch: Callable[[DataFrame], DataFrame], config: CrawlConfig, out: str) -> int:
    """Go on with the crawl under ``out`` until its frontier has nothing new; how many requests
    were made.  Pages and visited URLs (with ``due``) are kept there by batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    one_level = replace(config, recursive=False, page_requisites=False)
    made = 0

    def one(batch: DataFrame, number: int) -> None:
        nonlocal made
        asked = stored(batch)
        done = crawl(asked.select("url"), fetch, one_level)
        places = asked.select("url", "depth", "parent", "due")
        done.visited.select("url", "reason").join(places, "url").write.mode("overwrite").parquet(f"{out}/visited/batch={number}")
        found = done.pages.drop("depth").join(places.select("url", "depth"), "url")
        found.write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
        base = spark.read.schema(found.schema).parquet(f"{out}/pages/batch={number}").where(recurses(F.col("depth"), config))
        links = page_links(base.select(F.col("used_url").alias("url"), "content_type", "body"), config)
        ok = links.where(first_reason(child_rules(F.col("url"), F.col("parent"), config)).isNull())
        depth = base.groupBy(F.col("used_url").alias("parent")).agg((F.min("depth") + 1).alias("depth"))
        ok.join(depth, "parent").groupBy("url").agg(F.min(F.struct("depth", "parent")).alias("f")).select("url", "f.depth", "f.parent").write.mode("append").parquet(f"{out}/frontier")
        made += asked.count()

    while True:
        requests = spark.readStream.schema(REQUEST).parquet(f"{out}/frontier").where("url is not null")
        keyed = requests.withColumn("host", F.coalesce(urls.host(F.col("url")), F.lit(""))).groupBy("host")
        due = keyed.transformWithStateInPandas(statefulProcessor=HostState(config.wait), outputStructType=f"{REQUEST}, due double", outputMode="Append", timeMode="None")
        running = due.writeStream.foreachBatch(one).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
        if not sum(p.numInputRows for p in running.recentProgress):
            return made
