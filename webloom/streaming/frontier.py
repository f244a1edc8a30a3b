"""A stream of seeds: each micro-batch is crawled without what earlier ones visited.

This goes beyond batch retrieval.  What a micro-batch gave is kept under its number, so a batch
that is replayed after a failure replaces what it wrote and leaves the same rows; what was
visited before it is what stands under smaller numbers, and neither its seeds nor the links
found from them ask for such a page again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.operators.crawl import crawl
from webloom.plans.config import CrawlConfig


VISITED = "url string, depth int, parent string, reason string, batch int"


def crawl_stream(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], config: CrawlConfig, out: str, checkpoint: str) -> StreamingQuery:
    """Crawl each micro-batch of ``url`` rows; visited and pages are kept under
    ``out`` by batch."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.schema(VISITED).parquet(f"{out}/visited").where(F.col("batch") < number)
        except AnalysisException as e:  # there is none before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = None
        done = crawl(batch.select("url").distinct(), fetch, config, visited=seen)
        for name in ("pages", "visited"):
            getattr(done, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return seeds.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
