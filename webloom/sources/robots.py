"""Robots files, one for each origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls
from webloom.plans.config import CrawlConfig
from webloom.sources.web import fetch


def robots_files(pages: DataFrame, config: CrawlConfig, *, url: str = "url") -> DataFrame:
    """(origin, body, ok) for the origins of a table of URLs, each asked once; any error
    leaves ok false, which denies all."""
    origins = pages.select(urls.origin(F.col(url)).alias("origin")).where("origin is not null").distinct()
    got = fetch(origins.select(F.concat("origin", F.lit("/robots.txt")).alias("url")), config)
    ok = F.col("error").isNull() & F.coalesce(F.col("status") < 400, F.lit(False))
    return got.select(F.regexp_replace("url", "/robots\\.txt$", "").alias("origin"), F.when(ok, F.decode("body", "UTF-8")).alias("body"), ok.alias("ok"))
