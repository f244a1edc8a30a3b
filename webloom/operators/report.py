"""Summaries of crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import text, urls


def reject_summary(visited: DataFrame) -> DataFrame:
    return visited.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("urls"))


def reject_log(visited: DataFrame) -> DataFrame:
    """Lines of a reject log."""
    quote = F.when(F.col("url").rlike('[",]'), F.concat(F.lit('"'), F.replace("url", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("url"))
    return visited.where("reason is not null").select(F.concat(F.col("reason"), F.lit(","), quote, F.lit(",")).alias("value"))


def by_host(pages: DataFrame) -> DataFrame:
    return pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum("bytes").alias("bytes"))


def totals(pages: DataFrame) -> DataFrame:
    out = pages.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return out.withColumn("size", text.format_bytes(F.col("bytes")))
