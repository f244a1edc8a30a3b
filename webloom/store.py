"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; only where that is unset and all runs on one machine a
    temporary one is made and set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    path = path or f"{shared_folder(df.sparkSession)}/crawl/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, facts: dict[str, Column], path: str | None = None) -> tuple[DataFrame, dict]:
    """``df`` stored, and sums over it that come with the writing, without another scan; those
    of no rows are missing."""
    seen = Observation(f"round-{uuid.uuid4().hex}")
    table = stored(df.observe(seen, *[c.alias(name) for name, c in facts.items()]), path)
    return table, {k: v for k, v in seen.get.items() if v is not None}


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/crawl/{uuid.uuid4().hex}"


def filesystem(uri: str):
    """The file system of a folder that driver and executors share, and the folder's path
    there: for what is not a table and is read and written by tasks themselves."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
