"""Files that are there already: their list, and the contents of some."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.store import filesystem

FILES = "path string, size bigint, mtime timestamp"
BATCH = 8 << 20


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime) of the files below a folder, paths from there as ``paths.local_path``
    gives them (``./a/b``); contents are not read.  A folder that is not there has none; hidden
    files are left out."""
    from pyarrow import fs

    store, base = filesystem(folder)
    if store.get_file_info(base).type != fs.FileType.Directory:
        return spark.createDataFrame([], FILES)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    plain = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    inside = F.expr(f"substring(plain, {len(base.rstrip('/')) + 2})")
    return found.withColumn("plain", plain).select(F.concat(F.lit("./"), inside).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def contents(wanted: DataFrame, folder: str) -> DataFrame:
    """(path, content) of the files that a table (path) names; those that are not there are
    left out."""
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for batch in batches:
            held, size = [], 0
            for path in batch.column(0).to_pylist():
                try:
                    with store.open_input_file(f"{base}/{path.removeprefix('./')}") as f:
                        held.append({"path": path, "content": f.read()})
                except FileNotFoundError:
                    continue
                size += len(held[-1]["content"])
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)

    return wanted.select("path").where("path is not null").distinct().mapInArrow(run, "path string, content binary")
