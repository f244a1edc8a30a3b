"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as in the word pattern ``[^\x20\x09-\x0D]+``; bytes.split() splits at the same.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's
    ``spark.checkpoint.dir``.  Only where that is unset and all run on one machine (tests) a
    temporary one is made and set; on a cluster it is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="webloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of the tables written inside each open ``scratch``.
_SCRATCH: list[list[str]] = []


def written(df: DataFrame, *, keep: bool = False) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder as Parquet and read them
    back, so that a lost executor costs no recomputation and every later pass sees the
    same rows.  Inside a ``scratch`` the table goes with it unless it is to be kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if folder.rsplit("/", 2)[1] == "webloom":  # none but those
                _delete(table.sparkSession, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables written inside it, but for those kept."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _delete(spark, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the executors delete the shuffle files of finished jobs: Spark does so once the
    driver's heap no longer holds their plans, which may else be long after.  The second
    round is for what the first leaves to finalizers."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = []
    for part in ddl.split(","):
        name, kind = part.split()
        if kind.startswith("array<"):
            fields.append(pa.field(name, pa.list_(kinds[kind[6:-1]])))
        else:
            fields.append(pa.field(name, kinds[kind]))
    return pa.schema(fields)


def release_memory() -> None:
    """Give freed memory back to the system at a task's end: Python workers are used again
    and would else keep their largest task's share."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]], ddl: str, *, passed: Iterable[T.StructField] = ()) -> DataFrame:
    """mapInArrow with columns given as a dict of arrays; ``make`` runs once per task
    and returns what handles a batch.  Before the columns of ``ddl`` stand those of
    ``passed``, of any type, which a handler hands on as it got them."""
    schema = arrow_schema(ddl)
    through = list(passed)
    names = [f.name for f in through]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            handle = make()
            for batch in batches:
                if batch.num_rows:
                    for out in handle(batch):
                        arrays = [out[c] for c in names]
                        arrays += [x if isinstance(x := out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f in schema]
                        yield pa.RecordBatch.from_arrays(arrays, names=[*names, *schema.names])
        finally:  # a task that fails or is cut short gives its memory back as well
            handle = None
            release_memory()

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in through] + T.StructType.fromDDL(ddl).fields))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more than this part of all rows is joined apart.
PARTS = 4096


def split_join(many: DataFrame, one: DataFrame, on: list[str], *, times: str, total: int, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row for each key and in ``times`` how many
    rows of ``many`` have it, ``total`` being their sum.  Keys of over 1 / PARTS of all rows,
    of which there are fewer than PARTS (at most half the rows, where these are few), are
    broadcast; so no task gets all rows of a frequent one."""
    most = max(1, total // PARTS)
    heavy = F.broadcast(one.where(F.col(times) > most).drop(times))
    apart = many.join(heavy.select(*on), on, "left_anti").join(one.where(F.col(times) <= most).drop(times), on, how)
    return many.join(heavy, on, how).unionByName(apart)


#: Rows of 64 marks each that ``maybe_among`` broadcasts, at most; a power of two.
MARKS = 1 << 17


def maybe_among(many: DataFrame, few: DataFrame, on: list[str], name: str) -> DataFrame:
    """``many`` with a boolean column ``name``: true where ``few`` has a row of these ``on``,
    and by chance elsewhere (for one row in 140 if ``few`` has 60,000, for more the more it
    has).  So what is false need not be sent to a join with ``few``; the marks broadcast are
    of one size, whatever the tables."""
    row, bit = fresh(many, "_row"), fresh(many, "_bit")
    hashed = {row: F.pmod(F.xxhash64(F.lit(1), *on), F.lit(MARKS)), bit: F.expr(f"shiftleft(1L, cast(pmod(xxhash64(2, {', '.join(f'`{c}`' for c in on)}), 64) as int))")}
    marks = few.select(*[c.alias(n) for n, c in hashed.items()]).groupBy(row).agg(F.bit_or(bit).alias(fresh(many, "_marks")))
    met = many.withColumns(hashed).join(F.broadcast(marks), row, "left")
    return met.withColumn(name, F.coalesce(F.col(marks.columns[1]).bitwiseAND(F.col(bit)) != 0, F.lit(False))).drop(row, bit, marks.columns[1])


def texts_of(batch: pa.RecordBatch, column: str | int) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, null as empty, and the offsets of its rows."""
    col = batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes each, or of a single longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def bucket_of(column: str, k: int, remainders: Iterable[int], negate: bool = False):
    """Rows whose crc32 of the id as text leaves one of these remainders."""
    m = F.crc32(F.col(column).cast("string").cast("binary")) % k
    held = m.isin(list(remainders))
    held = F.coalesce(held, F.lit(False))
    return ~held if negate else held
