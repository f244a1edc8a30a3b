"""Best-fit packing of tokenised documents by exact complements.

How documents are packed depends on their lengths alone, and there are at most ``LENGTH`` of
these however many documents there are.  So Spark counts the pieces of each length, the plan
is made from that histogram (``plan``), and the pieces are put into it by their rank among the
pieces of their length:

* tasks tokenise documents, cut those that are too long and number the pieces of each length as
  they come; a row has the digest of its ids, never the ids;
* the counts by task and length give each task's first rank of each length;
* the plan is a list of runs "pieces of this length from this rank on go to sequences from this
  number on, at this offset", which a task searches for each of its rows.

No group is ever gathered: a length that a third of all pieces share is ranked in every task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.llm.common import fresh, map_batches, read, slices, texts_of, written
from webloom.llm.packing import CHUNK, END, Words, definition

LENGTH = 4096


class Sums:
    """Which lengths, and which sums of two and of three lengths, can be made of what is left.

    ``left`` counts pieces by length.  ``pairs[s]`` counts the pairs (a, b) with a <= b and
    a + b = s of lengths that are left; it is kept up as lengths come to an end, so a search
    for a pair or triple looks at each length once and not at the pairs.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.there = left > 0
        self.pairs = np.zeros(len(left), np.int64)
        gone = np.flatnonzero(self.there)
        self.there = np.zeros(len(left), bool)
        for a in gone:
            self.there[a] = True
            self._count(a, 1)

    def _count(self, a: int, sign: int) -> None:
        """Pairs of ``a`` with the lengths that are there, itself among them."""
        self.pairs[a:] += sign * self.there[: len(self.left) - a]

    def take(self, length: int, count: int) -> None:
        self.left[length] -= count
        if not self.left[length]:
            self._count(length, -1)
            self.there[length] = False

    def _enough(self, parts: list[int], held: list[int]) -> bool:
        every = parts + held
        return all(every.count(p) <= self.left[p] for p in parts)

    def exact(self, gap: int, held: list[int], most: int = 3) -> list[int] | None:
        """One, two or three lengths (``most`` at most) that are left, beside those of ``held``,
        and make up ``gap``; fewest first, then the longest."""
        if self.there[gap] and self._enough([gap], held):
            return [gap]
        if self.pairs[gap] and most > 1:
            if (two := self._pair(gap, gap - 1, held)) is not None:
                return two
        if most < 3:
            return None
        # the longest of three is at least a third of the gap
        low = -(-gap // 3)
        first = np.arange(low, max(gap - 1, low))
        first = first[self.there[first] & (self.pairs[gap - first] > 0)][::-1]
        for a in first.tolist():
            if (two := self._pair(gap - a, a, [*held, a])) is not None and self._enough([a, *two], held):
                return [a, *two]
        return None

    def _pair(self, total: int, most: int, held: list[int]) -> list[int] | None:
        a = np.arange(-(-total // 2), min(most, total - 1) + 1)
        a = a[self.there[a] & self.there[total - a]]
        for x in a[::-1].tolist():
            if self._enough([x, total - x], held):
                return [x, total - x]
        return None

    def longest(self, gap: int, held: list[int]) -> int | None:
        """The longest length that is left beside ``held`` and fits."""
        fits = np.flatnonzero(self.there[: gap + 1])
        for a in fits[::-1].tolist():
            if self._enough([a], held):
                return a
        return None


def plan(counts: dict[int, int], length: int = LENGTH) -> np.ndarray:
    """The one of four plans (``_plan`` with sums of one, of two, of three, and of more lengths)
    that needs fewest sequences: for many pieces the last comes to the least there can be, for
    few any may win."""
    plans = [_plan(counts, length, most) for most in (4, 3, 2, 1)]
    return min(plans, key=lambda runs: (runs[:, 4] + runs[:, 2]).max(initial=0))


def _plan(counts: dict[int, int], length: int, most: int) -> np.ndarray:
    """Runs (piece length, first rank, copies, repeat, first sequence, offset) that place every
    piece: ``repeat`` pieces of the length follow each other in each of ``copies`` sequences,
    in rank order.

    First sequences are filled exactly.  From the longest length on, a sequence begins with a
    piece of it, and what makes up the rest exactly is looked for among single lengths, pairs
    and triples; where there is nothing the longest piece that fits is added and the search
    goes on.  A combination is used as often as its pieces last.  What no combination fills
    goes by best fit from the longest on: into the open sequences of least room, as many of a
    kind at a time as there are.

    Each use brings a length below what the combination needs of it, so a length is met at most
    log2(length) times, and best fit splits at most one kind of open sequence for each length:
    the plan's size depends on ``length``, not on the pieces.
    """
    left = np.zeros(length + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    rank, runs, sequences = np.zeros(length + 1, np.int64), [], 0

    def put(size: int, copies: int, repeat: int, first: int, offset: int) -> None:
        runs.append((size, rank[size], copies, repeat, first, offset))
        rank[size] += copies * repeat

    sums, residual = Sums(left), np.zeros(length + 1, np.int64)
    for size in range(length, 0, -1):
        while left[size]:
            parts = [size]
            while (gap := length - sum(parts)) and (rest := sums.exact(gap, parts, most)) is None:
                if most < 4 or (more := sums.longest(gap, parts)) is None:
                    break
                parts.append(more)
            if gap and rest is None:
                residual[size] = left[size]
                sums.take(size, int(left[size]))
                break
            parts += rest if gap else []
            need = {p: parts.count(p) for p in parts}
            copies = int(min(left[p] // n for p, n in need.items()))
            offset = 0
            for p in sorted(need, reverse=True):
                put(p, copies, need[p], sequences, offset)
                sums.take(p, copies * need[p])
                offset += p * need[p]
            sequences += copies
    # open sequences by room: lists of (first sequence, how many)
    room: dict[int, list[tuple[int, int]]] = {}

    def fill(gap: int, first: int, open_: int, size: int, n: int) -> int:
        """Put up to ``n`` pieces into sequences of this room; how many found a place."""
        each = gap // size
        whole = min(open_, n // each)
        some = n - whole * each if whole < open_ else 0
        for start, copies, repeat in ((first, whole, each), (first + whole, 1, some)):
            if copies and repeat:
                put(size, copies, repeat, start, length - gap)
                room.setdefault(gap - repeat * size, []).append((start, copies))
        used = whole + (some > 0)
        if used < open_:
            room.setdefault(gap, []).append((first + used, open_ - used))
        return whole * each + some

    for size in range(length, 0, -1):
        n = int(residual[size])
        if not n:
            continue
        for gap in sorted(g for g in room if g >= size):
            for first, open_ in room.pop(gap):
                if n:
                    n -= fill(gap, first, open_, size, n)
                else:
                    room.setdefault(gap, []).append((first, open_))
            if not n:
                break
        if n:
            fresh_ = -(-n // (length // size))
            fill(length, sequences, fresh_, size, n)
            sequences += fresh_
    return np.array(runs, np.int64).reshape(-1, 6)


def place(runs: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and rank."""
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    size, first, copies, _, sequence, offset = runs[order].T
    # a length's runs have rising ranks; ranks are looked for among the runs of the length
    begins = np.searchsorted(size, sizes, "left")
    ends = np.searchsorted(size, sizes, "right")
    lo, hi = begins.copy(), ends.copy()
    while (hi - lo > 1).any():
        middle = (lo + hi) // 2
        right = first[middle] <= ranks
        wide = hi - lo > 1
        lo = np.where(wide & right, middle, lo)
        hi = np.where(wide & ~right, middle, hi)
    inside = ranks - first[lo]
    return sequence[lo] + inside % copies[lo], offset[lo] + sizes * (inside // copies[lo])


def pieces(df: DataFrame, definition: str, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, the task and the piece's
    number among the task's pieces of its length, and with ``ids`` its token ids."""
    packed = df.sparkSession.sparkContext.broadcast(definition)

    def make():
        words, task = Words(packed.value), TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        mark = np.array([end], "<u4").tobytes()

        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, 1)
            keys = batch.column(0)
            for lo, hi in slices(offsets, CHUNK):
                found, counts = words.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                blob = found.astype("<u4").tobytes()
                ends = np.cumsum(counts)
                # pieces of each document: full ones, then the rest with the end token
                total = counts + 1
                number = -(-total // length)
                doc = np.repeat(np.arange(hi - lo), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * length
                size = np.minimum(total[doc] - start, length)
                at = (ends - counts)[doc] + start
                last = start + size == total[doc]
                view = memoryview(blob)
                got = [view[4 * a : 4 * (a + n - e)] for a, n, e in zip(at.tolist(), size.tolist(), last.tolist(), strict=True)]
                crc = [zlib.crc32(mark, zlib.crc32(x)) if e else zlib.crc32(x) for x, e in zip(got, last.tolist(), strict=True)]
                # the pieces of one length are numbered in their order
                order = np.argsort(size, kind="stable")
                ordered = size[order]
                same = np.arange(len(size)) - np.searchsorted(ordered, ordered, "left")
                rank = np.empty(len(size), np.int64)
                rank[order] = seen[ordered] + same
                np.add.at(seen, size, 1)
                out = {key_name: keys.slice(lo, hi - lo).take(pa.array(doc)), "piece": piece.astype(np.int32), "start": start, "length": size, "ids_crc32": np.array(crc, np.int64), "task": np.full(len(doc), task), "rank": rank}
                if ids:
                    out["ids"] = [np.frombuffer(bytes(x) + mark * e, "<i4") for x, e in zip(got, last.tolist(), strict=True)]
                yield out

        return handle

    key_name = key
    ddl = "piece int, start bigint, length bigint, ids_crc32 bigint, task bigint, rank bigint" + ", ids array<int>" * ids
    return map_batches(df.select(key, text), make, ddl, passed=[df.select(key).schema[0]])


def pack(df: DataFrame, definition: str, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, sequence_id and offset, and
    with ``ids`` the piece's token ids.

    ``definition`` is the content of a tokenizer file.  A null or empty text is the end token
    alone; a null key stays null; repeated rows are packed each on its own; other columns are
    not read; an empty table gives no rows.  The pieces are stored before they are counted, so a
    task that runs again cannot change what was planned.
    """
    spark = df.sparkSession
    inner = fresh(df.drop(key), "piece_key")
    named = df.select(F.col(key).alias(inner), F.col(text).alias(f"{inner}_text"))
    cut = written(pieces(named, definition, key=inner, text=f"{inner}_text", length=length, end=end, ids=ids))
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    by_task = written(by_task)
    # at most ``length`` rows
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(counts, length))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(by_task.select("task", "length", before.alias("before")), ["task", "length"])
    ranked = ranked.select(inner, "piece", "start", "length", "ids_crc32", *(["ids"] if ids else []), (F.col("before") + F.col("rank")).alias("rank"))
    carried = [f for f in ranked.schema.fields if f.name != "rank"]

    def make():
        def handle(batch: pa.RecordBatch):
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            sequence, offset = place(runs.value, column("length").to_numpy(), column("rank").to_numpy())
            yield {f.name: column(f.name) for f in carried} | {"sequence_id": sequence, "offset": offset}

        return handle

    return map_batches(ranked, make, "sequence_id bigint, offset bigint", passed=carried).withColumnRenamed(inner, key)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), definition())
