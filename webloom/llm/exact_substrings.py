"""Removal of every 200-byte string that also starts elsewhere, by suffix buckets.

Suffixes are put into buckets by an anchor: of the K-grams inside a 200-byte window, the
one of least hash (the leftmost of equals).  Equal windows have equal anchors, so they
share a bucket, and neighbouring windows mostly share theirs: a bucket's member is a run
of starts with one anchor, its context the bytes these windows cover.

1. Runs send the hash of their anchor; only anchors found more than once go on, now with a
   128-bit BLAKE2b digest of the context.  Runs with equal contexts are repeated, and one of
   them stands for all.  (Sorting two members of each, to compare their bytes, was tried and
   given up: see the README.)
2. Where an anchor has several contexts, one member of each goes to the anchor's bucket with
   its bytes.  A task takes a block of its buckets at a time and sorts their suffixes with a
   difference cover (``cover.py``); neighbours in that order that agree on 200 bytes are
   repeated.  A bucket of more than ``MOST`` contexts (a passage in very many documents) is
   not gathered in one task: it is cut into its windows, which are counted by their digests,
   with partial sums before the shuffle.
3. The ranges found go to their documents, whose covered bytes are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import discard, drop_shuffles, map_batches, read, release_memory, slices, split_join, texts_of, written
from webloom.llm.cover import PAD, same_next, suffix_order
from webloom.llm.flat import MIX, spans

LENGTH = 200
K = 32
MOST = 4096
CHUNK = 1 << 20
#: Bytes of contexts whose suffixes are sorted together; one larger bucket goes alone.
BLOCK = 3 << 20
_A = np.uint64(0xD6E8FEB86659FD93)
_B = np.uint64(0xA0761D6478BD642F)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def rolling(data: np.ndarray, factor: np.uint64, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes of the ``size`` bytes at each position, by doubling; a position
    with fewer bytes left has none."""
    out, now, size = {}, MIX[data], 1
    powers = {1: factor}
    while True:
        if size in sizes:
            out[size] = now
        if size * 2 > max(sizes) or len(now) <= size:
            return out
        power = powers[size]
        now = now[:-size] * power + now[size:]
        with np.errstate(over="ignore"):
            powers[size * 2] = power * power
        size *= 2


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 128-bit digest of each run of bytes, as two columns of 64 bits."""
    raw, make = memoryview(data.tobytes()), hashlib.blake2b
    found = b"".join([make(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(found, "<i8").reshape(-1, 2)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(values)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    full[:n] = values
    square = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, contexts: bool = True) -> dict[str, np.ndarray]:
    """Runs of window starts with one anchor: the text, the first start in it, the number
    of starts, the anchor's hash and (if wanted) the context's digest, in two parts."""
    n = len(data) - length + 1
    names = ("text", "lo", "n", "anchor", "c1", "c2")
    if n <= 0:
        return {c: np.zeros(0, np.int64) for c in names}
    gram = _stir(rolling(data, _A, (K,))[K])
    place = np.arange(len(gram), dtype=np.uint64)
    anchor = (least(gram >> np.uint64(24) << np.uint64(24) | place, length - K + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    fits = np.arange(n) + length <= offsets[text + 1]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(fits & new)
    starts = np.flatnonzero(fits)
    number = np.bincount(np.searchsorted(first, starts, "right") - 1, minlength=len(first)) if len(first) else np.zeros(0, np.int64)
    out = {"text": text[first], "lo": first - offsets[text[first]], "n": number, "anchor": gram[anchor[first]].view(np.int64)}
    if contexts:
        context = digests(data, first, first + number + length - 1)
        # equal bytes have their anchor at the same place, so the digest says all
        out |= {"c1": context[:, 0], "c2": context[:, 1]}
    return out


def _find_runs(texts: DataFrame, contexts: bool) -> DataFrame:
    """The runs of all rows, or their anchors alone."""

    def make():
        def handle(batch: pa.RecordBatch):
            r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = texts_of(batch, "text")
            for lo, hi in slices(offsets, CHUNK):
                part = data[offsets[lo] : offsets[hi]]
                if hi - lo == 1 and len(part) > 3 * CHUNK:
                    found = _long(part, contexts)
                else:
                    found = [runs(part, offsets[lo : hi + 1] - offsets[lo], contexts=contexts)]
                for r in found:
                    if contexts:
                        yield {"anchor": r["anchor"], "c1": r["c1"], "c2": r["c2"], "r1": r1[lo:hi][r["text"]], "r2": r2[lo:hi][r["text"]], "lo": r["lo"].astype(np.int32), "n": r["n"].astype(np.int32)}
                    else:
                        yield {"anchor": r["anchor"]}

        return handle

    return map_batches(texts, make, "anchor bigint, c1 bigint, c2 bigint, r1 bigint, r2 bigint, lo int, n int" if contexts else "anchor bigint")


def _long(data: np.ndarray, contexts: bool):
    """A text that is too long to hash at once, by parts; each part begins where the run
    that the last part may have cut begins."""
    at, n = 0, len(data)
    while at + LENGTH <= n:
        part = data[at : at + 2 * CHUNK]
        r = runs(part, np.array([0, len(part)]), contexts=contexts)
        last, count = at + len(part) == n, len(r["lo"])
        keep = slice(None) if last or count < 2 else slice(None, -1)
        step = int(r["lo"][-1]) if count > 1 else len(part) - LENGTH + 1
        yield {c: v[keep] + at if c == "lo" else v[keep] for c, v in r.items()}
        if last:
            return
        at += step


def _gather(joined: DataFrame, most: int) -> DataFrame:
    """From texts with their representatives: contexts by anchor, or for the members of
    crowded buckets the hashes of each window."""

    def make():
        def handle(batch: pa.RecordBatch):
            r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = texts_of(batch, "text")
            items = batch.column(3)
            values, cut = items.flatten(), items.offsets.to_numpy() - items.offsets[0].as_py()
            anchor, lo, n, crowd = (values.field(c).to_numpy() for c in ("anchor", "lo", "n", "crowd"))
            of = np.repeat(np.arange(len(r1)), np.diff(cut))
            begin = offsets[of] + lo
            size = n.astype(np.int64) + LENGTH - 1
            for calm in (True, False):
                mine = np.flatnonzero((crowd <= most) == calm)
                for a in range(0, len(mine), 8192):
                    m = mine[a : a + 8192]
                    flat = data[spans(begin[m], size[m])]
                    ends = np.cumsum(size[m])
                    if calm:
                        blob = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(flat)])
                        yield {"k1": anchor[m], "k2": pa.nulls(len(m), pa.int64()), "r1": r1[of[m]], "r2": r2[of[m]], "lo": lo[m], "bytes": blob}
                    else:
                        inner = spans(ends - size[m], n[m].astype(np.int64))
                        name = digests(flat, inner, inner + LENGTH)
                        yield {"k1": name[:, 0], "k2": name[:, 1], "r1": np.repeat(r1[of[m]], n[m]), "r2": np.repeat(r2[of[m]], n[m]), "lo": (spans(lo[m].astype(np.int64), n[m].astype(np.int64))).astype(np.int32), "bytes": pa.nulls(len(inner), pa.binary())}

        return handle

    return map_batches(joined, make, "k1 bigint, k2 bigint, r1 bigint, r2 bigint, lo int, bytes binary")


def repeated_in(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For contexts of these sizes one after another: whether the window at each of their
    starts (all but the last ``length`` - 1 positions) is found at another start."""
    ends = np.cumsum(sizes)
    starts = spans(ends - sizes, sizes - length + 1)
    text = np.concatenate((data, np.zeros(PAD, np.uint8)))
    order = suffix_order(text, starts)
    same = same_next(text, order[1:], order[:-1], length)
    marked = np.zeros(len(data), bool)
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    return marked[starts]


def ranges(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a run of consecutive positions of one key begins, and their lengths."""
    new = np.append(True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1))
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(at)))


def _sort_buckets(contexts: DataFrame) -> DataFrame:
    """Rows sorted by anchor; blocks of whole buckets are sorted one after another."""

    def make():
        held: list[tuple] = []
        size = [0]
        last = [None]

        def close():
            if not held:
                return
            r1, r2, lo, sizes, data = (np.concatenate([h[i] for h in held]) for i in range(5))
            held.clear()
            size[0] = 0
            marked = repeated_in(data, sizes)
            n = sizes - LENGTH + 1
            row = np.repeat(np.arange(len(sizes)), n)[marked]
            at = spans(lo.astype(np.int64), n)[marked]
            if len(at):
                begin, count = ranges(row, at)
                yield {"r1": r1[row[begin]], "r2": r2[row[begin]], "lo": at[begin].astype(np.int32), "n": count.astype(np.int32)}

        def handle(batch: pa.RecordBatch | None):
            if batch is None:
                yield from close()
                return
            key, r1, r2, lo = (batch.column(i).to_numpy() for i in range(4))
            data, offsets = texts_of(batch, "bytes")
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            at = 0
            while at < len(key):
                if size[0] >= BLOCK and last[0] != key[at]:
                    yield from close()
                # up to the first end of a bucket at which the block is full, or all there is
                full = np.searchsorted(offsets, offsets[at] + max(0, BLOCK - size[0]))
                after = cuts[np.searchsorted(cuts, full) :]
                hi = int(after[0]) if len(after) else len(key)
                held.append((r1[at:hi], r2[at:hi], lo[at:hi], np.diff(offsets[at : hi + 1]), data[offsets[at] : offsets[hi]]))
                size[0] += int(offsets[hi] - offsets[at])
                last[0] = key[hi - 1]
                at = hi

        return handle

    ddl = "r1 bigint, r2 bigint, lo int, n int"
    schema = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])

    def run(batches):
        handle = make()

        def all_():
            yield from batches
            yield None

        try:
            for batch in all_():
                if batch is None or batch.num_rows:
                    for out in handle(batch):
                        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        finally:
            handle = None
            release_memory()

    return contexts.select("k1", "r1", "r2", "lo", "bytes").repartition("k1").sortWithinPartitions("k1").mapInArrow(run, ddl)


def repeated_windows(texts: DataFrame, most: int = MOST) -> DataFrame:
    """``r1``, ``r2``, ``lo``, ``n``: ranges of starts (in bytes) of repeated windows of
    the rows of ``r1``, ``r2`` and ``text``.  The ranges of one row may touch or repeat."""
    place, context = ["r1", "r2", "lo", "n"], ["anchor", "c1", "c2"]
    # a table of its own, so that the join deals both sides anew and may split a frequent anchor
    often = written(_find_runs(texts, False).groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    again = written(_find_runs(texts, True).join(often.select("anchor"), "anchor"))
    total = int(often.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
    kinds = written(again.groupBy(*context).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*place)).alias("rep")))
    discard(often)
    drop_shuffles(texts.sparkSession)  # those of anchors and runs, before texts are sent
    equal = split_join(again, kinds.where("times > 1").select(*context, "times"), context, times="times", total=total, how="left_semi").select(*place)
    crowds = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    reps = kinds.join(crowds, "anchor").select("rep.*", "anchor", "crowd").groupBy("r1", "r2").agg(F.collect_list(F.struct("anchor", "lo", "n", "crowd")).alias("items"))
    gathered = written(_gather(texts.join(reps, ["r1", "r2"]).select("r1", "r2", "text", "items"), most))
    sorted_ = _sort_buckets(gathered.where("bytes is not null"))
    windows = gathered.where("bytes is null").select("k1", "k2", "r1", "r2", "lo")
    twice = written(windows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    many = int(twice.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
    if not many:
        return equal.unionByName(sorted_)
    counted = split_join(windows, twice, ["k1", "k2"], times="times", total=many, how="left_semi").select("r1", "r2", "lo", F.lit(1).alias("n"))
    return equal.unionByName(sorted_).unionByName(counted)


def _remove(joined: DataFrame, kept: list[str], emit: tuple[str, ...]) -> DataFrame:
    def make():
        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, "text")
            lows, counts = (batch.column(batch.schema.get_field_index(c)) for c in ("lows", "counts"))
            # in parts, so that no second copy of a whole batch is held
            for at, end in slices(offsets, 2 * CHUNK):
                n = end - at
                out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")}
                for i, lo, count in zip(range(at, end), lows.slice(at, n).to_pylist(), counts.slice(at, n).to_pylist(), strict=True):
                    text, removed, spans_ = data[offsets[i] : offsets[i + 1]].tobytes(), 0, 0
                    size = len(text)
                    if lo:
                        a = np.array(lo, np.int64)
                        order = np.argsort(a, kind="stable")
                        a, b = a[order], a[order] + np.array(count, np.int64)[order] + LENGTH - 1
                        b = np.maximum.accumulate(b)
                        new = np.append(True, a[1:] > b[:-1])
                        first, last = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]
                        removed, spans_ = int((last - first).sum()), len(first)
                        text = b"".join(text[x:y] for x, y in zip([0, *last.tolist()], [*first.tolist(), size], strict=True))
                    for c, x in (("n_bytes", size), ("n_removed", removed), ("n_spans", spans_), ("kept_sha256", hashlib.sha256(text).hexdigest() if "kept_sha256" in emit else None), ("kept_text", text.decode("utf-8", "ignore") if "kept_text" in emit else None)):
                        out[c].append(x)
                yield {c: batch.column(i).slice(at, n) for i, c in enumerate(kept)} | out

        return handle

    types = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string", "kept_text": "string"}
    rows = joined.select(*kept, "text", "lows", "counts")
    return map_batches(rows, make, ", ".join(f"{c} {types[c]}" for c in emit), passed=rows.schema.fields[: len(kept)])


def _judged(docs: DataFrame, key: str, text: str, also: list[Column], emit: tuple[str, ...], most: int) -> tuple[DataFrame, list[str]]:
    """The columns ``also`` under names that clash with none here, and those of ``emit``."""
    # r1 and r2 name a row by its content, whichever task reads it; equal rows share them
    body = F.coalesce(F.col(text), F.lit(""))
    second = F.coalesce(F.col(key), F.lit(-1)) if dict(docs.dtypes)[key] in ("int", "bigint") else F.xxhash64(F.lit(1), key, text)
    own = [f"own{i}" for i in range(len(also))]
    rows = docs.select(*[c.alias(o) for c, o in zip(also, own, strict=True)], body.alias("text"), F.xxhash64(body, F.col(key)).alias("r1"), second.cast("bigint").alias("r2"))
    found = repeated_windows(rows.select("r1", "r2", "text"), most)
    found = found.groupBy("r1", "r2").agg(F.collect_list("lo").alias("lows"), F.collect_list("n").alias("counts"))
    return _remove(rows.join(found, ["r1", "r2"], "left"), own, emit), own


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = (), emit: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), most: int = MOST) -> DataFrame:
    """``key``, the columns ``also`` and those named in ``emit`` (``kept_text`` too: the
    remaining bytes as text, without characters that a cut broke) for each row.

    Every byte covered by a ``LENGTH``-byte string that also starts elsewhere, in this
    row or another, is removed; strings are judged on the input.  Shorter, null and empty
    texts lose nothing; of repeated rows of at least ``LENGTH`` bytes nothing is left;
    null keys keep their row; an empty table gives no rows.
    """
    names = [key, *also]
    out, own = _judged(docs, key, text, [F.col(c) for c in names], emit, most)
    return out.select(*[F.col(o).alias(c) for c, o in zip(names, own, strict=True)], *emit)


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """``docs``, its texts without the bytes that ``remove_repeats`` removes.  All columns
    keep their names, types and order; a text of which nothing is left is empty, a null one
    null."""
    # of the text itself only whether there is one goes along
    out, own = _judged(docs, key, text, [F.col(c).isNotNull() if c == text else F.col(c) for c in docs.columns], ("kept_text",), most)
    return out.select(*[(F.when(F.col(o), F.col("kept_text")) if c == text else F.col(o)).alias(c) for c, o in zip(docs.columns, own, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
