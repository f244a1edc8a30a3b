"""Toxicity by a linear classifier over character n-grams, its features scaled by naive
Bayes log-count ratios.

A document's features are the distinct n-grams (hashed to ``BUCKETS``) of its lower-cased
text.  The classifier is fitted on the driver to a bounded sample of the labelled rows
(``SAMPLE`` of each label, those of the lowest hash of the id); with the label counts of
the whole table as weights.  Scoring reads every whole text once, in the tasks that scan
it; the model, a table of ``BUCKETS`` floats, is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import bucket_of, fresh, map_batches, read, release_memory, slices, texts_of, written

SIZES = (4, 5, 6)
BUCKETS = 1 << 18
SAMPLE = 4000
CHUNK = 1 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts (A-Z lower-cased) and the offsets of each text."""
    lead = (data & 0xC0) != 0x80
    ends = np.concatenate(([0], np.cumsum(lead)))[offsets]
    return np.frombuffer(data.tobytes().lower().decode("utf-8").encode("utf-32-le"), np.uint32), ends


def grams(points: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...] = SIZES, buckets: int = BUCKETS):
    """For each size, the bucket of the n-gram at each position (n-grams end within their
    text) and those positions.  A text shorter than n has none of size n."""
    n, shift = len(points), np.uint64(64 - (buckets - 1).bit_length())
    hashed = points.astype(np.uint64)
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # characters up to the text's end
    for size in range(2, max(sizes) + 1):
        if size > n:
            return
        hashed = hashed[: n - size + 1] * MULT + points[size - 1 :]
        hashed ^= hashed >> np.uint64(29)
        if size in sizes:
            at = np.flatnonzero(room[: n - size + 1] >= size)
            yield ((hashed[at] * MULT) >> shift).astype(np.int32), at


def doc_features(points: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, in order; with ``keep`` only buckets that it marks."""
    found = []
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    for bucket, at in grams(points, offsets):
        if keep is not None:
            some = keep[bucket]
            bucket, at = bucket[some], at[some]
        found.append((row[at] << 32) | bucket)
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


@dataclass
class Model:
    """Log-odds: ``bias`` plus the weights of a text's distinct n-grams."""

    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        points, ends = code_points(data, offsets)
        row, bucket = doc_features(points, ends, self.weights != 0)
        odds = self.bias + np.bincount(row, weights=self.weights[bucket], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def significant(pos: np.ndarray, neg: np.ndarray, *, sure: float = 4.0, alpha: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Buckets whose log-count ratio r = log(p / q), smoothed by ``alpha``, is at least
    ``sure`` of its standard errors from 0, and their ratios.  ``pos`` and ``neg``: in how
    many texts of each label every bucket is found."""
    pos, neg = pos + alpha, neg + alpha
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    used = np.flatnonzero(np.abs(ratio) >= sure * np.sqrt(1 / pos + 1 / neg))
    return used, ratio[used]


def fit(docs: list[np.ndarray], labels: np.ndarray, share: np.ndarray, used: np.ndarray, ratio: np.ndarray, *, epochs: int = 80, l2: float = 1e-4) -> Model:
    """``docs``: the buckets of each text that are among ``used``, whose ratios scale them;
    ``share``: the weight of each text.  A logistic loss with an l2 penalty is minimised by
    Adam over the whole sample.  Without texts of both labels every score is the label
    that there is (0 if there is none).
    """
    y = np.asarray(labels, np.float64)
    total = share.sum()
    prior = float((share * y).sum() / total) if total else 0.0
    if not 0 < prior < 1:
        return Model(np.zeros(BUCKETS, np.float32), 30.0 if prior else -30.0)
    place = np.zeros(BUCKETS, np.int64)
    place[used] = np.arange(len(used))
    m = len(used)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    col = place[np.concatenate(docs)]
    value = ratio[col]
    starts = np.searchsorted(row, np.arange(len(docs)))
    empty = np.bincount(row, minlength=len(docs)) == 0
    w, b = np.zeros(m), float(np.log(prior / (1 - prior)))
    m1, m2, g1, g2 = np.zeros(m), np.zeros(m), 0.0, 0.0
    weight = share / total
    for t in range(1, epochs + 1):
        terms = np.append(w[col] * value, 0.0)
        odds = np.add.reduceat(terms, np.minimum(starts, len(terms) - 1))
        odds[empty] = 0
        p = 1 / (1 + np.exp(-np.clip(odds + b, -50, 50)))
        err = weight * (p - y)
        grad = np.bincount(col, weights=err[row] * value, minlength=m) + l2 * w
        gb = float(err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        g1, g2 = 0.9 * g1 + 0.1 * gb, 0.99 * g2 + 0.01 * gb * gb
        step = 0.05 / (1 + t / 40)
        w -= step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        b -= step * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w * ratio
    return Model(weights, b)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Model:
    """Fit to at most ``most`` rows of each label.

    The executors count in how many texts each bucket is found (at most 2 * BUCKETS
    numbers come back); the second pass hands over only the significant buckets of each
    text, so what the driver holds does not grow with the texts' lengths.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(key), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col(key).isNotNull()).distinct()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # a limit for each label: every task keeps only its first rows before they meet
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(most) for y in (0, 1)]
    chosen = written(first[0].unionByName(first[1]))
    # at most 2 * most rows, so they may be broadcast; repeated documents count once for each row
    sampled = docs.select(key, text).join(F.broadcast(chosen), key).select(text, "y")

    def count():
        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, text)
            ys = batch.column(1).to_numpy()
            for lo, hi in slices(offsets, CHUNK):
                points, ends = code_points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row, bucket = doc_features(points, ends)
                got, n = np.unique(ys[lo:hi][row].astype(np.int64) << 32 | bucket, return_counts=True)
                yield {"y": (got >> 32).astype(np.int32), "bucket": (got & 0xFFFFFFFF).astype(np.int32), "n": n}

        return handle

    table = map_batches(sampled, count, "y int, bucket int, n bigint").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    ys, buckets, n = (table.column(c).to_numpy() for c in ("y", "bucket", "n"))
    found = np.zeros((2, BUCKETS))
    found[ys, buckets] = n
    used, ratio = significant(found[1], found[0])
    keep = np.zeros(BUCKETS, bool)
    keep[used] = True
    packed = spark.sparkContext.broadcast(keep)

    def features():
        wanted = packed.value

        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, text)
            for lo, hi in slices(offsets, CHUNK):
                points, ends = code_points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row, bucket = doc_features(points, ends, wanted)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield {"y": batch.column(1).slice(lo, hi - lo), "buckets": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket, pa.int32()))}

        return handle

    got = map_batches(sampled, features, "y int, buckets array<int>").toArrow()
    y = got.column("y").to_numpy().astype(np.int64)
    sets = [np.asarray(x, np.int64) for x in got.column("buckets").to_numpy(zero_copy_only=False)] if len(y) else []
    order = sorted(range(len(y)), key=lambda i: (y[i], len(sets[i]), sets[i].tobytes()))  # the same sum whatever order tasks end in
    number = np.bincount(y, minlength=2)
    share = np.array([counts.get(k, 0) / max(1, number[k]) for k in (0, 1)])
    model = fit([sets[i] for i in order], y[order], share[y[order]], used, ratio)
    del table, ys, buckets, n, got, sets
    release_memory()  # the driver's Python would keep what the fit took
    return model


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = (), names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``key``, the columns ``also``, score and predicted (called ``names``) of each row.

    A null or empty text has the score of no features; null keys and repeated rows each
    keep theirs; an empty table gives no rows.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model)
    read_ = list(dict.fromkeys((key, text, *also)))
    rows = docs.select(*read_)
    place = read_.index(text)

    def make():
        scores = packed.value.scores

        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, place)
            for lo, hi in slices(offsets, CHUNK):
                got = scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                out = {c: batch.column(i).slice(lo, hi - lo) for i, c in enumerate(read_)}
                yield out | {names[0]: got, names[1]: (got >= 0.5).astype(np.int32)}

        return handle

    kept = [f for f in rows.schema if f.name == key or f.name in also]
    return map_batches(rows, make, f"{names[0]} double, {names[1]} int", passed=kept)


def reject_toxic(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not predict to be toxic, as they were."""
    said = fresh(docs, "_score"), fresh(docs, "_label")
    return score(docs, model, key=key, text=text, also=tuple(docs.columns), names=said).where(F.col(said[1]) == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(bucket_of("doc_id", 5, [0], negate=True)))
    return score(docs, model).select("doc_id", bucket_of("doc_id", 5, [0]).alias("held_out"), "score", "predicted")
