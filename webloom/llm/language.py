"""Language identification of mixed-language text.

Each word gets, for each language, the log-likelihood of its character trigrams (with
word boundaries); the ranges of its letters' script narrow the languages to those seen in
that script; and Viterbi finds the likeliest labels of the words, where a change of label
costs a penalty.  A text's language is the one whose spans hold most letters.

The trigram model is fitted to a bounded sample of each language's labelled rows (about
``SAMPLE`` of them, those whose hash is below the share that this makes of the language), so
that rare languages are learnt as well.  Its size is ``BUCKETS`` floats a language while that
is at most ``MODEL_BYTES``; with more languages each has half, a quarter and so on of the
buckets.  So all languages are kept, and the table may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import bucket_of, map_batches, read, slices, texts_of, written

BUCKETS = 1 << 17
SAMPLE = 2000
MODEL_BYTES = 64 << 20
SWITCH = 8.0
CHUNK = 3 << 20
#: First code points of script ranges and the scripts' numbers (0: none of these).
RANGES = [
    (0x0000, 0), (0x0041, 1), (0x02B0, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6), (0x0780, 0),
    (0x08A0, 6), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0B80, 10), (0x0C00, 11), (0x0D80, 12), (0x0E00, 13), (0x0E80, 14), (0x0F00, 15), (0x1000, 16), (0x10A0, 17),
    (0x1100, 18), (0x1200, 19), (0x13A0, 0), (0x1780, 20), (0x1800, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 21), (0x3100, 0), (0x3400, 22), (0xA000, 0),
    (0xAC00, 18), (0xD7B0, 0), (0xF900, 22), (0xFB00, 1), (0xFB07, 0),
]
SCRIPTS = 23
_FIRST = np.array([a for a, _ in RANGES], np.uint32)
_KIND = np.array([b for _, b in RANGES], np.uint8)
MULT = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


def _lower() -> np.ndarray:
    return np.fromiter((ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x10000)), np.uint32, 0x10000)


_CACHE: dict[str, np.ndarray] = {}


def table(name: str) -> np.ndarray:
    if name not in _CACHE:
        _CACHE[name] = {"letters": _letters, "lower": _lower}[name]()
    return _CACHE[name]


def script_of(points: np.ndarray) -> np.ndarray:
    low = np.array([_KIND[np.searchsorted(_FIRST, np.arange(0x10000), "right") - 1]])[0] if "script" not in _CACHE else _CACHE["script"]
    _CACHE["script"] = low
    return np.where(points < 0x10000, low[np.minimum(points, 0xFFFF)], 0)


@dataclass
class Words:
    """The words (runs of letters) of a chunk of texts: starts and lengths among the
    trigram positions, the text and the script of each."""

    grams: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray
    script: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    lead = (data & 0xC0) != 0x80
    ends = np.concatenate(([0], np.cumsum(lead)))[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n, capped = len(points), np.minimum(points, 0xFFFF)
    is_letter = table("letters")[capped]
    high = points > 0xFFFF
    if high.any():
        is_letter = is_letter.copy()
        is_letter[high] = np.fromiter((chr(c).isalpha() for c in points[high]), bool, int(high.sum()))
    low = np.where(high, points, table("lower")[capped])
    before = np.append(False, is_letter[:-1]) if n else is_letter
    begins = is_letter & ~before
    starts_of_text = ends[:-1][ends[:-1] < ends[1:]]
    begins[starts_of_text] = is_letter[starts_of_text]
    starts = np.flatnonzero(begins)
    at = np.flatnonzero(is_letter)
    number = np.cumsum(begins)[at] - 1
    lengths = np.bincount(number, minlength=len(starts))
    # trigrams centred on each letter; the neighbour of a word's edge letter is a boundary
    left = np.where(begins[at], 0, low[at - 1])
    last = np.ones(len(at), bool)
    last[:-1] = number[1:] != number[:-1]
    right = np.where(last, 0, low[np.minimum(at + 1, n - 1)]) if n else low
    mixed = (left.astype(np.uint64) << np.uint64(42)) | (low[at].astype(np.uint64) << np.uint64(21)) | right.astype(np.uint64)
    mixed ^= mixed >> np.uint64(31)
    grams = ((mixed * MULT) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int32)
    return Words(grams, np.cumsum(lengths) - lengths, lengths, np.searchsorted(ends, starts, "right") - 1, script_of(points[starts]))


def shift_of(buckets: int) -> int:
    """How many low bits of a bucket's number a table of so many rows leaves out."""
    return (BUCKETS // buckets).bit_length() - 1


def rows_for(languages: int) -> int:
    """The rows of the table for so many languages."""
    rows = BUCKETS
    while rows > 1 and rows * languages * 4 > MODEL_BYTES:
        rows //= 2
    return rows


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: log-probability
    scripts: np.ndarray  # script x language: seen in training
    switch: float = SWITCH

    def word_scores(self, w: Words) -> np.ndarray:
        """Words x languages."""
        if not len(w.starts):
            return np.zeros((0, len(self.languages)), np.float32)
        scores = np.add.reduceat(self.table[w.grams >> shift_of(len(self.table))], w.starts, axis=0)
        return np.where(self.scripts[w.script], scores, scores - 1000)

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each text and the share of its letters in that language."""
        n, k = len(offsets) - 1, len(self.languages)
        if not k or not len(data):
            return ["und"] * n, np.zeros(n)
        w = words_of(data, offsets)
        path = viterbi(self.word_scores(w), w.text, n, self.switch)
        mass = np.bincount(w.text * k + path, weights=w.lengths, minlength=n * k).reshape(n, k)
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        names = [self.languages[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        return names, np.where(total > 0, mass[np.arange(n), best] / np.maximum(total, 1), 0.0)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Spans (start, end, language) of a text: from the first to the last letter of
        neighbouring words with one label."""
        data = np.frombuffer(text.encode(), np.uint8)
        if not len(data) or not self.languages:
            return []
        w = words_of(data, np.array([0, len(data)]))
        path = viterbi(self.word_scores(w), w.text, 1, self.switch)
        is_letter = np.fromiter((c.isalpha() for c in text), bool, len(text))
        starts = np.flatnonzero(is_letter & ~np.append(False, is_letter[:-1]))
        out: list[list] = []
        for s, size, lang in zip(starts.tolist(), w.lengths.tolist(), path.tolist(), strict=True):
            if out and out[-1][2] == lang:
                out[-1][1] = s + size
            else:
                out.append([s, s + size, lang])
        return [(a, b, self.languages[c]) for a, b, c in out]


def viterbi(scores: np.ndarray, text: np.ndarray, n: int, switch: float) -> np.ndarray:
    """The best label of each word of ``n`` texts, whose words stand one after another.

    All texts advance together, a word at a time; with one penalty for every change, the
    best predecessor of a label is that label or the best of all.  Ties go to the same
    label, then to the first.
    """
    count = np.bincount(text, minlength=n)
    order = np.argsort(-count, kind="stable")
    begin = (np.cumsum(count) - count)[order]
    sizes = count[order]
    k = scores.shape[1]
    back = np.zeros(scores.shape, np.min_scalar_type(max(k - 1, 0)))
    best = np.zeros((n, k))
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1 if n else 1), "right").tolist()
    for t, m in enumerate(active):
        at = begin[:m] + t
        if t == 0:
            best[:m] = scores[at]
            continue
        top = best[:m].argmax(axis=1)
        change = best[np.arange(m), top] - switch
        stay = best[:m] >= change[:, None]
        back[at] = np.where(stay, np.arange(k), top[:, None])
        best[:m] = np.where(stay, best[:m], change[:, None]) + scores[at]
    path = np.zeros(len(scores), np.int64)
    now = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        path[at] = now[:m]
        now[:m] = back[at, now[:m]]
    return path


def fit(counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray], alpha: float = 0.3) -> Model:
    """From trigram counts (by row of the table) and word counts by script of each language."""
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((SCRIPTS, 0), bool))
    c = np.stack([counts[x] for x in names], axis=1) + alpha
    seen = np.stack([scripts[x] for x in names], axis=1) > 0
    seen[~seen.any(axis=1)] = True  # a script of no language narrows nothing
    return Model(names, np.log(c / c.sum(axis=0)).astype(np.float32), seen)


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> Model:
    """Fit to about ``most`` rows with text and lang of each language (all, where it has no
    more), chosen by hash of key and text.  Every language is learnt."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    number = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    languages = number.count()
    if not languages:
        return fit({}, {})
    size = rows_for(languages)
    # a row for each language; where they are very many they are not broadcast
    chosen = rows.join(F.broadcast(number) if languages <= 1 << 16 else number, "lang").where(F.shiftrightunsigned("h", 11) * F.lit(2.0**-53) * F.col("rows") < most)

    def make():
        def handle(batch: pa.RecordBatch):
            langs = np.array(batch.column(1).to_pylist(), object)
            data, offsets = texts_of(batch, "text")
            for lo, hi in slices(offsets, CHUNK):
                if offsets[lo] == offsets[hi]:
                    continue
                w = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                of_word = langs[lo:hi][w.text] if len(w.text) else np.zeros(0, object)
                for name in sorted(set(of_word.tolist())):
                    mine = of_word == name
                    got, number = np.unique(w.grams[np.repeat(mine, w.lengths)] >> shift_of(size), return_counts=True)
                    s, of_script = np.unique(w.script[mine], return_counts=True)
                    yield {"lang": [name] * (len(got) + len(s)), "bucket": np.concatenate((got, s.astype(np.int64) + size)).astype(np.int32), "n": np.concatenate((number, of_script))}

        return handle

    # at most MODEL_BYTES / 4 rows, and SCRIPTS for each language
    got = map_batches(chosen.select("text", "lang"), make, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts, scripts = {}, {}
    for name, g in got.groupby("lang"):
        full = np.zeros(size + SCRIPTS)
        full[g.bucket.to_numpy()] = g.n.to_numpy()
        counts[name], scripts[name] = full[:size], full[size:]
    return fit(counts, scripts)


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred and score (share of the letters) of each row.

    A text that is null or has no letter is ``und`` with score 0; equal shares go to the
    first language by name; null keys and repeated rows each keep theirs; an empty table
    gives no rows; with a model of no languages all is ``und``.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model)

    # what is held for a letter grows with the languages
    most = max(1 << 14, CHUNK * 4 // max(4, len(model.languages)))

    def make():
        label = packed.value.label

        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, text)
            for lo, hi in slices(offsets, most):
                names, share = label(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield {key: batch.column(0).slice(lo, hi - lo), "lang_pred": names, "score": share}

        return handle

    return map_batches(docs.select(key, text), make, f"{key} {dict(docs.dtypes)[key]}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(bucket_of("doc_id", 3, [1], negate=True)))
    return identify(docs, model).select("doc_id", bucket_of("doc_id", 3, [1]).alias("held_out"), "lang_pred", "score")
