"""Quality rules: counts of words, symbols and repeats, and an n-gram perplexity band.

The model is a modified Kneser-Ney model of order 2 over words, one for each language,
counted over every whole text; what it holds grows with the corpus.

1. Words are counted; those of the largest shares in their language, ``VOCABULARY`` at most,
   have ids of their own, every other one the id of its class (language and length), whose
   probability is shared by the class's distinct words.
2. Bigrams of ids are counted.  A task sends its distinct ones, sorted and packed, to
   buckets by hash; a bucket adds them up into sorted arrays of keys and counts, its part of
   the model.  The lower order (in how many bigrams a word is second) and what backing off
   from a word weighs follow from the buckets; both have a row for an id, so they are
   broadcast.  Bigrams that make up 2 ** -20 of all or more, of which there cannot be more
   than 2 ** 20, are broadcast too.
3. Texts are scored where the counts are: each sends the rest of its bigrams, packed, to
   the buckets, which look them up and send back sums of logarithms.  A text's own
   occurrences are taken off a bigram's count, so that no text vouches for itself.

A text fails where its log-perplexity lies outside its language's band: the median plus
or minus a multiple of the quartile range over the language's texts that pass the base
rules, wider for short texts, whose perplexity is less certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import SPACE, arrow_schema, discard, drop_shuffles, map_batches, read, release_memory, slices, texts_of, written
from webloom.llm.flat import distinct, run_hashes

CHUNK = 2 << 20
VOCABULARY = 1 << 17
#: Languages with a model of their own, those of most words; the rest share one.
LANGUAGES = 4096
#: Classes of words by length: 1 and 2 bytes, 3 and 4, and so on, 15 and more.
CLASSES = 8
#: Bits of an id in a bigram's key.
BITS = 24
HEAVY = 1 << 20
#: Word positions for each bucket.
PER_BUCKET = 1 << 21
#: The band: median +- WIDTH quartile ranges * sqrt(1 + SHORT / words).
WIDTH_LOW, WIDTH_HIGH, SHORT = 6.0, 6.0, 60
SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
OTHER = "und"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STIR = np.uint64(0x9E3779B97F4A7C15)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text of each word."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    space = SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    full = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[full] = ~space[full]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(space)
    of = rows[starts]
    # a word ends before the next space or the end of its text
    ends = np.minimum(np.append(stops, len(data))[np.searchsorted(stops, starts)], offsets[of + 1]) if len(starts) else starts
    return starts, ends, of


def language_hash(name: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"))


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, language: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word (A-Z lower-cased) of a language; the three low bits are
    its class."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    h = (run_hashes(LOWER[data], starts, size) ^ language) * _STIR
    h ^= h >> np.uint64(29)
    return (h * _STIR) & ~np.uint64(7) | np.minimum((size - 1) >> 1, CLASSES - 1).astype(np.uint64)


def _languages(batch: pa.RecordBatch) -> np.ndarray:
    """The hash of each row's language."""
    encoded = batch.column(1).fill_null(OTHER).dictionary_encode()
    names = np.array([language_hash(x) for x in encoded.dictionary.to_pylist()], np.uint64)
    return names[encoded.indices.to_numpy()] if len(names) else np.zeros(batch.num_rows, np.uint64)


def sums(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts (1 each) of each."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)


def packed(values: np.ndarray, width: int) -> bytes:
    """Whole numbers below 256 ** ``width``, their bytes by significance, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys of bigrams, by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)), 2 * BITS // 8)


def unpacked_keys(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(blob, n, 2 * BITS // 8), dtype=np.uint64)


def bucket_of_key(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = (keys ^ (keys >> np.uint64(BITS))) * _STIR
    return ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys, in their order."""
    bucket = bucket_of_key(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for places in np.split(order, cuts):
        if len(places):
            yield int(bucket[places[0]]), places


@dataclass
class Words:
    """The ids: ``keys`` (sorted) and ``ids`` of the vocabulary; then ``CLASSES`` ids for
    each language and the shared one, then an id for the start of a text of each."""

    keys: np.ndarray
    ids: np.ndarray
    language_of_word: np.ndarray
    languages: np.ndarray
    #: log of the distinct words that share an id
    shared: np.ndarray

    @property
    def size(self) -> int:
        return len(self.ids) + (CLASSES + 1) * (len(self.languages) + 1)

    def language(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each language; the last number is that of the rest."""
        if not len(self.languages):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.languages, hashes), len(self.languages) - 1)
        return np.where(self.languages[at] == hashes, at, len(self.languages))

    def language_of_id(self) -> np.ndarray:
        every = np.arange(len(self.languages) + 1)
        return np.concatenate((self.language_of_word, np.repeat(every, CLASSES), every))

    def bigrams(self, data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of the bigram that ends with each word, and the word's text."""
        starts, ends, of = word_bounds(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint64), of
        keys, number = word_keys(data, starts, ends, hashes[of]), self.language(hashes)[of]
        ids = len(self.ids) + CLASSES * number + (keys & np.uint64(7)).astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ids = np.where(self.keys[at] == keys, self.ids[at], ids)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        first = np.append(True, of[1:] != of[:-1])
        before[first] = len(self.ids) + CLASSES * (len(self.languages) + 1) + number[first]
        return before.astype(np.uint64) << np.uint64(BITS) | ids.astype(np.uint64), of


@dataclass
class Model:
    """What every task holds: discounts by language, and for each id the total and the
    weight of backing off as a first word and the lower order's probability as a second;
    and the counts of the heavy bigrams."""

    words: Words
    discount: np.ndarray
    total: np.ndarray
    gap: np.ndarray
    lower: np.ndarray
    heavy: tuple[np.ndarray, np.ndarray]
    buckets: int

    def logs(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Logarithms of the probabilities of bigrams with these counts by other texts."""
        v, w = (keys >> np.uint64(BITS)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)
        off = self.discount[self.words.language_of_id()[v], np.minimum(counts, 3)]
        p = (counts - off) / self.total[v] + self.gap[v] * self.lower[w]
        return np.log(np.maximum(p, 1e-300)) - self.words.shared[w]


def _word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``language``, ``word`` (hashes) and ``n``, added up in every task before the shuffle."""

    def make():
        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, text)
            hashes = _languages(batch)
            for lo, hi in slices(offsets, 4 * CHUNK):
                found = []
                for a, b in slices(offsets[lo : hi + 1], CHUNK):
                    at = offsets[lo + a : lo + b + 1] - offsets[lo + a]
                    part = data[offsets[lo + a] : offsets[lo + b]]
                    starts, ends, of = word_bounds(part, at)
                    found.append((word_keys(part, starts, ends, hashes[lo + a : lo + b][of]), hashes[lo + a : lo + b][of]))
                for one in np.unique(hashes[lo:hi]):
                    word, n = sums(np.concatenate([w[h == one] for w, h in found]))
                    yield {"language": np.full(len(word), one).view(np.int64), "word": word.view(np.int64), "n": n}

        return handle

    return map_batches(docs.select(text, lang), make, "language bigint, word bigint, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame, *, text: str = "text", lang: str = "lang", vocabulary: int = VOCABULARY) -> tuple[Words, int]:
    """The ids, and the number of word positions."""
    table = written(_word_counts(docs, text, lang))
    totals = table.groupBy("language").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "language")
    top = totals.limit(LANGUAGES).toPandas()
    positions = int(table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    own = table.join(F.broadcast(totals.limit(LANGUAGES)), "language")  # LANGUAGES rows of two numbers
    # by sixteenths of a power of two of the share: as many whole steps as the vocabulary holds
    own = own.where("n > 1").withColumn("step", F.floor(-16 * F.log2(F.col("n") / F.col("total"))))
    last, held = -1, 0
    for r in own.groupBy("step").count().orderBy("step").collect():  # at most 16 * 64 rows
        held += r["count"]
        if held > vocabulary:
            break
        last = r["step"]
    best = own.where(F.col("step") <= last).select("language", "word").toPandas()
    kinds = table.groupBy("language", F.expr("word & 7").alias("class")).agg(F.count(F.lit(1)).alias("types"))
    known = F.broadcast(totals.limit(LANGUAGES).select("language", F.lit(1).alias("known")))
    kinds = kinds.join(known, "language", "left").groupBy(F.when(F.col("known") == 1, F.col("language")).alias("language"), "class").agg(F.sum("types").alias("types")).toPandas()
    discard(table)
    languages = np.sort(top["language"].to_numpy(np.int64).view(np.uint64))
    keys, of = best["word"].to_numpy(np.int64).view(np.uint64), best["language"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    words = Words(keys[order], np.arange(len(keys)), np.zeros(0, np.int64), languages, np.zeros(0))
    words.language_of_word = words.language(of[order])
    # words that share an id: those of the class but not in the vocabulary
    types = np.zeros((len(languages) + 1, CLASSES))
    rest = kinds["language"].isna().to_numpy()
    number = np.full(len(kinds), len(languages))
    number[~rest] = words.language(kinds["language"].to_numpy()[~rest].astype(np.int64).view(np.uint64))
    np.add.at(types, (number, kinds["class"].to_numpy(np.int64)), kinds["types"].to_numpy(np.float64))
    np.subtract.at(types, (words.language_of_word, (words.keys & np.uint64(7)).astype(np.int64)), 1)
    words.shared = np.concatenate((np.zeros(len(keys)), np.log(np.maximum(types, 1)).reshape(-1), np.zeros(len(languages) + 1)))
    return words, positions


def _bucketed(rows: DataFrame, make, ddl: str, by: str = "bucket") -> DataFrame:
    """Rows by bucket (or part) and kind to a handler that also gets None at the end."""
    schema = arrow_schema(ddl)

    def run(batches):
        try:
            handle = make()

            def then_none():
                yield from batches
                yield None

            for batch in then_none():
                if batch is None or batch.num_rows:
                    for out in handle(batch):
                        yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f in schema], schema=schema)
        finally:
            handle = None
            release_memory()

    return rows.repartition(by).sortWithinPartitions(by, "kind").mapInArrow(run, ddl)


PARTS = "bucket int, kind int, n int, keys binary, counts binary"


def count_bigrams(docs: DataFrame, words: Words, positions: int, buckets: int, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The model's parts: for each bucket a row of kind 0 with its keys and counts, and one
    of kind 1 with the heavy ones."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    least = max(2, -(-positions // HEAVY))

    def send():
        ids = shared.value

        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, text)
            hashes = _languages(batch)
            for lo, hi in slices(offsets, 4 * CHUNK):
                found = []
                for a, b in slices(offsets[lo : hi + 1], CHUNK):
                    at = offsets[lo + a : lo + b + 1] - offsets[lo + a]
                    found.append(ids.bigrams(data[offsets[lo + a] : offsets[lo + b]], at, hashes[lo + a : lo + b])[0])
                keys, n = sums(np.concatenate(found))
                out = {c: [] for c in ("bucket", "kind", "n", "keys", "counts")}
                for bucket, at in by_bucket(keys, buckets):
                    for c, x in (("bucket", bucket), ("kind", 0), ("n", len(at)), ("keys", packed_keys(keys[at])), ("counts", packed(n[at], 5))):
                        out[c].append(x)
                yield out

        return handle

    def add():
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = [None]

        def close():
            if not held:
                return
            keys, n = sums(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            for kind, which in ((0, n < least), (1, n >= least)):
                k, c = keys[which], n[which]
                yield {"bucket": [now[0]], "kind": [kind], "n": [len(k)], "keys": [packed_keys(k)], "counts": [packed(c, 5)]}

        def handle(batch: pa.RecordBatch | None):
            if batch is None:
                yield from close()
                return
            for bucket, n, keys, counts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if bucket != now[0]:
                    yield from close()
                    now[0] = bucket
                held.append((unpacked_keys(keys, n), unpacked(counts, n, 5).astype(np.int64)))

        return handle

    return _bucketed(map_batches(docs.select(text, lang), send, PARTS), add, PARTS)


def fit(parts: DataFrame, words: Words, buckets: int) -> Model:
    """Discounts, lower order and weights from the model's parts; what comes back to the
    driver is a row for each id, and the heavy bigrams."""
    names = ("total", "kinds", "n1", "n2", "n3", "n4", "second")
    size = words.size

    def make():
        def handle(batch: pa.RecordBatch):
            for n, keys, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                k, c = unpacked_keys(keys, n), unpacked(counts, n, 5).astype(np.int64)
                v, w = (k >> np.uint64(BITS)).astype(np.int64), (k & np.uint64((1 << BITS) - 1)).astype(np.int64)
                one = lambda at, weights=None: np.bincount(at, weights=weights, minlength=size).astype(np.int64)
                got = [one(v, c), one(v), *(one(v[c == i]) for i in (1, 2, 3, 4)), one(w)]
                some = np.flatnonzero(got[1] + got[6])
                yield {"id": some} | {name: x[some] for name, x in zip(names, got, strict=True)}

        return handle

    by_id = map_batches(parts.select("n", "keys", "counts"), make, "id bigint, " + ", ".join(f"{c} bigint" for c in names)).groupBy("id").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    full = {c: np.zeros(size) for c in names}
    for c in names:
        full[c][by_id["id"].to_numpy()] = by_id[c].to_numpy()
    of = words.language_of_id()
    per = {c: np.bincount(of, weights=full[c], minlength=len(words.languages) + 1) for c in names}
    discount = np.stack([np.zeros(len(per["n1"])), *discounts(per["n1"], per["n2"], per["n3"], per["n4"])], axis=1)
    many = full["kinds"] - full["n1"] - full["n2"]
    total = np.maximum(full["total"], 1)
    gap = (discount[of, 1] * full["n1"] + discount[of, 2] * full["n2"] + discount[of, 3] * many) / total
    lower = full["second"] / np.maximum(per["second"][of], 1)
    heavy = [(unpacked_keys(r["keys"], r["n"]), unpacked(r["counts"], r["n"], 5).astype(np.int64)) for r in parts.where("kind = 1 and n > 0").select("n", "keys", "counts").collect()]
    keys, counts = (np.concatenate([h[i] for h in heavy]) if heavy else np.zeros(0, (np.uint64, np.int64)[i]) for i in range(2))
    order = np.argsort(keys)
    return Model(words, discount, total, gap, lower, (keys[order], counts[order]), buckets)


def discounts(n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, n4: np.ndarray) -> list[np.ndarray]:
    """What is taken off counts of 1, 2, and 3 or more, from how many bigrams have a count
    of 1, 2, 3 and 4; kept inside (0, count), so that few bigrams do no harm."""
    n = [np.asarray(x, np.float64) for x in (n1, n2, n3, n4)]
    with np.errstate(divide="ignore", invalid="ignore"):
        y = np.where(n[0] + 2 * n[1] > 0, n[0] / (n[0] + 2 * n[1]), 0.5)
        raw = [np.where(n[i - 1] > 0, i - (i + 1) * y * n[i] / n[i - 1], i * 0.5) for i in (1, 2, 3)]
    return [np.clip(x, 0.05, i - 0.05) for i, x in zip((1, 2, 3), raw, strict=True)]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each text; see ``measure``."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    word = ~SPACE[data]
    per = lambda marks: np.bincount(rows[marks], minlength=n)
    starts, ends, of = word_bounds(data, offsets)
    out = {"n_words": np.bincount(of, minlength=n), "word_chars": per(word & ((data & 0xC0) != 0x80)), "n_symbols": per(SYMBOL[data])}
    # words in windows found twice or more
    same = np.zeros(len(starts), bool)
    if len(starts) > 3:
        ids = _names(data, starts, ends - starts)
        pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)[1].reshape(-1)
        whole = np.flatnonzero(of[2:] == of[:-2])
        if len(whole):
            three = np.unique(pair[whole] << 32 | ids[whole + 2], return_inverse=True)[1].reshape(-1)
            _, at, number = np.unique(of[whole] << 32 | three, return_inverse=True, return_counts=True)
            twice = whole[number[at.reshape(-1)] > 1]
            for k in range(3):
                same[twice + k] = True
    out["n_repeat_words"] = np.bincount(of[same], minlength=n)
    # lines with a word that equal an earlier line
    line = data == 0x0A
    first = np.concatenate((offsets[:-1], np.flatnonzero(line) + 1))
    text = np.concatenate((np.arange(n), rows[line]))
    order = np.lexsort((first, text))
    first, text = first[order], text[order]
    last = np.minimum(np.append(np.flatnonzero(line), len(data))[np.searchsorted(np.flatnonzero(line), first)], offsets[text + 1])
    words_before = np.concatenate(([0], np.cumsum(word)))
    some = words_before[last] > words_before[np.minimum(first, last)]
    first, last, text = first[some], last[some], text[some]
    if len(first):
        ids = _names(data, first, last - first)
        kept = np.unique(text << 32 | ids) >> 32
        out["n_dup_lines"] = np.bincount(text, minlength=n) - np.bincount(kept, minlength=n)
    else:
        out["n_dup_lines"] = np.zeros(n, np.int64)
    return out


def _names(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number for each distinct run of bytes."""
    found = distinct(data, starts, lengths)
    if found is not None:
        return found[1].astype(np.int64)
    number: dict[bytes, int] = {}
    raw = data.tobytes()
    return np.array([number.setdefault(raw[a : a + b], len(number)) for a, b in zip(starts.tolist(), lengths.tolist(), strict=True)], np.int64)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: int = VOCABULARY, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``key``, lang, the counts and the log-perplexity (over words) of each whole text; a
    text without words has none."""
    spark = docs.sparkSession
    words, positions = count_words(docs, text=text, lang=lang, vocabulary=vocabulary)
    drop_shuffles(spark)
    buckets = max(1, -(-positions // per_bucket))
    parts = written(count_bigrams(docs, words, positions, buckets, text=text, lang=lang))
    drop_shuffles(spark)
    shared = spark.sparkContext.broadcast(fit(parts, words, buckets))
    kind = dict(docs.dtypes)[key]
    own = {"part": "bigint", "row": "int", **dict.fromkeys(COUNTS, "bigint"), "sum": "double", "scored": "bigint"}
    sent = {"bucket": "int", "kind": "int", "n": "int", "keys": "binary", "counts": "binary", "rows": "binary", "name": kind, "lang": "string", **own}

    def send():
        import xxhash

        model = shared.value
        schema = arrow_schema(", ".join(f"{c} {t}" for c, t in sent.items()))
        empty = {f.name: f.type for f in schema}

        def filled(n: int, given: dict) -> dict:
            return {c: given.get(c, pa.nulls(n, t)) for c, t in empty.items()}

        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, text)
            hashes, langs = _languages(batch), batch.column(1).fill_null(OTHER)
            for lo, hi in slices(offsets, CHUNK):
                at, part = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                # named by content, so the same when a task runs again; equal parts add up to equal shares
                name = int(np.uint64(xxhash.xxh64_intdigest(part.tobytes() + at.tobytes() + hashes[lo:hi].tobytes())).view(np.int64))
                keys, of = model.words.bigrams(part, at, hashes[lo:hi])
                pairs, times = sums_of_pairs(keys, of)
                keys, of = pairs
                where = np.minimum(np.searchsorted(model.heavy[0], keys), max(0, len(model.heavy[0]) - 1))
                heavy = model.heavy[0][where] == keys if len(model.heavy[0]) else np.zeros(len(keys), bool)
                log = np.zeros(len(keys))
                log[heavy] = times[heavy] * model.logs(keys[heavy], np.maximum(model.heavy[1][where[heavy]] - times[heavy], 0))
                total = np.bincount(of, weights=log, minlength=hi - lo)
                scored = np.bincount(of[heavy], weights=times[heavy], minlength=hi - lo).astype(np.int64)
                # rows go through any task, behind the last bucket's number
                yield filled(hi - lo, {"bucket": buckets + ((name % 4096 + np.arange(hi - lo)) % 4096).astype(np.int32), "kind": np.full(hi - lo, 2, np.int32), "name": batch.column(0).slice(lo, hi - lo), "lang": langs.slice(lo, hi - lo), "part": np.full(hi - lo, name), "row": np.arange(hi - lo, dtype=np.int32), "sum": total, "scored": scored} | base_counts(part, at))
                rest = ~heavy
                keys, of, times = keys[rest], of[rest], times[rest]
                out = {c: [] for c in ("bucket", "n", "keys", "counts", "rows")}
                for bucket, places in by_bucket(keys, buckets):
                    for c, x in (("bucket", bucket), ("n", len(places)), ("keys", packed_keys(keys[places])), ("counts", packed(times[places], 5)), ("rows", packed(of[places], 3))):
                        out[c].append(x)
                m = len(out["n"])
                if m:
                    yield filled(m, out | {"kind": np.ones(m, np.int32), "part": np.full(m, name)})

        return handle

    own = {"name": kind, "lang": "string", **own}
    back = {"kind": "int", **own, "rows": "binary", "sums": "binary", "times": "binary", "n": "int"}

    def look_up():
        model = shared.value
        empty = {f.name: f.type for f in arrow_schema(", ".join(f"{c} {t}" for c, t in back.items()))}
        now: list = [None, np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        held: dict[int, np.ndarray] = {}  # sums and numbers of a part's rows, over the task's buckets
        size = [0]

        def flush():
            out = {c: [] for c in ("part", "rows", "sums", "times", "n")}
            for part, got in held.items():
                rows = np.flatnonzero(got[1])
                for c, x in (("part", part), ("rows", packed(rows, 3)), ("sums", got[0][rows].tobytes()), ("times", packed(got[1][rows].astype(np.int64), 5)), ("n", len(rows))):
                    out[c].append(x)
            m = len(held)
            held.clear()
            size[0] = 0
            if m:
                yield {c: out.get(c, pa.nulls(m, t)) for c, t in empty.items()} | {"kind": np.full(m, 3, np.int32)}

        def handle(batch: pa.RecordBatch | None):
            if batch is None:
                yield from flush()
                return
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            kinds = column("kind").to_numpy()
            rows = np.flatnonzero(kinds == 2)
            if len(rows):
                yield {c: column(c).take(pa.array(rows)) if c in own or c == "kind" else pa.nulls(len(rows), t) for c, t in empty.items()}
            for i in np.flatnonzero(kinds < 2).tolist():
                bucket, n = column("bucket")[i].as_py(), column("n")[i].as_py()
                if kinds[i] == 0:
                    now[:] = [bucket, unpacked_keys(column("keys")[i].as_py(), n), unpacked(column("counts")[i].as_py(), n, 5).astype(np.int64)]
                    continue
                if now[0] != bucket:
                    raise RuntimeError(f"bucket {bucket} has no part of the model")
                keys, times = unpacked_keys(column("keys")[i].as_py(), n), unpacked(column("counts")[i].as_py(), n, 5).astype(np.int64)
                of = unpacked(column("rows")[i].as_py(), n, 3).astype(np.int64)
                at = np.minimum(np.searchsorted(now[1], keys), len(now[1]) - 1)
                log = times * model.logs(keys, np.maximum(now[2][at] - times, 0))
                part, most = column("part")[i].as_py(), int(of.max()) + 1
                got = held.get(part)
                if got is None or got.shape[1] < most:
                    more = np.zeros((2, most))
                    if got is not None:
                        more[:, : got.shape[1]] = got
                    size[0] += most - (0 if got is None else got.shape[1])
                    held[part] = got = more
                got[0] += np.bincount(of, weights=log, minlength=got.shape[1])
                got[1] += np.bincount(of, weights=times, minlength=got.shape[1])
                if size[0] > 1 << 20:
                    yield from flush()

        return handle

    result = {c: t for c, t in own.items() if c not in ("part", "row", "sum", "scored")} | {"log_perplexity": "double"}

    def finish():
        """Rows of kind 2, then sums of kind 3, part by part."""
        rows: list[pa.RecordBatch] = []
        sums_: list = []
        now = [None]

        def close():
            n = max((int(r[0].max()) + 1 for r in sums_ if len(r[0])), default=0)
            total, times = np.zeros(n), np.zeros(n)
            for of, value, number in sums_:
                total[of] += value
                times[of] += number
            for batch in rows:
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                words_, at = column("n_words").to_numpy(), column("row").to_numpy()
                left = words_ - column("scored").to_numpy()
                # the mean over the bigrams looked up, as equal parts have all their shares
                at = np.minimum(at, max(0, n - 1))
                mean = total[at] / np.maximum(times[at], 1) if n else np.zeros(len(words_))
                value = -(column("sum").to_numpy() + left * mean) / np.maximum(words_, 1)
                yield {c: column(c) for c in result if c != "log_perplexity"} | {"log_perplexity": pa.array(value, mask=words_ == 0)}
            rows.clear()
            sums_.clear()

        def handle(batch: pa.RecordBatch | None):
            if batch is None:
                yield from close()
                return
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            part, kinds = column("part").to_numpy(), column("kind").to_numpy()
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if part[lo] != now[0]:
                    yield from close()
                    now[0] = part[lo]
                if kinds[lo] == 2:
                    rows.append(batch.slice(lo, hi - lo))
                    continue
                for i in range(lo, hi):
                    n = column("n")[i].as_py()
                    sums_.append((unpacked(column("rows")[i].as_py(), n, 3).astype(np.int64), np.frombuffer(column("sums")[i].as_py(), np.float64), unpacked(column("times")[i].as_py(), n, 5).astype(np.int64)))

        return handle

    rows = map_batches(docs.select(key, lang, text), send, ", ".join(f"{c} {t}" for c, t in sent.items()))
    model_rows = parts.where("kind = 0").select(*[F.col(c) if c in ("bucket", "kind", "n", "keys", "counts") else F.lit(None).cast(t).alias(c) for c, t in sent.items()])
    scored = _bucketed(model_rows.unionByName(rows), look_up, ", ".join(f"{c} {t}" for c, t in back.items()))
    out = written(_bucketed(scored, finish, ", ".join(f"{c} {t}" for c, t in result.items()), by="part"))
    discard(parts)
    drop_shuffles(spark)
    return out.withColumnRenamed("name", key) if key != "name" else out


def sums_of_pairs(keys: np.ndarray, of: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (key, text) in order, and how often each is found."""
    order = np.lexsort((of, keys))
    keys, of = keys[order], of[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], of[first]), np.diff(np.append(first, len(keys)))


def judge(measured: DataFrame, *, low: float = WIDTH_LOW, high: float = WIDTH_HIGH, short: int = SHORT) -> DataFrame:
    """Adds base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    q = F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(10000))
    bands = measured.where(~failed).groupBy("lang").agg(q.alias("q"))
    bands = written(bands.select("lang", F.col("q")[1].alias("mid"), F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(0.01)).alias("spread")))
    if bands.count() <= 1 << 16:  # a row for each language: at most so many are broadcast
        bands = F.broadcast(bands)
    wide = F.col("spread") * F.sqrt(1 + F.lit(short) / F.greatest(F.col("n_words"), F.lit(1)))
    inside = (F.col("log_perplexity") >= F.col("mid") - low * wide) & (F.col("log_perplexity") <= F.col("mid") + high * wide)
    return measured.join(bands, "lang", "left").withColumns({"base_failed": failed, "kept": ~failed & F.coalesce(inside, F.lit(True))})


def filter_quality(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key``, the counts, base_failed, kept and log_perplexity of each row.

    Words are runs without ASCII white space.  A null or empty text has no words and
    fails; a null language is one of its own, ``und``; a language none of whose texts pass
    the base rules needs no band.  Repeated rows each count and keep theirs; null keys
    keep their row; an empty table gives no rows; other columns are not read.
    """
    return judge(measure(docs, key=key, text=text, lang=lang))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_quality(read(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "log_perplexity")
