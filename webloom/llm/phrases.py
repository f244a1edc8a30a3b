"""Phrase collocations, mined by pivot partitioning.

Every phrase is owned by its pivot, the rarest of its words.  A text is rewritten once for each
of its words as what that word may own: the word with up to three neighbours on either side,
cut at the first that is rarer (or too rare for any phrase, or beyond a break).  Fragments go
to their pivot, are mined there, and only phrases that hold the pivot are counted, so a phrase
is counted in one place and words too rare for a phrase are never sent.

* Words are counted first.  How rare a word is, tasks read off a table of fixed size
  (``SLOTS`` numbers, indexed by a hash of language and word) that holds the largest count of
  the words of a slot.  Words that share a slot may only make another word the owner, or send
  fragments that come to nothing; what is counted does not change.
* A neighbour to the left must be less rare than the pivot, one to the right may be the pivot
  again: each occurrence of a phrase is thus seen from the leftmost pivot in it, once.
* A task sums equal fragments of a chunk of text and sends a row for each pivot of the chunk:
  the neighbours' words once, and fragments as indexes into them.  Copies of a text in one
  chunk cost nothing.
* A pivot of more than ``SPLIT`` occurrences is dealt to several tasks by chunk; the counts of
  its phrases are then summed in a second, small shuffle.  All other phrases are final where
  they are mined.

Parts of frequent phrases are frequent, so the counts of all cuts are among those mined.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.llm.common import arrow_schema, map_batches, read, release_memory, slices, split_join, texts_of, written
from webloom.llm.flat import run_hashes, spans

LEAST = 30
LONGEST = 4
INSIDE = 80
TOP = 2000
#: Bytes of text that are rewritten together, and fragments that are mined together.
CHUNK = 4 << 20
RUN = 1 << 17
#: Words that are hashed and compared at a time.
SLICE = 1 << 17
#: Numbers of the table of counts, a power of two.
SLOTS = 1 << 22
#: Occurrences of a pivot, or of all pivots of a task, above which they are split.
SPLIT = 1 << 20
WORDS_A_TASK = 1 << 21

BREAK, BLANK = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK[[0x20, 0x09]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with A-Z in lower case, starts and lengths of their words, the number of the
    piece and of the text that each is in."""
    n = len(data)
    low = data.copy()
    low[(data >= 0x41) & (data <= 0x5A)] += 32
    cut = BREAK[low]
    inside = ~(cut | BLANK[low])
    begin = inside.copy()
    if n > 1:
        begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] = inside[heads]
    end = inside.copy()
    if n > 1:
        end[:-1] &= ~inside[1:] | begin[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end)
    text = np.searchsorted(offsets, starts, "right") - 1
    return low, starts, ends - starts + 1, np.cumsum(cut)[starts] + text, text


def strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    """Runs of bytes as strings."""
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(data[spans(starts, lengths)]))


def joined(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> pa.StringArray:
    """Runs of bytes with a space between those of a group; ``groups`` holds how many runs
    each group has, one at least."""
    out = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    at = np.cumsum(lengths + 1) - lengths - 1
    out[spans(at, lengths)] = data[spans(starts, lengths)]
    last = np.cumsum(groups) - 1
    begin = np.concatenate(([0], last[:-1] + 1)) if len(groups) else np.zeros(0, np.int64)
    lo, size = at[begin], at[last] + lengths[last] - at[begin]
    return strings(out, lo, size)


class Chunk:
    """Words of a chunk of texts by their distinct forms (of a language each)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.data, self.starts, self.lengths, self.piece, text = words_of(data, offsets)
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        self.names = names
        of_text = np.array([number[x] for x in langs], np.int64)
        seeds = np.array([crc32(x.encode()) for x in names], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        lang = of_text[text]
        # a slice of words at a time: each byte of a slice takes several numbers
        parts = [run_hashes(self.data, self.starts[i : i + SLICE], self.lengths[i : i + SLICE]) for i in range(0, len(self.starts), SLICE)]
        hashes = (np.concatenate(parts) if parts else np.zeros(0, np.uint64)) + self.lengths.astype(np.uint64)
        hashes = (hashes ^ seeds[lang]) * np.uint64(0xD6E8FEB86659FD93)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        which = which.reshape(-1)
        if not self._same(first[which], lang):  # two words of one hash: told apart by their bytes
            raw, seen, first, which = self.data.tobytes(), {}, [], np.empty(len(lang), np.int64)
            for i, (a, n, g) in enumerate(zip(self.starts.tolist(), self.lengths.tolist(), lang.tolist(), strict=True)):
                which[i] = seen.setdefault((g, raw[a : a + n]), len(seen))
                if which[i] == len(first):
                    first.append(i)
            order = sorted(range(len(first)), key=lambda j: (int(hashes[first[j]]), list(seen)[j]))
            first = np.array(first, np.int64)[order]
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            which = back[which]
        self.first, self.which, self.lang, self.hashes = first, which, lang[first], hashes[first]

    def _same(self, other: np.ndarray, lang: np.ndarray) -> bool:
        if (self.lengths[other] != self.lengths).any() or (lang[other] != lang).any():
            return False
        for i in range(0, len(other), SLICE):
            starts, lengths = self.starts[i : i + SLICE], self.lengths[i : i + SLICE]
            at = spans(starts, lengths)
            if (self.data[at] != self.data[at + np.repeat(self.starts[other[i : i + SLICE]] - starts, lengths)]).any():
                return False
        return True

    def words(self, which: np.ndarray) -> pa.StringArray:
        return strings(self.data, self.starts[self.first[which]], self.lengths[self.first[which]])

    def langs(self, which: np.ndarray) -> pa.Array:
        return pa.array(self.names, pa.string()).take(pa.array(self.lang[which]))


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64) if slots > 1 else np.zeros(len(hashes), np.int64)


def chunks(batch: pa.RecordBatch, size: int) -> Iterator[Chunk]:
    data, offsets = texts_of(batch, 1)
    langs = batch.column(0).to_pylist()
    for lo, hi in slices(offsets, size):
        part = data[offsets[lo] : offsets[hi]]
        if len(part):
            yield Chunk(part, offsets[lo : hi + 1] - offsets[lo], langs[lo:hi])


def count_words(docs: DataFrame, slots: int = SLOTS, chunk: int = CHUNK) -> DataFrame:
    """(lang, word, slot, f) of every word of a table (lang, text)."""

    def make():
        def handle(batch: pa.RecordBatch):
            for c in chunks(batch, chunk):
                every = np.arange(len(c.first))
                yield {"lang": c.langs(every), "word": c.words(every), "slot": slot_of(c.hashes, slots), "f": np.bincount(c.which, minlength=len(every))}

        return handle

    return map_batches(docs, make, "lang string, word string, slot bigint, f bigint").groupBy("lang", "word", "slot").agg(F.sum("f").alias("f"))


def fragments(c: Chunk, often: np.ndarray, least: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fragments of a chunk and how often each stands there, by pivot.

    A row is the pivot, its neighbours to the left from the nearest on, and those to the
    right: places among the chunk's words, those of greater place being less rare, 0 for
    none.  A pivot without neighbours gives none."""
    order = np.lexsort((np.arange(len(c.first)), c.hashes, often))
    rank = np.zeros(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    rank[often < least] = 0
    r, far = rank[c.which], longest - 1
    n = len(r)
    pad = np.zeros(far, np.int32)
    wide = np.concatenate((pad, r, pad))
    piece = np.concatenate((np.full(far, -1), c.piece, np.full(far, -1)))
    columns = [r]
    for side in (-1, 1):
        open_ = r > 0
        for k in range(1, far + 1):
            other = wide[far + side * k : far + side * k + n]
            open_ = open_ & (piece[far + side * k : far + side * k + n] == c.piece) & ((other > r) if side < 0 else (other >= r))
            columns.append(np.where(open_, other, 0))
    keep = (columns[1] > 0) | (columns[far + 1] > 0)
    table = np.stack([x[keep] for x in columns])
    mixed = np.zeros(table.shape[1], np.uint64)
    for x in table:
        mixed = (mixed + x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    table = table[:, np.lexsort((mixed, table[0]))]
    new = np.ones(table.shape[1], bool)
    new[1:] = (table[:, 1:] != table[:, :-1]).any(axis=0)
    # equal rows are neighbours unless two others share a hash; then they are counted apart
    at = np.flatnonzero(new)
    return table[:, at], np.diff(np.append(at, table.shape[1])), order


def rewrite(docs: DataFrame, often, *, least: int, longest: int, slots: int, split: int, chunk: int = CHUNK) -> DataFrame:
    """(lang, pivot, share, words, places, counts) of a table (lang, text): a row for each
    pivot of a chunk.  ``share`` is null, or which part of an often pivot's chunks this is."""

    def make():
        table = often.value
        state = {"n": TaskContext.get().partitionId()}

        def handle(batch: pa.RecordBatch):
            for c in chunks(batch, chunk):
                state["n"] += 7919
                count = table[slot_of(c.hashes, slots)]
                rows, times, order = fragments(c, count, least, longest)
                if not rows.shape[1]:
                    continue
                heads = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
                number = np.diff(np.append(heads, rows.shape[1]))
                group = np.repeat(np.arange(len(heads)), number)
                near = rows[1:].T.reshape(-1).astype(np.int64)
                width = rows.shape[0] - 1
                owner = np.repeat(group, width)
                there = near > 0
                keys, inverse = np.unique((owner[there] << 32) | near[there], return_inverse=True)
                sizes = np.bincount(keys >> 32, minlength=len(heads))
                begin = np.cumsum(sizes) - sizes
                place = np.zeros(len(near), np.int64)
                place[there] = inverse.reshape(-1) - begin[owner[there]] + 1
                word = order[(keys & 0xFFFFFFFF) - 1]
                pivot = order[rows[0, heads] - 1]
                parts = -(-count[pivot] // split)
                share = np.where(parts > 1, state["n"] % np.maximum(parts, 1), -1)
                at = c.first[word]
                short, long = place.astype("<u2").tobytes(), place.astype("<u4").tobytes()
                ends = np.cumsum(number) * width
                lows = ends - number * width
                yield {
                    "lang": c.langs(pivot), "pivot": c.words(pivot), "share": pa.array(share, pa.int64(), mask=share < 0),
                    "words": joined(c.data, c.starts[at], c.lengths[at], sizes),
                    "places": [long[4 * a : 4 * b] if s > 0xFFFF else short[2 * a : 2 * b] for a, b, s in zip(lows.tolist(), ends.tolist(), sizes.tolist(), strict=True)],
                    "counts": [x.tobytes() for x in np.split(times.astype("<u4"), heads[1:])],
                }

        return handle

    return map_batches(docs, make, "lang string, pivot string, share bigint, words string, places binary, counts binary")


def _combined(columns: list[np.ndarray], weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and the sums of their weights."""
    key, first = columns[0], None
    for x in columns[1:]:
        _, key = np.unique(key, return_inverse=True)
        key = key.reshape(-1) * (int(x.max()) + 1) + x
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(inverse.reshape(-1), kind="stable")
    begin = np.searchsorted(inverse.reshape(-1)[order], np.arange(len(first)))
    return [x[first] for x in columns], np.add.reduceat(weights[order], begin)


def mine_rows(table: pa.Table, least: int, longest: int) -> Iterator[dict]:
    """Phrases of whole pivots: rows of ``rewrite`` that stand together by lang, pivot and
    share."""
    table = table.combine_chunks()
    width = 2 * (longest - 1)
    lists = pc.split_pattern(table["words"].combine_chunks(), " ")
    base = np.asarray(lists.offsets)[:-1]
    pivots = table["pivot"].combine_chunks()
    coded = pa.concat_arrays([lists.values, pivots]).dictionary_encode()
    code, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    own = code[len(lists.values) :]
    langs = table["lang"].combine_chunks().dictionary_encode()
    lang = np.asarray(langs.indices).astype(np.int64)
    share = np.asarray(table["share"].combine_chunks().fill_null(-1))
    counts = [np.frombuffer(x, "<u4") for x in table["counts"].to_pylist()]
    number = np.array([len(x) for x in counts], np.int64)
    places = np.concatenate([np.frombuffer(x, "<u2" if len(x) == 2 * width * n else "<u4").astype(np.int64) for x, n in zip(table["places"].to_pylist(), number.tolist(), strict=True)])
    row = np.repeat(np.arange(len(number)), number)
    places = places.reshape(-1, width)
    at = base[row][:, None] + places - 1
    near = np.where(places > 0, code[np.maximum(at, 0)], -1)
    far = longest - 1
    line = [near[:, far - 1 - k] for k in range(far)] + [own[row]] + [near[:, far + k] for k in range(far)]
    weight = np.concatenate(counts).astype(np.int64)
    group = np.cumsum(np.concatenate(([False], (lang[1:] != lang[:-1]) | (own[1:] != own[:-1]) | (share[1:] != share[:-1]))))
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    for n in range(2, longest + 1):
        found, times, of = [[] for _ in range(n)], [], []
        for before in range(n):
            lo, hi = far - before, far - before + n - 1
            there = np.flatnonzero((line[lo] >= 0) & (line[hi] >= 0))
            for i in range(n):
                found[i].append(line[lo + i][there])
            times.append(weight[there])
            of.append(group[row[there]])
        columns = [np.concatenate(of), *map(np.concatenate, found)]
        if not len(columns[0]):
            continue
        columns, total = _combined(columns, np.concatenate(times))
        first = head[columns[0]]
        open_ = share[first] >= 0
        keep = (total >= least) | open_
        words = [names.take(pa.array(x[keep])) for x in columns[1:]]
        yield {"lang": langs.dictionary.take(pa.array(lang[first][keep])), "phrase": pc.binary_join_element_wise(*words, " "), "size": np.full(int(keep.sum()), n, np.int32), "f": total[keep], "open": open_[keep]}


MINED = "lang string, phrase string, size int, f bigint, open boolean"


def mine(sent: DataFrame, tasks: int, *, least: int, longest: int, run: int = RUN) -> DataFrame:
    """(lang, phrase, size, f, open): phrases with what they are counted, which is final and
    at least ``least`` unless they are open.  A task takes pivots as they come, ``run``
    fragments at a time, so it holds these and the largest pivot."""
    schema = arrow_schema(MINED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out(table: pa.Table):
            for x in mine_rows(table, least, longest):
                yield pa.RecordBatch.from_arrays([x[f.name] if isinstance(x[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(x[f.name], f.type) for f in schema], schema=schema)

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                size += pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index("counts")))).as_py() // 4
                if size < run:
                    continue
                table = pa.Table.from_batches(held).combine_chunks()
                last = pc.and_(pc.and_(pc.equal(table["lang"], table["lang"][-1]), pc.equal(table["pivot"], table["pivot"][-1])), pc.equal(table["share"].combine_chunks().fill_null(-1), -1 if table["share"][-1].as_py() is None else table["share"][-1]))
                whole = pc.index(last, True).as_py()
                if whole:
                    yield from out(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                size = sum(pc.sum(pc.binary_length(b.column(b.schema.get_field_index("counts")))).as_py() for b in held) // 4
            if held:
                yield from out(pa.Table.from_batches(held))
        finally:
            held.clear()
            release_memory()

    dealt = sent.repartition(tasks, "lang", "pivot", "share").sortWithinPartitions("lang", "pivot", "share")
    return dealt.mapInArrow(work, MINED)


def phrase_counts(docs: DataFrame, words: DataFrame, *, least: int = LEAST, longest: int = LONGEST, slots: int = SLOTS, split: int = SPLIT, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of two to ``longest`` words that stand in a table
    (lang, text) ``least`` times or more; ``words`` is ``count_words`` of it, stored."""
    spark = docs.sparkSession
    # at most ``slots`` rows of two numbers, whatever the corpus
    filled = words.where(F.col("f") >= least).groupBy("slot").agg(F.max("f").alias("f")).toArrow()
    table = np.zeros(slots, np.int64)
    table[filled["slot"].to_numpy()] = filled["f"].to_numpy()
    total = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // WORDS_A_TASK))
    sent = rewrite(docs, spark.sparkContext.broadcast(table), least=least, longest=longest, slots=slots, split=split, chunk=chunk)
    mined = written(mine(sent, tasks, least=least, longest=longest, run=run))
    summed = mined.where("open").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return mined.where("not open").drop("open").unionByName(summed)


def part(phrase: str, size: str, begin, length) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " "), begin, length), " ")


def score(a, both):
    """Twice a million times the share that a phrase has in its parts; exact beyond 64 bits."""
    return F.expr(f"cast((cast(2000000 as decimal(7,0)) * cast({a} as decimal(20,0))) div cast({both} as decimal(20,0)) as bigint)")


def scored(counts: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of phrases (lang, phrase, size, f), stored, by their
    weakest cut; ``words`` has (lang, word, f) of all words in them."""
    sides = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit(True).alias("left"), part("phrase", "size", F.lit(1), k).alias("sub")), F.struct(k.alias("k"), F.lit(False).alias("left"), part("phrase", "size", k + 1, F.col("size") - k).alias("sub"))))
    asked = counts.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.flatten(sides)).alias("s")).select("lang", "phrase", "size", "a", "s.*")
    times = asked.groupBy("lang", "sub").agg(F.count(F.lit(1)).alias("times"))
    every = counts.where(F.col("size") < longest).select("lang", F.col("phrase").alias("sub"), "f").unionByName(words.select("lang", F.col("word").alias("sub"), "f"))
    total = counts.agg(F.coalesce(F.sum(2 * (F.col("size") - 1)), F.lit(0)).alias("n")).first()["n"]
    # a common word is part of very many phrases and is joined apart
    met = split_join(asked, every.join(times, ["lang", "sub"]), ["lang", "sub"], times="times", total=total)
    side = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}")
    cut = met.groupBy("lang", "phrase", "size", "a").agg(*[side(k, left) for k in range(1, longest) for left in (True, False)])
    # the lowest score, then the smallest cut
    ways = F.array_compact(F.array(*[F.when(F.col("size") > k, F.struct(score("a", f"l{k} + r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]))
    return cut.withColumn("w", F.array_min(ways)).select("lang", "phrase", "size", "a", "w.l", "w.r", "w.score")


def not_inside(counts: DataFrame, share: int = INSIDE, longest: int = LONGEST) -> DataFrame:
    """The rows whose words do not lie inside a longer phrase that is found ``share`` percent
    as often or more."""
    spots = lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: part("phrase", "size", i, F.lit(n)))
    none = F.array().cast("array<string>")
    subs = F.concat(*[F.when(F.col("size") > n, spots(n)).otherwise(none) for n in range(2, longest)]) if longest > 2 else none
    longer = counts.select("lang", F.explode(F.array_distinct(subs)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    held = counts.join(longer, ["lang", "phrase"], "left")
    wide = lambda c, n: F.lit(n).cast("decimal(5,0)") * F.col(c).cast("decimal(20,0)")
    return held.where(F.col("_longer").isNull() | (wide("_longer", 100) < wide("f", share))).drop("_longer")


def first_of_each(df: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first ``top`` rows of each language by score, count and phrase, with ``rank``.  Rows
    of a language are ranked in parts first, so that no task gets all of them."""
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    near = salted.withColumn("_n", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*by))).where(F.col("_n") <= top)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top).drop("_salt", "_n")


def collocations(df: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP, **sizes: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``top`` phrases of each language.

    A null text is empty and a null language ``und``; repeated rows count each; a language
    without a phrase gives no rows, an empty table none; other columns are not read.
    ``sizes`` are those of ``phrase_counts``.
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = written(count_words(docs, sizes.get("slots", SLOTS), sizes.get("chunk", CHUNK)))
    counts = written(phrase_counts(docs, words, least=least, longest=longest, **sizes))
    best = scored(counts, words.where(F.col("f") >= least), longest).join(not_inside(counts, inside, longest).select("lang", "phrase"), ["lang", "phrase"])
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    ranked = first_of_each(best, top).join(n, "lang")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), parts AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered)
), grams AS MATERIALIZED (
  SELECT lang, g, k, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS g FROM parts, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k
  ) GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), cands AS MATERIALIZED (SELECT lang, g, k, f AS a, string_split(g, ' ') AS ws FROM grams WHERE k > 1 AND f >= 30
), ways AS MATERIALIZED (
  SELECT lang, g, a, j, array_to_string(ws[1:j], ' ') AS lg, array_to_string(ws[j + 1:k], ' ') AS rg FROM cands, (SELECT unnest(range(1, 4)) AS j) WHERE j < k
), cuts AS (
  SELECT w.lang, w.g, w.a, w.j, x.f AS l, y.f AS r, (2000000::HUGEINT * w.a // (x.f + y.f))::BIGINT AS score
  FROM ways w JOIN grams x ON x.lang = w.lang AND x.g = w.lg JOIN grams y ON y.lang = w.lang AND y.g = w.rg
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), covers AS (
  SELECT lang, sub, max(a) AS most FROM (
    SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS sub FROM cands, (SELECT unnest(range(2, 4)) AS m), (SELECT unnest(range(1, 4)) AS i) WHERE m < k AND i + m - 1 <= k
  ) GROUP BY ALL
), kept AS (
  SELECT o.lang, o.g AS phrase, o.a, o.l, o.r, o.score FROM lowest o LEFT JOIN covers v ON v.lang = o.lang AND v.sub = o.g
  WHERE v.most IS NULL OR 100 * v.most < 80 * o.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
