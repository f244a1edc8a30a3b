"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are cut into blocks so that two of them with at most ``BITS`` differing bits
agree on some choice of whole blocks; each fingerprint is sent under every choice, those
that meet are verified by Hamming distance, and the links' components are found on
distinct fingerprints, so any number of copies of a text counts as one.

A meeting of more than ``MOST`` fingerprints is not compared: its remaining bits are cut
into ``BITS`` + 1 blocks, one of which close pairs share as well, and its members are sent
on under these longer keys, until each meeting is small.  Nodes of one fingerprint are
linked first and one of them goes on, so what remains after all bits but 12 are fixed
holds at most 4096; where fewer bits are free than blocks are needed, a meeting is
compared as it is.  So this ends.  A meeting hands on no
pairs but one edge from each member to the first of its local component.

``one_of_each`` (the pipeline's stage) finds its candidates by wider fingerprints of the same
kind, cut into as many blocks as the lower similarity asks for; texts that meet are compared
by Hamming distance, and shingle sets exactly before any link is made.  Blocks do not get
wider with the table, up to 2^24 texts, so each text is sent as often in a large table as in a
small one; a meeting of many is cut again where it takes place, by choices of the bits that
are compared.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import drop_shuffles, fresh, map_batches, maybe_among, read, release_memory, slices, texts_of, written
from webloom.llm.components import components

BITS = 3
MOST = 4096
SEED = 42
CHUNK = 4 << 20
#: Near copies: width of the shingles and least similarity.  A bit of such a pair differs with
#: probability 0.152 at most (its angle over pi), but for four shingles among five 0.1875.
WIDTH, LEAST = 5, (4, 5)
DIFFER = 0.1875
#: Part of such pairs that may meet under no block, bits by which those that meet are compared,
#: and most of these that may differ: so far out is one pair in 10^5 at DIFFER, and of
#: unrelated texts, 128 bits apart, one in 10^11.
MISSED, COMPARED, APART = 1e-5, 256, 74
#: Rows of the votes' matrix and least picks of each shingle; fingerprints compared each with
#: each, and how many of them with all at once; rows and blocks at a time.
CODE, TURNS, DENSE, ROWS, SET_ROWS, PASS = 2048, 4, 1024, 32, 512, 48
#: Part of the pairs at DIFFER that a larger meeting, cut again, may not bring together.
UNMET = 0.01
SET_CHUNK = 1 << 19
BLOCK = 2_000_000
_STIR = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of the shingles of a text's words (lower-cased A-Z)."""
    import xxhash

    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    hash64, ends, at = xxhash.xxh64_intdigest, [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [hash64(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def votes(hashes: np.ndarray) -> int:
    """The fingerprint: the bits set in over half of the hashes; none gives zero."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 18):
        part = hashes[lo : lo + (1 << 18)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", widths: tuple[int, ...] = (3,)) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a signed long) of each row; a text without words,
    or null, has fingerprint zero, one with fewer words than a shingle has its whole
    sequence as its only shingle.  Further ``widths`` give columns fp<width>."""
    names = ["fp", *(f"fp{w}" for w in widths[1:])]

    def make():
        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, text)
            for lo, hi in slices(offsets, CHUNK):
                raw, at = data[offsets[lo] : offsets[hi]].tobytes(), (offsets[lo : hi + 1] - offsets[lo]).tolist()
                out = {key: batch.column(0).slice(lo, hi - lo)}
                for name, width in zip(names, widths, strict=True):
                    found = [votes(np.array(shingle_hashes(raw[a:b], width), np.uint64)) for a, b in zip(at, at[1:], strict=False)]
                    out[name] = np.array(found, np.uint64).view(np.int64)
                yield out

        return handle

    return map_batches(docs.select(key, text), make, f"{key} {dict(docs.dtypes)[key]}, " + ", ".join(f"{n} bigint" for n in names))


def cut(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in ``n`` blocks of nearly equal size, taking every n-th bit."""
    return [bits[i::n] for i in range(n)]


def mask_of(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def first_masks(count: int, differ: int = BITS) -> list[int]:
    """The choices of blocks, of so many bits that few fingerprints meet by chance: with b
    blocks, close pairs agree on b - ``differ`` of them."""
    blocks = differ + 2
    while blocks < 2 * differ + 2 and 16 * 2 ** (64 * (blocks - differ) // blocks) < count:
        blocks += 1
    parts = cut(list(range(64)), blocks)
    return [mask_of(sum(chosen, [])) for chosen in combinations(parts, blocks - differ)]


def finer(mask: int, differ: int = BITS) -> list[int]:
    fixed, free = ([b for b in range(64) if (mask >> b & 1) == want] for want in (1, 0))
    return [mask_of(fixed + part) for part in cut(free, differ + 1)]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each of ``a`` and each of ``b``, fingerprints of one word or rows of several."""
    if a.ndim == 1:
        return np.bitwise_count(a[:, None] ^ b[None])
    total = np.zeros((len(a), len(b)), np.uint16)
    for word in range(a.shape[1]):
        total += np.bitwise_count(a[:, None, word] ^ b[None, :, word])
    return total


def near_edges(values: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """One edge (by places in ``values``) from each fingerprint that has a near one to the
    first of its component, within these values alone.  Each is compared once with those
    not yet reached."""
    n = len(values)
    to = np.full(n, -1)

    def met_by(front: np.ndarray, rest: np.ndarray) -> np.ndarray:
        return (apart(values[front], values[rest]) <= differ).any(axis=0)

    for first in range(n):
        if to[first] >= 0:
            continue
        to[first] = first
        front = np.array([first])
        rest = np.flatnonzero(to < 0)
        while len(front) and len(rest):
            met = np.zeros(len(rest), bool)
            step = max(1, (1 << 20) // len(rest))
            for lo in range(0, len(front), step):
                met |= met_by(front[lo : lo + step], rest)
            front, rest = rest[met], rest[~met]
            to[front] = first
    moved = np.flatnonzero(to != np.arange(n))
    return moved, to[moved]


def _meet(differ: int):
    """Rows sorted by (mask, value): each run of equal keys is one meeting."""
    held: list[tuple] = []
    at: list = [None]

    def close():
        if not held:
            return
        node, fp = (np.concatenate([h[i] for h in held]) for i in range(2))
        held.clear()
        if len(node) == 2:
            if (int(fp[0]) ^ int(fp[1])).bit_count() <= differ and node[0] != node[1]:
                yield node[1:], node[:1]
        elif len(node) > 2:
            order = np.lexsort((node, fp))
            node, fp = node[order], fp[order]
            a, b = near_edges(fp, differ)
            if len(a):
                yield node[a], node[b]

    def handle(batch: pa.RecordBatch | None):
        if batch is None:
            yield from close()
            return
        mask, value, node, fp = (batch.column(i).to_numpy() for i in range(4))
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        edges = [0, *new.tolist(), len(mask)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if at[0] != (key := (mask[lo], value[lo])):
                yield from close()
                at[0] = key
            held.append((node[lo:hi], fp[lo:hi].view(np.uint64)))

    return handle


def _meetings(keyed: DataFrame, differ: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        handle = _meet(differ)
        a, b = [], []

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], schema=schema)
            a.clear()
            b.clear()
            return got

        try:
            for batch in _then_none(batches):
                for x, y in handle(batch):
                    a.append(x)
                    b.append(y)
                    if len(a) > 20_000:
                        yield out()
            if a:
                yield out()
        finally:
            handle = None
            release_memory()

    rows = keyed.select("mask", "value", "node", "fp")
    return rows.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(run, "a bigint, b bigint")


def _then_none(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch
    yield None


def links(nodes: DataFrame, count: int, *, differ: int = BITS, most: int = MOST) -> DataFrame:
    """Edges ``a``, ``b`` between the nodes of a table ``node``, ``fp`` whose components
    are those of all pairs with at most ``differ`` differing bits."""
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    edges = nodes.join(heads.withColumnRenamed("node", "head"), "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    keyed = heads.select("node", "fp", F.explode(F.array(*map(F.lit, first_masks(count, differ)))).alias("mask"))
    while True:
        keyed = keyed.select("mask", F.expr("fp & mask").alias("value"), "node", "fp")
        sizes = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("size"))
        crowded = written(sizes.where(F.col("size") > most).select("mask", "value"))
        masks = [r[0] for r in crowded.select("mask").distinct().collect()]  # as many as there are choices of blocks
        cuts = {m: finer(m, differ) for m in masks}
        cuts = {m: to for m, to in cuts.items() if m not in to}  # others have a block without bits: close pairs may share no more
        crowded = crowded.where(F.col("mask").isin(list(cuts)))
        edges = edges.unionByName(_meetings(keyed.join(crowded, ["mask", "value"], "left_anti") if cuts else keyed, differ))
        if not cuts:
            return edges
        options = F.create_map(*[x for m, to in cuts.items() for x in (F.lit(m), F.array(*map(F.lit, to)).cast("array<bigint>"))])
        keyed = written(keyed.join(crowded, ["mask", "value"], "left_semi").select("node", "fp", F.explode(options[F.col("mask")]).alias("mask")).distinct())


def classes(prints: DataFrame, *, key: str = "doc_id", differ: int = BITS) -> DataFrame:
    """``fp`` and ``component_id`` (the smallest key reachable) for each distinct
    fingerprint of a table of ``key`` and ``fp``.  Null keys have fingerprints but give no
    component its name; a component of null keys alone has a null name."""
    each = written(prints.groupBy("fp").agg(F.min(key).alias("low")))
    edges = links(each.select(F.col("fp").alias("node"), "fp"), each.count(), differ=differ)
    roots = components(edges)
    joined = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return joined.join(names, "root").select("fp", "component_id")


def choices(width: int, missed: float, share: float = 1.0) -> int:
    """How many choices of ``width`` bits leave a pair at DIFFER unmet under all of them with
    probability ``missed``, if the part ``share`` of what agrees under one is found there."""
    return math.ceil(math.log(missed) / math.log1p(-share * (1 - DIFFER) ** width))


def blocks_for(count: int) -> tuple[int, int]:
    """How many blocks of how many bits: so wide that few meet by chance in small tables, and
    that a block's meeting is one task's work in large ones; a pair at DIFFER is brought
    together under no block with probability MISSED."""
    bits = round(math.log2(max(count, 1)))
    width = max(6, min(8, bits - 7), bits - 16)
    return choices(width, MISSED, 1 - UNMET), width


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def wide_fingerprints(hashes: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """A row of ``bits`` bits (whole bytes) for each set of shingle hashes, the sets one after
    another in ``hashes``: set where over half of the shingles vote for it.  The votes of a
    shingle are a row of a Hadamard matrix, or its negative, that its hash picks; so all sums
    of a set come from how often each row was picked.  The bits come in turn from several such
    picks, so that no set rests on one where the rows of its few shingles happen to depend on
    each other."""
    low, high = _hadamard(64), _hadamard(CODE // 64)
    owner = np.repeat(np.arange(len(sizes)), sizes) * CODE
    turns = max(TURNS, -(-bits // CODE))
    each, out = -(-bits // turns), []
    for turn in range(turns):
        flip, factor = (np.uint64((2 * turn + i) * 0x9E3779B97F4A7C15 % 2**64 | 1) for i in (1, 2))
        mixed = (hashes ^ flip) * factor
        mixed = (mixed ^ mixed >> np.uint64(29)) * _STIR
        picked = (mixed >> np.uint64(32)).astype(np.int64) % CODE
        sign = 1.0 - 2.0 * (mixed >> np.uint64(63)).astype(np.float64)
        times = np.bincount(owner + picked, weights=sign, minlength=len(sizes) * CODE).astype(np.float32)
        total = (high @ (times.reshape(-1, 64) @ low).reshape(len(sizes), CODE // 64, 64)).reshape(len(sizes), CODE)
        out.append(total[:, np.random.default_rng([SEED, turn]).permutation(CODE)[:each]] > 0)
    return np.packbits(np.stack(out, axis=2).reshape(len(sizes), -1)[:, :bits], axis=1)


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def _set_prints(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    """``key``, ``t`` (hash of the text), ``s`` (hash of its set of shingles, 0 if empty),
    ``n`` (its size) and ``print`` (its fingerprint) of each row."""
    import xxhash

    def make():
        def handle(batch: pa.RecordBatch):
            data, offsets = texts_of(batch, text)
            for lo, end in slices(offsets, SET_CHUNK):
                for lo in range(lo, end, SET_ROWS):
                    hi = min(lo + SET_ROWS, end)
                    raw, at = data[offsets[lo] : offsets[hi]].tobytes(), (offsets[lo : hi + 1] - offsets[lo]).tolist()
                    sets = [shingle_set(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]
                    n = np.array([len(x) for x in sets], np.int64)
                    name = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                    prints = wide_fingerprints(np.concatenate(sets), n, bits)
                    yield {key: batch.column(0).slice(lo, hi - lo), "t": batch.column(1).slice(lo, hi - lo), "s": name, "n": n, "print": [x.tobytes() for x in prints]}

        return handle

    rows = docs.select(key, F.xxhash64(text).alias("t"), text)
    return map_batches(rows, make, f"{key} {dict(docs.dtypes)[key]}, t bigint, s bigint, n bigint, print binary")


def _keyed(sets: DataFrame, blocks: range, width: int) -> DataFrame:
    """``block`` (its number and its bits), ``s`` and ``seen`` (the bits that are compared) of
    each fingerprint under each of these blocks."""

    def make():
        weights = 1 << np.arange(width, dtype=np.int64)

        def handle(batch: pa.RecordBatch):
            for lo in range(0, batch.num_rows, SET_ROWS):
                part = batch.slice(lo, SET_ROWS)
                data, _ = texts_of(part, "print")
                rows = data.reshape(part.num_rows, -1)
                first = COMPARED + blocks.start * width
                bits = np.unpackbits(rows[:, first // 8 :], axis=1)[:, first % 8 :][:, : len(blocks) * width]
                value = bits.reshape(len(rows), len(blocks), width) @ weights + (np.arange(blocks.start, blocks.stop) << 40)
                seen = pa.array([x.tobytes() for x in rows[:, : COMPARED // 8]], pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), len(blocks))))
                yield {"block": value.reshape(-1), "s": np.repeat(part.column(0).to_numpy(), len(blocks)), "seen": seen}

        return handle

    return map_batches(sets.select("s", "print"), make, "block bigint, s bigint, seen binary")


def stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges ``a``, ``b`` among 0 to n - 1 as one from each that has any to the first of
    its component."""
    to = np.arange(n)
    while True:
        x, y = to[a], to[b]
        if (x == y).all():
            break
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
    moved = np.flatnonzero(to != np.arange(n))
    return moved, to[moved]


def _near_pairs(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges whose components are those of all pairs of at most APART differing bits."""
    if len(seen) > DENSE:
        return near_edges(seen, APART)
    found = []
    step = max(ROWS, 16 * DENSE // len(seen))
    for lo in range(0, len(seen), step):
        a, b = np.nonzero(apart(seen[lo : lo + step], seen[: lo + step]) <= APART)
        found.append((a + lo, b))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a[a > b], b[a > b]


def near_in_block(seen: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """One edge (by places in ``seen``) from each of a block's fingerprints that has a near
    one to the first of its component.  More than DENSE of them are cut by choices of bits,
    which are others for each block, and compared where they agree on one."""
    n = len(seen)
    if n <= DENSE:
        return stars(n, *_near_pairs(seen))
    width = max(1, round(math.log2(n)) - 7)
    bits = np.unpackbits(seen.view(np.uint8).reshape(n, -1), axis=1)
    rng, weights, left, pairs = np.random.default_rng([SEED, block]), 1 << np.arange(width, dtype=np.int64), np.zeros(0, np.int64), []
    for _ in range(choices(width, UNMET)):
        if len(left) < width:
            left = rng.permutation(COMPARED)
        chosen, left = left[:width], left[width:]
        value = bits[:, chosen] @ weights
        order = np.argsort(value, kind="stable")
        ends = np.flatnonzero(np.diff(value[order], append=-1)) + 1
        for lo, hi in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            if hi - lo > 1:
                run = order[lo:hi]
                a, b = _near_pairs(seen[run])
                if len(a):
                    pairs.append((run[a], run[b]))
        if pairs:  # few are held, however many choices find them
            pairs = [stars(n, *(np.concatenate(x) for x in zip(*pairs, strict=True)))]
    return pairs[0] if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _near_in_blocks(batches):
    """Edges whose components are those of the near pairs found within each run of equal
    ``block``: one from a fingerprint to the smallest ``s`` of its component there, so that
    blocks in which a group meets mostly give the same edges."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    at, held, out = None, [], []

    def close():
        if held:
            s, seen = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            order = np.argsort(s, kind="stable")
            a, b = near_in_block(seen[order], int(at) >> 40)
            if len(a):
                out.append((s[order[a]], s[order[b]]))

    def edges():
        a, b = (np.concatenate([x[i] for x in out]) for i in range(2))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    for batch in _then_none(batches):
        if batch is None:
            close()
            break
        block, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        seen = texts_of(batch, "seen")[0].reshape(len(s), -1).view(np.uint64)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(s)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if at != block[lo]:
                close()
                at = block[lo]
            held.append((s[lo:hi], seen[lo:hi]))
        if len(out) > 10_000:
            yield edges()
    if out:
        yield edges()
    release_memory()


def _fewer(edges: DataFrame) -> DataFrame:
    """The edges of ``_near_in_blocks`` as about one for each vertex: of the vertices near to
    one, at most as many as there are blocks, it and all others are linked to the smallest."""
    near = edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("near"))
    from_ = F.concat(F.array("a"), F.slice("near", 2, F.size("near")))
    return near.select(F.explode(from_).alias("a"), F.col("near")[0].alias("b")).distinct()


def candidates(sets: DataFrame, count: int, width: int) -> DataFrame:
    """Edges ``a``, ``b`` between the sets (``s``, ``print``) whose components are those of
    the sets that meet under one of ``count`` blocks of ``width`` bits and are near.  At most
    PASS blocks are sent at a time, so what lies on disk at once does not grow with their
    number."""
    edges, step = None, math.ceil(count / math.ceil(count / PASS))
    for first in range(0, count, step):
        keyed = _keyed(sets, range(first, min(first + step, count)), width)
        met = keyed.repartition("block").sortWithinPartitions("block").mapInArrow(_near_in_blocks, "a bigint, b bigint")
        found = written(_fewer(met))
        edges = found if edges is None else edges.unionByName(found)
        drop_shuffles(sets.sparkSession)
    return edges


def similar_sets(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """One edge (by places in ``sets``) from each set to the first of its component, where
    two sets are linked if their Jaccard similarity is at least ``least`` (a fraction).

    The sets not yet reached stand in an index from hash to owner, made anew each time
    half of them are gone."""
    n, (up, down) = len(sets), least
    size = np.array([len(x) for x in sets], np.int64)
    to = np.full(n, -1)

    def index():
        rest = np.flatnonzero(to < 0)
        owner = np.repeat(rest, size[rest])
        values = np.concatenate([sets[i] for i in rest]) if len(rest) else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        return values[order], owner[order], len(rest)

    values, owner, held = index()
    left = n
    for first in range(n):
        if to[first] >= 0:
            continue
        to[first] = first
        left -= 1
        front = [first]
        while front and left:
            if 2 * left < held:
                values, owner, held = index()
            one = front.pop()
            lo, hi = np.searchsorted(values, sets[one], "left"), np.searchsorted(values, sets[one], "right")
            many = hi - lo
            places = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(owner[places], minlength=n)
            met = np.flatnonzero((down * common >= up * (size[one] + size - common)) & (common > 0) & (to < 0))
            to[met] = first
            left -= len(met)
            front.extend(met.tolist())
    moved = np.flatnonzero(to != np.arange(n))
    return moved, to[moved]


def _verified(batches):
    """Exact links within each run of equal (root, i, j); rows are sorted by these and ``s``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    at, names, sets = None, [], []

    def close():
        if len(sets) > 1:
            a, b = similar_sets(sets)
            s = np.array(names, np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(s[a]), pa.array(s[b])], schema=schema)
        names.clear()
        sets.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = texts_of(batch, "text")
        roots, i, j, s = (batch.column(x).to_pylist() for x in range(4))
        for row, key in enumerate(zip(roots, i, j, strict=True)):
            if key != at:
                yield from close()
                at = key
            if names and names[-1] == s[row]:  # repeated rows
                continue
            names.append(s[row])
            sets.append(shingle_set(data[offsets[row] : offsets[row + 1]].tobytes()))
    yield from close()
    release_memory()


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without all but the row of smallest key of each group of near copies.

    Two texts are linked if their sets of five-word shingles have a Jaccard similarity of
    at least 0.8, and a group is a component of links.  Candidates meet under blocks of a
    wide SimHash fingerprint, are near by it, and are joined to candidate groups; within these
    the similarity is counted exactly, so no link is an estimate.  A group of more than
    ``block`` shingles is cut into blocks and every two blocks are compared, each in its own
    place.

    Of rows with equal key and text one stays; one key with several texts keeps each that
    is no near copy.  Rows with a null key have no name to be grouped by and all stay;
    texts without words are copies of each other.  Columns stay as they are.
    """
    named = docs.where(F.col(key).isNotNull())
    count, width = blocks_for(named.count())
    prints = written(_set_prints(named, key, text, COMPARED + count * width))
    each = written(prints.groupBy("s").agg(F.min(F.struct(F.col(key).alias("k"), "t")).alias("low"), F.first("n").alias("n"), F.first("print").alias("print")))
    roots = components(candidates(each.where("n > 0"), count, width))
    members = each.select("s", "n", "low").join(roots.withColumnRenamed("node", "s"), "s")
    parts = members.groupBy("root").agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("parts"))
    members = written(members.join(parts, "root").select("root", "s", "parts", F.col("low.k").alias("k"), F.col("low.t").alias("t")))
    texts = named.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    texts = maybe_among(texts, members, ["k", "t"], "asked").where("asked").drop("asked").join(members, ["k", "t"])
    mine, other = F.pmod(F.xxhash64("s"), F.col("parts")).cast("int"), F.col("other")
    pairs = texts.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("root", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"), "s", "text")
    found = components(pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "s").mapInArrow(_verified, "a bigint, b bigint"))
    groups = each.select("s", "low").join(found.withColumnRenamed("node", "s"), "s", "left")
    stays = written(groups.groupBy(F.coalesce("root", "s").alias("g")).agg(F.min("low").alias("low")).select("low.k", "low.t"))
    # rows that go, or of which there are several; only these and a few by chance are sent with their texts
    rows = prints.groupBy(F.col(key).alias("k"), "t").agg(F.count(F.lit(1)).alias("times"))
    doubtful = written(rows.join(stays.withColumn("stays", F.lit(True)), ["k", "t"], "left").where("stays is null or times > 1").select("k", "t"))
    k, t = fresh(docs, "_key"), fresh(docs, "_text_hash")
    judged = maybe_among(named.withColumns({k: F.col(key), t: F.xxhash64(text)}), doubtful.toDF(k, t), [k, t], doubt := fresh(docs, "_doubt"))
    kept = judged.where(F.col(doubt)).join(stays.toDF(k, t), [k, t], "left_semi").dropDuplicates([k, t])
    return judged.where(~F.col(doubt)).select(*docs.columns).unionByName(kept.select(*docs.columns)).unionByName(docs.where(F.col(key).isNull()))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, differ: int = BITS) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row.

    Texts without words (null and empty ones too) have fingerprint zero and are linked
    like any other.  Repeated rows each keep theirs; ties need no rule, as a component is
    a set.  An empty table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs, key=key, text=text, widths=(width,)))
    named = classes(prints, key=key, differ=differ)
    return prints.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
