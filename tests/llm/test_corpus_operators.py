"""Phrase mining, the audit of filters and best-fit packing against brute force and SQL."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from webloom.llm import best_fit, filter_audit, packing, phrases, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def texts(seed, n=160):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(12)]
    out = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, " \n\t ", "de", None, None), (4, "New York. new york!NEW york", "en", "s", 3), (4, "New York. new york!NEW york", "en", "s", 3), (None, "a b a b a b", None, "s", 1), (None, "a b a b a b", None, "s", 1)]
    out += [(5, "É日本 x y 日本 x " * 40, "und", "s", 1), (6, "a a a a a a\ta  a", "en", "s", 1), (7, "b" * 3000 + " " + "A B, C" * 500, "fr", "s", 1), (8, "$ " + "Same text " * 60, "en", "s", 1)]
    for i in range(20, 20 + n):
        words = [rng.choice(common) if rng.random() < 0.7 else "new york city" if rng.random() < 0.4 else f"r{rng.randrange(4000)}" for _ in range(rng.randrange(1, 250))]
        out.append((i, "".join(w + rng.choice([" "] * 8 + [", ", ".\n", "  "]) for w in words), rng.choice(["en", "de", None]), "s", 1))
    copied = out[30][1]
    out += [(i, copied, rng.choice(["en", "de"]), "s", 1) for i in range(1000, 1100)]
    return out


@pytest.fixture(scope="module")
def rows():
    return texts(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit("x") for c in ("word", "phrase", "f", "k", "mask", "digest", "rank", "task", "piece", "length", "piece_key", "n")})


def plain_phrases(rows, least, longest, top):
    found, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                found[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in found.items():
        cands = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in cands.items():
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            if not any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in cands.items()):
                kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for i, (score, a, g, l, r) in enumerate(sorted(kept)[:top]):
            out.append((lang, i + 1, g.decode(), -a, l, r, n[lang], -score))
    return Counter(out)


@pytest.mark.parametrize("sizes", [{}, {"slots": 4, "split": 3, "chunk": 2000, "run": 20}, {"slots": 1, "split": 50, "chunk": 1 << 20, "run": 7}])
def test_collocations(docs, rows, sizes):
    got = Counter(tuple(r) for r in phrases.collocations(docs, least=8, top=40, **sizes).collect())
    assert got == plain_phrases(rows, 8, 4, 40)
    assert max(r[1] for r in got) == 40


def test_collocations_of_five_words_and_of_nothing(docs, rows):
    got = Counter(tuple(r) for r in phrases.collocations(docs, least=5, longest=5, top=3000).collect())
    assert got == plain_phrases(rows, 5, 5, 3000)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("doc_id < 4")).count() == 0


def test_words_of_one_hash_are_told_apart(monkeypatch):
    data = np.frombuffer(b"aa bb aa,cc", np.uint8)
    monkeypatch.setattr(phrases, "run_hashes", lambda data, starts, lengths: np.zeros(len(starts), np.uint64))
    c = phrases.Chunk(data, np.array([0, len(data)]), ["en"])
    assert c.words(c.which).to_pylist() == ["aa", "bb", "aa", "cc"] and len(c.first) == 3
    found, times, order = phrases.fragments(c, np.array([5, 5, 5]), 1, 4)
    names = ["", *c.words(order).to_pylist()]
    assert Counter({tuple(names[x] for x in col): n for col, n in zip(found.T, times, strict=True)}) == Counter({("aa", "", "", "", "bb", "aa", ""): 1, ("aa", "bb", "", "", "", "", ""): 1})


def test_scores_beyond_64_bits(spark):
    a, l, r = 9_000_000_000_000, 9_000_000_000_001, 9_500_000_000_003
    counts = spark.createDataFrame([("en", "x y", 2, a), ("en", "x y z", 3, 7_200_000_000_000), ("en", "p q", 2, 9_000_000_000_000), ("en", "p q r", 3, 7_199_999_999_999)], "lang string, phrase string, size int, f bigint")
    words = spark.createDataFrame([("en", w, n) for w, n in (("x", l), ("y", r), ("z", r), ("p", l), ("q", l), ("r", r))], "lang string, word string, f bigint")
    got = {x.phrase: x for x in phrases.scored(counts, words).collect()}
    assert (got["x y"].score, got["x y"].l, got["x y"].r) == (2_000_000 * a // (l + r), l, r)
    assert {x.phrase for x in phrases.not_inside(counts).collect()} == {"x y z", "p q", "p q r"}  # 80 % is inside, less is not


def test_queries_equal_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for m in (phrases, filter_audit):
        df = m.query(spark, d)
        cols = ", ".join(df.columns)
        assert Counter(tuple(r) for r in df.collect()) == Counter(con.sql(f"select {cols} from ({m.ORACLE_SQL})").fetchall())


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        upper = sum("A" <= c <= "Z" for c in text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * upper > 10 * len(text), "D": bool(set(text) & set("#$%&*|")), "E": i is not None and i > least[text]}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        here, table, shapley = [d for d in docs if d[0] == part], [], Counter()
        for order in itertools.permutations("ABCDE"):
            left, gone = here, []
            for step, f in enumerate(order):
                lost = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left, gone = [d for d in left if f not in d[1]], gone + lost
                shapley[f] += len(lost)
                table.append((part, "".join(order), step + 1, len(left), len(lost), redundant, sum(d[1] == {f} for d in here), sum(d[2] for d in lost), sum(d[3] for d in lost)))
        out += [(*t, shapley[t[1][t[2] - 1]]) for t in table]
    return Counter(out)


def test_audit(spark, docs, rows):
    rng = random.Random(1)
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 400, 3)] + [(4, 1, None), (4, 0, 1), (8, None, None), (None, 1, 1), (1001, 1, 0), (1001, 0, 1), (9999, 1, 1)]
    table = spark.createDataFrame(labels, LABELS).withColumns({"text": F.lit("x"), "k": F.lit(1), "n": F.lit(2)})
    got = Counter(tuple(r) for r in filter_audit.audit(docs, table).collect())
    assert got == plain_audit(rows, labels)
    assert len(filter_audit.lattice()) == 80 and len(filter_audit.steps()) == 600
    assert filter_audit.audit(docs.limit(0), table).count() == 0
    assert sum(filter_audit.audit(docs, table.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()) == 0


def laid_out(found):
    """Sequences of (offset, length) rows are gapless; their number."""
    by = defaultdict(list)
    for s, o, n in found:
        by[s].append((o, n))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
    return by


def best_fit_decreasing(sizes, length):
    bins = []
    for n in sorted(sizes, reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(length - n)
    return len(bins)


def placed(sizes, length):
    counts = Counter(sizes)
    runs = best_fit.plan(counts, length)
    every = [(n, r) for n, c in counts.items() for r in range(c)]
    size, rank = np.array(every).T
    seq, off = best_fit.place(runs, size, rank)
    by = laid_out(zip(seq.tolist(), off.tolist(), size.tolist(), strict=True))
    assert all(sum(n for _, n in v) <= length for v in by.values()) and sum(map(len, by.values())) == len(sizes)
    return by


def test_plans():
    assert len(best_fit.plan({})) == 0
    assert len(placed([16], 16)) == 1 and len(placed([9] * 50, 16)) == 50 and len(placed([1] * 1000, 16)) == 63
    # exact complements: alone, of two and of three
    assert len(placed([11, 5, 9, 4, 3, 8, 5, 2, 1] * 7, 16)) == 21
    rng = random.Random(2)
    more = 0
    for _ in range(300):
        length = rng.choice([8, 16, 31])
        sizes = [rng.randint(1, length) for _ in range(rng.randrange(1, 40))]
        more += len(placed(sizes, length)) - best_fit_decreasing(sizes, length)
        assert len(placed(sizes, length)) <= best_fit_decreasing(sizes, length) + 1
    assert more <= 6  # few, by one
    sizes = [min(4096, max(1, int(math.exp(rng.gauss(6, 1))))) for _ in range(20000)]
    assert len(placed(sizes, 4096)) <= math.ceil(sum(sizes) / 4096) + 1


def test_best_fit(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = best_fit.pack(docs, packing.definition(), length=512, ids=True).collect()
    want, found = Counter(), defaultdict(list)
    for i, x, *_ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for p in range(-(-len(ids) // 512)):
            want[i, p, 512 * p, tuple(ids[512 * p : 512 * p + 512])] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    by = laid_out((r.sequence_id, r.offset, r.length) for r in got)
    assert max(sum(n for _, n in v) for v in by.values()) <= 512
    sizes = [r.length for r in got]
    assert len(by) <= best_fit_decreasing(sizes, 512)
    # what a task packs is what the plan says
    assert Counter(tuple(sorted(n for _, n in v)) for v in by.values()) == Counter(tuple(sorted(n for _, n in v)) for v in placed(sizes, 512).values())
    assert best_fit.pack(docs.limit(0), packing.definition()).count() == 0
    named = docs.drop("task").withColumnRenamed("doc_id", "task").withColumn("task", F.col("task").cast("string"))
    assert best_fit.pack(named, packing.definition(), key="task", length=512).count() == len(got)


def plain_cost_balance(sizes, length):
    """Each document, longest first, goes to the sequence of least cost with room, and on."""
    total = sum(sizes)
    room = [length] * (total // length) + [1 << b for b in reversed(range(length.bit_length())) if (total % length) >> b & 1]
    used, cost, out = [0] * len(room), [0.0] * len(room), []
    for d in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        start = 0
        while start < sizes[d]:
            s = min((i for i in range(len(room)) if used[i] < room[i]), key=lambda i: (cost[i], i))
            n = min(sizes[d] - start, room[s] - used[s])
            out.append((d, start, n, s, used[s]))
            cost[s] += n * packing.LINEAR + n * n * packing.QUADRATIC
            used[s] += n
            start += n
    return out, len(room)


def test_cost_balanced_assignment_equals_a_plain_one(spark):
    """Window by window, over one task's documents in their order."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["new", "york", "a", "zebra"]) for _ in range(int(rng.expovariate(1 / 90))))) for i in range(150)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), packing.definition(), length=128, window=3000).collect()
    sizes = [len(t.encode(x, add_special_tokens=False).ids) + 1 for _, x in rows]
    want, held, base = set(), [], 0
    for i in range(len(rows) + 1):
        if i == len(rows) or (held and sum(sizes[j] for j in held) + sizes[i] > 3000):
            pieces, n = plain_cost_balance([sizes[j] for j in held], 128)
            want |= {(held[d], start, length, base + s, offset) for d, start, length, s, offset in pieces}
            base, held = base + n, []
        held.append(i)
    assert {(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got} == want and len(got) == len(want)


def plain_buckets(text, sizes=toxicity.SIZES, bits=18):
    """The buckets of a text's n-grams, one n-gram at a time."""
    mask, mult = (1 << 64) - 1, int(toxicity.MULT)
    points, out = [ord(c) for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in text)], set()
    for n in sizes:
        for i in range(len(points) - n + 1):
            h = points[i]
            for p in points[i + 1 : i + n]:
                h = (h * mult + p) & mask
                h ^= h >> 29
            out.add(((h * mult) & mask) >> (64 - bits))
    return out


def test_toxicity_equals_a_plain_fit(spark):
    """Log-count ratios of distinct n-grams, and a logistic fit of the features that they
    scale, against loops over dictionaries."""
    rng = random.Random(12)
    words = ["sun", "rain", "cloud", "Wind", "storm", "été", "snow"]
    rows = []
    for i in range(330):
        said = [rng.choice(words) for _ in range(rng.randint(3, 12))] + (["you moron"] if i % 3 == 0 else [])
        rows.append((i, " ".join(rng.sample(said, len(said))), int(i % 3 == 0)))
    model = toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int"))
    sets = [(plain_buckets(x), y) for _, x, y in rows]
    found = {y: Counter(b for s, z in sets if z == y for b in s) for y in (0, 1)}
    total = {y: sum(found[y].values()) + toxicity.BUCKETS for y in (0, 1)}  # each count smoothed by one
    ratio = {}
    for b in found[0] | found[1]:
        p, q = found[1][b] + 1, found[0][b] + 1
        r = math.log((p / total[1]) / (q / total[0]))
        if abs(r) >= 4 * math.sqrt(1 / p + 1 / q):
            ratio[b] = r
    assert ratio and set(np.flatnonzero(model.weights).tolist()) == set(ratio)
    docs = [(sorted(s & set(ratio)), y) for s, y in sets]
    prior = sum(y for _, y in docs) / len(docs)
    w, bias = dict.fromkeys(ratio, 0.0), math.log(prior / (1 - prior))
    first, second = dict.fromkeys([*ratio, None], 0.0), dict.fromkeys([*ratio, None], 0.0)
    for t in range(1, 81):
        grad = {b: 1e-4 * w[b] for b in w} | {None: 0.0}
        for s, y in docs:
            err = (1 / (1 + math.exp(-(bias + sum(w[b] * ratio[b] for b in s)))) - y) / len(docs)
            grad[None] += err
            for b in s:
                grad[b] += err * ratio[b]
        for b, g in grad.items():
            first[b], second[b] = 0.9 * first[b] + 0.1 * g, 0.99 * second[b] + 0.01 * g * g
            move = 0.05 / (1 + t / 40) * (first[b] / (1 - 0.9**t)) / (math.sqrt(second[b] / (1 - 0.99**t)) + 1e-8)
            if b is None:
                bias -= move
            else:
                w[b] -= move
    assert model.bias == pytest.approx(bias, abs=1e-6)
    assert {b: float(model.weights[b]) for b in ratio} == {b: pytest.approx(w[b] * ratio[b], abs=1e-5) for b in ratio}
    text = "you MORON of the storm"
    odds = bias + sum(w[b] * ratio[b] for b in plain_buckets(text) & set(ratio))
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id int, text string"), model).collect()[0]
    assert got.score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-5)
