"""The training-data operators against brute force, round trips and held-out accuracy,
and on null, empty, repeated and clashing rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from webloom.llm import ann, byte_bpe, common, exact_substrings, language, packing, pii, quality, simhash, toxicity, url_filter
from webloom.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and to in that is was for on with as it by at from his her they this have or one had not but what all were when we there can an your which".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ","]) for _ in range(n))


def odd_rows(rng):
    long = sentence(rng, 4000)
    return [
        (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, None, None), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (None, "no id at all here", "en", "s", 1),
        (6, long, "en", "s", 1), (7, long, "en", "s", 1), (8, "É日本 😀 x@y.example.com +1 (555) 010-2030 10.0.0.255 4111 1111 1111 1111", "de", "s", 1), (9, "a" * 5000, "fr", "s", 1), (10, "Don't \x1c stop 1234 <|endoftext|>", "es", "s", 1),
    ]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = odd_rows(rng)
    for i in range(20, 120):
        out.append((i, "\n".join(sentence(rng, rng.randint(3, 60)) for _ in range(rng.randint(1, 6))), rng.choice(["en", "de"]), "s", 1))
    for i in range(120, 140):  # near copies
        words = out[rng.randint(20, 60)][1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "en", "s", 1))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns, some with names that operators use themselves
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({"score": F.lit(1), "fp": F.lit("x"), "r1": F.lit(0), "value": F.lit(None).cast("int")})


def by_id(df):
    return [r.asDict() for r in df.collect()]


def test_url_filter(spark):
    rows = [(1, "http://A.Example.ORG/en/12?x"), (2, None), (3, "no scheme"), (4, "ftp://x.com/de/1"), (5, "http://com/fr/"), (6, "http://org"), (6, "http://org"), (7, "https://example.org/es/#t"), (None, "http://x.com/fr/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("rule", F.lit("mine"))
    got = Counter(tuple(r) for r in url_filter.judge(pages, url_filter.rules_frame(spark)).collect())
    want = Counter([
        (1, "a.example.org", "/en/12", "example.org/en/1", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "x.com", "/de/1", "com/de/", "block"), (5, "com", "/fr/", "com/fr/", "allow"),
        (6, "org", "", None, "allow"), (6, "org", "", None, "allow"), (7, "example.org", "/es/", "example.org/es/", "block"), (None, "x.com", "/fr/", "com/fr/", "allow"),
    ])
    assert got == want
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark)).count() == 0


def test_url_filter_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view pages as select * from '{d}/pages.parquet'")
    want = Counter(duckdb.sql(f"select page_id, host, path, rule, verdict from ({url_filter.ORACLE_SQL})").fetchall())
    assert Counter(tuple(r) for r in url_filter.query(spark, d).collect()) == want


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(packing.pack(docs.select("doc_id", "text"), packing.definition(), ids=True))
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x, *_ in rows)
    pieces, seqs = {}, {}
    for p in got:
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] and len(p["ids"]) == p["length"] > 0
        pieces.setdefault(p["doc_id"], []).append(p)
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    found = Counter()
    for i, ps in pieces.items():
        copies = Counter(k for k, _ in want.elements())[i]
        if copies == 1:
            ps.sort(key=lambda p: p["start"])
            found[i, tuple(x for p in ps for x in p["ids"])] += 1
            assert sum(p["length"] for p in ps) == ps[0]["doc_tokens"]
    assert found == Counter({k: v for k, v in want.items() if k[0] in {i for i, _ in found}})
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0  # no padding
    assert sum(p["length"] for p in got) == sum(len(k[1]) * v for k, v in want.items())
    assert packing.pack(docs.limit(0), packing.definition()).count() == 0


def test_bpe_round_trip(spark, docs, rows):
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, emit=("ids", "n_tokens", "ids_sha256", "decoded"))
    got = Counter((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["ids_sha256"], bytes(r["decoded"])) for r in by_id(df))
    want = Counter()
    for i, x, *_ in rows:
        ids = enc.encode_ordinary(x or "")
        want[i, tuple(ids), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), (x or "").encode()] += 1
    assert got == want
    back = byte_bpe.decode(spark.createDataFrame([(1, [0, 1]), (2, None)], "doc_id int, ids array<int>"), ranks).collect()
    assert bytes(back[1].decoded) == b""  # null ids decode to nothing


def brute_simhash(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, rows):
    fps = [(i, brute_simhash(x)) for i, x, *_ in rows]
    parent = {f: f for _, f in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in list(parent):
        for b in list(parent):
            if (a ^ b).bit_count() <= 3:
                parent[top(a)] = top(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[top(f)] = min(least.get(top(f), 10**9), i)
    want = Counter((i, f"{f:016x}", least.get(top(f))) for i, f in fps)
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_crowded_meetings_lose_no_link(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) & ~0xFFFFF | rng.getrandbits(20) for _ in range(3)}
    base = next(iter(values))
    values |= {base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 12))) for _ in range(150)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v, v, 0) for v in signed], "node bigint, fp bigint, other bigint")
    got = components(simhash.links(df, len(signed), most=16)).collect()
    parent = {v: v for v in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    want = {v: top(v) for v in signed}
    lonely = {v for v in signed if Counter(want.values())[want[v]] == 1}
    assert {r.node: r.root for r in got} == {v: r for v, r in want.items() if v not in lonely}


def test_crowded_equal_fingerprints_lose_no_link(spark):
    # many nodes of one fingerprint, and a full cube of few free bits
    same = [(i, 12345) for i in range(40)]
    cube = [(100 + i, 0x5A5A5A5A5A00 | i) for i in range(8)]
    df = spark.createDataFrame(same + cube, "node bigint, fp bigint").withColumn("other", F.lit(0).cast("bigint"))
    got = {r.node: r.root for r in components(simhash.links(df, len(same + cube), most=4)).collect()}
    fps = dict(same + cube)
    parent = {v: v for v in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 3:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    assert {v: got.get(v, v) for v in fps} == {v: top(v) for v in fps}


def test_one_of_each(spark, docs, rows):
    kept = {r["doc_id"] for r in by_id(simhash.one_of_each(docs))}
    assert {6} <= kept and 7 not in kept and None in kept
    assert len(kept & {1, 2, 3}) == 1  # no words: copies of each other
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns


def test_one_of_each_keeps_texts_that_share_a_key(spark):
    rng = random.Random(23)
    one, two = sentence(rng, 80), sentence(rng, 80)
    df = spark.createDataFrame([(1, one), (1, two), (1, one), (2, two)], "doc_id bigint, text string")
    assert Counter(tuple(r) for r in simhash.one_of_each(df).collect()) == Counter([(1, one), (1, two)])


def test_one_of_each_links_by_exact_similarity(spark):
    rng = random.Random(17)
    texts = []
    for _ in range(60):
        words = [f"{rng.choice(WORDS)}{rng.randrange(40)}" for _ in range(rng.randint(40, 160))]
        texts.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for _ in range(rng.randint(1, 8)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(1000)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x.split() for x in texts)]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    want = {i for i in range(len(texts)) if top(i) == i}
    assert 20 < len(pairs) and len(want) > 80
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == want
    assert {r.doc_id for r in simhash.one_of_each(df, block=100).collect()} == want


def test_wide_fingerprints_are_majorities():
    rng = np.random.default_rng(29)
    sizes = np.array([1, 4, 5, 60, 0, 300])
    hashes = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    got = np.unpackbits(simhash.wide_fingerprints(hashes, sizes, 460), axis=1)[:, :460]
    votes = np.unpackbits(simhash.wide_fingerprints(hashes, np.ones(len(hashes), np.int64), 460), axis=1)[:, :460]
    ends = np.cumsum(sizes)
    for bits, lo, hi in zip(got, ends - sizes, ends, strict=True):
        assert (bits == (2 * votes[lo:hi].sum(axis=0, dtype=np.int64) > hi - lo)).all()


def test_candidates_meet_by_simhash(spark):
    """Near copies are found by their fingerprints; of the 9,710
    other pairs, which share a third of a template, hardly any are near."""
    rng = random.Random(31)
    template = [f"t{i}" for i in range(50)]
    texts = [" ".join(template + [f"w{rng.randrange(10**9)}" for _ in range(100)]) for _ in range(120)]
    texts += [x + " and more" for x in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    count, width = simhash.blocks_for(len(texts))
    prints = common.written(simhash._set_prints(df, "doc_id", "text", simhash.COMPARED + count * width))
    names = {r.s: r.doc_id for r in prints.select("s", "doc_id").collect()}
    edges = {frozenset((names[r.a], names[r.b])) for r in simhash.candidates(prints, count, width).collect()}
    assert {frozenset((i, 120 + i)) for i in range(20)} <= edges and len(edges) < 40


def test_large_groups_give_few_edges_a_text(spark):
    """A group's texts meet under most blocks; the edges do not grow with blocks or pairs."""
    rng = random.Random(37)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(400):
        copy = list(words)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    count, width = simhash.blocks_for(50_000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    prints = common.written(simhash._set_prints(df, "doc_id", "text", simhash.COMPARED + count * width))
    edges = common.written(simhash.candidates(prints, count, width))
    assert 399 <= edges.count() <= 3 * 400  # in two passes
    roots = [r.root for r in components(edges).collect()]
    assert len(roots) == 400 and len(set(roots)) == 1


def test_blocks_sent_do_not_grow_with_the_table():
    (small, _), (large, _) = simhash.blocks_for(50_000), simhash.blocks_for(14_000_000)
    assert small == large <= 60
    assert simhash.blocks_for(1 << 28)[1] == 12


def test_large_blocks_are_cut_and_find_near_pairs():
    rng = np.random.default_rng(41)
    n, k = 3000, 600
    seen = rng.integers(0, 2**64, (n, 4), dtype=np.uint64)
    seen[-k:] = seen[:k] ^ np.packbits(rng.random((k, simhash.COMPARED)) < 0.1, axis=1).view(np.uint64)
    assert n > simhash.DENSE
    far = simhash.apart(seen, seen)
    want = {(int(x), int(y)) for x, y in zip(*np.nonzero(far <= simhash.APART), strict=True) if x > y}
    assert want == {(n - k + i, i) for i in range(k)}
    a, b = simhash.near_in_block(seen, 7)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    hot = seen[:1] ^ np.packbits(rng.random((n, simhash.COMPARED)) < 0.05, axis=1).view(np.uint64)
    a, b = simhash.near_in_block(hot, 7)
    assert a.tolist() == list(range(1, n)) and not b.any()


def test_maybe_among_misses_nothing(spark):
    many = spark.createDataFrame([(i % 500 if i % 7 else None, i % 3, i) for i in range(3000)], "k bigint, t bigint, _row bigint")
    few = spark.createDataFrame([(i, 1) for i in range(0, 100)] + [(None, 2)], "k bigint, t bigint")
    got = common.maybe_among(many, few, ["k", "t"], "asked").collect()
    assert len(got) == 3000
    among = {(r.k, r.t) for r in few.collect()}
    assert all(r.asked for r in got if (r.k, r.t) in among)
    assert sum(r.asked for r in got if (r.k, r.t) not in among) < 30
    assert not any(r.asked for r in common.maybe_among(many, few.limit(0), ["k", "t"], "asked").collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_components_delete_their_tables(spark):
    """Only the last round's edges stay, and with ``scratch`` not even these."""
    there = Path(common.shared_dir(spark).removeprefix("file:"))
    files = lambda: {p for p in there.rglob("*.parquet") if p.is_file()}
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    before = files()
    assert components(edges).count() == 61 and len({p.parent for p in files() - before}) == 1
    before = files()
    with common.scratch(spark):
        assert components(edges).count() == 61
    assert files() == before


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, rx in BASE.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    "a@b.c_d@e.f a@b a..b@c-d.example.", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.002.003.004", "4111-1111-1111-1111 4111 1111 1111 1112 41111111111111111111111", "+1 (555) 010-2030) +1 +12345678 - +123 45 67 8", "é +49 30 901820 日本 x@y.zz", "@a.b x@.b %@a.b",
    "card 378282246310005 tel (555) 010-2030 me [at] site [dot] org 1:2:3:4:5:6:7:8",
]


def test_pii(spark, docs, rows):
    more = [(1000 + i, t, "en", "s", 1) for i, t in enumerate(TRICKY)] + [(2000, " ".join(f"u{i}@h{i}.example.com {i}" for i in range(700)), "en", "s", 1)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, DOCS).select("doc_id", "text"))
    got = Counter()
    for r in by_id(pii.detect(df)):
        spans = r["spans"].split(",") if r["spans"] else []
        got[r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] += 1
        text = next(x for i, x, *_ in rows + more if i == r["doc_id"])
        assert set(brute_pii(text)) <= set(spans)
    want = Counter()
    for i, x, *_ in rows + more:
        b = brute_pii(x)
        want[i, hashlib.sha256(",".join(b).encode()).hexdigest(), *(sum(s.startswith(k) for s in b) for k in BASE)] += 1
    assert got == want


def test_redact(spark):
    df = spark.createDataFrame([(1, "é a@b.example x +1 555 010 2030!"), (2, None), (3, ""), (4, "4111111111111111")], "doc_id int, text string")
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {1: "é [email] x [phone]!", 2: None, 3: "", 4: "[card]"}


def plain_mask(text, spans):
    """Spans (kind, start, end) masked by hand: the first, then the longest, names a merged run."""
    runs = []
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if runs and s < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            best = max((x for x in spans if x[1] == s), key=lambda x: (x[2], [-ord(c) for c in x[0]]))
            runs.append([s, e, best[0]])
    out, at = [], 0
    for s, e, k in runs:
        out.append(text[at:s] + f"[{k}]")
        at = e
    return "".join(out) + text[at:]


def test_redact_masks_what_is_detected(spark, rows):
    """Also in texts of thousands of spans, of overlapping ones, and far into a long text."""
    rng = random.Random(21)
    bits = ["+1 555 010 2030", "a@b.example", "10.0.0.1", "4111 1111 1111 1111", "é", "😀", "+4111111111111111", "x", "jane [at] example [dot] com", "1.2.3.4.5", "(555) 123-4567", "word " * 300]
    texts = [" ".join(f"u{i}@h{i}.example.com {i}" for i in range(16_000)), "+1 (555) 010-2030, " * 3000, sentence(rng, 300_000) + " z@z.example"]
    texts += ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(60)] + TRICKY + [x for _, x, *_ in rows if x]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {r.doc_id: r.spans for r in pii.detect(df).collect()}
    for r in pii.redact(df).collect():
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in found[r.doc_id].split(",") if x)]
        assert r.text == plain_mask(texts[r.doc_id], spans), r.doc_id


def test_added_spans(spark):
    """Addresses that only the broad pattern finds are added where cue and context speak for
    them, whether or not the text holds another '[at]'; what stands alone nowhere is not."""
    rng = random.Random(3)
    rows = [(i, sentence(rng, 20) + f" contact: u{i}@example.com or write to k{i} [at] example [dot] com. " + sentence(rng, 9)) for i in range(40)]
    rows += [(100 + i, sentence(rng, 20) + f" mail v{i} @ example.org, " + sentence(rng, 9)) for i in range(20)]
    rows += [(200 + i, f"x{i}(at)y(dot)zz" + sentence(rng, 9)) for i in range(200)]
    got = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.detect(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    said = {i: [text[int(s) : int(e)] for _, s, e in got[i]] for i, text in rows}
    assert all(said[i] == [f"u{i}@example.com", f"k{i} [at] example [dot] com"] for i in range(40))
    assert all(said[100 + i] == [f"v{i} @ example.org"] for i in range(20))


def test_reliabilities_equal_a_plain_em():
    """EM over counted vote patterns against EM over every single span."""
    rng = np.random.default_rng(4)
    truth = rng.random(400) < 0.4
    fires = {v: (rng.uniform(0.6, 0.95), rng.uniform(0.05, 0.4)) for v in pii.VOTES}
    votes = np.array([[rng.random() < fires[v][0 if t else 1] for v in pii.VOTES] for t in truth])
    kinds, count = np.unique(votes, axis=0, return_counts=True)
    got, rates, prior = pii.reliabilities([(dict(zip(pii.VOTES, map(int, k), strict=True)), int(n)) for k, n in zip(kinds, count, strict=True)])
    yes, no, share = np.full(5, 0.8), np.full(5, 0.3), 0.5
    for _ in range(100):
        a = np.log(share) + np.where(votes, np.log(yes), np.log(1 - yes)).sum(axis=1)
        b = np.log(1 - share) + np.where(votes, np.log(no), np.log(1 - no)).sum(axis=1)
        p = 1 / (1 + np.exp(b - a))
        share = p.mean()
        one, two = (1 + p @ votes) / (2 + p.sum()), (1 + (1 - p) @ votes) / (2 + (1 - p).sum())
        yes, no = np.maximum(one, two), np.minimum(one, two)
    assert abs(prior - share) < 1e-9 and all(abs(rates[v][0] - y) < 1e-9 and abs(rates[v][1] - n) < 1e-9 for v, y, n in zip(pii.VOTES, yes, no, strict=True))
    assert ((p > 0.5) == truth).mean() > 0.85


def test_ann(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:160] = x[7]  # many copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None] * 8), (0, x[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.search(table, table.where("vec_id % 20 = 0"), shard=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 900, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in mine)
        hits += len(set(order) & {v for _, v, _ in mine})
        total += 10
    assert set(got) == set(range(0, 900, 20)) and hits / total >= 0.95
    few = ann.search(table.where("vec_id < 3"), table.where("vec_id = 0")).collect()
    assert len(few) == 2 and ann.search(table.limit(0), table.limit(0)).count() == 0


def test_ann_widths_and_ties(spark):
    """Vectors of the queries' usual length take part, whatever rows come first; at equal
    distances the smaller id is nearer, distinct vectors included."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(25)] + [(100 + i, rng.normal(size=8).tolist()) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = ann.search(table, table.where("vec_id % 10 = 0")).collect()
    assert {r.query_id for r in got} == set(range(100, 160, 10)) and all(r.vec_id >= 100 for r in got) and len(got) == 60
    # forty vectors at distance 1 from the query, in all directions
    axes = np.concatenate((np.eye(20), -np.eye(20)))[np.random.default_rng(3).permutation(40)]
    ring = [(0, [5.0] * 20)] + [(i + 1, (np.full(20, 5.0) + a).tolist()) for i, a in enumerate(axes)]
    table = spark.createDataFrame(ring[::-1], "vec_id bigint, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in ann.search(table, table.where("vec_id = 0"), beam=40).collect())
    assert got == [(i, i) for i in range(1, 11)]


@pytest.mark.parametrize(("offset", "scale"), [(0, 1), (3000, 1), (1e4, 1), (1e6, 1), (0, 1e-20), (0, 1e20), (0, 1e160), (0, 1e-160), (1e4, 1e155)])
def test_ann_far_from_the_origin(spark, offset, scale):
    """Neither a common offset nor a scale changes what is near; nor do a few vectors that are
    far from all others."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 12))
    x[:5] *= 1e12
    x[700:] += 1e5  # a second cluster
    v = (x + offset) * scale
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(table, table.where("vec_id % 20 = 0"), shard=800, beam=48).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        d = np.sqrt((((v - v[q]) / scale) ** 2).sum(axis=1))
        d[q] = np.inf
        assert all(abs(s / scale - d[i]) <= 1e-9 * d[i] for i, s in got[q])
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {i for i, _ in got[q]})
    assert hits / 750 >= 0.95


def test_shards_are_sized_by_bytes():
    assert ann.shard_rows(64) == ann.SHARD and ann.shard_rows(768) * 8 * 2 * 768 < ann.SHARD_BYTES and ann.block_of(768) < ann.BLOCK == ann.block_of(64)


def test_ann_reads_a_small_part_of_a_shard():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(6000, 12)).astype(np.float32)
    graph = ann.build(points)
    queries = points[:200] + 0.01
    found, _, taken = ann.beam_search(points, *graph, queries, 32)
    near = np.argsort(((points[None] - queries[:, None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found[:, :10].tolist(), near.tolist(), strict=True)]) > 0.95
    assert taken.mean() < 0.15 * len(points)


def brute_windows(texts, n=200):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        marked = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                marked[i : i + n] = b"\1" * n
        kept = bytes(c for c, m in zip(t, marked, strict=True) if not m)
        out.append((len(t), sum(marked), len(re.findall(rb"\x01+", bytes(marked))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_suffix_dedup(spark, most):
    rng = random.Random(11)
    passage = sentence(rng, 80)
    rows = [(i, x) for i, x, *_ in odd_rows(rng)]
    for i in range(100, 140):
        text = sentence(rng, rng.randint(1, 150))
        rows.append((i, text[: rng.randint(0, 300)] + (passage[rng.randint(0, 60) :] if i % 3 == 0 else "é") + text[200:]))
    rows += [(200, "ab" * 400), (201, "x" * 199), (202, "x" * 200), (203, "x" * 202), (204, passage[:250] + passage[:250])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("lo", F.lit(1))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in by_id(exact_substrings.remove_repeats(df, most=most)))
    assert got == Counter((i, *w) for (i, _), w in zip(rows, brute_windows([(t or "").encode() for _, t in rows]), strict=True))
    assert exact_substrings.remove_repeats(df.limit(0)).count() == 0


def test_crowded_buckets_are_counted():
    """The digests by which crowded buckets are counted find what sorting finds."""
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1500:2100] = data[300:900]
    starts = np.arange(3000 - 199)
    names = [tuple(x) for x in exact_substrings.digests(data, starts, starts + 200).tolist()]
    count = Counter(names)
    marked = exact_substrings.repeated_in(data, np.array([3000]))
    assert [count[x] > 1 for x in names] == marked.tolist()


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_quality(spark, docs, rows):
    got = Counter()
    for r in by_id(quality.filter_quality(docs)):
        counts = tuple(r[c] for c in quality.COUNTS)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        got[r["doc_id"], *counts] += 1
    assert got == Counter((i, *brute_quality(x)) for i, x, *_ in rows)
    assert quality.filter_quality(docs.limit(0)).count() == 0


def brute_log_perplexities(rows):
    """Plain modified Kneser-Ney over word bigrams: (text, language) -> log-perplexity.
    Words found once are known by their length only; a text's own bigrams do not count."""
    from math import log

    lower = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
    split = lambda x: [lower(w) for w in re.findall(r"[^\x20\x09-\x0D]+", x or "")]
    found = Counter((g or "und", w) for _, x, g, *_ in rows for w in split(x))
    length = lambda w: min((len(w.encode()) - 1) // 2, 7)
    types = Counter((g, length(w)) for (g, w), n in found.items() if n == 1)
    name = lambda g, w: w if found[g, w] > 1 else length(w)
    said = [(g or "und", split(x)) for _, x, g, *_ in rows]
    pairs = [Counter(zip([None] + [name(g, w) for w in x], [name(g, w) for w in x], strict=False)) for g, x in said]
    count = Counter()
    for (g, _), c in zip(said, pairs, strict=True):
        count.update({(g, *k): n for k, n in c.items()})
    total, kinds, second, number = Counter(), Counter(), Counter(), Counter()
    for (g, v, w), n in count.items():
        total[g, v] += n
        kinds[g, v, min(n, 3)] += 1
        second[g, w] += 1
        second[g] += 1
        number[g, n] += 1
    off = {}
    for g in {g for g, _ in said}:
        n = [number[g, i] for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        off[g] = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i * 0.5, 0.05), i - 0.05) for i in (1, 2, 3)]
    out = []
    for (g, x), own in zip(said, pairs, strict=True):
        value = 0.0
        for (v, w), n in own.items():
            c = count[g, v, w] - n
            gap = sum(off[g][i] * kinds[g, v, i] for i in (1, 2, 3)) / total[g, v]
            p = (c - off[g][min(c, 3)]) / total[g, v] + gap * second[g, w] / second[g]
            value += n * (log(p) - (log(types[g, w]) if isinstance(w, int) else 0.0))
        out.append(-value / len(x) if x else None)
    return out


def brute_kept(rows, low=quality.WIDTH_LOW, high=quality.WIDTH_HIGH):
    values = brute_log_perplexities(rows)
    ok = [r[0] >= 50 and 100 * r[4] <= 50 * r[0] for r in (brute_quality(x) for _, x, *_ in rows)]
    out = []
    for (_, x, g, *_), value, good in zip(rows, values, ok, strict=True):
        mine = sorted(v for v, b, (_, _, h, *_) in zip(values, ok, rows, strict=True) if b and (h or "und") == (g or "und"))
        if good:
            lo, mid, hi = (mine[max(0, -(-int(q * 4) * len(mine) // 4) - 1)] for q in (0.25, 0.5, 0.75))
            wide = max(hi - lo, 0.01) * (1 + quality.SHORT / len(brute_words(x))) ** 0.5
            good = mid - low * wide <= value <= mid + high * wide
        out.append(good)
    return out


def brute_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def junk(rng, n):
    return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 12))) for _ in range(n))


@pytest.mark.parametrize("per_bucket", [quality.PER_BUCKET, 500])
def test_perplexity_equals_brute_force(spark, docs, rows, per_bucket):
    found = {}
    for r in quality.measure(docs, per_bucket=per_bucket).collect():
        found.setdefault(r["doc_id"], []).append(r["log_perplexity"])
    for (i, *_), want in zip(rows, brute_log_perplexities(rows), strict=True):
        assert all((x is None) == (want is None) and (want is None or abs(x - want) < 1e-6) for x in found[i]), i


def test_verdicts(spark):
    """Clean texts stay, planted junk of unknown words goes, as the plain rules say; one
    language holds nine tenths of the rows and one hardly any."""
    rng = random.Random(11)
    rows = [(i, sentence(rng, rng.randint(60, 300)), "en" if i % 10 else "de") for i in range(200)]
    rows += [(200 + i, junk(rng, 150), "en") for i in range(4)] + [(300, sentence(rng, 80), "sw"), (301, sentence(rng, 80), None), (302, "short one", "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.filter_quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    want = brute_kept(rows)
    assert [got[i] for i, *_ in rows] == want
    assert all(got[i] for i in range(200)) and not any(got[200 + i] for i in range(4)) and got[300] and got[301] and not got[302]


def test_words_model_grows_with_the_texts(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, 200), "en") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")

    def held(part):
        words, positions = quality.count_words(part)
        return sum(r["n"] for r in quality.count_bigrams(part, words, positions, 3).select("n").collect())

    assert held(df) > 1.5 * held(df.where("doc_id < 20"))


def test_kneser_ney_sums_to_one(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(40)), "x") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    words, positions = quality.count_words(df)
    parts = quality.count_bigrams(df, words, positions, 2).cache()
    model = quality.fit(parts, words, 2)
    count = {}
    for r in parts.collect():
        if r["n"]:
            count |= dict(zip(quality.unpacked_keys(r["keys"], r["n"]).tolist(), quality.unpacked(r["counts"], r["n"], 5).tolist(), strict=True))
    for v in range(len(words.ids)):
        keys = np.array([v << quality.BITS | w for w in range(len(words.ids))], np.uint64)
        whole = np.exp(model.logs(keys, np.array([count.get(int(k), 0) for k in keys], np.int64))).sum()
        assert abs(whole - 1) < 1e-9


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        words = sentence(rng, rng.randint(20, 80)).split(" ")
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (None, "x")], "doc_id bigint, text string").withColumn("predicted", F.lit("mine"))
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(docs, known.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i].predicted, y) for i, y in labels if i % 3 == 0]
    assert sum(p == y for p, y in held) / len(held) >= 0.97
    assert 0 <= got[5000].score <= 1 and None in got
    assert toxicity.reject_toxic(docs, model).columns == docs.columns
    none = toxicity.train(docs, known.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_toxicity_fit_gives_memory_back(spark, monkeypatch):
    """The driver's Python lets go of what the fit took, once it is done."""
    rng = random.Random(37)
    docs = spark.createDataFrame([(i, ("you idiot " if i % 2 else "") + sentence(rng, 20)) for i in range(40)], "doc_id bigint, text string")
    calls = []
    monkeypatch.setattr(toxicity, "release_memory", lambda: calls.append(1), raising=False)
    toxicity.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int"))
    assert calls


def test_language(spark):
    rng = random.Random(4)
    other = "der die das und nicht mit sich auf eine als auch nach wie aus bei wird sind noch über schön".split()
    german = lambda n: " ".join(rng.choice(other) for _ in range(n))
    rows = [(i, german(30) if i % 2 else sentence(rng, 30), "de" if i % 2 else "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs.where("doc_id % 3 <> 1"))
    odd = [(1000, None, None), (1001, "12 34 !?", None), (1002, sentence(rng, 60) + " " + german(20), None), (None, german(9), None)]
    got = {r.doc_id: r for r in language.identify(docs.unionByName(spark.createDataFrame(odd, docs.schema)), model).collect()}
    held = [(got[i].lang_pred, g) for i, _, g in rows if i % 3 == 1]
    assert sum(p == g for p, g in held) / len(held) >= 0.97
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1002].lang_pred == "en" and got[None].lang_pred == "de"
    spans = model.spans("the and that with this have " + "und nicht auch wird sich noch")
    assert [s[2] for s in spans] == ["en", "de"]
    assert language.identify(docs, language.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_rare_and_many_languages(spark):
    """A language of a few rows among thousands is learnt, and so are more languages than
    the table has room for at full size."""
    rng = random.Random(6)
    rows = [(i, sentence(rng, 12), "en") for i in range(3000)] + [(5000 + i, "қазақ тілінде жазылған мәтін бар " * 3, "kk") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs, most=500)
    assert model.languages == ["en", "kk"]
    assert {r.lang_pred for r in language.identify(docs.where("doc_id >= 5000"), model).collect()} == {"kk"}
    alphabets = [[chr(0x4E00 + 40 * i + j) for j in range(40)] for i in range(300)]
    rows = [(i, " ".join("".join(rng.choice(alphabets[i]) for _ in range(4)) for _ in range(40)), f"x{i:03}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.train(docs)
    assert len(model.languages) == 300 and model.table.nbytes <= language.MODEL_BYTES
    right = sum(r.lang_pred == f"x{r.doc_id:03}" for r in language.identify(docs, model).collect())
    assert right >= 290


def test_viterbi_equals_the_best_of_all_labellings():
    from itertools import product

    rng = np.random.default_rng(8)
    for _ in range(30):
        sizes, k, switch = rng.integers(0, 6, 4), int(rng.integers(1, 4)), float(rng.choice([0.0, 0.5, 2.0]))
        scores, text = rng.normal(size=(int(sizes.sum()), k)), np.repeat(np.arange(4), sizes)
        path = language.viterbi(scores, text, 4, switch)
        for t in range(4):
            mine, own = scores[text == t], path[text == t]
            worth = lambda x: sum(mine[i, c] for i, c in enumerate(x)) - switch * sum(a != b for a, b in zip(x, x[1:], strict=False))  # noqa: B023, E731
            assert abs(worth(own.tolist()) - max(map(worth, product(range(k), repeat=len(mine))))) < 1e-9


@pytest.mark.parametrize("key", ["bigint", "string"])
def test_learners_on_long_repeated_and_no_rows(spark, key):
    rng = random.Random(7)
    long = sentence(rng, 400_000)  # above one chunk
    rows = [(i, sentence(rng, 20) + (" idiot" if i % 4 == 0 else ""), "en") for i in range(200)]
    rows += [(1000, long, "en"), (1001, long + " idiot idiot", None), (7, rows[7][1], "en"), (None, None, None), (1002, "", "de")]
    docs = spark.createDataFrame([(None if i is None else str(i) if key == "string" else i, x, g) for i, x, g in rows], f"doc_id {key}, text string, lang string")
    labels = spark.range(200).selectExpr(f"cast(id as {key}) as doc_id", "cast(id % 4 = 0 as int) as toxic")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if str(r.doc_id) == "7"}) == 1
    named = language.identify(docs, language.train(docs)).collect()
    assert len(named) == len(rows) and sum(r.lang_pred == "und" for r in named) == 2
    none = docs.limit(0)
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0 and language.identify(none, language.train(none)).count() == 0


def names_used(*modules):
    """Every column name that the operators' sources mention."""
    import inspect

    found = set()
    for m in modules:
        found |= {x.lower() for x in re.findall(r"""["'`]([A-Za-z_][A-Za-z_0-9]{0,20})["'`]""", inspect.getsource(m))}
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars"})


def test_clashing_names_in_stages(spark, rows, key="bigint"):
    """Columns that share a name with anything used inside stay as they were, of any type."""
    from webloom.llm import common
    from webloom.llm import components as components_

    names = names_used(common, components_, simhash, exact_substrings, pii, toxicity, packing)
    df = spark.createDataFrame(rows[:60], DOCS).withColumn("doc_id", F.col("doc_id").cast(key)).repartition(2)
    kinds = [F.lit("x"), F.lit(1.5).cast("decimal(10,2)"), F.array(F.lit(1)), F.struct(F.lit(1).alias("s")), F.lit(None).cast("timestamp")]
    wide = df.select("*", *[kinds[i % 5].alias(c) for i, c in enumerate(names)])
    model = toxicity.train(df.limit(0), spark.createDataFrame([], f"doc_id {key}, toxic int"))
    for stage in (lambda d: toxicity.reject_toxic(d, model), simhash.one_of_each, exact_substrings.without_repeats, pii.redact):
        out, plain = stage(wide), stage(df)
        assert out.dtypes == wide.dtypes
        rows_ = out.collect()
        assert all(r[c] == w for r in rows_ for c, w in zip(names, [("x", 1.5, [1], (1,), None)[i % 5] for i in range(len(names))], strict=True) if c in ("fp", "r1", "base_email", "_row"))
        assert Counter((r["doc_id"], r["text"]) for r in rows_) == Counter((r["doc_id"], r["text"]) for r in plain.collect())
        assert stage(wide.limit(0)).count() == 0


def test_clashing_names_in_operators(spark, rows, key="string"):
    from webloom.llm import common

    names = names_used(common, simhash, exact_substrings, pii, toxicity, packing, quality, language, byte_bpe)
    df = spark.createDataFrame(rows[:40], DOCS).withColumn("doc_id", F.col("doc_id").cast(key)).repartition(2)
    wide = df.select("*", *[F.lit("x").alias(c) for c in names])
    for operator in (simhash.near_duplicates, exact_substrings.remove_repeats, pii.detect, quality.filter_quality, lambda d: language.identify(d, language.train(d)), lambda d: packing.pack(d, packing.definition())):
        got, want = operator(wide), operator(df)
        assert got.columns == want.columns and got.count() == want.count()


def test_long_texts_in_chunked_paths(spark):
    """Texts above every chunk size beside short ones: removal against brute force,
    fingerprints against plain shingles."""
    rng = random.Random(31)
    passage = sentence(rng, 60)
    long = sentence(rng, 900_000)  # over 3 MB
    rows = [(1, long[:3_000_000] + passage + long[3_000_000:]), (2, passage), (3, "short"), (4, None), (5, sentence(rng, 300_000))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: r for r in exact_substrings.remove_repeats(df).collect()}
    cut = len(passage)
    assert got[1].n_removed >= cut and got[2].n_removed == cut and got[5].n_removed == 0 and got[4].n_bytes == 0
    assert got[1].n_bytes == len(rows[0][1])
    prints = {r.doc_id: r.fp for r in simhash.fingerprints(df).collect()}
    for i, text in rows:
        hashes = np.array(simhash.shingle_hashes((text or "").encode(), 3), np.uint64)
        bits = sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))
        assert prints[i] == (bits - (1 << 64) if bits >> 63 else bits)


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(20, 140)], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == names, name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert corpus_pipeline.run(spark, str(tmp_path)).where("length < 1 or length > 2048").count() == 0


def test_pipeline_equals_plain_steps(spark, rows, tmp_path):
    """All five stages against plain Python (and the tokenizers library) on a small corpus."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(17)
    own = [(i, x, "en", "s", None) for i, x, *_ in rows if i is not None and i != 4 and i < 60] + [(4, "one", "en", "s", None)]
    passage = sentence(rng, 60)
    own += [(1000 + i, sentence(rng, 40) + " " + passage + " " + sentence(rng, 40), "en", "s", None) for i in range(4)]
    own += [(2000, own[20][1] + " more", "en", "s", None), (2001, "write a@b.example, 10.0.0.1 or +1 (555) 010-2030", "en", "s", None), (3000, "you idiot " * 3 + sentence(rng, 20), "en", "s", None)]
    toxic = [(5000 + i, "you idiot " * 3 + sentence(rng, 20), "en", "s", None) for i in range(60)]
    spark.createDataFrame(own + toxic, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0) for i, *_ in own if i < 3000] + [(i, 1) for i, *_ in toxic]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    sets = {}
    for i, x, *_ in own:
        if i == 3000:
            continue
        w = [a.encode().lower() for a in re.findall(r"[^\x20\x09-\x0D]+", x or "")]
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept = {i: x for i, x, *_ in own if i in root and find(i) == i}
    ids = sorted(kept)
    bare = {}
    for i, (_, _, _, digest) in zip(ids, brute_windows([(kept[i] or "").encode() for i in ids]), strict=True):
        bare[i] = digest
    config = {n: f for n, f in corpus_pipeline.STAGES}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in ("toxicity", "near_dedup", "substring_dedup"):
        config[name](spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    texts = {r.doc_id: r.text for r in now.collect()}
    assert sorted(texts) == ids
    assert all(hashlib.sha256((texts[i] or "").encode()).hexdigest() == bare[i] for i in ids if (kept[i] or "").isascii())
    spans = {r.doc_id: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in pii.detect(now).collect()}
    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokens.encode(plain_mask(texts[i] or "", spans[i]), add_special_tokens=False).ids) + 1 for i in ids}
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want
