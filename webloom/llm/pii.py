"""Personal data by weak supervision, in DataFrame functions alone.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; broader ones
propose further candidates.  Labelers vote on each: the base pattern, a strict form, a
gazetteer of cue words nearby, the context (does it stand alone), and a validity rule.
Expectation-maximisation over the counts of vote patterns estimates how far each labeler
can be trusted and how likely each pattern is personal data; with these as soft labels a
logistic span classifier is trained, which sees form and context but not whether the base
pattern matched.  It decides on the candidates; base spans always stay.

Lists are worked through in parts and by halving, and masked texts in blocks, so that a text
of very many spans costs little more than its length.  The patterns of votes and features are at most some hundreds whatever the corpus, so their
counts (over all texts) go to the driver; no text does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import read, written

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
#: The base patterns.  Possessive runs and the look at what stands before a match find the
#: same leftmost matches as the plain patterns, in time linear in the text.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BROAD = {
    "email": rf"(?<!{LOCAL}){LOCAL}++\x20?(?:\[at\]|\(at\)|@)\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\[dot\]|\(dot\))\x20?|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?<![0-9][\x20.-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])",
}
#: What a text must contain for a pattern to be tried.
NEEDS = {("email", True): ("@",), ("phone", True): ("+",), ("email", False): ("@", "[at]", "(at)")}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,10}$",
    "ip": r"^([1-9][0-9]{0,2}\.(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){2}|[0-9A-Fa-f:]+)$",
    "card": r"^[3-6][0-9]{3}([\x20-]?)[0-9]{4,6}(\1[0-9]{4,5}){1,2}$",
    "phone": r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?([\x20.-][0-9]{2,4}){2,4}$",
}
#: Cue words of the gazetteer, in the languages at hand.
CUES = {
    "email": "mail|contact|kontakt|correo|courriel|write to|schreib",
    "ip": r"\bip\b|host|server|address|adresse|dirección|login",
    "card": "card|karte|carte|tarjeta|visa|credit|kredit|crédit",
    "phone": r"\btel|phone|call|mobile|fax|handy|appel|llam",
}
TLDS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl"
PART = 256
#: Code points of a block that pieces of a text are taken from.
BLOCK = 1024
VOTES = ("base", "strict", "cue", "alone", "valid")
FEATURES = ("strict", "cue", "alone", "valid", "short", "long")
#: The classifier's least probability for a candidate to count.
THRESHOLD = 0.8


def of(first, f):
    """A function of one Column, as the array functions want it, with ``first`` given."""
    return lambda x: f(first, x)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        v = F.substr(number, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"


def passes(kind: str, m: Column) -> Column:
    """The rule that a base match must pass."""
    n = F.length(digits(m))
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def valid(kind: str, m: Column) -> Column:
    """The validity labeler."""
    d = digits(m)
    if kind == "email":
        return F.lower(m).rlike(rf"(?:\.|\[dot\]\x20?|\(dot\)\x20?)(?:{TLDS})$")
    if kind == "ip":
        return m.contains(":") | m.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    return F.length(d).between(10, 15) & ~d.rlike(r"^([0-9])\1*$")


def running(items: Column, first: Column, step, item: str) -> Column:
    """What ``step`` (of a number and an item) makes of each item: a struct of type
    ``item`` and the next number, the first being ``first``.  Taken in parts, so that long
    lists are not copied again and again."""

    def one(acc: Column, x: Column) -> Column:
        got, pos = step(acc["pos"], x)
        return F.struct(pos.alias("pos"), F.concat(acc["list"], F.array(got)).alias("list"))

    def part(acc: Column, c: Column) -> Column:
        start = F.struct(acc["pos"].alias("pos"), F.array().cast(f"array<{item}>").alias("list"))
        inner = F.aggregate(F.slice(items, c * PART + 1, PART), start, one)
        # one evaluation of the inner sum, though two of its fields are used
        return F.get(F.transform(F.array(inner), lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["lists"], F.array(r["list"])).alias("lists"))), F.lit(0))

    start = F.struct(first.alias("pos"), F.array().cast(f"array<array<{item}>>").alias("lists"))
    parts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int"))
    return F.when(F.size(items) > 0, F.flatten(F.aggregate(parts, start, part)["lists"])).otherwise(F.array().cast(f"array<{item}>"))


def located(matches: Column, gaps: Column) -> Column:
    """array<s, e, m, before, after> from a text's matches and what stands between them."""
    z = F.transform(
        matches,
        lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), m.alias("m"), F.right(F.get(gaps, i), F.lit(32)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(16)).alias("after")),
    )

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        s = pos + x["gap"]
        e = s + F.length(x["m"])
        return F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")), e

    return running(z, F.lit(0), step, "struct<s:int,e:int,m:string,before:string,after:string>")


def meets(spans: Column, x: Column) -> Column:
    """Whether ``x`` overlaps one of ``spans``, which are in order and disjoint: the first
    that ends behind its start is found by halving."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        low = F.get(spans, mid)["e"] <= x["s"]
        going = acc["lo"] < acc["hi"]
        return F.struct(F.when(going & low, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(going & ~low, mid).otherwise(acc["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda acc: F.get(spans, acc["lo"])["s"] < x["e"])
    return F.coalesce(found, F.lit(False))


def judged(kind: str, spans: Column) -> Column:
    """Spans with the labelers' votes and the features of their form."""
    return F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["m"].rlike(STRICT[kind]).alias("strict"),
            F.lower(F.concat_ws(" ", x["before"], x["after"])).rlike(CUES[kind]).alias("cue"),
            (x["before"].rlike(r"(?:^|[\s(\[\"':;,|])$") & x["after"].rlike(r"^(?:[\s)\]\"':;,.!?|]|$)")).alias("alone"),
            valid(kind, x["m"]).alias("valid"),
            (x["e"] - x["s"] < 12).alias("short"),
            (x["e"] - x["s"] > 20).alias("long"),
        ),
    )


def found(docs: DataFrame, *, text: Column, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` (which must clash with no name here) with columns base_<kind> (spans that
    pass) and more_<kind> (candidates that overlap no base span)."""
    body = F.coalesce(text, F.lit(""))
    df = docs.select(*keep, body.alias("_t"))
    sets = [(k, base) for base in (True, False) for k in KINDS]
    pattern = lambda k, base: (BASE if base else BROAD)[k]

    def tried(k: str, base: bool) -> Column:
        m = F.regexp_extract_all(F.col("_t"), F.lit(pattern(k, base)), F.lit(0))
        needs = NEEDS.get((k, base))
        if needs is None:
            return m
        any_ = F.col("_t").contains(needs[0])
        for n in needs[1:]:
            any_ = any_ | F.col("_t").contains(n)
        return F.when(any_, m).otherwise(F.array().cast("array<string>"))

    name = lambda k, base: f"{'b' if base else 'x'}_{k}"
    df = df.select(*keep, "_t", *[tried(*s).alias(f"m_{name(*s)}") for s in sets])
    df = df.select(*keep, *[f"m_{name(*s)}" for s in sets], *[F.when(F.size(f"m_{name(*s)}") > 0, F.split("_t", pattern(*s), -1)).alias(f"g_{name(*s)}") for s in sets])
    df = df.select(*keep, *[located(F.col(f"m_{name(*s)}"), F.col(f"g_{name(*s)}")).alias(name(*s)) for s in sets])
    df = df.select(*keep, *[F.filter(F.col(f"b_{k}"), of(k, lambda k, x: passes(k, x["m"]))).alias(f"b_{k}") for k in KINDS], *[f"x_{k}" for k in KINDS])
    free = lambda x: ~(meets(F.col("b_email"), x) | meets(F.col("b_ip"), x) | meets(F.col("b_card"), x) | meets(F.col("b_phone"), x))
    return df.select(*keep, *[judged(k, F.col(f"b_{k}")).alias(f"base_{k}") for k in KINDS], *[judged(k, F.filter(f"x_{k}", free)).alias(f"more_{k}") for k in KINDS])


def cells(spans: DataFrame) -> list[tuple[str, dict[str, int], int]]:
    """How many spans of each kind have each pattern of votes and features."""
    tagged = [
        F.transform(F.col(f"{where}_{k}"), of((k, b), lambda kb, x: F.struct(F.lit(kb[0]).alias("kind"), F.lit(kb[1]).alias("base"), *[x[c].alias(c) for c in FEATURES])))
        for k in KINDS
        for where, b in (("base", True), ("more", False))
    ]
    names = ("base", *FEATURES)
    rows = spans.select(F.explode(F.concat(*tagged)).alias("x")).groupBy("x.kind", *[f"x.{c}" for c in names]).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted(((r["kind"], {c: int(bool(r[c])) for c in names}, r["n"]) for r in rows), key=lambda x: (x[0], sorted(x[1].items())))


def reliabilities(rows: list[tuple[dict[str, int], int]], rounds: int = 100) -> tuple[list[float], dict[str, tuple[float, float]], float]:
    """EM for votes that are independent given the truth.

    Returns each row's probability, each labeler's rates of firing on personal data and
    on other spans, and the share of personal data.
    """
    rate = {v: (0.8, 0.3) for v in VOTES}
    prior, probability = 0.5, [0.5] * len(rows)
    for _ in range(rounds):
        for i, (x, _) in enumerate(rows):
            a, b = math.log(prior), math.log(1 - prior)
            for v in VOTES:
                yes, no = rate[v]
                a += math.log(yes if x[v] else 1 - yes)
                b += math.log(no if x[v] else 1 - no)
            probability[i] = 1 / (1 + math.exp(min(500, b - a)))
        total = sum(n for _, n in rows)
        mass = sum(p * n for p, (_, n) in zip(probability, rows, strict=True))
        prior = min(0.99, max(0.01, mass / total)) if total else 0.5
        for v in VOTES:
            yes = (1 + sum(p * n for p, (x, n) in zip(probability, rows, strict=True) if x[v])) / (2 + mass)
            no = (1 + sum((1 - p) * n for p, (x, n) in zip(probability, rows, strict=True) if x[v])) / (2 + total - mass)
            # a labeler never counts against what it votes for
            rate[v] = (max(yes, no), min(yes, no))
    return probability, rate, prior


@dataclass
class Model:
    """For each kind the bias and weights of the span classifier, and what EM estimated."""

    weights: dict[str, tuple[float, dict[str, float]]]
    rates: dict[str, dict[str, tuple[float, float]]]

    def accepts(self, kind: str, x: Column) -> Column:
        if kind not in self.weights:
            return F.lit(False)
        bias, weights = self.weights[kind]
        odds = F.lit(bias)
        for name, w in weights.items():
            odds = odds + x[name].cast("double") * w
        return 1 / (1 + F.exp(-odds)) >= THRESHOLD


def train(rows: list[tuple[str, dict[str, int], int]], steps: int = 400, l2: float = 1e-3) -> Model:
    """A kind without any span gets no classifier, and so no added spans."""
    weights, rates = {}, {}
    for kind in KINDS:
        mine = [(x, n) for k, x, n in rows if k == kind]
        total = sum(n for _, n in mine)
        if not total:
            continue
        soft, rates[kind], prior = reliabilities(mine)
        w, b, hw, hb = dict.fromkeys(FEATURES, 0.0), math.log(prior / (1 - prior)), dict.fromkeys(FEATURES, 1e-8), 1e-8
        for _ in range(steps):
            gw, gb = {f: l2 * v for f, v in w.items()}, 0.0
            for (x, n), y in zip(mine, soft, strict=True):
                z = b + sum(w[f] for f in FEATURES if x[f])
                err = (1 / (1 + math.exp(-max(-500, min(500, z)))) - y) * n / total
                gb += err
                for f in FEATURES:
                    if x[f]:
                        gw[f] += err
            hb += gb * gb
            b -= 0.5 * gb / math.sqrt(hb)
            for f in FEATURES:
                hw[f] += gw[f] ** 2
                w[f] -= 0.5 * gw[f] / math.sqrt(hw[f])
        weights[kind] = (b, w)
    return Model(weights, rates)


def _span_list(spans: dict[str, Column]) -> Column:
    said = [F.transform(F.array_sort(s), of(k, lambda k, x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))) for k, s in spans.items()]
    return F.array_join(F.concat(*said), ",")


def all_spans(spans: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, base_<kind> and all_<kind> as arrays of (s, e)."""
    plain = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    base = {k: plain(F.col(f"base_{k}")) for k in KINDS}
    more = {k: plain(F.filter(F.col(f"more_{k}"), of(k, model.accepts))) for k in KINDS}
    return spans.select(*keep, *[base[k].alias(f"base_{k}") for k in KINDS], *[F.concat(base[k], more[k]).alias(f"all_{k}") for k in KINDS])


def detect(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the number of base spans of each kind, base_sha256 and spans of each row.

    Offsets count code points.  Null and empty texts have no spans (the digest of nothing,
    an empty list); null keys and repeated rows each keep their row; an empty table gives
    no rows; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("_row"), F.col(text).alias("_text"))
    spans = written(found(rows, text=F.col("_text"), keep=("_row",)))
    model = train(cells(spans))
    named = all_spans(spans, model, ("_row",))
    return named.select(
        F.col("_row").alias(key),
        *[F.size(f"base_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(_span_list({k: F.col(f"base_{k}") for k in KINDS}), 256).alias("base_sha256"),
        _span_list({k: F.col(f"all_{k}") for k in KINDS}).alias("spans"),
    )


def masked(body: Column, spans: Column) -> Column:
    """``body`` with the spans (s, -e, kind; in order) replaced by their kinds in brackets.

    The text is cut into blocks of ``BLOCK`` code points, so that a piece is taken from the
    blocks that it touches and not from the text's start."""
    blocks = F.regexp_extract_all(body, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    # a span that begins behind the end of all before it is a head; the others add to its length
    heads = F.filter(
        running(spans, F.lit(0), lambda reach, x: (F.struct(reach.alias("after"), x["s"].alias("s"), x["kind"].alias("kind")), F.greatest(reach, -x["e"])), "struct<after:int,s:int,kind:string>"),
        lambda x: x["s"] >= x["after"],
    )
    end = F.array_max(F.transform(spans, lambda x: -x["e"]))

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        tail = F.substr(F.get(blocks, first), F.pmod(a, F.lit(BLOCK)) + 1)
        head = F.coalesce(F.substr(F.get(blocks, last), F.lit(1), F.pmod(b, F.lit(BLOCK))), F.lit(""))
        between = F.when(last > first + 1, F.array_join(F.slice(blocks, first + 2, last - first - 1), "")).otherwise("")
        return F.when(a >= b, "").when(first == last, F.substr(F.get(blocks, first), F.pmod(a, F.lit(BLOCK)) + 1, b - a)).otherwise(F.concat(tail, between, head))

    # blocks and heads are made once, as elements of an array
    both = F.array(F.struct(blocks.alias("blocks"), heads.alias("heads"), end.alias("end"), F.length(body).alias("size")))
    text = F.transform(
        both,
        lambda z: F.concat(
            F.array_join(F.transform(z["heads"], lambda x: F.concat(piece(z["blocks"], x["after"], x["s"]), F.lit("["), x["kind"], F.lit("]"))), ""),
            piece(z["blocks"], z["end"], z["size"]),
        ),
    )
    return F.when(F.size(spans) > 0, F.get(text, F.lit(0))).otherwise(body)


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets, as
    ``[email]``; of overlapping spans the first (then the longest) names the whole.  A null
    text stays null; all columns keep their names and order."""
    own = docs.columns
    if len(set(own)) != len(own):
        raise ValueError("columns must have distinct names")
    # the row goes as one column, so that its names clash with none here
    rows = docs.select(F.struct(*[F.col(c) for c in own]).alias("_row"))
    spans = written(found(rows, text=F.col("_row").getField(text), keep=("_row",)))
    named = all_spans(spans, train(cells(spans)), ("_row",))
    tagged = F.array_sort(F.concat(*[F.transform(f"all_{k}", of(k, lambda k, x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit(k).alias("kind")))) for k in KINDS]))
    named = named.select("_row", tagged.alias("_spans"))
    body = F.col("_row").getField(text)
    return named.select(*[(masked(body, F.col("_spans")) if c == text else F.col("_row").getField(c)).alias(c) for c in own])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
