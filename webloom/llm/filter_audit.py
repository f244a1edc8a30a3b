"""What filters do to each other, whatever the order in which they are applied.

With five filters there are 80 edges of their lattice: 16 subsets that may have been applied
already, for each of the five filters that may come next.  A document is known to an edge by
the set of filters that it fails and by nothing else, so documents are summed to one row for
each part and set of failures before any edge is looked at; these rows are summed to edges,
and a step of a permutation is the edge of its prefix and its letter.  All 600 steps are thus
read off 80 sums, never off the documents.

A text is read once, inside the JVM.  Only its digest goes through a shuffle; a text that a
third of all documents share is summed to a row by each task before that.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.llm.common import read, written

FILTERS = "ABCDE"
#: The bit of the filter that needs other documents.
COPY = 1 << FILTERS.index("E")


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    split = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    words, distinct = F.size(split), F.size(F.array_distinct(split))
    fails = [
        words < 100,
        F.lit(100) * distinct < F.lit(80) * words,
        F.lit(100) * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(10) * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    out = F.lit(0)
    for i, failed in enumerate(fails):
        out = out.bitwiseOR(F.when(failed, 1 << i).otherwise(0))
    return out


def failures(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of
    ``mask``, and how many of these a label calls good or toxic.

    A null text is empty, a null part the empty string.  A row with a null key is no copy and
    makes none; rows of one key and text are all kept by E if no smaller key has the text.
    Of several label rows of a key any that marks it counts.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    said = docs.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), own_failures(body).alias("mask"), F.sha2(F.encode(body, "UTF-8"), 256).alias("digest"))
    marked = labels.groupBy(F.col(key).alias("k")).agg(F.max((F.col("quality") == 1).cast("int")).alias("g"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    # one row for a key, text and part, so that rows given often are joined once
    each = said.groupBy("k", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(marked, "k", "left")
    each = each.select("k", "digest", "part", "mask", "n", *[(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(name) for c, name in (("g", "good"), ("t", "toxic"))])
    sums = ["n", "good", "toxic"]
    known = F.col("k").isNotNull()
    # of each text and part: its rows, those of its least key, and those without one
    texts = each.groupBy("digest", "part", "mask").agg(
        *[F.sum(F.when(known, F.col(c)).otherwise(0)).alias(c) for c in sums],
        *[F.sum(F.when(known, 0).otherwise(F.col(c))).alias(f"{c}_free") for c in sums],
        F.min(F.when(known, F.struct("k", *sums))).alias("least"),
    )
    first = F.col("least.k") == F.min("least.k").over(W.partitionBy("digest"))
    kept = [(F.when(first, F.col(f"least.{c}")).otherwise(0) + F.col(f"{c}_free")).alias(c) for c in sums]
    texts = texts.select("part", "mask", F.struct(*kept).alias("kept"), *sums, *[F.col(f"{c}_free") for c in sums])
    copies = [(F.col(c) + F.col(f"{c}_free") - F.col(f"kept.{c}")).alias(c) for c in sums]
    both = texts.select("part", F.explode(F.array(F.struct("mask", F.col("kept").alias("s")), F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), F.struct(*copies).alias("s")))).alias("x"))
    return both.where("x.s.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(*[F.sum(f"x.s.{c}").alias(c) for c in sums])


def lattice(count: int = len(FILTERS)) -> list[tuple[int, int, int]]:
    """(applied, next, orders) for each edge: the bits of the subset applied already, the
    number of the next filter, and in how many orders the edge stands."""
    edges = []
    for applied in range(1 << count):
        done = applied.bit_count()
        edges += [(applied, f, factorial(done) * factorial(count - done - 1)) for f in range(count) if not applied >> f & 1]
    return edges


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, applied, next) for each step of each order: 600 rows."""
    out = []
    for order in permutations(range(len(FILTERS))):
        applied = 0
        for i, f in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), i + 1, applied, f))
            applied |= 1 << f
    return out


def edge_sums(failed: DataFrame) -> DataFrame:
    """(part, applied, next, kept, removed, redundant, unique_fails, good_lost, toxic_lost) for
    each part and each edge of the lattice."""
    edges = F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(f).alias("next"), F.lit(n).cast("long").alias("orders")) for a, f, n in lattice()])
    mask, one = F.col("mask"), F.expr("shiftleft(1, next)")
    met = mask.bitwiseAND(F.col("applied")) != 0
    fails = mask.bitwiseAND(one) != 0
    total = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(0))
    # 80 rows for each of at most 32 sums of a part
    return failed.select("*", F.inline(edges)).groupBy("part", "applied", "next", "orders").agg(
        total(~met & ~fails).alias("kept"), total(~met & fails).alias("removed"), total(met & fails).alias("redundant"), total(mask == one).alias("unique_fails"),
        total(~met & fails, "good").alias("good_lost"), total(~met & fails, "toxic").alias("toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order of the filters and step: ``kept``, ``removed``,
    ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost``, and ``shapley``, what the
    step's filter removes summed over all orders.

    Every part has all 600 rows; an empty table gives none.  See ``failures`` for nulls,
    repeated rows and labels; other columns are not read.
    """
    edges = written(edge_sums(failures(docs, labels, **columns)))
    shapley = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    paths = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, applied int, next int")
    met = edges.join(F.broadcast(paths), ["applied", "next"]).join(shapley, ["part", "next"])
    return met.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), flags AS (
  SELECT t.doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) AS c, regexp_matches(body, '[#$%&*|]') AS d,
    coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY body), false) AS e
  FROM texts t
), marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT part, [a, b, c, d, e] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM flags LEFT JOIN marks USING (doc_id)
), sums AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL
), letters AS (SELECT unnest(range(1, 6)) AS f
), orders AS (
  SELECT [f] AS fs FROM letters
  UNION ALL
  SELECT list_append(fs, f) FROM orders, letters WHERE len(fs) < 5 AND NOT list_contains(fs, f)
), paths AS (
  SELECT array_to_string(list_transform(fs, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, s AS step, fs[s] AS f, fs[:s - 1] AS before
  FROM (SELECT fs FROM orders WHERE len(fs) = 5), (SELECT unnest(range(1, 6)) AS s)
), judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failed, coalesce(list_bool_or(list_transform(before, lambda x: fails[x])), false) AS gone,
    len(list_filter(fails, lambda x: x)) = 1 AND fails[f] AS lone
  FROM sums, paths
), counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failed), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND failed), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (lone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND failed), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failed), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""
