"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the vertex, a vertex of very many edges being
joined by broadcast; nothing is collected.  Edges go to a table in the shared folder after
each round, those of the round before are deleted, and the loop ends when a round leaves them
as they were, which takes a number of rounds logarithmic in the vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import discard, split_join, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    """Link each vertex's larger neighbours to the smallest vertex near it."""
    near = _both(edges)
    low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("times"))
    # a centre of very many edges is joined apart
    met = split_join(near.where("b > a"), low, ["a"], times="times", total=2 * count)
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    """Link each vertex and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("times"))
    moved = split_join(down, low, ["a"], times="times", total=count).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node of an
    edge table ``a``, ``b`` of longs; loops and repeated edges do no harm, an empty table
    gives no rows.  Smallest is by signed order."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now)
    mark, count = None, now.count()
    for _ in range(rounds):
        wide = written(_large_star(now, count))
        last, now = now, written(_small_star(wide, wide.count()))
        discard(last, wide)
        count, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, total) == mark:
            break
        mark = (count, total)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
