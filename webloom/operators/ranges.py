"""Running sums and nearest rows over any order, without a task that holds a whole group.

Rows are stored in ranges of their group and order; what a range needs of others is one row for
each range, as ranges are sorted by group and so at most one group reaches into a range from
each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webloom.store import stored


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """Stored in ranges of ``by``, with the number of the range in ``_part``."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))


def from_other_parts(df: DataFrame, group: str, value: Column, *, later: bool) -> DataFrame:
    """(_part, group, _carried): of each range that a group is continued in, the value of the
    nearest earlier (or later) range of the group that has one; no more rows than ranges.
    ``value`` is an aggregate."""
    each = df.groupBy("_part", group).agg(value.alias("_v"))
    w = W.partitionBy(group).orderBy(F.col("_part").desc() if later else F.col("_part")).rowsBetween(W.unboundedPreceding, -1)
    return each.select("_part", group, F.last("_v", ignorenulls=True).over(w).alias("_carried")).where("_carried is not null")


def running(df: DataFrame, group: str, order: list[str], **sums: Column) -> DataFrame:
    """A table of ``ranged`` by ``group`` and then ``order`` with sums over the rows of the
    group before each, by name."""
    inside = W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy("_part", group).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    ahead = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_part", group, *[F.sum(n).over(ahead).alias(f"_before_{n}") for n in sums], F.count(F.lit(1)).over(ahead).alias("_n")).where("_n > 0").drop("_n")
    met = df.join(F.broadcast(before), ["_part", group], "left")
    given = [F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n, c in sums.items()]
    return met.select(*df.columns, *[c.cast("bigint").alias(n) for n, c in zip(sums, given, strict=True)])
