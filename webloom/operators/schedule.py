"""When requests would be made: waits between them and a limited rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def request_times(jobs: DataFrame, wait: float, *, random_wait: bool = False, host: str = "host", order: str = "seq") -> DataFrame:
    """Adds ``at``: seconds from a host's first request.  Random waits are 0.5 to 1.5 times
    ``wait``, drawn from a hash of host and place, so a second run has the same."""
    part = F.pmod(F.xxhash64(host, order), F.lit(1_000_000)) / 1_000_000 + 0.5
    step = F.lit(float(wait)) * (part if random_wait else F.lit(1.0))
    w = W.partitionBy(host).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return jobs.withColumn("at", F.coalesce(F.sum(step).over(w), F.lit(0.0)))


def transfer_seconds(size, rate: int):
    """Seconds of a body under a token bucket of ``rate`` bytes a second that begins full
    with two seconds' worth."""
    return F.greatest((size - F.lit(2 * rate)) / F.lit(rate), F.lit(0.0))
