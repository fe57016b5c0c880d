"""Ranks and running sums over unbounded groups, without one task a group.

Rows are hashed into buckets in a fixed order; a bucket's total is a row of a small
table, and a window runs only within (group, bucket). The order of a group is (bucket,
order key): reproducible, and independent of partitions and executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, group: list[str], key: Column, size: Column, buckets: int = 4096, rounds: str = "") -> DataFrame:
    """Adds `before`: the sum of `size` over the rows of the group that come earlier."""
    keyed = df.withColumn("_key", F.xxhash64(F.lit(rounds), key)).withColumn("_tie", key)
    keyed = keyed.withColumn("_bucket", F.pmod("_key", F.lit(buckets)).cast("int")).withColumn("_size", size)
    totals = keyed.groupBy(*group, "_bucket").agg(F.sum("_size").alias("_total"))
    upto = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*group, "_bucket", F.coalesce(F.sum("_total").over(upto), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*group, "_bucket").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    same = [local[g].eqNullSafe(start[g]) for g in group] + [local["_bucket"] == start["_bucket"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = local.join(start, on, "left")
    keep = [local[c] for c in df.columns]
    return out.select(*keep, (F.col("_start") + F.col("_local")).alias("before"))
