"""Order over unbounded groups without one task a group: global places, and neighbours of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(df: DataFrame, lead: dict[str, Column], then: list[Column], group: list[str] = (), name: str = "place") -> DataFrame:
    """Adds the place of each row in the order (*lead, *then), from 1, within `group`.

    Only the sizes of the groups of equal `lead` are summed along the order; rows are
    numbered within such a group. Nulls come first, as in Spark's ascending order; a
    descending key is given as its negative.
    """
    keyed = df.withColumns({f"_l{i}": c for i, c in enumerate(lead.values())})
    ls = [f"_l{i}" for i in range(len(lead))]
    sizes = keyed.groupBy(*group, *ls).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*(group or [F.lit(1)])).orderBy(*ls)
    start = sizes.select(*(F.col(c).alias(f"{c}_") for c in [*group, *ls]), (F.sum("_n").over(along) - F.col("_n")).alias("_start"))
    inside = keyed.withColumn("_i", F.row_number().over(Window.partitionBy(*group, *ls).orderBy(*then)))
    on = [inside[c].eqNullSafe(start[f"{c}_"]) for c in [*group, *ls]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return inside.join(start, cond).select(*(inside[c] for c in df.columns), (F.col("_start") + F.col("_i")).alias(name))


def with_neighbours(df: DataFrame, group: str, at: str, value: str, before: int, after: int, block: int = 4096) -> DataFrame:
    """Adds `near_before` and `near_after`: up to so many values of the rows before (nearest first) and
    after each row, in the order of `at` within `group`.

    A group is cut into blocks of `at`; a block's window needs only its own rows and the last
    and first rows of the blocks around it, of which there are few a block. Rows of a null group or place are
    left out; `at` is unique in a group.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(at).isNotNull()).withColumn("_b", F.floor(F.col(at) / block))
    inner = Window.partitionBy(group, "_b").orderBy(at)
    item = F.struct(F.col(at).alias("at"), F.col(value).alias("v"))
    most = max(before, after)
    edge = rows.withColumn("_i", F.row_number().over(inner)).withColumn("_k", F.row_number().over(Window.partitionBy(group, "_b").orderBy(F.desc(at)))).where(F.least("_i", "_k") <= most)
    ends = edge.groupBy(group, "_b").agg(
        F.array_sort(F.collect_list(F.when(F.col("_i") <= after, item))).alias("heads"), F.array_sort(F.collect_list(F.when(F.col("_k") <= before, item))).alias("tails")
    )
    along = Window.partitionBy(group).orderBy("_b")
    prev = F.flatten(F.collect_list("tails").over(along.rowsBetween(-max(before, 1), -1)))
    next_ = F.flatten(F.collect_list("heads").over(along.rowsBetween(1, max(after, 1))))
    halo = ends.select(group, "_b", F.transform(F.slice(F.reverse(prev), 1, max(before, 1)), lambda x: x["v"]).alias("_prev"), F.transform(F.slice(next_, 1, max(after, 1)), lambda x: x["v"]).alias("_next"))
    # nulls would be dropped from a collected list, so values are wrapped
    wrapped = F.struct(F.col(value).alias("v"))
    own = rows.withColumn("_p", F.reverse(F.collect_list(wrapped).over(inner.rowsBetween(-before, -1)))).withColumn("_a", F.collect_list(wrapped).over(inner.rowsBetween(1, after)))
    both = own.join(halo, [group, "_b"])
    values = lambda c: F.transform(c, lambda x: x["v"])
    return both.select(
        *df.columns, F.slice(F.concat(values("_p"), "_prev"), 1, max(before, 1)).alias("near_before"), F.slice(F.concat(values("_a"), "_next"), 1, max(after, 1)).alias("near_after")
    )
