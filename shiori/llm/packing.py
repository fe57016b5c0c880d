"""Problem 8: filling containers of fixed capacities with documents.

Method: variable-capacity best fit. Sizes are whole tokens, at most the largest
capacity, so all items are described by a histogram with one row a size. The driver
solves best-fit-decreasing over that histogram (bounded by the capacity, not by the
number of documents): it takes the largest size left, tries every permitted capacity,
fills the rest best-fit, opens the capacity of least unused share, and repeats the same
filling as often as the counts allow. Last, each bin is downsized to the smallest
capacity that holds its contents. Items then get their bin by rank within their size,
computed in buckets, so that no size is gathered into one task.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.llm.spread import running
from shiori.session import small


def fill(first: int, capacity: int, sizes: list[int], count: dict[int, int]) -> dict[int, int]:
    """One bin's contents as {size: times}: the first item, then best fit into what is left."""
    content, left = {first: 1}, capacity - first
    while left > 0:
        k = bisect_right(sizes, left) - 1
        while k >= 0 and count[sizes[k]] - content.get(sizes[k], 0) <= 0:
            k -= 1
        if k < 0:
            break
        # as many of this size as fit and are left
        s = sizes[k]
        times = min(left // s, count[s] - content.get(s, 0))
        content[s] = content.get(s, 0) + times
        left -= times * s
    return content


def plan_bins(histogram: dict[int, int], capacities: list[int]) -> list[tuple[int, int, dict[int, int]]]:
    """[(capacity, repeats, {size: times a bin})] holding every item of the histogram once."""
    count = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(count)
    capacities = sorted(capacities)
    bins: list[tuple[int, int, dict[int, int]]] = []
    while sizes:
        s = sizes[-1]
        best = None
        for c in capacities:
            if c < s:
                continue
            content = fill(s, c, sizes, count)
            used = sum(k * n for k, n in content.items())
            # Least unused share; between equals the larger bin, which leaves fewer bins.
            if best is None or (round((c - used) / c, 9), -c) < best[0]:
                best = ((round((c - used) / c, 9), -c), c, content)
        _, c, content = best
        times = min(count[k] // n for k, n in content.items())
        used = sum(k * n for k, n in content.items())
        c = next(x for x in capacities if x >= used)
        bins.append((c, times, content))
        for k, n in content.items():
            count[k] -= n * times
        sizes = [k for k in sizes if count[k] > 0]
    return bins


def pack(items: DataFrame, key: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """(key, piece_no, piece_start, n_tokens, pack_name, capacity_tokens, pack_id).

    Every item comes out once; only one larger than the largest capacity is split, into
    pieces of that capacity and a rest. Null and zero sizes hold nothing and come out
    with a null pack. pack_id is unique; a pack's items never exceed its capacity.
    """
    spark = items.sparkSession
    largest = max(capacities.values())
    named = {c: n for n, c in sorted(capacities.items(), reverse=True)}
    base = items.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"))
    full = F.when(F.col("_n") > largest, F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / largest).cast("int"))).otherwise(F.array(F.lit(0)))
    pieces = base.select(key, "_n", F.explode(full).alias("piece_no")).select(
        key, "piece_no", (F.col("piece_no").cast("long") * largest).alias("piece_start"),
        F.least(F.lit(largest), F.col("_n") - F.col("piece_no").cast("long") * largest).alias("n_tokens"),
    )
    held = pieces.where("n_tokens > 0")
    histogram = {r["n_tokens"]: r["n"] for r in held.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, first_bin, used_of = [], 0, dict.fromkeys(histogram, 0)
    for c, times, content in plan_bins(histogram, list(capacities.values())):
        for s, n in content.items():
            rows.append((s, used_of[s], n, first_bin, c, named[c]))
            used_of[s] += n * times
        first_bin += times
    schema = "n_tokens long, from_rank long, a_bin long, first_bin long, capacity_tokens int, pack_name string"
    plan = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
    # The plan of one size as an array: a bounded row each, looked up by rank.
    spans = plan.groupBy("n_tokens").agg(F.sort_array(F.collect_list(F.struct("from_rank", "a_bin", "first_bin", "capacity_tokens", "pack_name"))).alias("spans"))
    ranked = running(held, ["n_tokens"], F.struct(key, "piece_no"), F.lit(1))
    # Binary search is not built in; sizes have few spans each, and filter runs in the JVM.
    span = F.element_at(F.filter("spans", lambda x: x["from_rank"] <= F.col("before")), -1)
    # a row a size, so at most as many as the largest capacity has tokens
    placed = ranked.join(small(spans), "n_tokens").withColumn("s", span).select(
        key, "piece_no", "piece_start", "n_tokens", "s.pack_name", "s.capacity_tokens",
        (F.col("s.first_bin") + F.floor((F.col("before") - F.col("s.from_rank")) / F.col("s.a_bin"))).cast("long").alias("pack_id"),
    )
    nothing = pieces.where("n_tokens <= 0").select(
        key, "piece_no", "piece_start", "n_tokens", F.lit(None).cast("string").alias("pack_name"), F.lit(None).cast("int").alias("capacity_tokens"), F.lit(None).cast("long").alias("pack_id")
    )
    return placed.unionByName(nothing)
