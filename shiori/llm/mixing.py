"""Problem 9: mixing sources to target weights.

Method: Pfair scheduling. The mixture is a sequence of slots of one block of tokens each.
Block k (from 0) of a source that has the share w of all blocks is released at slot
floor(k / w) and due before slot ceil((k + 1) / w); earliest deadline first among the
released then serves every block in its window, so that each source is at any time less
than one block from its share. A text longer than a block is served part by part, in the
slots of the blocks its tokens lie in.

Up to PERIOD slots are scheduled at once. A longer mixture is cut into periods, each
scheduled by itself by an executor: the driver only fixes how many blocks each source has
at a period's start, its exact amount rounded up or down, and within the period a source's
share is its part of the period's blocks. The distance is then below two blocks, however
long the mixture is: one from the period's ends, one within it. `shares` reports it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.llm.spread import running
from shiori.session import settle, small

PERIOD = 1 << 20
BLOCK_TOKENS = 1024


def allocate(sources: list[tuple[str, float, int, int]], total: float | None = None) -> dict[str, float]:
    """Tokens of each source (name, weight, tokens at hand, max repeats).

    The default total is what the weighted sources hold once. A source gets its weight's
    share of it, at most its tokens times its repeats; what capped sources can't give is
    shared by the others in proportion to their weights, as far as they can.
    """
    cap = {s: n * r for s, w, n, r in sources if n > 0 and r > 0 and w > 0}
    weight = {s: w for s, w, n, r in sources if s in cap}
    total = sum(n for s, _, n, _ in sources if s in cap) if total is None else total
    total = min(total, sum(cap.values()))
    got: dict[str, float] = {}
    free, left = dict(weight), float(total)
    while free:
        scale = left / sum(free.values())
        bound = [s for s in free if free[s] * scale >= cap[s]]
        if not bound:
            return got | {s: w * scale for s, w in free.items()}
        for s in bound:
            got[s] = float(cap[s])
            left -= cap[s]
            del free[s]
    return got


def boundaries(blocks: dict[str, int], period: int = PERIOD) -> list[dict[str, int]]:
    """Blocks of each source before slot 0, period, 2 period and so on, and at the end.

    A source has its exact amount rounded down, or up where its next block is due first.
    """
    total = sum(blocks.values())
    out = [dict.fromkeys(blocks, 0)]
    for t in range(period, total, period):
        now = {s: max(out[-1][s], n * t // total) for s, n in blocks.items()}
        for s in sorted(blocks, key=lambda s: (-(-(now[s] + 1) * total // blocks[s]), s)):
            if sum(now.values()) < t and now[s] * total < blocks[s] * t:
                now[s] += 1
        for s in sorted(blocks, key=lambda s: (-blocks[s], s))[: max(sum(now.values()) - t, 0)]:
            now[s] -= 1
        out.append(now)
    return [*out, dict(blocks)]


def period_order(start: dict[str, int], end: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of the blocks from `start` to `end`: earliest deadline first among the released."""
    count = {s: end[s] - start[s] for s in start if end[s] > start[s]}
    total, at = sum(count.values()), sum(start.values())
    waiting = [(0, s, 0) for s in sorted(count)]
    released: list[tuple[int, str, int]] = []
    out: list[tuple[str, int, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(k + 1) * total // count[s]), s, k))
        _, s, k = heapq.heappop(released)
        out.append((s, start[s] + k, at + t))
        if k + 1 < count[s]:
            heapq.heappush(waiting, ((k + 1) * total // count[s], s, k + 1))
    return out


def _slots(spark: SparkSession, blocks: dict[str, int]) -> DataFrame:
    """(source, blk, slot) of every block of the mixture."""
    at = boundaries(blocks) if blocks else []
    names = sorted(blocks)
    rows = [(i, [a[s] for s in names], [b[s] for s in names]) for i, (a, b) in enumerate(zip(at, at[1:]))]

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm import mixing

        for b in batches:
            for start, end in zip(b["first"], b["last"]):
                got = mixing.period_order(dict(zip(names, map(int, start))), dict(zip(names, map(int, end))))
                yield pd.DataFrame(got, columns=["source", "blk", "slot"])

    return spark.createDataFrame(rows, "period long, first array<long>, last array<long>").repartition(max(1, len(rows))).mapInPandas(order, "source string, blk long, slot long")


def mix(docs: DataFrame, weights: DataFrame, key: str, source: str, size: str, total: float | None = None, block: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture: slot, source, key, copy_no, part_no, token_start, n_tokens; read in the order of
    (slot, source_offset). A row is the part of a text whose tokens, from token_start on, lie
    in one block. shares: one row a source of `weights`, with target, tokens, actual share,
    repeats, and the largest distance from that share, in blocks, over all prefixes.
    Documents without weight, of null source or without tokens aren't used; a source without
    documents comes out with share 0. A text that has begun comes out to its end: a source
    overshoots its share by less than one document.
    `weights` is a table of a row a source, gathered on the driver with its totals.
    """
    spark = docs.sparkSession
    named = docs.select(key, F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens")).where("n_tokens > 0")
    w = weights.groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    used = named.join(w.select("source"), "source", "left_semi")
    placed = settle(running(used, ["source"], F.col(key), F.col("n_tokens")))
    sums = placed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    listed = [(r["source"], r["target_weight"] or 0.0, r["n_tokens"] or 0, r["max_repeats"] or 0) for r in w.join(sums, "source", "left").collect()]
    give = allocate(listed, total)
    bounds = spark.createDataFrame([(s, n, r, give.get(s, 0.0)) for s, _, n, r in listed], "source string, held long, max_repeats int, give double")
    passes = F.least(F.col("max_repeats"), F.ceil(F.col("give") / F.col("held")).cast("int"))
    copies = placed.join(small(bounds), "source").where("give > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), passes - 1)))
    copies = copies.withColumn("at", F.col("before") + F.col("copy_no").cast("long") * F.col("held")).where(F.col("at") < F.col("give"))
    got = copies.groupBy("source").agg(F.max(F.col("at") + F.col("n_tokens")).alias("tokens"), F.count(F.lit(1)).alias("documents"), (F.max("copy_no") + 1).alias("repeats")).collect()
    blocks = {r["source"]: -(-r["tokens"] // block) for r in got}
    slots = settle(_slots(spark, blocks))
    blk = F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block)))
    parts = copies.select("source", key, "copy_no", "at", "n_tokens", blk.alias("blk"))
    first = F.greatest(F.col("at"), F.col("blk") * block)
    parts = parts.select("source", key, (F.col("copy_no") + 1).alias("copy_no"), "blk", (F.col("blk") - F.floor(F.col("at") / block)).alias("part_no"), (first - F.col("at")).alias("token_start"), (F.least(F.col("at") + F.col("n_tokens"), (F.col("blk") + 1) * block) - first).alias("n_tokens"), first.alias("source_offset"))
    mixture = parts.join(slots, ["source", "blk"]).select("slot", "source", key, "copy_no", "part_no", "token_start", "n_tokens", "source_offset")
    whole, all_tokens = sum(blocks.values()), sum(r["tokens"] for r in got)
    rows = [(r["source"], r["tokens"], r["documents"], r["repeats"], r["tokens"] / all_tokens, blocks[r["source"]] / whole) for r in got]
    kept = small(spark.createDataFrame(rows, "source string, tokens long, documents long, repeats int, actual_share double, w double"))
    far = slots.join(kept.select("source", "w"), "source").groupBy("source").agg(F.max(F.greatest(F.abs(F.col("blk") - F.col("w") * F.col("slot")), F.abs(F.col("blk") + 1 - F.col("w") * (F.col("slot") + 1)))).alias("largest_deviation"))
    shares = w.join(kept, "source", "left").join(far, "source", "left").select("source", "target_weight", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "documents", "repeats")), F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"), F.coalesce("largest_deviation", F.lit(0.0)).alias("largest_deviation"))
    return mixture, shares
