"""Problem 4: runs of identical or near-identical consecutive events.

Method: optimal segmentation of every entity's ordered events by pruned dynamic
programming: within-run dissimilarity plus a penalty a boundary is minimised. The
dissimilarity of neighbours (edit distance of what counts of the texts, against the
allowed share) is computed in the JVM. An entity is cut into blocks of line numbers, so
that a hot entity spreads over tasks; the programme runs in each block, and the segments
at block edges are chained afterwards (at most two rows a block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiori.session import settle

BLOCK = 4096
#: Cost of a boundary; a tolerated change costs less, an intolerable one more than any penalty saved.
PENALTY = 1.0
FORBIDDEN = 1e6


def counted(text: Column) -> Column:
    """What counts of a text: letters, digits and marks; no blanks, punctuation or symbols."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}]", "")


def dissimilarity(a: Column, b: Column, share: float) -> Column:
    """0 for equal texts, below PENALTY within the allowed share, else FORBIDDEN; null never repeats."""
    allowed = F.floor(F.greatest(F.length(a), F.length(b)) * F.lit(share) + 1e-9).cast("int")
    near = F.abs(F.length(a) - F.length(b)) <= allowed
    dist = F.levenshtein(a, b)
    return (
        F.when(a.isNull() | b.isNull(), FORBIDDEN)
        .when(a == b, 0.0)
        .when((allowed > 0) & near, F.when(dist <= allowed, dist / (allowed + 1) * PENALTY).otherwise(FORBIDDEN))
        .otherwise(FORBIDDEN)
    )


def segment(d: np.ndarray) -> list[int]:
    """Starts of the optimal segments; d[i] is the dissimilarity of event i to the one before (d[0] unused).

    Cost of a segment s..t is the sum of d over s+1..t, plus PENALTY. A start s whose
    F(s) + C(s, t) reaches F(t) + PENALTY can't win later, since C only grows, and is pruned.
    """
    n = len(d)
    best, back = np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    alive: list[list[float]] = []  # [start, F(start) + C(start, t)]
    for t in range(1, n + 1):
        if t > 1:
            for s in alive:
                s[1] += d[t - 1]
        alive.append([t - 1, best[t - 1]])
        start, cost = min(alive, key=lambda s: (s[1], s[0]))
        best[t], back[t] = cost + PENALTY, start
        alive = [s for s in alive if s[1] < best[t]]
    starts, t = [], n
    while t > 0:
        t = int(back[t])
        starts.append(t)
    return starts[::-1]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["doc_id", "blk", "first_line_no", "last_line_no", "n", "t0", "t1", "head", "tail", "joins"]
    for b in batches:
        out = []
        for doc, blk, ev in zip(b["doc_id"], b["blk"], b["ev"]):
            d = np.array([e["d"] for e in ev])
            starts = segment(d)
            for s, e in zip(starts, [*starts[1:], len(ev)]):
                head, tail = s == 0, e == len(ev)
                if e - s < 2 and not head and not tail:
                    continue
                t0 = [x["start_ms"] for x in ev[s:e] if x["start_ms"] is not None]
                t1 = [x["end_ms"] for x in ev[s:e] if x["end_ms"] is not None]
                out.append((doc, blk, ev[s]["line_no"], ev[e - 1]["line_no"], e - s, min(t0, default=None), max(t1, default=None), head, tail, bool(head and d[0] < PENALTY)))
        f = pd.DataFrame(out, columns=cols)
        for c in ("t0", "t1"):
            f[c] = f[c].astype("Int64")
        yield f


def collapse_runs(lines: DataFrame, share: float = 0.1, block: int = BLOCK) -> DataFrame:
    """(doc_id, first_line_no, last_line_no, n_lines, duration_ms) of every run of two or more lines.

    `lines`: doc_id, line_no (each pair once), text, start_ms, end_ms. Null texts repeat
    nothing. Two texts nothing of which counts are equal. duration_ms is the latest end
    less the earliest start of the run's timed lines, null if one of them is missing.
    Rows with a null key are left out. An empty table gives an empty result.
    """
    keyed = lines.where("doc_id is not null and line_no is not null").select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), counted(F.col("text")).alias("norm"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms")
    ).withColumn("blk", F.floor(F.col("line_no") / block))
    w = Window.partitionBy("doc_id", "blk").orderBy("line_no")
    last = keyed.groupBy("doc_id", "blk").agg(F.max_by("norm", "line_no").alias("last_norm"))
    edge = last.select("doc_id", "blk", F.lag("last_norm").over(Window.partitionBy("doc_id").orderBy("blk")).alias("edge_norm"))
    edge = edge.where("edge_norm is not null")
    here = keyed.withColumn("rn", F.row_number().over(w)).withColumn("before", F.lag("norm").over(w))
    here = here.join(edge, ["doc_id", "blk"], "left")
    before = F.when(F.col("rn") == 1, F.col("edge_norm")).otherwise(F.col("before"))
    here = here.withColumn("d", dissimilarity(before, F.col("norm"), share))
    ev = F.sort_array(F.collect_list(F.struct("line_no", "d", "start_ms", "end_ms"))).alias("ev")
    solved = here.groupBy("doc_id", "blk").agg(ev).mapInPandas(
        _solve, "doc_id string, blk long, first_line_no long, last_line_no long, n int, t0 long, t1 long, head boolean, tail boolean, joins boolean"
    )
    solved = settle(solved)
    # only segments at block edges, two a block at most, are chained along the entity
    at_edge = F.col("head") | F.col("tail")
    along = Window.partitionBy("doc_id").orderBy("first_line_no")
    edges = solved.where(at_edge).withColumn("grp", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(along))
    joined = edges.groupBy("doc_id", "grp").agg(
        F.min("first_line_no").alias("first_line_no"), F.max("last_line_no").alias("last_line_no"), F.sum("n").alias("n_lines"), F.min("t0").alias("t0"), F.max("t1").alias("t1")
    ).drop("grp")
    inside = solved.where(~at_edge).select("doc_id", "first_line_no", "last_line_no", F.col("n").cast("long").alias("n_lines"), "t0", "t1")
    runs = joined.unionByName(inside)
    return runs.where("n_lines >= 2").select(
        "doc_id", F.col("first_line_no").cast("int").alias("first_line_no"), F.col("last_line_no").cast("int").alias("last_line_no"), "n_lines", (F.col("t1") - F.col("t0")).alias("duration_ms")
    )
