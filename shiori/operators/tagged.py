"""Tokens of a morphological tagger (I1, I3, I4, K1): a plug-in's output, or a table of it, as the corpus's tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiori.functions import text as T

# Features a tagger gives, first of a kind wins, and parts of speech that are no words.
BASES, READINGS = ["orth_base", "lemma", "orth"], ["kana", "kana_base", "pron"]
DETAILS = ["pos1", "pos2", "pos3", "pos4"]
SIGNS = ["補助記号", "空白", "記号"]
FEATURES = ", ".join(f"{c} string" for c in [*BASES, *READINGS, *DETAILS])


def said(c: str) -> Column:
    """A feature's value; empty and starred ones are none."""
    return F.when(~F.col(c).isin("", "*"), F.col(c))


def words(tokens: DataFrame) -> DataFrame:
    """(…, surface, base, reading, pos, pos_detail): tokens (with `surface` and any of the features) that are words.

    Signs, blanks and tokens without Japanese go. The base falls back to the surface; a
    reading may be null. Features the table doesn't have count as null.
    """
    have = lambda names: [said(c) for c in names if c in tokens.columns] or [F.lit(None).cast("string")]
    t = tokens.withColumn("surface", F.trim("surface")).where(T.has_japanese(F.col("surface")))
    keep = [c for c in tokens.columns if c not in {*BASES, *READINGS, *DETAILS, "surface", "base", "reading", "pos", "pos_detail"}]
    detail = F.concat_ws("-", *have(DETAILS))
    out = t.select(*keep, "surface", F.coalesce(*have(BASES), "surface").alias("base"), F.coalesce(*have(READINGS)).alias("reading"), F.coalesce(*have(["pos1"])).alias("pos"), F.nullif(detail, F.lit("")).alias("pos_detail"))
    return out.where(~F.coalesce(F.col("pos").isin(SIGNS), F.lit(False)))


def located(tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """F16: tokens (doc_id, line_no, token_pos, surface, …) with start_pos and end_pos: each is looked for in its
    line's text from where the one before ended; one that isn't found has null places and moves nothing."""
    rest = [c for c in tokens.columns if c not in ("doc_id", "line_no")]
    by = tokens.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("token_pos", *(c for c in rest if c != "token_pos")))).alias("toks"))
    j = by.join(lines.select("doc_id", "line_no", F.coalesce("text", F.lit("")).alias("text")), ["doc_id", "line_no"])
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(a: Column, x: Column) -> Column:
        found = F.call_function("locate", x["surface"], F.col("text"), a["at"] + 1)
        at = F.when(found > 0, found - 1 + F.length(x["surface"])).otherwise(a["at"])
        return F.struct(at.alias("at"), F.concat(a["starts"], F.array(F.when(found > 0, found - 1))).alias("starts"))

    starts = F.aggregate("toks", none, step)["starts"]
    each = j.select("doc_id", "line_no", F.explode(F.arrays_zip(F.col("toks").alias("t"), starts.alias("start_pos"))).alias("z"))
    return each.select("doc_id", "line_no", *(F.col(f"z.t.{c}").alias(c) for c in rest), "z.start_pos", (F.col("z.start_pos") + F.length("z.t.surface")).alias("end_pos"))


def tag(lines: DataFrame, make: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """Lines (doc_id, line_no, text) through a tagger, as words with places. `make` gives a function from a
    text to its tokens, each a dict of `surface` and features; it is called once a task, in the worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = make()
        names = ["doc_id", "line_no", "token_pos", "surface", *BASES, *READINGS, *DETAILS]
        for b in batches:
            rows = [(d, n, i, t["surface"], *(t.get(c) for c in names[4:])) for d, n, x in zip(b["doc_id"], b["line_no"], b["text"]) if x for i, t in enumerate(tagger(x))]
            yield pd.DataFrame(rows, columns=names)

    raw = lines.select("doc_id", "line_no", "text").mapInPandas(run, f"doc_id string, line_no int, token_pos int, surface string, {FEATURES}")
    return words(located(raw, lines))
