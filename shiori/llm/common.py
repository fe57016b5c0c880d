"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.session import settle, small, table


def lines_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lines` with every (doc_id, line_no) once: a line delivered again is one line.

    Only keys are shuffled to find those delivered again; the few texts of these are then
    reduced, all others stay where they are read. Rows without a key can't be named in a
    result and are left out.
    """
    cols = ["doc_id", "line_no", "text", "start_ms", "end_ms"]
    raw = table(spark, sf_dir, "lines").where("doc_id is not null and line_no is not null").select(*cols, "loaded_at")
    again = small(settle(raw.groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "line_no")))
    rest = F.struct("loaded_at", "text", "start_ms", "end_ms")
    first = raw.join(again, ["doc_id", "line_no"], "left_semi").groupBy("doc_id", "line_no").agg(F.min(rest).alias("r"))
    once = raw.join(again, ["doc_id", "line_no"], "left_anti").select(*cols)
    return once.unionByName(first.select("doc_id", "line_no", "r.text", "r.start_ms", "r.end_ms"))


def line_key() -> "Column":
    return F.concat(F.col("doc_id"), F.lit("#"), F.col("line_no").cast("string"))
