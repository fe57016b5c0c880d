"""Subtitle and lyric files as lines: SubRip, ASS/SSA, LRC and plain lyrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.functions import text as T
from shiori.functions import vector as V

LINE = "file string, line_no int, text string, start_ms long, end_ms long"


def cleaned(c: Column) -> Column:
    """Markup first, in the JVM; entities, where there are any, in Arrow batches."""
    return F.when(c.contains("&"), V.unescaped(T.subtitle_markup(c))).otherwise(T.subtitle_markup(c))


def srt_lines(files: DataFrame) -> DataFrame:
    """A1: `files` (file, content) to lines. A block counts from its first time line on; a
    block without time or without Japanese is left out. Null contents have no lines."""
    blocks = files.select("file", F.posexplode(F.split(F.trim(F.regexp_replace("content", "\r\n?|﻿", "\n")), r"\n\s*\n")).alias("block", "body"))
    at = lambda k: F.regexp_extract("body", T.SRT_TIME, k)
    timed = blocks.where(F.col("body").rlike(T.SRT_TIME))
    rest = F.regexp_extract("body", rf"(?s){T.SRT_TIME}[^\n]*\n?(.*)$", 9)
    lines = timed.select(
        "file", "block", rest.alias("raw"), T.clock_ms(at(1), at(2), at(3), at(4)).alias("start_ms"), T.clock_ms(at(5), at(6), at(7), at(8)).alias("end_ms")
    ).withColumn("text", cleaned(F.col("raw")))
    lines = lines.where(T.has_japanese(F.col("text")))
    order = Window.partitionBy("file").orderBy("block")
    return lines.select("file", F.row_number().over(order).alias("line_no"), "text", "start_ms", "end_ms")


def ass_lines(files: DataFrame) -> DataFrame:
    """A2: the Dialogue rows of [Events], text column by the Format row (else the tenth); no times."""
    rows = files.select("file", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("n", "row")).withColumn("row", F.trim("row")).where("row != ''")
    upto = Window.partitionBy("file").orderBy("n")
    section = F.last(F.when(F.col("row").startswith("["), F.lower("row")), ignorenulls=True).over(upto)
    fields = F.when(F.lower("row").startswith("format:"), F.transform(F.split(F.lower(F.substring_index("row", ":", -1)), ","), lambda x: F.trim(x)))
    rows = rows.withColumn("section", section).where("section = '[events]'").withColumn("fields", F.last(fields, ignorenulls=True).over(upto))
    spot = F.coalesce(F.nullif(F.array_position("fields", "text"), F.lit(0)), F.lit(10)).cast("int")
    said = rows.where(F.lower("row").startswith("dialogue:")).withColumn("spot", spot)
    payload = F.ltrim(F.expr("substring(row, instr(row, ':') + 1)"))
    said = said.withColumn("cells", F.split(payload, ",")).where("size(cells) >= spot")
    body = F.array_join(F.slice("cells", F.col("spot"), F.size("cells") - F.col("spot") + 1), ",")
    lines = said.select("file", "n", cleaned(body).alias("text")).where(T.has_japanese(F.col("text")))
    order = Window.partitionBy("file").orderBy("n")
    none = F.lit(None).cast("long")
    return lines.select("file", F.row_number().over(order).alias("line_no"), "text", none.alias("start_ms"), none.alias("end_ms"))


def lrc_lines(files: DataFrame) -> DataFrame:
    """A5, F2: a row for each stamp of a line, by time; a row ends where the next begins."""
    rows = files.select("file", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("n", "row"))
    stamps = F.regexp_extract_all("row", F.lit(f"({T.LRC_STAMP})"), 1)
    body = F.trim(F.regexp_replace("row", rf"^.*{T.LRC_STAMP}", ""))
    rows = rows.withColumn("stamps", stamps).withColumn("text", body).where((F.size("stamps") > 0) & T.has_japanese(F.col("text")))
    each = rows.select("file", "n", "text", F.posexplode("stamps").alias("k", "stamp"))
    part = lambda k: F.regexp_extract("stamp", r"\[(\d{1,3}):(\d{2})(?:[.:](\d{1,3}))?\]", k)
    start = T.clock_ms(F.lit("0"), part(1), part(2), F.when(part(3) == "", "0").otherwise(part(3)))
    timed = each.withColumn("start_ms", start)
    order = Window.partitionBy("file").orderBy("start_ms", "n", "k")
    return timed.select("file", F.row_number().over(order).alias("line_no"), "text", "start_ms", F.lead("start_ms").over(order).alias("end_ms"))


def plain_lines(files: DataFrame) -> DataFrame:
    """Trimmed lines with any Japanese."""
    rows = files.select("file", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("n", "row"))
    rows = rows.withColumn("text", F.trim("row")).where(T.has_japanese(F.col("text")))
    none = F.lit(None).cast("long")
    return rows.select("file", F.row_number().over(Window.partitionBy("file").orderBy("n")).alias("line_no"), "text", none.alias("start_ms"), none.alias("end_ms"))


def lines_of(files: DataFrame) -> DataFrame:
    """A3: by suffix; an unknown suffix has no lines."""
    suffix = F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1))
    parts = [srt_lines(files.where(suffix == "srt")), ass_lines(files.where(suffix.isin("ass", "ssa"))), lrc_lines(files.where(suffix == "lrc"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, content) of a folder, each file in the first charset that reads it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select(F.col("path").alias("file"), V.decoded("content").alias("content"))
