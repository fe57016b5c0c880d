"""Core tables of the corpus: documents, lines, matches, lexicon. Each has its order key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.functions import text as T
from shiori.session import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the first loaded of repeated rows."""
    raw = table(spark, sf_dir, "documents_src")
    first = Window.partitionBy("doc_id").orderBy("loaded_at", "source_ord")
    return raw.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line: a line delivered again is the same line."""
    raw = table(spark, sf_dir, "lines")
    return raw.groupBy("doc_id", "line_no").agg(F.min("text").alias("text"), F.min("start_ms").alias("start_ms"), F.min("end_ms").alias("end_ms"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a match of a word in a line."""
    return table(spark, sf_dir, "matches").distinct()


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: matches with their document's source columns and the corpus order `seq`."""
    d = documents(spark, sf_dir).select("doc_id", "source_ord", "source_type", "title", "file_name", "artist", "album", "episode")
    seq = F.struct("source_ord", "doc_id", "line_no", "token_pos")
    return matches(spark, sf_dir).join(d, "doc_id").withColumn("seq", seq)


def tokens(lines_: DataFrame) -> DataFrame:
    """(doc_id, line_no, token_pos, surface, start_pos, end_pos); a run of Japanese characters is a token.

    A line is split once, at the runs and between them; its tokens' places are running sums
    of the lengths of both."""
    cut = lines_.select("doc_id", "line_no", T.tokens(F.col("text")).alias("runs"), F.split("text", f"{T.JAPANESE}+").alias("gaps"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    pairs = F.zip_with("runs", F.slice("gaps", 1, F.greatest(F.size("runs"), F.lit(0))), lambda r, g: F.struct(F.length(g).alias("g"), F.length(r).alias("r")))
    starts = F.aggregate(pairs, none, lambda a, x: F.struct((a["at"] + x["g"] + x["r"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + x["g"])).alias("starts")))["starts"]
    parts = cut.select("doc_id", "line_no", F.posexplode(F.arrays_zip(F.col("runs").alias("surface"), starts.alias("start_pos"))).alias("token_pos", "t"))
    return parts.select("doc_id", "line_no", "token_pos", "t.surface", "t.start_pos", (F.col("t.start_pos") + F.length("t.surface")).alias("end_pos"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The easiest level of each surface, first on ties."""
    best = Window.partitionBy("surface").orderBy(F.desc("jlpt_level"), "entry_pos")
    raw = table(spark, sf_dir, "lexicon").where("surface is not null")
    return raw.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def reading_index(lex: DataFrame) -> DataFrame:
    """Readings that belong to one surface only."""
    each = lex.select("surface", "jlpt_level", F.explode(T.readings(F.col("reading"))).alias("key"))
    return each.groupBy("key").agg(F.min("surface").alias("surface"), F.min("jlpt_level").alias("jlpt_level"), F.count_distinct("surface").alias("n")).where("n = 1").drop("n")
