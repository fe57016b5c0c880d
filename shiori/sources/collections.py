"""Landed API answers as tables: collections of shows and music (A45-A49, A63, A64, I46-I49), lyric searches (H18, H19), model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiori.functions import text as T

# Keys of an information box that name an artist.
ARTIST_KEYS = ["艺术家", "歌手", "演唱", "artist", "vocal", "作曲"]
COLLECTION = "subject_id long, ep_status int, subject struct<id: long, name: string, name_cn: string, date: string, infobox: array<struct<key: string, value: string>>>"
EPISODES = "subject_id long, id long, name string, name_cn string, sort string, disc string, duration string"


def _text(c: str | Column) -> Column:
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def shows(items: DataFrame) -> DataFrame:
    """A row a collected show; one without an id raises."""
    key = F.coalesce("subject_id", "subject.id")
    key = F.when(key.isNull(), F.raise_error(F.lit("a collection item has no subject id")).cast("long")).otherwise(key)
    date = _text("subject.date")
    return items.select(key.alias("bangumi_id"), F.coalesce(_text("subject.name"), F.concat(F.lit("Bangumi "), key.cast("string"))).alias("title_jp"), _text("subject.name_cn").alias("title_zh"), date.alias("air_date"), T.show_year(date).alias("air_year"), "ep_status")


def artist(infobox: Column) -> Column:
    """The first entry of the box that names an artist."""
    named = F.filter(F.coalesce(infobox, F.array().cast("array<struct<key:string,value:string>>")), lambda x: F.lower(F.trim(x["key"])).isin(ARTIST_KEYS) & (F.coalesce(F.trim(x["value"]), F.lit("")) != ""))
    return F.trim(F.get(named, F.lit(0))["value"])


def integer(c: Column) -> Column:
    """An integer, also from a decimal; else null."""
    return c.try_cast("double").try_cast("int")


def tracks(items: DataFrame, episodes: DataFrame) -> DataFrame:
    """The tracks of each album by its episodes; an album without any is one track."""
    a = items.select(F.coalesce("subject_id", "subject.id").alias("bangumi_id"), F.coalesce(_text("subject.name"), _text("subject.name_cn")).alias("album"), artist(F.col("subject.infobox")).alias("artist"))
    e = episodes.select(F.col("subject_id").alias("bangumi_id"), F.col("id").alias("episode_id"), F.coalesce(_text("name"), _text("name_cn")).alias("title"), integer(F.col("sort")).alias("track_number"), integer(F.col("disc")).alias("disc"), T.duration_ms(F.col("duration")).alias("duration_ms")).where("title is not null")
    j = a.join(e, "bangumi_id", "left")
    key = F.when(F.col("title").isNull(), F.concat(F.lit("bangumi:"), F.col("bangumi_id"), F.lit(":subject"))).otherwise(F.concat(F.lit("bangumi:"), F.col("bangumi_id"), F.lit(":ep:"), F.col("episode_id")))
    return j.select(key.alias("track_key"), "bangumi_id", F.coalesce("title", "album").alias("title"), "album", "artist", "track_number", "disc", "duration_ms")


def artist_names(c: Column) -> Column:
    """The artists of a credit, then the credit as a whole; at most twelve."""
    parts = F.filter(F.transform(F.split(c, r"(?i)\s*(?:、|,|/|／|;|；|&|＆| feat\.? | ft\.? )\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.array_distinct(F.concat(parts, F.array(c))), 1, 12)


def lyric_searches(t: DataFrame) -> DataFrame:
    """Search parameters of each track, most specific first: title with artist and album, with artist, with album, alone."""
    names = F.coalesce(artist_names(F.col("artist")), F.array().cast("array<string>"))
    one = lambda a, b, rank: F.struct(F.lit(rank).alias("rank"), a.alias("artist"), b.alias("album"))
    none = F.lit(None).cast("string")
    by_artist = F.flatten(F.transform(names, lambda n: F.array(one(n, F.col("album"), 1), one(n, none, 2))))
    all_ = F.concat(by_artist, F.array(one(none, F.col("album"), 3), one(none, none, 4)))
    each = t.select("track_key", "title", F.posexplode(all_).alias("place", "p"))
    first = each.groupBy("track_key", "title", "p.artist", "p.album").agg(F.min("place").alias("place"))
    return first


def answer(c: Column, fields: list[str]) -> Column:
    """The fields of a model's answer: of JSON, fenced or not, else of loose key lines; a missing field is null."""
    body = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    loose = lambda f: F.regexp_extract(body, rf'(?m)^\s*"{f}"\s*:\s*"?(.*?)"?,?\s*$', 1)
    squeeze = lambda x: F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))
    return F.struct(*(squeeze(F.coalesce(F.get_json_object(body, f"$.{f}"), loose(f))).alias(f) for f in fields))
