"""Word lists, dictionaries and catalogues."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.functions import text as T

# Alternative column names of word lists, first match wins.
NAMES = {
    "surface": ["word", "surface", "kanji", "expression", "term", "vocab", "text"],
    "reading": ["reading", "kana", "furigana", "pronunciation"],
    "level": ["level", "jlpt", "jlpt_level", "tags", "tag"],
    "meaning": ["meaning", "translation", "gloss", "english", "zh"],
}
# Entries every list gets, unless it has the surface.
OVERRIDES = [
    ("言う", "いう", 5, "to say"), ("行く", "いく; ゆく", 5, "to go"), ("見る", "みる", 5, "to see; to watch"),
    ("来る", "くる", 5, "to come"), ("良い", "よい; いい", 5, "good"), ("ありがとう", "ありがとう", 5, "thank you"),
    ("おはよう", "おはよう", 5, "good morning"), ("こんにちは", "こんにちは", 5, "hello, good day"),
    ("こんばんは", "こんばんは", 5, "good evening"), ("ごめんなさい", "ごめんなさい", 5, "sorry, excuse me"),
]
READING_OVERRIDES = [("みる", "見る"), ("くる", "来る"), ("よい", "良い"), ("いい", "良い")]
# Ten sample rows.
SAMPLE = [("約束", "やくそく", 4, "promise"), ("気持ち", "きもち", 4, "feeling"), ("学校", "がっこう", 5, "school"), ("水", "みず", 5, "water"), ("経験", "けいけん", 3, "experience"), ("努力", "どりょく", 3, "effort"), ("影響", "えいきょう", 2, "influence"), ("状況", "じょうきょう", 2, "situation"), ("概念", "がいねん", 1, "concept"), ("矛盾", "むじゅん", 1, "contradiction")]
LEXICON = "surface string, reading string, jlpt_level int, meaning string, entry_pos int"


def adapt_words(rows: DataFrame) -> DataFrame:
    """Any word list with one of the known column names; rows without word or level raise."""
    have = {c.lower(): c for c in rows.columns}

    def pick(kind: str):
        found = [F.nullif(F.trim(F.col(have[n]).cast("string")), F.lit("")) for n in NAMES[kind] if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    surface, level = T.word_pattern(pick("surface")), T.level_number(pick("level"))
    checked = F.when(surface.isNull() | level.isNull(), F.raise_error(F.lit("a word list row has no word or no level")).cast("string")).otherwise(surface)
    return rows.select(checked.alias("surface"), T.word_pattern(pick("reading")).alias("reading"), level.alias("jlpt_level"), pick("meaning").alias("meaning")).withColumn("entry_pos", F.monotonically_increasing_id())


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list by suffix; JSON may be a list, {words: list} or {level: list}."""
    if path.endswith(".csv"):
        return adapt_words(spark.read.option("header", True).csv(path))
    rows = spark.read.text(path, wholetext=True).select(F.col("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v in b["value"]:
                d = json.loads(v)
                d = d.get("words", d) if isinstance(d, dict) else d
                if isinstance(d, dict):
                    d = [({"word": x} if isinstance(x, str) else x) | {"level": k} for k, xs in d.items() for x in xs]
                for x in d:
                    low = {str(k).lower(): y for k, y in x.items()}
                    get = lambda kind: next((str(low[n]) for n in NAMES[kind] if low.get(n) not in (None, "")), None)
                    out.append([get("surface"), get("reading"), get("level"), get("meaning")])
            yield pd.DataFrame(out, columns=["word", "reading", "level", "meaning"])

    return adapt_words(rows.mapInPandas(run, "word string, reading string, level string, meaning string"))


def with_overrides(lexicon: DataFrame) -> DataFrame:
    """H4: built-in entries whose surface the list lacks, appended."""
    spark = lexicon.sparkSession
    extra = spark.createDataFrame([(*o, 1_000_000 + i) for i, o in enumerate(OVERRIDES)], LEXICON)
    return lexicon.unionByName(extra.join(lexicon.select("surface").distinct(), "surface", "left_anti"))


def read_jmdict(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JMdict XML(.gz) file, an element a row."""
    schema = "ent_seq int, k_ele array<struct<keb string, ke_inf array<string>, ke_pri array<string>>>, r_ele array<struct<reb string, re_inf array<string>, re_pri array<string>>>, sense array<struct<pos array<string>, gloss array<string>, misc array<string>, field array<string>, dial array<string>>>"
    return spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)


def jmdict_entries(raw: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, ent_seq, common, spellings, readings, pos, glosses) of entries with a target key (column `key`)."""
    e = raw.select(
        "ent_seq",
        F.transform("k_ele", lambda k: k["keb"]).alias("spellings"), F.transform("r_ele", lambda r: r["reb"]).alias("readings"),
        (F.exists(F.coalesce("k_ele", F.array()), lambda k: F.size(k["ke_pri"]) > 0) | F.exists(F.coalesce("r_ele", F.array()), lambda r: F.size(r["re_pri"]) > 0)).alias("common"),
        F.array_distinct(F.flatten(F.transform("sense", lambda s: F.coalesce(s["pos"], F.array())))).alias("pos"),
        F.filter(F.transform("sense", lambda s: F.slice(F.coalesce(s["gloss"], F.array()), 1, 3)), lambda g: F.size(g) > 0).alias("glosses"),
    )
    keyed = e.withColumn("key", F.explode(F.array_distinct(F.concat(F.coalesce("spellings", F.array()), F.coalesce("readings", F.array())))))
    return keyed.join(targets.select("key").distinct(), "key", "left_semi")


def read_wiktionary(spark: SparkSession, path: str) -> DataFrame:
    """Best-scored entry of each key of a JSONL(.gz) dump, first on ties."""
    schema = "word string, lang_code string, pos string, forms array<struct<form string, tags array<string>>>, senses array<struct<glosses array<string>, tags array<string>>>"
    rows = spark.read.schema(schema).json(path).where("lang_code = 'ja' and word is not null")
    kana = F.filter(F.transform(F.coalesce("forms", F.array()), lambda f: f["form"]), lambda f: f.rlike("^[぀-ヿー]+$"))
    good = F.filter(F.coalesce("senses", F.array()), lambda s: (F.size(s["glosses"]) > 0) & ~F.coalesce(F.arrays_overlap(s["tags"], F.array(F.lit("form-of"), F.lit("alt-of"))), F.lit(False)))
    scored = rows.select("word", "pos", F.array_distinct(kana).alias("readings"), F.array_distinct(F.flatten(F.transform(good, lambda s: s["glosses"]))).alias("glosses"), F.monotonically_increasing_id().alias("at"))
    scored = scored.where("size(glosses) > 0").withColumn("score", F.lit(10) + F.when(F.size("readings") > 0, 3).otherwise(0) + F.when(F.col("pos").isin("noun", "verb", "adj", "adv"), 2).otherwise(0))
    best = Window.partitionBy("word").orderBy(F.desc("score"), "at")
    return scored.withColumn("k", F.row_number().over(best)).where("k = 1").select(F.col("word").alias("key"), "pos", "readings", "glosses", "score")


def read_anime_db(spark: SparkSession, path: str) -> DataFrame:
    """Records of an offline catalogue (JSON with data[], or JSONL)."""
    schema = "title string, synonyms array<string>, episodes int, animeSeason struct<year:int>, sources array<string>"
    if path.endswith(".jsonl"):
        rows = spark.read.schema(schema).json(path).where("sources is not null")
    else:
        rows = spark.read.option("multiLine", True).schema(f"data array<struct<{', '.join(re.sub(' ', ':', p, count=1) for p in schema.split(', '))}>>").json(path).selectExpr("inline(data)")
    source_id = lambda p: F.nullif(F.regexp_extract(F.coalesce(F.get(F.filter("sources", lambda s: s.rlike(p)), F.lit(0)), F.lit("")), p, 1), F.lit("")).cast("int")
    return rows.select("title", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"), F.col("animeSeason.year").alias("year"), "episodes", source_id(r"myanimelist\.net/anime/(\d+)").alias("mal_id"), source_id(r"anilist\.co/anime/(\d+)").alias("anilist_id"), source_id(r"anidb\.net/anime/(\d+)").alias("anidb_id"))


def plain_content(node) -> str:
    """Readable text of structured content; examples and tags are left out."""
    if node is None:
        return ""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return "".join(plain_content(x) for x in node)
    kind = str((node.get("data") or {}).get("content", ""))
    if re.search("example|tag|attribution", kind):
        return ""
    inner = plain_content(node.get("content") if "content" in node else node.get("text"))
    return inner + "\n" if node.get("tag") in ("li", "div", "p", "br", "tr") else inner


def yomitan_rows(files: DataFrame, dict_id: str) -> DataFrame:
    """Dictionary index rows of Yomitan archives (file, content): one a lookup key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.sources.lexicons import plain_content

        for b in batches:
            out = []
            for raw in b["content"]:
                with zipfile.ZipFile(BytesIO(bytes(raw))) as z:
                    n = 0
                    for name in sorted(x for x in z.namelist() if re.search(r"term_bank_\d+\.json$", x)):
                        for t in json.loads(z.read(name)):
                            n += 1
                            if len(t) < 6:
                                continue
                            text = "\n".join(x for x in (plain_content(g).strip() for g in t[5]) if x)
                            tags = " ".join(filter(None, [t[2], t[7] if len(t) > 7 else ""]))
                            if not text and not tags:
                                continue
                            for key in dict.fromkeys([t[0], f"{t[0]}\t{t[1]}" if t[1] else t[0]]):
                                out.append((dict_id, n, key, t[0], t[1], int(t[4] or 0), tags, text))
            yield pd.DataFrame(out, columns=["dict_id", "entry_id", "lookup_key", "headword", "reading", "score", "tags", "content"])

    return files.select("content").mapInPandas(run, "dict_id string, entry_id long, lookup_key string, headword string, reading string, score int, tags string, content string")
