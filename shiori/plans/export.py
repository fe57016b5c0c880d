"""Export: corpus tables, index, keyed lookups, registries; and landed answers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.functions import text as T
from shiori.functions.vector import mapped
from shiori.operators import corpus as C
from shiori.operators.order import placed
from shiori.plans.sources import source_index
from shiori.plans.words import CORE, graded_word_stats
from shiori.session import table
from shiori.sources import collections as K
from shiori.sources import glosses

SHARDS = 64
ITEMS = [(1, 5, (1, "甲", "甲中", "2001-04-01", [])), (None, 2, (2, "", "乙", "x", [("歌手", " 星野 "), ("artist", "z")])), (3, None, (3, "丙", None, None, None))]
EPISODES = [(2, 20, "夜", None, "1.0", "1", "4:05"), (2, 21, "", "朝", "2", None, "x"), (2, 22, None, None, "3", "1", "1")]
ANSWERS = ['```json\n{"meaning": "约 定", "note": "x"}\n```', '"meaning": "约定",\n"note": "y\\"z"', "nothing", ""]
RAW = ["（やくそく）【名·他サ】约定，约会", "①【名】水 ", "名 人", "约定", "（こうこう/タカこう）高校"]
DEFS = ["[名词] 水；液体", "1. 约定\n友達と約束する。\n和朋友约定。\n2. 规则", "みる的连用形", "「手紙」的简写", "→ 言う，说", "abc", "同みる。", "水（mizu）"]
CONTENT = [("a", 1200, 10, 800, True, 0.05, 12), ("b", 9000, 5, 200, False, 0.6, 90), ("c", 300, 2, 250, True, 0.0, 0)]


def word_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of words with their shard; the shard is a prefix of the word's hash."""
    w = graded_word_stats(spark, sf_dir)
    return w.select("word", "level", "n", "titles", F.substring(F.sha2("word", 256), 1, 2).alias("shard"))


def write_corpus(spark: SparkSession, sf_dir: str, target: str) -> None:
    """Words and sources as tables, by shard, so that a lookup by key reads one folder."""
    word_shards(spark, sf_dir).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(f"{target}/words")
    source_index(spark, sf_dir).withColumn("shard", F.substring("source_key", 1, 2)).write.mode("overwrite").partitionBy("shard").parquet(f"{target}/sources")


def word_details(spark: SparkSession, target: str, words: list[str]) -> DataFrame:
    """Rows of the words asked for; the shard condition prunes folders, and a word that is missing says so."""
    asked = spark.createDataFrame([(w,) for w in words], "word string").distinct()
    shards = [r[0] for r in asked.select(F.substring(F.sha2("word", 256), 1, 2)).distinct().collect()]
    have = spark.read.parquet(f"{target}/words").where(F.col("shard").isin(shards))
    return asked.join(have, "word", "left").withColumn("missing", F.col("n").isNull())


def exported_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of exported words only (graded, or seen twice), a row a line."""
    keep = graded_word_stats(spark, sf_dir).where("level > 0 or n >= 2").select("word")
    m = C.matches(spark, sf_dir).join(keep, "word", "left_semi")
    item = F.struct("token_pos", "start_pos", "word")
    return m.groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("matches"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["word"]), " ").alias("words"))


def removable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ungraded words without any example."""
    ex = table(spark, sf_dir, "word_examples").select("word").distinct()
    return graded_word_stats(spark, sf_dir).where("level = 0").join(ex, "word", "left_anti").select("word", "n")


def imported_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported texts with a clean label, in order."""
    d = C.documents(spark, sf_dir).where("source_type = 'text' and file_name like 'web/%.txt'")
    stem = F.regexp_replace(F.substring_index("file_name", "/", -1), r"\.[^.]+$", "")
    label = F.trim(F.regexp_replace(F.regexp_replace(stem, r"^\d+-|\[[^\]]*\]", ""), r"[_\s]+", " "))
    return placed(d.select("doc_id", "title", label.alias("label")), {"title": F.col("title")}, [F.col("doc_id")]).drop("title")


def character_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of each show, replaced as a whole by the latest document that lists any."""
    d = C.documents(spark, sf_dir).where("bangumi_id is not null and size(characters) > 0")
    last = Window.partitionBy("bangumi_id").orderBy(F.desc("loaded_at"), "doc_id")
    return d.withColumn("k", F.row_number().over(last)).where("k = 1").select("bangumi_id", F.explode("characters").alias("name")).where("trim(name) != ''").distinct()


def collected_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A45, A63, I46."""
    return K.shows(spark.createDataFrame(_items(), K.COLLECTION))


def collected_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks in the order of album, disc, number and title."""
    t = K.tracks(spark.createDataFrame(_items(), K.COLLECTION).where("coalesce(subject_id, subject.id) > 1"), spark.createDataFrame(EPISODES, K.EPISODES))
    return placed(t, {"album": F.col("album")}, [F.coalesce("disc", F.lit(1)), F.coalesce("track_number", F.lit(9999)), F.col("title")])


def _items() -> list:
    return [(a, b, (i, n, c, d, box)) for a, b, (i, n, c, d, box) in ITEMS]


def lyric_search_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of each lyric document of the corpus."""
    d = C.documents(spark, sf_dir).where("source_type = 'lyrics'").select(F.col("doc_id").alias("track_key"), "title", "artist", "album")
    return K.lyric_searches(d).groupBy("track_key").agg(F.count(F.lit(1)).alias("searches"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I97, K4."""
    a = spark.createDataFrame([(i, v) for i, v in enumerate(ANSWERS)], "i int, v string").withColumn("a", K.answer(F.col("v"), ["meaning", "note"]))
    return a.select("i", "a.meaning", "a.note")


def gloss_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gloss, labels and readings of raw glosses."""
    g = spark.createDataFrame([(i, v) for i, v in enumerate(RAW)], "i int, v string").withColumn("g", mapped(glosses.entry_json)("v"))
    return g.select("i", F.get_json_object("g", "$.gloss").alias("gloss"), F.get_json_object("g", "$.labels").alias("labels"), F.get_json_object("g", "$.readings").alias("readings"))


def wiktionary_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I55-I64."""
    g = spark.createDataFrame([(i, v) for i, v in enumerate(DEFS)], "i int, v string")
    return g.select("i", mapped(glosses.wiktionary)("v").alias("gloss"))


def article_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a page by length, paragraphs, Japanese letters, selector and links."""
    c = spark.createDataFrame(CONTENT, "id string, chars int, paragraphs int, japanese int, selected boolean, link_density double, links int")
    s = F.least("chars", F.lit(4500)) + 220 * F.col("paragraphs") + 0.3 * F.col("japanese") + F.when(F.col("selected"), 600).otherwise(0) - 3200 * F.col("link_density")
    s = s - 0.6 * F.greatest(F.lit(0), F.col("chars") - 7000) - 80 * F.greatest(F.lit(0), F.col("links") - F.col("paragraphs") - 3)
    return c.select("id", F.round(s, 6).alias("score"))


def article_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stretches at the quarters of each import, by which a page's article is found again."""
    w = table(spark, sf_dir, "web_imports").where("body is not null").select("import_id", F.regexp_replace("body", r"\s+", "").alias("b"))
    cut = F.array(*(F.expr(f"substring(b, cast(floor(greatest(length(b) - 24, 0) * {q} / 4) as int) + 1, 24)") for q in range(5)))
    return w.select("import_id", F.array_join(F.array_distinct(cut), "|").alias("anchors"))


def dictionary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup keys of each lexicon entry, word with reading first, then parts."""
    x = C.lexicon(spark, sf_dir)
    parts = T.readings(F.col("reading"))
    keys = F.array_distinct(F.concat(F.transform(parts, lambda r: F.concat_ws("\t", F.col("surface"), r)), F.array("surface"), parts))
    return x.select("surface", F.posexplode(keys).alias("place", "key"))


def marked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded words of each document with their count and first place."""
    m = C.located(spark, sf_dir).where("jlpt_level > 0")
    return m.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "token_pos")).alias("f")).select("doc_id", "word", "n", F.col("f.line_no").alias("first_line"))


def recent_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's five latest words with their furthest value."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("unit")).where("unit is not null")
    u = e.groupBy("user_id", "unit").agg(F.max("ts").alias("last"), F.max(F.round("value", 6)).alias("furthest"))
    order = Window.partitionBy("user_id").orderBy(F.desc("last"), "unit")
    return u.withColumn("place", F.row_number().over(order)).where("place <= 5").select("user_id", "unit", "furthest", "place")


def _rows(rows: list[tuple], cols: str) -> str:
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") as t({cols})"


_stats = f"{CORE}, gs as (select word, coalesce(max(jl), 0) as level, count(*) as n, count(distinct title) as titles from (select loc.*, lex.jlpt_level as jl from loc left join lex on loc.word = lex.surface) group by word)"
SQL = {
    "word_shards": f"with {_stats} select word, level, n, titles, substring(sha256(word), 1, 2) as shard from gs",
    "exported_matches": f"with {_stats} select doc_id, line_no, count(*) as matches, string_agg(word, ' ' order by token_pos, start_pos, word) as words from mt where word in (select word from gs where level > 0 or n >= 2) group by doc_id, line_no",
    "removable_candidates": f"with {_stats} select word, n from gs where level = 0 and word not in (select word from word_examples where word is not null)",
    "imported_sources": f"""with {CORE} select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(file_name, '[^/]*$'), '\\.[^.]+$', ''), '^[0-9]+-|\\[[^\\]]*\\]', '', 'g'), '[_\\s]+', ' ', 'g')) as label, row_number() over (order by title nulls first, doc_id) as place from doc where source_type = 'text' and file_name like 'web/%.txt'""",
    "character_table": f"with {CORE}, d as (select * from doc where bangumi_id is not null and len(characters) > 0 qualify row_number() over (partition by bangumi_id order by loaded_at desc, doc_id) = 1) select distinct bangumi_id, name from (select bangumi_id, unnest(characters) as name from d) where trim(name) <> ''",
    "collected_shows": _rows([(1, "甲", "甲中", "2001-04-01", 2001, 5), (2, "Bangumi 2", "乙", "x", None, 2), (3, "丙", None, None, None, None)], "bangumi_id, title_jp, title_zh, air_date, air_year, ep_status"),
    "collected_tracks": _rows([("bangumi:3:subject", 3, "丙", "丙", None, None, None, None, 1), ("bangumi:2:ep:20", 2, "夜", "乙", "星野", 1, 1, 245000, 2), ("bangumi:2:ep:21", 2, "朝", "乙", "星野", 2, None, None, 3)], "track_key, bangumi_id, title, album, artist, track_number, disc, duration_ms, place"),
    "lyric_search_parameters": f"""with {CORE}, d as (select doc_id as track_key, artist, album from doc where source_type = 'lyrics'),
      n as (select track_key, album, unnest(list_append(list_filter(list_transform(regexp_split_to_array(artist, '(?i)\\s*(?:、|,|/|／|;|；|&|＆| feat\\.? | ft\\.? )\\s*'), lambda x: trim(x)), lambda x: x <> ''), artist)) as a from d where artist is not null),
      p as (select track_key, a, album from n union select track_key, a, null from n union select track_key, null, album from d union select track_key, null, null from d) select track_key, count(*) as searches from p group by track_key""",
    "model_answers": _rows([(0, "约 定", "x"), (1, "约定", 'y\\"z'), (2, None, None), (3, None, None)], "i, meaning, note"),
    "gloss_fields": _rows([(0, "约定，约会", "名词|他动", "やくそく"), (1, "水", "名词", ""), (2, "人", "名词", ""), (3, "约定", "", ""), (4, "高校", "", "こうこう|タカこう")], "i, gloss, labels, readings"),
    "wiktionary_glosses": _rows([(0, "水；液体"), (1, "约定；规则"), (2, ""), (3, "「手紙」"), (4, "说"), (5, ""), (6, ""), (7, "水")], "i, gloss"),
    "article_ranking": _rows([("a", 4080.0), ("b", -4020.0), ("c", 1415.0)], "id, score"),
    "article_anchors": f"""with w as (select import_id, regexp_replace(body, '\\s+', '', 'g') as b from web_imports where body is not null), e as (select import_id, q, substring(b, cast(floor(greatest(length(b) - 24, 0) * q / 4) as int) + 1, 24) as a from w, (values (0), (1), (2), (3), (4)) as t(q)),
      f as (select import_id, a, min(q) as q from e group by import_id, a) select import_id, string_agg(a, '|' order by q) as anchors from f group by import_id""",
    "dictionary_keys": f"""with {CORE}, r as (select surface, list_filter(list_transform(regexp_split_to_array(coalesce(reading, ''), '[;；、,]'), lambda x: trim(x)), lambda x: x <> '') as p from lex), k as (select surface, list_concat(list_transform(p, lambda x: surface || chr(9) || x), [surface], p) as k from r),
      e as (select surface, unnest(k) as key, generate_subscripts(k, 1) as i from k), f as (select surface, key, min(i) as i from e group by surface, key) select surface, cast(row_number() over (partition by surface order by i) - 1 as int) as place, key from f""",
    "marked_words": f"with {CORE} select doc_id, word, count(*) as n, min(line_no) as first_line from loc where jlpt_level > 0 group by doc_id, word",
    "recent_reading": """with e as (select user_id, ts, value, cast(json_extract_string(props, '$.k') as int) as unit from events), u as (select user_id, unit, max(ts) as last, max(round(value, 6)) as furthest from e where unit is not null group by user_id, unit)
      select user_id, unit, furthest, row_number() over (partition by user_id order by last desc, unit) as place from u qualify row_number() over (partition by user_id order by last desc, unit) <= 5""",
}
QUERIES = [word_shards, exported_matches, removable_candidates, imported_sources, character_table, collected_shows, collected_tracks, lyric_search_parameters, model_answers, gloss_fields, wiktionary_glosses, article_ranking, article_anchors, dictionary_keys, marked_words, recent_reading]
