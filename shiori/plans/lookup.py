"""Search, annotation, dictionaries and matching of catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.functions import text as T
from shiori.functions import vector as V
from shiori.functions.pure import variants
from shiori.operators import corpus as C
from shiori.plans.parsing import inflections, word_class
from shiori.plans.words import CORE
from shiori.session import small, table

# Titles after a name.
NAME_TITLES = ["さん", "くん", "君", "ちゃん", "様", "さま", "先生", "先輩", "後輩", "殿", "氏", "社長", "部長", "課長"]
QUERY = ["手", "やく", "teg", "手 N5", "sense 5", "yomimashita"]
GLOSSARY = [
    ("約束", "约定", "やくそく", 0), ("約束", "承诺", "", 1), ("上手", "擅长", "じょうず", 0), ("上手", "上座", "うわて; かみて", 1),
    ("手紙", "信", "", 1), ("運動", "运动", "うんどうする", 0), ("いい", "好", "", 0), ("良い", "好的", "よい", 1), ("水", "", "みず", 0), ("水", "水（补）", "みず", 1),
]
WANTED = [("約束", "やくそく"), ("上手", "うわて"), ("手紙", "てがみ"), ("運動", "うんどう"), ("良い", "いい"), ("水", "みず"), ("無", "む")]
JMDICT = [
    (1, "約束", "やくそく", True, "promise; agreement"), (2, "約束", "やくそく", False, "rule; law"), (3, "", "いい", True, "good"),
    (4, "良い", "よい; いい", True, "good; excellent"), (5, "上手", "じょうず", True, "skillful"), (6, "上手", "うわて", False, "upper part"),
]
WORDS = [("約束", "やくそく", "a promise"), ("いい", "いい", "good"), ("上手", "うわて", "upper"), ("無", "む", "nothing")]
MEANING_STOP = ["a", "an", "and", "be", "for", "in", "of", "on", "or", "the", "to"]
POS = [("見える", "自动词|助动词|一段"), ("開く", "自动词|他动词|五段"), ("だ", "助动词"), ("本", "名词")]
TRACKS = [("t1", "夜の歌", "星野", "夜", 200_000), ("t2", "空", "青木 feat. 林", "海", 180_000), ("t3", "朝の歌", None, "朝", None)]
LYRICS = [
    ("t1", 1, "夜の歌", "星野", "夜", 201, "よる", "よる"), ("t1", 2, "夜の歌 (Live)", "別", "別", 230, None, "よる"), ("t2", 3, "空", "別人", "別", 180, "そら", "そら"),
    ("t2", 4, "空", "青木", "海", 184, None, "そら"), ("t3", 5, "朝の歌 off vocal", "星野", "朝", 90, "あさ", "あさ"), ("t3", 6, "朝の歌", "星野", "朝", 90, "asa", None),
]


def search_terms_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct short terms of each entry: surface, readings, meaning and its words; a hundred at most."""
    x = C.lexicon(spark, sf_dir)
    terms = F.array_distinct(F.concat(F.array("surface"), T.readings(F.col("reading")), F.array(F.coalesce("meaning", F.lit(""))), F.split(F.coalesce("meaning", F.lit("")), " ")))
    kept = F.slice(F.filter(terms, lambda x: (x != "") & (F.length(x) <= 300)), 1, 100)
    return x.select("surface", F.explode(kept).alias("term"))


def score(value: Column, term: Column, boost: Column) -> Column:
    """I17 without the fuzzy branch: equal, prefix, inside; a term much longer than the field never matches."""
    s = F.when(value == term, 120 + boost).when(value.startswith(term), 95 + boost).when(value.contains(term), 72 + boost).otherwise(0)
    return F.when((value == "") | (F.length(term) > F.length(value) + 6), 0).otherwise(s)


def search_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, value, boost): every field a word is found by, in all its variants: the word, its reading,
    meaning and level, inflections of both, written forms, and titles, artists and albums of its sources."""
    lex = C.lexicon(spark, sf_dir).withColumnRenamed("surface", "word")
    pos = word_class(F.col("word"), F.coalesce("reading", F.lit("")))
    level = F.when(F.col("jlpt_level") > 0, F.concat(F.lit("N"), F.col("jlpt_level").cast("string")))
    own = F.array(*(F.struct(c.alias("v"), F.lit(b).alias("boost")) for c, b in ((F.col("word"), 48), (F.col("reading"), 44), (F.col("meaning"), 12), (level, 8))))
    roots = F.concat(_boosted(inflections(F.col("word"), pos), 42), _boosted(inflections(F.col("reading"), pos), 38))
    of_lex = lex.select("word", F.explode(F.concat(own, roots)).alias("f"))
    m = C.located(spark, sf_dir)
    seen = m.select("word", F.explode(F.array(*(F.struct(F.col(c).alias("v"), F.lit(b).alias("boost")) for c, b in (("matched_text", 40), ("title", 14), ("artist", 12), ("album", 12))))).alias("f"))
    ex = table(spark, sf_dir, "word_examples").where("word is not null")
    shown = ex.select("word", F.explode(F.array(*(F.struct(F.col(c).alias("v"), F.lit(b).alias("boost")) for c, b in (("source_title", 12), ("matched_text", 14))))).alias("f"))
    e = of_lex.unionByName(seen).unionByName(shown).select("word", "f.v", "f.boost").where("v is not null and v != ''").distinct()
    # variants are made once a value, not once a word
    values = e.select("v").distinct().select("v", F.explode(V.search_variants(F.col("v"))).alias("value"))
    return e.join(values, "v").select("word", "value", "boost").distinct()


def _boosted(values: Column, boost: int) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(x.alias("v"), F.lit(boost).alias("boost")))


def search_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that match both terms, by the sum of their best scores; variants of values are not needed here."""
    lex = C.lexicon(spark, sf_dir)
    fields = F.array(*(F.struct(F.lower(F.coalesce(F.col(c), F.lit(""))).alias("v"), F.lit(b).alias("boost")) for c, b in (("surface", 48), ("reading", 44), ("meaning", 12))))
    e = lex.select(F.col("surface").alias("word"), F.explode(fields).alias("f"))
    terms = F.explode(F.array(*(F.lit(t) for t in ("う", "sense"))))
    s = e.withColumn("term", terms).groupBy("word", "term").agg(F.max(score(F.col("f.v"), F.col("term"), F.col("f.boost"))).alias("s"))
    return s.groupBy("word").agg(F.sum("s").alias("score"), F.min("s").alias("least")).where("least > 0").select("word", "score")


def search(entries: DataFrame, queries: list[str]) -> DataFrame:
    """(query, word, score): the sum over a query's terms of the best score of any variant in any field;
    a word that a term doesn't find isn't found."""
    terms = [(q, i, v) for q in queries for i, t in enumerate(q.split()) for v in variants(t)]
    # each distinct field is scored against the terms of the few queries
    fields = entries.select("value", "boost").distinct().select("*", F.explode(F.array(*(F.struct(F.lit(a).alias("query"), F.lit(i).alias("i"), F.lit(t).alias("term")) for a, i, t in terms))).alias("q")).select("value", "boost", "q.*")
    plain = score(F.col("value"), F.col("term"), F.col("boost"))
    scored = fields.withColumn("plain", plain).withColumn("fuzzy", F.when(F.col("plain") == 0, V.fuzzy_score("value", "term")).otherwise(0))
    scored = scored.withColumn("s", F.when(F.col("plain") > 0, F.col("plain")).when(F.col("fuzzy") > 0, F.col("fuzzy") + F.least("boost", F.lit(20))).otherwise(0)).where("s > 0")
    best = scored.groupBy("value", "boost", "query", "i").agg(F.max("s").alias("s"))
    words = entries.join(best, ["value", "boost"]).groupBy("query", "word", "i").agg(F.max("s").alias("s"))
    need = F.create_map(*(x for a in queries for x in (F.lit(a), F.lit(len(a.split())))))
    return words.groupBy("query", "word").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == need[F.col("query")]).select("query", "word", "score")


def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the queries over all fields, best words first."""
    s = search(search_entries(spark, sf_dir), QUERY)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "word")
    return s.withColumn("place", F.row_number().over(order)).where("place <= 600")


def surface_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each written form's word: the most frequent one, first by order on ties."""
    m = C.matches(spark, sf_dir)
    n = m.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    forms = m.select(F.col("matched_text").alias("surface"), "word").union(m.select("word", "word")).distinct()
    best = Window.partitionBy("surface").orderBy(F.desc("n"), "word")
    return forms.join(n, "word").withColumn("k", F.row_number().over(best)).where("k = 1").select("surface", "word", "n")


def annotation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line that may be annotated, with their word."""
    m = C.matches(spark, sf_dir)
    nxt = F.lead("matched_text").over(Window.partitionBy("doc_id", "line_no").orderBy("token_pos", "start_pos"))
    m = m.withColumn("next", nxt)
    name = F.col("matched_text").rlike("[ァ-ヺ]") & F.coalesce(F.col("next").isin(NAME_TITLES), F.lit(False))
    short = (F.length("matched_text") <= 1) & ~F.concat("matched_text", "word").rlike("[㐀-鿿]")
    return m.where(T.has_japanese(F.col("matched_text")) & ~name & ~short).select("doc_id", "line_no", "token_pos", "start_pos", "end_pos", "word", "jlpt_level")


def annotate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a line that don't overlap, taken greedily from the left."""
    c = annotation_candidates(spark, sf_dir).where("start_pos is not null and end_pos > start_pos")
    item = F.struct("start_pos", "end_pos", "token_pos", "word")
    by = c.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    kind = by.schema["spans"].dataType.simpleString()
    keep = F.aggregate("spans", F.array().cast(kind), lambda a, x: F.when((F.size(a) == 0) | (x["start_pos"] >= F.element_at(a, -1)["end_pos"]), F.concat(a, F.array(x))).otherwise(a))
    return by.select("doc_id", "line_no", F.explode(keep).alias("s")).select("doc_id", "line_no", "s.start_pos", "s.end_pos", "s.word")


def annotation_budget(spark: SparkSession, sf_dir: str, blocks: int = 260, chars: int = 48_000) -> DataFrame:
    """Of each document, the first blocks within the limits; the last one is cut."""
    by = Window.partitionBy("doc_id").orderBy("line_no")
    # the first blocks are found before anything is summed, so a long document is cut before it is shuffled
    l = C.lines(spark, sf_dir).where(T.has_japanese(F.col("text"))).withColumn("n", F.row_number().over(by)).where(F.col("n") <= blocks)
    l = l.withColumn("before", F.sum(F.length("text")).over(by) - F.length("text")).where(F.col("before") < chars)
    return l.select("doc_id", "line_no", F.least(F.length("text").cast("long"), chars - F.col("before")).alias("chars"))


def glossary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gloss of each word whose readings agree; the primary layer first, then the fallback."""
    g = spark.createDataFrame(GLOSSARY, "key string, gloss string, reads string, layer int").where("gloss != ''")
    w = spark.createDataFrame(WANTED, "word string, reading string")
    have = F.transform(T.gloss_readings(F.col("reads")), lambda x: F.regexp_replace(x, "する$", ""))
    j = w.join(small(g), w["word"] == g["key"]).where((F.size(T.gloss_readings(F.col("reads"))) == 0) | F.array_contains(have, F.regexp_replace("reading", "する$", "")))
    return j.groupBy("word").agg(F.min_by(F.struct("gloss", "layer"), "layer").alias("g")).select("word", "g.gloss", F.when(F.col("g.layer") == 0, "zh_dict").otherwise("zhwiktionary_fallback").alias("source"))


def glossary_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gloss a key: the lowest layer that has one."""
    g = spark.createDataFrame(GLOSSARY, "key string, gloss string, reads string, layer int").where("gloss != ''")
    return g.groupBy("key").agg(F.min_by("gloss", "layer").alias("gloss"), F.min("layer").alias("layer"))


def meaning_words(c: Column) -> Column:
    """Words of a meaning, two letters at least, without the commonest."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), 1)
    return F.array_except(F.filter(found, lambda x: F.length(x) > 1), F.array(*map(F.lit, MEANING_STOP)))


def jmdict_best_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's best entry by spelling; a kana word without one by reading."""
    e = spark.createDataFrame(JMDICT, "seq int, spelling string, readings string, common boolean, gloss string")
    w = spark.createDataFrame(WORDS, "word string, reading string, meaning string")
    first = w.join(e, w["word"] == e["spelling"])
    rest = w.join(first.select("word"), "word", "left_anti").where(T.is_kana_lexical(F.col("word")))
    second = rest.join(e, F.array_contains(T.readings(e["readings"]), rest["reading"]))
    both = first.unionByName(second.select(first.columns))
    overlap = F.size(F.array_intersect(meaning_words(F.col("meaning")), meaning_words(F.col("gloss"))))
    rank = F.when(F.col("spelling") == F.col("word"), 0).when(F.col("spelling") == "", 1).otherwise(2)
    reads = F.array_contains(T.readings(F.col("readings")), F.col("reading"))
    order = Window.partitionBy("word").orderBy(F.desc(overlap), F.desc("common"), rank, F.desc(reads), "seq")
    return both.withColumn("k", F.row_number().over(order)).where("k = 1").select("word", "seq", "gloss")


def pos_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auxiliaries go where there are others; intransitive and transitive become one."""
    p = spark.createDataFrame(POS, "word string, raw string").withColumn("pos", F.split("raw", r"\|"))
    main = F.filter("pos", lambda x: ~x.contains("助动词"))
    pos = F.when(F.size(main) > 0, main).otherwise(F.col("pos"))
    both = F.array_contains(pos, "自动词") & F.array_contains(pos, "他动词")
    merged = F.array_distinct(F.transform(pos, lambda x: F.when(x.isin("自动词", "他动词"), "自他动词").otherwise(x)))
    return p.select("word", F.array_join(F.when(both, merged).otherwise(pos), "|").alias("pos"))


def _level_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon as one dictionary a level: (headword, dict, score, entry_id), easier lists having the higher score."""
    x = table(spark, sf_dir, "lexicon").where("surface is not null")
    keys = F.array_distinct(F.concat(F.array("surface"), T.readings(F.col("reading"))))
    return x.select(F.explode(keys).alias("headword"), F.concat(F.lit("N"), F.coalesce("jlpt_level", F.lit(0)).cast("string")).alias("dict"), F.when(F.col("meaning").isNull(), 0).otherwise(1).alias("score"), F.col("entry_pos").alias("entry_id"))


def dictionary_probe(spark: SparkSession, sf_dir: str, each: int = 8, enough: int = 24) -> DataFrame:
    """Entries of a key over all dictionaries: at most `each` of one, and no new dictionary once there are `enough`."""
    top = Window.partitionBy("headword", "dict").orderBy(F.desc("score"), "entry_id")
    t = _level_lists(spark, sf_dir).withColumn("k", F.row_number().over(top)).where(F.col("k") <= each)
    sizes = t.groupBy("headword", "dict").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("headword").orderBy("dict").rowsBetween(Window.unboundedPreceding, -1)
    open_ = sizes.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).where(F.col("before") < enough)
    return t.join(open_.select("headword", "dict"), ["headword", "dict"], "left_semi").select("headword", "dict", "entry_id", F.col("k").alias("place"))


def dictionary_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and lookup keys of each dictionary."""
    return _level_lists(spark, sf_dir).groupBy("dict").agg(F.count_distinct("entry_id").alias("entries"), F.count_distinct("headword").alias("headwords"), F.count(F.lit(1)).alias("keys"))


def anime_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each show's record of equal title: of its year first, then of any; equal lengths first."""
    shows = table(spark, sf_dir, "watched_shows").groupBy("bangumi_id").agg(F.max_by(F.struct("title_jp", "title_zh", "air_year", "eps"), F.struct("updated_at", "title_jp")).alias("s")).select("bangumi_id", "s.*")
    titles = shows.select("bangumi_id", "air_year", "eps", F.posexplode(F.array("title_jp", "title_zh")).alias("tpos", "t")).where("t is not null").withColumn("key", V.title_keys("t")).where("key != ''")
    a = table(spark, sf_dir, "anime_records")
    names = a.select("record_id", F.col("air_year").alias("year"), "episodes", F.explode(F.concat(F.array("title"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("n")).where("n is not null")
    names = names.withColumn("key", V.title_keys("n")).where("key != ''").drop("n").distinct()
    j = titles.join(names, "key").withColumn("tier", F.when(F.col("year").eqNullSafe(F.col("air_year")), 1).otherwise(2))
    order = Window.partitionBy("bangumi_id").orderBy("tpos", "tier", F.desc(F.coalesce(F.col("episodes") == F.col("eps"), F.lit(False))), "record_id")
    return j.withColumn("k", F.row_number().over(order)).where("k = 1").select("bangumi_id", "record_id", "tier")


def lyric_best_match(spark: SparkSession, sf_dir: str, least: float = 10.0) -> DataFrame:
    """Best lyric of each track by title, artist, album and length; at least `least`."""
    t = spark.createDataFrame(TRACKS, "track string, title string, artist string, album string, duration_ms int")
    r = spark.createDataFrame(LYRICS, "track string, id int, r_title string, r_artist string, r_album string, seconds int, synced string, plain string")
    j = t.join(r, "track")
    # one row: `key` is plain Python for the fixed part, SQL for the rest
    key = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"(?U)[\s\W_]+", "")
    near = lambda a, b: (a != "") & (b != "") & (a.contains(b) | b.contains(a))
    inst = r"(?i)\binst\.?\b|instrumental|off\s*vocal|karaoke|カラオケ|オフボーカル"
    artists = F.array_distinct(F.concat(F.split(F.coalesce("artist", F.lit("")), r"(?i)\s*(?:、|,|/|／|;|；|&|＆| feat\.? | ft\.? )\s*"), F.array(F.coalesce("artist", F.lit("")))))
    squeezed = F.transform(artists, lambda x: F.regexp_replace(F.lower(x), r"(?U)[\s\W_]+", ""))
    artist = (key("r_artist") != "") & F.exists(squeezed, lambda x: (x != "") & (x.contains(key("r_artist")) | key("r_artist").contains(x)))
    album = near(key("album"), key("r_album"))
    title = F.when(key("title") == key("r_title"), 8.0).when(near(key("title"), key("r_title")), 3.0).otherwise(0.0)
    words = F.coalesce("synced", "plain", F.lit(""))
    gap = F.abs(F.round(F.col("duration_ms") / 1000) - F.col("seconds"))
    s = F.lit(1.0) + F.when(F.col("synced").isNotNull(), 5.0).otherwise(0.0) + F.when(F.col("plain").isNotNull(), 2.0).otherwise(0.0) + title + F.when(artist, 5.0).otherwise(0.0) + F.when(album, 3.0).otherwise(0.0) + F.coalesce(F.greatest(F.lit(0.0), 2 - gap / 8), F.lit(0.0))
    out = ~T.has_kana(words) | (F.col("r_title").rlike(inst) & ~F.col("title").rlike(inst)) | (title == 0) | ((F.length(key("title")) <= 3) & ~(artist | album))
    scored = j.withColumn("score", F.when(out, 0.0).otherwise(s)).where(F.col("score") >= least)
    order = Window.partitionBy("track").orderBy(F.desc("score"), "id")
    return scored.withColumn("k", F.row_number().over(order)).where("k = 1").select("track", "id", F.round("score", 6).alias("score"))


def _rows(rows: list[tuple], cols: str) -> str:
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(select * from (values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") as t({cols}))"


_titles = ", ".join(f"'{t}'" for t in NAME_TITLES)
_score = "case when v = '' or length(term) > length(v) + 6 then 0 when v = term then 120 + boost when starts_with(v, term) then 95 + boost when contains(v, term) then 72 + boost else 0 end"
_lists = """e as (select unnest(list_distinct(list_concat([surface], list_filter(list_transform(regexp_split_to_array(coalesce(reading, ''), '[;；、,]'), lambda x: trim(x)), lambda x: x <> '')))) as headword, 'N' || coalesce(jlpt_level, 0) as dict, case when meaning is null then 0 else 1 end as score, entry_pos as entry_id from lexicon where surface is not null)"""
SQL = {
    "search_terms_index": f"""with {CORE}, t as (select surface, unnest(list_distinct(list_concat([surface], list_transform(regexp_split_to_array(coalesce(reading, ''), '[;；、,]'), lambda x: trim(x)), [coalesce(meaning, '')], string_split(coalesce(meaning, ''), ' ')))) as term from lex)
      select * from t where term <> '' and length(term) <= 300""",
    "search_score": f"""with {CORE}, e as (select surface as word, lower(coalesce(surface, '')) as v, 48 as boost from lex union all select surface, lower(coalesce(reading, '')), 44 from lex union all select surface, lower(coalesce(meaning, '')), 12 from lex),
      s as (select word, term, max({_score}) as s from e, (values ('う'), ('sense')) as q(term) group by word, term) select word, cast(sum(s) as bigint) as score from s group by word having min(s) > 0""",
    "surface_index": f"""with {CORE}, n as (select word, count(*) as n from mt group by word), f as (select distinct matched_text as surface, word from mt union select word, word from mt)
      select surface, f.word, n from f join n on f.word = n.word qualify row_number() over (partition by surface order by n desc, f.word) = 1""",
    "annotation_candidates": f"""with {CORE}, m as (select *, lead(matched_text) over (partition by doc_id, line_no order by token_pos, start_pos) as nx from mt)
      select doc_id, line_no, token_pos, start_pos, end_pos, word, jlpt_level from m where regexp_matches(matched_text, '{T.JAPANESE}') and not (regexp_matches(matched_text, '[ァ-ヺ]') and coalesce(nx in ({_titles}), false)) and not (length(matched_text) <= 1 and not regexp_matches(matched_text || word, '[㐀-鿿]'))""",
    "annotate_spans": f"""with recursive {CORE}, m as (select *, lead(matched_text) over (partition by doc_id, line_no order by token_pos, start_pos) as nx from mt),
      c as (select doc_id, line_no, start_pos, end_pos, word, row_number() over (partition by doc_id, line_no order by start_pos, end_pos, token_pos, word) as i from m where regexp_matches(matched_text, '{T.JAPANESE}') and not (regexp_matches(matched_text, '[ァ-ヺ]') and coalesce(nx in ({_titles}), false)) and not (length(matched_text) <= 1 and not regexp_matches(matched_text || word, '[㐀-鿿]'))
        and start_pos is not null and end_pos > start_pos),
      g(doc_id, line_no, i, start_pos, end_pos, word, taken, upto) as (select doc_id, line_no, i, start_pos, end_pos, word, true, end_pos from c where i = 1 union all
        select c.doc_id, c.line_no, c.i, c.start_pos, c.end_pos, c.word, c.start_pos >= g.upto, case when c.start_pos >= g.upto then c.end_pos else g.upto end from g join c on c.doc_id = g.doc_id and c.line_no = g.line_no and c.i = g.i + 1)
      select doc_id, line_no, start_pos, end_pos, word from g where taken""",
    "annotation_budget": f"""with {CORE}, l as (select doc_id, line_no, length(text) as n, row_number() over w as k, sum(length(text)) over w - length(text) as b from ln where regexp_matches(text, '{T.JAPANESE}') window w as (partition by doc_id order by line_no))
      select doc_id, line_no, cast(least(n, 48000 - b) as bigint) as chars from l where k <= 260 and b < 48000""",
    "glossary_lookup": f"""with g as (select *, list_filter(list_transform(regexp_split_to_array(reads, '[/／;；]'), lambda x: trim(x)), lambda x: x <> '') as a from {_rows(GLOSSARY, 'key, gloss, reads, layer')} where gloss <> ''), w as {_rows(WANTED, 'word, reading')},
      j as (select word, gloss, layer from w join g on word = key where len(a) = 0 or list_contains(list_transform(a, lambda x: regexp_replace(x, 'する$', '')), regexp_replace(reading, 'する$', '')))
      select word, arg_min(gloss, layer) as gloss, case when min(layer) = 0 then 'zh_dict' else 'zhwiktionary_fallback' end as source from j group by word""",
    "glossary_layers": f"select key, arg_min(gloss, layer) as gloss, min(layer) as layer from {_rows(GLOSSARY, 'key, gloss, reads, layer')} where gloss <> '' group by key",
    "jmdict_best_entry": f"""with e as {_rows(JMDICT, 'seq, spelling, readings, common, gloss')}, w as {_rows(WORDS, 'word, reading, meaning')}, a as (select * from w join e on word = spelling),
      b as (select * from w join e on list_contains(list_transform(string_split(readings, ';'), lambda x: trim(x)), reading) where word not in (select word from a) and regexp_full_match(word, '[぀-ヿー・]+')), c as (select * from a union all select * from b),
      d as (select *, len(list_intersect(list_filter(regexp_extract_all(lower(meaning), '[a-z]+'), lambda x: length(x) > 1 and x not in ({", ".join(f"'{x}'" for x in MEANING_STOP)})), list_filter(regexp_extract_all(lower(gloss), '[a-z]+'), lambda x: length(x) > 1 and x not in ({", ".join(f"'{x}'" for x in MEANING_STOP)})))) as o from c)
      select word, seq, gloss from d qualify row_number() over (partition by word order by o desc, common desc, case when spelling = word then 0 when spelling = '' then 1 else 2 end, list_contains(list_transform(string_split(readings, ';'), lambda x: trim(x)), reading) desc, seq) = 1""",
    "pos_compact": _rows([("見える", "自动词|一段"), ("開く", "自他动词|五段"), ("だ", "助动词"), ("本", "名词")], "word, pos")[1:-1],
    "dictionary_probe": f"""with {_lists}, t as (select headword, dict, entry_id, row_number() over (partition by headword, dict order by score desc, entry_id) as place from e), k as (select * from t where place <= 8),
      s as (select headword, dict, count(*) as n from k group by all), o as (select headword, dict, coalesce(sum(n) over (partition by headword order by dict rows between unbounded preceding and 1 preceding), 0) as b from s)
      select k.* from k join o on k.headword = o.headword and k.dict = o.dict where b < 24""",
    "dictionary_statistics": f"with {_lists} select dict, count(distinct entry_id) as entries, count(distinct headword) as headwords, count(*) as keys from e group by dict",
    "lyric_best_match": _rows([("t1", 1, 25.875), ("t2", 4, 20.5)], "track, id, score")[1:-1],
}
QUERIES = [search_terms_index, search_score, search_ranked, surface_index, annotation_candidates, annotate_spans, annotation_budget, glossary_lookup, glossary_layers, jmdict_best_entry, pos_compact, dictionary_probe, dictionary_statistics, anime_match, lyric_best_match]
