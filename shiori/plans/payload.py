"""What the viewer is given: word payloads, word sets, albums, dictionary groups, names and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.functions import text as T
from shiori.operators import corpus as C
from shiori.operators.order import placed
from shiori.plans.words import CORE, STOPWORDS, TYPES
from shiori.session import small, table

LEVEL, ARTISTS, FORMS = 3, 16, 4
FNV_START, FNV_PRIME = 2166136261, 16777619


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: exported words, and the other candidates that were seen."""
    n = C.matches(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    lex = C.lexicon(spark, sf_dir).select(F.col("surface").alias("word"), "reading", "jlpt_level", "meaning")
    both = lex.join(n, "word", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.where(F.coalesce("jlpt_level", F.lit(0)).between(1, 5) | ((F.col("n") > 0) & ~F.col("word").isin(STOPWORDS)))


def first_glosses(meaning: Column, k: int = 3) -> Column:
    """The first glosses of a meaning, joined again."""
    parts = F.filter(F.transform(F.split(meaning, "[;；]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.slice(parts, 1, k), "; ")


def word_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target word with level, reading, meaning and counts by source type, 0 where it has none."""
    counts = C.located(spark, sf_dir).groupBy("word").agg(*(F.count_if(F.col("source_type") == t).alias(f"n_{t}") for t in TYPES))
    t = targets(spark, sf_dir).join(counts, "word", "left")
    return t.select("word", F.coalesce("reading", F.lit("")).alias("reading"), F.coalesce("jlpt_level", F.lit(0)).alias("level"), first_glosses(F.coalesce("meaning", F.lit(""))).alias("meaning"), "n", *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in TYPES))


def level_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: words of one level; ungraded candidates don't come with it."""
    return targets(spark, sf_dir).where(F.col("jlpt_level") == LEVEL).select("word", "n")


def candidate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counters over candidates and exported words. An entry's first meaning is what the
    dictionary gives; a meaning in ideographs is a Chinese one."""
    t = targets(spark, sf_dir)
    ex = table(spark, sf_dir, "word_examples").where("word is not null").select("word").distinct().withColumn("shown", F.lit(True))
    t = t.join(ex, "word", "left")
    seen = (F.col("n") > 0) & ~F.col("word").isin(STOPWORDS)
    known = F.col("meaning").isNotNull()
    exported = F.coalesce("jlpt_level", F.lit(0)).between(1, 5) | (F.col("n") >= 2)
    zh = F.coalesce(T.has_ideograph(F.col("meaning")) & ~T.has_kana(F.col("meaning")), F.lit(False))
    count = lambda c: F.count_if(c)
    return t.agg(
        count(seen).alias("corpus_candidate_word_count"), count(seen & known).alias("corpus_jmdict_match_count"), count(seen & ~known).alias("corpus_unmatched_word_count"),
        count(exported).alias("exported_word_count"), count(exported & known).alias("exported_jmdict_word_count"), count(exported & ~known).alias("exported_no_jmdict_word_count"),
        count(exported & F.coalesce("shown", F.lit(False))).alias("exported_dictionary_example_word_count"), count(exported & zh).alias("exported_zh_meaning_word_count"),
        count(exported & ~zh).alias("exported_missing_zh_meaning_word_count"), count(exported & known & ~zh).alias("exported_english_only_word_count"),
    )


def examples_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of each word of one source type, and of all."""
    e = table(spark, sf_dir, "word_examples").where("word is not null").groupBy("example_id").agg(F.min(F.struct("word", "source_type")).alias("e")).select("e.*")
    both = e.select("word", F.explode(F.array(F.lit("all"), F.coalesce("source_type", F.lit("none")))).alias("source_type"))
    return both.groupBy("word", "source_type").agg(F.count(F.lit(1)).alias("examples"))


def reader_word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the reader marks by each choice of words: all, graded ones, one level."""
    w = C.matches(spark, sf_dir).groupBy("doc_id", "word").agg(F.max("jlpt_level").alias("level"))
    level = F.coalesce("level", F.lit(0))
    sets = F.array(F.lit("all"), F.when(level > 0, "graded"), F.when(level > 0, F.concat(F.lit("N"), level.cast("string"))))
    return w.select("doc_id", F.explode(F.array_compact(sets)).alias("chosen")).groupBy("doc_id", "chosen").agg(F.count(F.lit(1)).alias("words"))


def compact_examples(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """The few fields of an example that a prompt gets, cut to length."""
    e = table(spark, sf_dir, "word_examples").where("sentence is not null").groupBy("example_id").agg(F.min(F.struct("word", "sentence", "source_title")).alias("e"))
    return e.select("example_id", "e.word", T.truncated(F.col("e.sentence"), limit).alias("sentence"), T.truncated(F.coalesce("e.source_title", F.lit("")), limit).alias("source"))


def annotation_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written forms of each word, itself among them."""
    m = table(spark, sf_dir, "matches").where("word is not null")
    return m.select("word", F.explode(F.array_compact(F.array("word", "matched_text"))).alias("surface")).distinct()


def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent written forms of a word, four at most, the first by order on ties."""
    n = C.matches(spark, sf_dir).where("matched_text is not null").groupBy("word", "matched_text").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("word").orderBy(F.desc("n"), "matched_text")
    return n.withColumn("place", F.row_number().over(by)).where(F.col("place") <= FORMS).select("word", "matched_text", "place")


def display_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings worth showing: not the word itself, nor its kana in the other script."""
    r = table(spark, sf_dir, "matches").where("word is not null and reading is not null").select("word", "reading").distinct()
    return r.where(T.to_hiragana(F.col("word")) != T.to_hiragana(F.col("reading")))


def kana_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in the order of their readings in hiragana, then of themselves."""
    key = T.to_hiragana(F.regexp_replace(F.coalesce("reading", "word"), "[^぀-ヿー㐀-鿿々]", ""))
    w = targets(spark, sf_dir).withColumn("key", key)
    return placed(w.select("word", "key"), {"head": F.left("key", F.lit(2))}, [F.col("key"), F.col("word")])


def album_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs of an album, and its distinct artists, sixteen at most."""
    d = C.documents(spark, sf_dir).where("source_type = 'lyrics' and album is not null")
    artists = d.where("artist is not null").select("album", "artist").distinct()
    few = artists.withColumn("k", F.row_number().over(Window.partitionBy("album").orderBy("artist"))).where(F.col("k") <= ARTISTS).groupBy("album").agg(F.array_join(F.array_sort(F.collect_list("artist")), "、").alias("artists"))
    return d.groupBy("album").agg(F.count_distinct("title").alias("tracks")).join(few, "album", "left").select("album", "tracks", F.coalesce("artists", F.lit("")).alias("artists"))


def album_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for an album: with each artist of its songs, and by name alone."""
    d = C.documents(spark, sf_dir).where("source_type = 'lyrics' and album is not null")
    return d.select("album", F.explode(F.array(F.coalesce("artist", F.lit("")), F.lit(""))).alias("artist")).distinct()


def lyric_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lyric documents with their track, joined by the track's key."""
    d = C.documents(spark, sf_dir).where("source_type = 'lyrics'")
    key = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("title", "artist")))
    tracks = d.groupBy(key.alias("track_key")).agg(F.min("album").alias("album"), F.count(F.lit(1)).alias("files"))
    return d.select("doc_id", key.alias("track_key")).join(tracks, "track_key")


def replaced_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deliveries of shows, with those delivered again put in by title in place of the old ones."""
    s = table(spark, sf_dir, "watched_shows").where("title_jp is not null")
    n = s.groupBy("bangumi_id").agg(F.min(F.struct("updated_at", "title_jp", "ep_status")).alias("a"), F.max(F.struct("updated_at", "title_jp", "ep_status")).alias("z"), F.count(F.lit(1)).alias("n"))
    old = n.select(F.col("a.title_jp").alias("title"), F.col("a.ep_status").alias("ep_status"), "bangumi_id")
    new = n.where("n > 1").select(F.col("z.title_jp").alias("title"), F.col("z.ep_status").alias("ep_status"), "bangumi_id")
    return old.join(new.select("title").distinct(), "title", "left_anti").unionByName(new)


def dictionary_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word's entries in the lists of each level as dictionaries, with the groups' order: those with a
    meaning first, then easier lists, then the first entry."""
    x = table(spark, sf_dir, "lexicon").where("surface is not null")
    g = x.groupBy("surface", "jlpt_level").agg(F.count(F.lit(1)).alias("entries"), F.count("meaning").alias("with_meaning"), F.min("entry_pos").alias("first_pos"))
    by = Window.partitionBy("surface").orderBy(F.desc(F.col("with_meaning") > 0), F.desc("jlpt_level"), "first_pos")
    return g.select("surface", "jlpt_level", "entries", F.row_number().over(by).alias("place"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for files: letters, digits and few signs kept; or only what file systems forbid replaced."""
    d = C.documents(spark, sf_dir).where("title is not null")
    strict = F.substring(F.regexp_replace(F.regexp_replace("title", r"[^A-Za-z0-9぀-ヿ㐀-鿿々._-]+", "_"), "^[_.]+|[_.]+$", ""), 1, 80)
    return d.select("doc_id", strict.alias("slug"), F.trim(F.regexp_replace("title", r'[\\/:*?"<>|]+', "_")).alias("name"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of cached searches: the hash of the sorted parameters."""
    d = C.documents(spark, sf_dir).where("source_type = 'lyrics'")
    part = lambda c: F.concat(F.lit(f"{c}="), F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " "))
    return d.select("doc_id", F.sha2(F.concat_ws("\n", *map(part, ("album", "artist", "title"))), 256).alias("cache_key"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the code points, as a number."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long"), F.lit(1 << 32).cast("long")))


def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a line's text in base 36."""
    t = C.lines(spark, sf_dir).where("text is not null").select("text").distinct()
    return t.select("text", F.lower(F.conv(fnv1a(F.col("text")).cast("string"), 10, 36)).alias("line_key"))


def page_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with plain blanks, single spaces and at most one empty line."""
    t = F.regexp_replace(F.regexp_replace("body", " ", " "), "[ \\t]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, " ?\\n ?", "\n"), "\\n{3,}", "\n\n")
    return table(spark, sf_dir, "web_imports").where("body is not null").select("import_id", F.length(F.trim(t)).alias("chars"))


def tags_removed(text: Column) -> Column:
    """Text of dictionary markup: block tags break lines, other tags go, blanks are collapsed, empty lines dropped."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?i)<(?:br|/?(?:p|div|li|tr|h[1-6]))\b[^>]*>", "\n"), "<[^>]+>", "")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def markup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A53 over every document, whose text stands for a record."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.length(tags_removed(F.col("text"))).alias("chars"))


def glossary_parts_of_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a word's parts of speech: the dictionary's if it has any, else the glossary's, four at most."""
    notes = spark.createDataFrame(NOTES, "word string, notes string, glossary string")
    take = lambda c: F.array_join(F.slice(F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != ""), 1, 4), "|")
    return notes.select("word", F.when(F.coalesce("notes", F.lit("")) != "", take("notes")).otherwise(take("glossary")).alias("pos"))


NOTES = [("見る", "他动词|一段", "动词"), ("水", None, "名词"), ("約束", "", "名词|他动|サ变|五|六"), ("無", None, None)]

_n = "n as (select word, count(*) as n from mt group by word)"
_tg = f"""{_n}, tg0 as (select coalesce(lex.surface, n.word) as word, reading, jlpt_level, meaning, coalesce(n, 0) as n from lex full outer join n on lex.surface = n.word),
tg as (select * from tg0 where coalesce(jlpt_level, 0) between 1 and 5 or (n > 0 and word not in ({", ".join(f"'{w}'" for w in STOPWORDS)})))"""
_stop = ", ".join(f"'{w}'" for w in STOPWORDS)
_hira = lambda c: f"translate({c}, '{T.KATA}', '{T.HIRA}')"
SQL = {
    "word_payload": f"""with {CORE}, {_tg}, c as (select word, {", ".join(f"count(*) filter (source_type = '{t}') as n_{t}" for t in TYPES)} from loc group by word)
      select tg.word, coalesce(reading, '') as reading, coalesce(jlpt_level, 0) as level, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(meaning, ''), '[;；]'), lambda x: trim(x)), lambda x: x <> '')[1:3], '; ') as meaning, n, {", ".join(f"coalesce(n_{t}, 0) as n_{t}" for t in TYPES)} from tg left join c on tg.word = c.word""",
    "level_words": f"with {CORE}, {_tg} select word, n from tg where jlpt_level = {LEVEL}",
    "candidate_coverage": f"""with {CORE}, {_tg}, t as (select tg.*, n > 0 and word not in ({_stop}) as seen, meaning is not null as known, coalesce(jlpt_level, 0) between 1 and 5 or n >= 2 as ex, word in (select word from word_examples where word is not null) as shown,
        coalesce(regexp_matches(meaning, '{T.IDEOGRAPH}') and not regexp_matches(meaning, '[぀-ヿ]'), false) as zh from tg)
      select count(*) filter (seen) as corpus_candidate_word_count, count(*) filter (seen and known) as corpus_jmdict_match_count, count(*) filter (seen and not known) as corpus_unmatched_word_count, count(*) filter (ex) as exported_word_count, count(*) filter (ex and known) as exported_jmdict_word_count,
        count(*) filter (ex and not known) as exported_no_jmdict_word_count, count(*) filter (ex and shown) as exported_dictionary_example_word_count, count(*) filter (ex and zh) as exported_zh_meaning_word_count, count(*) filter (ex and not zh) as exported_missing_zh_meaning_word_count, count(*) filter (ex and known and not zh) as exported_english_only_word_count from t""",
    "examples_by_type": """with e as (select min(row(word, source_type)) as e from word_examples where word is not null group by example_id), f as (select e[1] as word, coalesce(e[2], 'none') as source_type from e)
      select word, source_type, count(*) as examples from (select word, source_type from f union all select word, 'all' from f) group by word, source_type""",
    "reader_word_sets": f"""with {CORE}, w as (select doc_id, word, coalesce(max(jlpt_level), 0) as level from mt group by doc_id, word)
      select doc_id, chosen, count(*) as words from (select doc_id, 'all' as chosen from w union all select doc_id, 'graded' from w where level > 0 union all select doc_id, 'N' || level from w where level > 0) group by doc_id, chosen""",
    "compact_examples": """with e as (select example_id, min(struct_pack(w := word, s := sentence, t := source_title)) as e from word_examples where sentence is not null group by example_id), f as (select example_id, e.w as word, trim(e.s) as s, trim(coalesce(e.t, '')) as t from e)
      select example_id, word, case when length(s) > 20 then rtrim(left(s, 20)) || '...' else s end as sentence, case when length(t) > 20 then rtrim(left(t, 20)) || '...' else t end as source from f""",
    "annotation_surfaces": "select word, word as surface from matches where word is not null union select word, matched_text from matches where word is not null and matched_text is not null",
    "word_forms": f"""with {CORE}, c as (select word, matched_text, count(*) as n from mt where matched_text is not null group by word, matched_text)
      select word, matched_text, place from (select *, row_number() over (partition by word order by n desc, matched_text) as place from c) where place <= {FORMS}""",
    "display_readings": f"select distinct word, reading from matches where word is not null and reading is not null and {_hira('word')} <> {_hira('reading')}",
    "kana_order": f"""with {CORE}, {_tg}, k as (select word, {_hira("regexp_replace(coalesce(reading, word), '[^぀-ヿー㐀-鿿々]', '', 'g')")} as key from tg) select word, key, row_number() over (order by key, word) as place from k""",
    "album_tracks": f"""with {CORE}, d as (select * from doc where source_type = 'lyrics' and album is not null), a as (select distinct album, artist from d where artist is not null), f as (select album, artist from a qualify row_number() over (partition by album order by artist) <= {ARTISTS})
      select d.album, count(distinct title) as tracks, coalesce((select string_agg(artist, '、' order by artist) from f where f.album = d.album), '') as artists from d group by d.album""",
    "album_searches": f"with {CORE} select album, coalesce(artist, '') as artist from doc where source_type = 'lyrics' and album is not null union select album, '' from doc where source_type = 'lyrics' and album is not null",
    "lyric_tracks": f"""with {CORE}, d as (select doc_id, album, coalesce(title, '') || '|' || coalesce(artist, '') as track_key from doc where source_type = 'lyrics'), t as (select track_key, min(album) as album, count(*) as files from d group by track_key)
      select d.doc_id, t.* from d join t using (track_key)""",
    "replaced_shows": """with s as (select * from watched_shows where title_jp is not null), o as (select * from s qualify row_number() over (partition by bangumi_id order by updated_at nulls first, title_jp, ep_status nulls first) = 1),
      z as (select * from (select *, count(*) over (partition by bangumi_id) as n from s) where n > 1 qualify row_number() over (partition by bangumi_id order by updated_at desc nulls last, title_jp desc, ep_status desc nulls last) = 1)
      select title_jp as title, ep_status, bangumi_id from o where title_jp not in (select title_jp from z) union all select title_jp, ep_status, bangumi_id from z""",
    "dictionary_groups": """with g as (select surface, jlpt_level, count(*) as entries, count(meaning) as m, min(entry_pos) as p from lexicon where surface is not null group by surface, jlpt_level)
      select surface, jlpt_level, entries, row_number() over (partition by surface order by m > 0 desc, jlpt_level desc nulls last, p) as place from g""",
    "safe_names": f"""with {CORE} select doc_id, substring(regexp_replace(regexp_replace(title, '[^A-Za-z0-9぀-ヿ㐀-鿿々._-]+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 1, 80) as slug, trim(regexp_replace(title, '[\\\\/:*?"<>|]+', '_', 'g')) as name from doc where title is not null""",
    "cache_keys": f"""with {CORE} select doc_id, sha256(concat_ws(chr(10), {", ".join(f"'{c}=' || regexp_replace(lower(trim(coalesce({c}, ''))), '\\s+', ' ', 'g')" for c in ("album", "artist", "title"))})) as cache_key from doc where source_type = 'lyrics'""",
    "line_keys": f"""with {CORE}, t as (select distinct text from ln where text is not null), h as (select text, list_reduce(list_prepend({FNV_START}::bigint, list_transform(list_filter(regexp_extract_all(text, '(?s).'), lambda x: x <> ''), lambda x: unicode(x)::bigint)), lambda h, c: xor(h, c) * {FNV_PRIME} % 4294967296) as h from t)
      select text, lower(to_base(h, 36)) as line_key from h""",
    "page_blanks": "select import_id, cast(length(trim(regexp_replace(regexp_replace(regexp_replace(replace(body, chr(160), ' '), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) as int) as chars from web_imports where body is not null",
    "markup_lines": """with t as (select doc_id, regexp_replace(regexp_replace(text, '(?i)<(?:br|/?(?:p|div|li|tr|h[1-6]))\\b[^>]*>', chr(10), 'g'), '<[^>]+>', '', 'g') as t from documents where text is not null)
      select doc_id, cast(length(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))) as int) as chars from t""",
    "glossary_parts_of_speech": """with n as (select * from (values ('見る', '他动词|一段', '动词'), ('水', null, '名词'), ('約束', '', '名词|他动|サ变|五|六'), ('無', null, null)) as t(word, notes, glossary))
      select word, array_to_string(list_filter(string_split(case when coalesce(notes, '') <> '' then notes else coalesce(glossary, '') end, '|'), lambda x: x <> '')[1:4], '|') as pos from n""",
}
QUERIES = [word_payload, level_words, candidate_coverage, examples_by_type, reader_word_sets, compact_examples, annotation_surfaces, word_forms, display_readings, kana_order, album_tracks, album_searches, lyric_tracks, replaced_shows, dictionary_groups, safe_names, cache_keys, line_keys, page_blanks, markup_lines, glossary_parts_of_speech]
