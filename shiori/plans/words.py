"""Word statistics, lexicon resolution and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.functions import text as T
from shiori.operators import corpus as C
from shiori.session import small, table
from shiori.sources.lexicons import LEXICON, OVERRIDES, READING_OVERRIDES, with_overrides

# Words too common to study, and parts of speech that are no study words.
STOPWORDS = [
    "ある", "いる", "する", "なる", "ない", "これ", "それ", "あれ", "この", "その", "あの", "ここ", "そこ", "あそこ", "どこ", "何",
    "はい", "いいえ", "そう", "どう", "もう", "また", "まだ", "ずっと", "もっと", "とても", "こと", "もの", "よう", "ため", "はず", "わけ",
    "つもり", "お", "ご", "さん", "ちゃん", "くん", "たち", "うん", "ああ", "あ", "え", "ん", "あっ", "まあ",
]
EXCLUDED_POS = ["助詞", "助動詞", "補助記号", "代名詞", "接続詞", "接頭辞", "接尾辞", "感動詞", "連体詞"]
TYPES = ["subtitle", "lyrics", "text"]

#: SQL of the core tables, for the oracles.
CORE = """
doc as (select * from documents_src qualify row_number() over (partition by doc_id order by loaded_at nulls first, source_ord nulls first) = 1),
ln as (select doc_id, line_no, min(text) as text, min(start_ms) as start_ms, min(end_ms) as end_ms from lines group by doc_id, line_no),
mt as (select distinct * from matches),
loc as (select m.*, d.source_ord, d.source_type, d.title, d.file_name, d.artist, d.album, d.episode from mt m join doc d using (doc_id)),
lex as (select * from lexicon where surface is not null qualify row_number() over (partition by surface order by jlpt_level desc nulls last, entry_pos) = 1)
"""


def study_candidate(base: Column, pos: Column, detail: Column) -> Column:
    """Not an excluded part of speech, proper noun or stop word; a null part of speech passes."""
    return ~F.coalesce(pos.isin(EXCLUDED_POS), F.lit(False)) & ~F.coalesce(detail.contains("固有名詞"), F.lit(False)) & ~base.isin(STOPWORDS)


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and distinct tokens by source type, all tokens counted."""
    t = C.tokens(C.lines(spark, sf_dir)).join(C.documents(spark, sf_dir).select("doc_id", "source_type"), "doc_id")
    return t.groupBy("source_type").agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("surface").alias("distinct_tokens"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token with its place."""
    return C.tokens(C.lines(spark, sf_dir))


def word_frequency_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most frequent words; ungraded words come last of a count."""
    m = C.matches(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("jlpt_level").alias("level"))
    order = F.when(F.col("level") == 0, 9).otherwise(F.col("level"))
    return m.orderBy(F.desc("n"), order, "word").limit(50)


def word_counts_by_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count column a source type."""
    m = C.located(spark, sf_dir)
    cols = [F.count_if(F.col("source_type") == t).alias(f"n_{t}") for t in TYPES]
    return m.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *cols)


def word_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of a word by count, first seen first on ties."""
    each = C.located(spark, sf_dir).groupBy("word", "title").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    order = Window.partitionBy("word").orderBy(F.desc("n"), "first_seq")
    return each.select("word", "title", "n", F.row_number().over(order).alias("place"))


def graded_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word with level, count, titles, lines and source types. The flagship."""
    lex = C.lexicon(spark, sf_dir).select(F.col("surface").alias("word"), F.col("jlpt_level").alias("lex_level"), "meaning")
    cols = [F.count_if(F.col("source_type") == t).alias(f"n_{t}") for t in TYPES]
    # aggregate first: the join then has a row a word
    stats = C.located(spark, sf_dir).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("title").alias("titles"), F.count_distinct("doc_id").alias("files"), *cols
    )
    return stats.join(small(lex), "word", "left").select("word", F.coalesce("lex_level", F.lit(0)).alias("level"), "meaning", "n", "titles", "files", *(f"n_{t}" for t in TYPES))


def display_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry's reading, else the most frequent one seen, first seen on ties."""
    seen = C.located(spark, sf_dir).where("reading is not null").groupBy("word", "reading").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    best = Window.partitionBy("word").orderBy(F.desc("n"), "first_seq")
    mode = seen.withColumn("k", F.row_number().over(best)).where("k = 1").select("word", F.col("reading").alias("seen_reading"), "n")
    lex = C.lexicon(spark, sf_dir).select(F.col("surface").alias("word"), F.col("reading").alias("lex_reading"))
    return mode.join(small(lex), "word", "left").select("word", F.coalesce("lex_reading", "seen_reading").alias("reading"), "n")


def level_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct surfaces a level, every listed level counting."""
    return table(spark, sf_dir, "lexicon").groupBy("jlpt_level").agg(F.count_distinct("surface").alias("listed"))


def level_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a level's words that were seen; 0 for an empty level."""
    words = C.matches(spark, sf_dir).select("word").distinct()
    seen = C.lexicon(spark, sf_dir).join(words, F.col("surface") == F.col("word"), "left_semi").groupBy("jlpt_level").agg(F.count(F.lit(1)).alias("seen"))
    all_ = level_totals(spark, sf_dir)
    return all_.join(seen, "jlpt_level", "left").select(F.col("jlpt_level").alias("level"), "listed", F.coalesce("seen", F.lit(0)).alias("seen"), F.round(F.coalesce(F.col("seen") / F.col("listed"), F.lit(0.0)), 6).alias("coverage"))


def show_stats_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, matches, words and matches a level of each title."""
    files = C.documents(spark, sf_dir).groupBy("title").agg(F.count(F.lit(1)).alias("files"))
    cols = [F.count_if(F.col("jlpt_level") == k).alias(f"n{k}") for k in range(5, 0, -1)]
    hits = C.located(spark, sf_dir).groupBy("title").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("word").alias("words"), *cols)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ["hits", "words", *(f"n{k}" for k in range(5, 0, -1))]]
    return files.join(hits, files["title"].eqNullSafe(hits["title"]), "left").select(files["title"], "files", *zero)


def lexicon_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11."""
    return C.lexicon(spark, sf_dir).select("surface", "reading", "jlpt_level", "entry_pos")


def reading_index_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E12, I25."""
    return C.reading_index(C.lexicon(spark, sf_dir))


def resolve_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct token with its word: by surface, else (kana only) by reading, fixed readings first, else itself ungraded."""
    lex = C.lexicon(spark, sf_dir)
    t = C.tokens(C.lines(spark, sf_dir)).groupBy("surface").agg(F.count(F.lit(1)).alias("n"))
    by_surface = lex.select("surface", F.col("surface").alias("w1"), F.col("jlpt_level").alias("l1"))
    fixed = spark.createDataFrame(READING_OVERRIDES, "key string, surface string").join(lex.select("surface", "jlpt_level"), "surface").select("key", "surface", "jlpt_level")
    index = fixed.unionByName(C.reading_index(lex).select("key", "surface", "jlpt_level").join(fixed.select("key"), "key", "left_anti"))
    by_reading = index.select(F.col("key").alias("hira"), F.col("surface").alias("w2"), F.col("jlpt_level").alias("l2"))
    t = t.withColumn("hira", F.when(~T.has_ideograph(F.col("surface")), T.to_hiragana(F.col("surface"))))
    r = t.join(small(by_surface), "surface", "left").join(small(by_reading), "hira", "left")
    return r.select("surface", F.coalesce("w1", "w2", "surface").alias("word"), F.coalesce("l1", "l2", F.lit(0)).alias("level"), "n")


def override_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4."""
    return with_overrides(table(spark, sf_dir, "lexicon").select(*[c.split()[0] for c in LEXICON.split(", ")])).select("surface", "reading", "jlpt_level")


def study_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are no stop words, with counts; rejected ones count in the totals all the same."""
    m = C.matches(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    return m.withColumn("candidate", study_candidate(F.col("word"), none, none))


def embedded_katakana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katakana matches that stand in a longer katakana run."""
    m = C.matches(spark, sf_dir).where(T.is_katakana_word(F.col("matched_text")) & T.is_katakana_word(F.col("word")))
    j = m.join(C.lines(spark, sf_dir).select("doc_id", "line_no", "text"), ["doc_id", "line_no"])
    left, right = T.char_at(F.col("text"), F.col("start_pos") - 1), T.char_at(F.col("text"), F.col("end_pos"))
    return j.where(left.rlike(T.KATAKANA) | right.rlike(T.KATAKANA)).select("doc_id", "line_no", "token_pos", "word")


def aliases(docs: DataFrame) -> DataFrame:
    """(doc_id, alias) of the characters: name parts, family endings and their tokens, no stop words."""
    parts = docs.select("doc_id", F.explode("characters").alias("name")).select("doc_id", F.explode(F.split("name", r"[\s　・･/／、，,（）()\[\]【】]+")).alias("part"))
    parts = parts.where((F.col("part") != "") & T.has_japanese(F.col("part")))
    tail = F.substring("part", -2, 2)
    ends = parts.where((F.length("part") >= 4) & T.all_ideographs(tail)).select("doc_id", tail.alias("alias"))
    runs = parts.select("doc_id", F.explode(T.tokens(F.col("part"))).alias("alias")).where(F.length("alias") >= 2)
    every = parts.select("doc_id", F.col("part").alias("alias")).unionByName(ends).unionByName(runs).distinct()
    return every.where(~F.col("alias").isin(STOPWORDS))


def character_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: matches whose text or word is a character's alias in the document."""
    a = aliases(C.documents(spark, sf_dir))
    m = C.matches(spark, sf_dir).select("doc_id", "line_no", "token_pos", "word", "matched_text")
    keys = m.select("doc_id", "line_no", "token_pos", "word", F.explode(F.array_distinct(F.array("word", "matched_text"))).alias("alias"))
    return keys.join(a, ["doc_id", "alias"], "left_semi").select("doc_id", "line_no", "token_pos", "word").distinct()


def zero_count_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lexicon word with its count, unseen ones with 0."""
    n = C.matches(spark, sf_dir).groupBy(F.col("word").alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    return C.lexicon(spark, sf_dir).join(n, "surface", "left").select("surface", "jlpt_level", F.coalesce("n", F.lit(0)).alias("n"))


def export_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon and seen words in export order, with their place."""
    n = C.matches(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    lex = C.lexicon(spark, sf_dir).select(F.col("surface").alias("word"), "jlpt_level")
    both = lex.join(n, "word", "full_outer").select("word", F.coalesce("jlpt_level", F.lit(0)).alias("level"), F.coalesce("n", F.lit(0)).alias("n"))
    # a global place needs a total order: one task sees counts of groups, not words
    key = F.struct((-F.col("n")).alias("a"), F.when(F.col("level") == 0, 9).otherwise(F.col("level")).alias("b"))
    keyed = both.withColumn("k", key)
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    start = sizes.select("k", (F.sum("size").over(Window.orderBy("k")) - F.col("size")).alias("start"))
    inside = keyed.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("word")))
    return inside.join(start, "k").select("word", "level", "n", (F.col("start") + F.col("i")).alias("place"))


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals."""
    m = C.located(spark, sf_dir).agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("word").alias("words"), F.count_distinct("title").alias("titles_with_matches"))
    d = C.documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("bangumi_id").alias("shows"))
    l = C.lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0))).alias("tokens"))
    one = lambda x: x.withColumn("one", F.lit(1))
    return one(m).join(one(d), "one").join(one(l), "one").drop("one")


def word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by source type and level with subtotals."""
    r = C.located(spark, sf_dir).rollup("source_type", "jlpt_level").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
    return r.select(F.coalesce("source_type", F.lit("all")).alias("source_type"), F.coalesce("jlpt_level", F.lit(-1)).alias("level"), "gid", "n")


J = T.JAPANESE
_stop = ", ".join(f"'{w}'" for w in STOPWORDS)
_types = ", ".join(f"count(*) filter (source_type = '{t}') as n_{t}" for t in TYPES)
SQL = {
    "token_totals": f"with {CORE}, t as (select doc_id, unnest(regexp_extract_all(text, '{J}+')) as surface from ln) select source_type, count(*) as tokens, count(distinct surface) as distinct_tokens from t join doc using (doc_id) group by source_type",
    "token_offsets": f"""with {CORE}, t as (select doc_id, line_no, text, regexp_extract_all(text, '{J}+') as a, regexp_split_to_array(text, '{J}+') as b from ln where text is not null),
      u as (select doc_id, line_no, a, b, unnest(range(0, len(a))) as p from t)
      select doc_id, line_no, cast(p as int) as token_pos, a[p + 1] as surface,
        cast(length(array_to_string(b[1:p + 1], '')) + length(array_to_string(a[1:p], '')) as int) as start_pos,
        cast(length(array_to_string(b[1:p + 1], '')) + length(array_to_string(a[1:p + 1], '')) as int) as end_pos from u""",
    "word_frequency_top": f"with {CORE} select word, count(*) as n, max(jlpt_level) as level from mt group by word order by n desc, case when max(jlpt_level) = 0 then 9 else max(jlpt_level) end, word limit 50",
    "word_counts_by_source_type": f"with {CORE} select word, count(*) as n, {_types} from loc group by word",
    "word_source_counts": f"""with {CORE}, e as (select word, title, count(*) as n, min(row(source_ord, doc_id, line_no, token_pos)) as f from loc group by word, title)
      select word, title, n, row_number() over (partition by word order by n desc, f) as place from e""",
    "graded_word_stats": f"""with {CORE}, s as (select word, count(*) as n, count(distinct title) as titles, count(distinct doc_id) as files, {_types} from loc group by word)
      select word, coalesce(jlpt_level, 0) as level, meaning, n, titles, files, n_subtitle, n_lyrics, n_text from s left join lex on word = surface""",
    "display_reading": f"""with {CORE}, e as (select word, reading, count(*) as n, min(row(source_ord, doc_id, line_no, token_pos)) as f from loc where reading is not null group by word, reading),
      b as (select * from e qualify row_number() over (partition by word order by n desc, f) = 1)
      select b.word, coalesce(lex.reading, b.reading) as reading, b.n from b left join lex on b.word = lex.surface""",
    "level_totals": "select jlpt_level, count(distinct surface) as listed from lexicon group by jlpt_level",
    "level_coverage": f"""with {CORE}, a as (select jlpt_level, count(distinct surface) as listed from lexicon group by jlpt_level),
      s as (select jlpt_level, count(*) as seen from lex where surface in (select word from mt) group by jlpt_level)
      select a.jlpt_level as level, listed, coalesce(seen, 0) as seen, round(coalesce(seen / listed, 0.0), 6) as coverage from a left join s on a.jlpt_level = s.jlpt_level""",
    "show_stats_by_level": f"""with {CORE}, f as (select title, count(*) as files from doc group by title),
      h as (select title, count(*) as hits, count(distinct word) as words, {", ".join(f"count(*) filter (jlpt_level = {k}) as n{k}" for k in range(5, 0, -1))} from loc group by title)
      select f.title, files, {", ".join(f"coalesce({c}, 0) as {c}" for c in ["hits", "words", "n5", "n4", "n3", "n2", "n1"])} from f left join h on f.title is not distinct from h.title""",
    "lexicon_dedupe": f"with {CORE} select surface, reading, jlpt_level, entry_pos from lex",
    "reading_index_unique": f"""with {CORE}, e as (select surface, jlpt_level, trim(unnest(regexp_split_to_array(coalesce(reading, ''), '[;；、,]'))) as key from lex)
      select key, min(surface) as surface, min(jlpt_level) as jlpt_level from e where key <> '' group by key having count(distinct surface) = 1""",
    "resolve_tokens": f"""with {CORE}, t as (select surface, count(*) as n from (select unnest(regexp_extract_all(text, '{J}+')) as surface from ln) group by surface),
      e as (select surface, jlpt_level, trim(unnest(regexp_split_to_array(coalesce(reading, ''), '[;；、,]'))) as key from lex),
      o as (select key, o.surface as w2, jlpt_level as l2 from (values {", ".join(f"('{a}', '{b}')" for a, b in READING_OVERRIDES)}) as o(key, surface) join lex on lex.surface = o.surface),
      r as (select * from o union all select key, min(surface) as w2, min(jlpt_level) as l2 from e where key <> '' and key not in (select key from o) group by key having count(distinct surface) = 1)
      select t.surface, coalesce(lex.surface, w2, t.surface) as word, coalesce(lex.jlpt_level, l2, 0) as level, n from t left join lex on t.surface = lex.surface
      left join r on not regexp_matches(t.surface, '{T.IDEOGRAPH}') and translate(t.surface, '{T.KATA}', '{T.HIRA}') = key""",
    "override_append": f"""select surface, reading, jlpt_level from lexicon union all select * from (values {", ".join(f"('{a}', '{b}', {c})" for a, b, c, _ in OVERRIDES)}) as o(surface, reading, jlpt_level)
      where surface not in (select surface from lexicon where surface is not null)""",
    "study_candidates": f"with {CORE} select word, count(*) as n, word not in ({_stop}) as candidate from mt group by word",
    "embedded_katakana": f"""with {CORE}, m as (select mt.*, ln.text from mt join ln using (doc_id, line_no) where regexp_full_match(matched_text, '{T.KATAKANA}+') and regexp_full_match(word, '{T.KATAKANA}+'))
      select doc_id, line_no, token_pos, word from m where (start_pos > 0 and regexp_matches(substring(text, start_pos, 1), '{T.KATAKANA}')) or regexp_matches(substring(text, end_pos + 1, 1), '{T.KATAKANA}')""",
    "character_rejections": f"""with {CORE}, n as (select doc_id, unnest(characters) as name from doc),
      p as (select doc_id, unnest(regexp_split_to_array(name, '[\\s　・･/／、，,（）()\\[\\]【】]+')) as part from n),
      q as (select * from p where part <> '' and regexp_matches(part, '{J}')),
      a as (select doc_id, part as alias from q union select doc_id, right(part, 2) from q where length(part) >= 4 and regexp_full_match(right(part, 2), '[㐀-鿿々]+')
            union select doc_id, alias from (select doc_id, unnest(regexp_extract_all(part, '{J}+')) as alias from q) where length(alias) >= 2)
      select distinct m.doc_id, line_no, token_pos, word from mt m join a on m.doc_id = a.doc_id and (word = alias or matched_text = alias) where alias not in ({_stop})""",
    "zero_count_lexicon": f"with {CORE}, c as (select word, count(*) as n from mt group by word) select surface, jlpt_level, coalesce(n, 0) as n from lex left join c on surface = word",
    "export_words": f"""with {CORE}, c as (select word, count(*) as n from mt group by word),
      b as (select coalesce(word, surface) as word, coalesce(jlpt_level, 0) as level, coalesce(n, 0) as n from c full outer join lex on word = surface)
      select word, level, n, row_number() over (order by n desc, case when level = 0 then 9 else level end, word) as place from b""",
    "corpus_summary": f"""with {CORE} select (select count(*) from loc) as matches, (select count(distinct word) from loc) as words, (select count(distinct title) from loc) as titles_with_matches,
      (select count(*) from doc) as documents, (select count(distinct bangumi_id) from doc) as shows, (select count(*) from ln) as lines, (select cast(sum(coalesce(len(regexp_extract_all(text, '{J}+')), 0)) as bigint) from ln) as tokens""",
    "word_rollup": f"""with {CORE} select coalesce(source_type, 'all') as source_type, coalesce(jlpt_level, -1) as level, grouping(source_type, jlpt_level) as gid, count(*) as n from loc group by rollup (source_type, jlpt_level)""",
}
QUERIES = [token_totals, token_offsets, word_frequency_top, word_counts_by_source_type, word_source_counts, graded_word_stats, display_reading, level_totals, level_coverage, show_stats_by_level, lexicon_dedupe, reading_index_unique, resolve_tokens, override_append, study_candidates, embedded_katakana, character_rejections, zero_count_lexicon, export_words, corpus_summary, word_rollup]
