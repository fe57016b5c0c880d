"""Entries of user dictionaries: definitions, tags and references; and tagged tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.operators import corpus as C
from shiori.operators import tagged
from shiori.plans.words import CORE, EXCLUDED_POS, STOPWORDS, study_candidate

# Words that are no definitions, and marks of entries that only refer to another.
NOISE = ["Wiktionary", "Kaikki", "|", "词源", "n", "v", "vi", "vt", "adj", "adv", "intj", "godan", "non-lemma", "sl", "alt-of", "alternative kanji"]
ALIKE, FORWARD = ["alt-of", "alternative kanji"], "redirected from"
ENTRIES = [
    (1, "約束", "n, vs", ["1. 约定。\n2. 规定．\n例"], 5), (2, "約束", "n", ["やくそく： 约定 "], 3), (3, "焔", "non-lemma", ["alternative kanji", "炎"], 0), (4, "観る", "non-lemma;v", ["alt-of", "見る"], 0),
    (5, "ミル", "non-lemma", ["redirected from 見る", "見る"], 0), (6, "水", "n", ["Wiktionary", "3 例", "water"], 1), (7, "火", "", ["比喻：热情"], 2), (8, "木", None, [], 0), (9, "約束する", "v", ["to promise"], 9),
]
ENTRY = "entry_id int, headword string, tags string, glossary array<string>, score int"


def tags_of(c: Column) -> Column:
    """Distinct tags, split at blanks and marks."""
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), r"[\s,;]+"), lambda x: x != ""))


def definitions(c: Column) -> Column:
    """The numbered definitions of a text, or the text as one unless it is a note; a headword before it goes."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    numbered = F.transform(F.filter(lines, lambda x: x.rlike(r"^\d+[.．]\s*\S")), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\d+[.．]\s*", ""), "[。．.]+$", ""))
    whole = F.trim(F.regexp_replace(c, r"\s+", " "))
    note = whole.isin("", *NOISE) | whole.rlike(r"^\d+\s*例$") | whole.contains(FORWARD)
    body = F.regexp_replace(whole, "^(?=[^：]*[぀-ヿ])[^：]{1,24}：\\s*(?=\\S)", "")
    return F.array_distinct(F.when(F.size(numbered) > 0, F.filter(numbered, lambda x: x != "")).when(note, F.array().cast("array<string>")).otherwise(F.array(body)))


def entries(raw: DataFrame) -> DataFrame:
    """Each entry with its tags, definitions and kind: a definition, a reference to another spelling or
    entry; those that only lead on, and those that say nothing, go."""
    e = raw.withColumn("tag_list", tags_of(F.col("tags")))
    marks = F.filter("glossary", lambda g: g.isin(ALIKE) | g.contains(FORWARD))
    e = e.withColumn("marks", marks).withColumn("defs", F.array_distinct(F.flatten(F.transform("glossary", definitions))))
    refers = F.array_contains("tag_list", "non-lemma")
    e = e.where(~(refers & F.exists("marks", lambda m: m.contains(FORWARD))))
    kind = F.when(refers & (F.size("defs") > 0), F.when(F.array_contains("marks", "alternative kanji"), "spelling").otherwise("see_also")).otherwise("definition")
    return e.withColumn("kind", kind).where((F.size("defs") > 0) | (F.size("tag_list") > 0))


def dictionary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A34, A35, C37, I78, I79."""
    e = entries(spark.createDataFrame(ENTRIES, ENTRY))
    return e.select("entry_id", "headword", F.array_join("tag_list", "|").alias("tags"), F.array_join("defs", "|").alias("defs"), "kind")


def dictionary_pruned(spark: SparkSession, sf_dir: str, wanted: str = "約束") -> DataFrame:
    """Where a wanted headword is defined, definitions of other headwords go; references stay."""
    e = entries(spark.createDataFrame(ENTRIES, ENTRY))
    found = e.where((F.col("kind") == "definition") & (F.col("headword") == wanted)).limit(1).select(F.lit(True).alias("found"))
    j = e.join(F.broadcast(found), F.lit(True), "left")
    return j.where(F.col("found").isNull() | (F.col("kind") != "definition") | (F.col("headword") == wanted)).select("entry_id", "headword", "kind")


def tagged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the matches as a tagger gives them (ungraded words are names): words by base, with
    their part of speech and whether they are study words."""
    m = C.matches(spark, sf_dir).where("matched_text is not null")
    name = F.coalesce(F.col("jlpt_level") == 0, F.lit(False))
    raw = m.select(F.col("matched_text").alias("surface"), F.col("word").alias("orth_base"), F.col("reading").alias("kana"), F.lit("名詞").alias("pos1"), F.when(name, "固有名詞").otherwise("*").alias("pos2"))
    t = tagged.words(raw)
    c = t.groupBy("base", "pos_detail").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("pos"))
    return c.select("base", "pos_detail", "n", study_candidate(F.col("base"), F.col("pos"), F.col("pos_detail")).alias("candidate"))


def _inline() -> str:
    cell = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "[" + ", ".join(map(cell, v)) + "]::varchar[]" if isinstance(v, list) else "'" + v.replace("\n", "' || chr(10) || '") + "'"
    return "(select * from (values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in ENTRIES) + ") as t(entry_id, headword, tags, glossary, score))"


_noise = ", ".join(f"'{n}'" for n in NOISE)
_entries = f"""g as (select entry_id, unnest(glossary) as g, generate_subscripts(glossary, 1) as i from {_inline()}),
l as (select *, list_filter(list_transform(string_split(g, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: regexp_matches(x, '^\\d+[.．]\\s*\\S')) as numbered, trim(regexp_replace(g, '\\s+', ' ', 'g')) as whole from g),
d as (select entry_id, i, case when len(numbered) > 0 then list_transform(numbered, lambda x: regexp_replace(regexp_replace(x, '^\\d+[.．]\\s*', ''), '[。．.]+$', '')) when whole in ('', {_noise}) or regexp_matches(whole, '^\\d+\\s*例$') or contains(whole, '{FORWARD}') then []
  when regexp_matches(regexp_extract(whole, '^([^：]{{1,24}})：\\s*\\S', 1), '[぀-ヿ]') then [regexp_replace(whole, '^[^：]{{1,24}}：\\s*', '')] else [whole] end as ds from l),
da as (select entry_id, flatten(list(ds order by i)) as defs from d group by entry_id),
e as (select t.entry_id, headword, list_filter(regexp_split_to_array(coalesce(tags, ''), '[\\s,;]+'), lambda x: x <> '') as tl, coalesce(defs, []) as defs, list_filter(glossary, lambda x: x in ('alt-of', 'alternative kanji') or contains(x, '{FORWARD}')) as mk from {_inline()} t left join da on t.entry_id = da.entry_id),
en as (select *, case when list_contains(tl, 'non-lemma') and len(defs) > 0 then case when list_contains(mk, 'alternative kanji') then 'spelling' else 'see_also' end else 'definition' end as kind from e
  where not (list_contains(tl, 'non-lemma') and len(list_filter(mk, lambda x: contains(x, '{FORWARD}'))) > 0) and (len(defs) > 0 or len(tl) > 0))"""
SQL = {
    "dictionary_entries": f"with {_entries} select entry_id, headword, array_to_string(tl, '|') as tags, array_to_string(defs, '|') as defs, kind from en",
    "dictionary_pruned": f"with {_entries} select entry_id, headword, kind from en where not exists (select 1 from en where kind = 'definition' and headword = '約束') or kind <> 'definition' or headword = '約束'",
    "tagged_candidates": f"""with {CORE}, t as (select coalesce(nullif(nullif(word, ''), '*'), trim(matched_text)) as base, case when jlpt_level = 0 then '名詞-固有名詞' else '名詞' end as pos_detail from mt where matched_text is not null and regexp_matches(trim(matched_text), '[぀-ヿ㐀-鿿々〆ヵヶ]'))
      select base, pos_detail, count(*) as n, pos_detail not like '%固有名詞%' and '名詞' not in ({", ".join(f"'{x}'" for x in EXCLUDED_POS)}) and base not in ({", ".join(f"'{w}'" for w in STOPWORDS)}) as candidate from t group by base, pos_detail""",
}
QUERIES = [dictionary_entries, dictionary_pruned, tagged_candidates]
