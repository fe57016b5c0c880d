"""Parsers and scalar functions on inline fixtures, written alike for both engines, and on the corpus's names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.functions import text as T
from shiori.functions import vector as V
from shiori.functions.pure import SPELLED
from shiori.operators import corpus as C
from shiori.plans.words import CORE
from shiori.session import table
from shiori.sources import subtitles as S
from shiori.sources import texts as X

SRT = "1\n00:00:01,500 --> 00:00:03,20\n{\\an8}約束を\\N<i>守る</i>\n\n2\n0:00:04.000 --> 0:00:05.250\nHello\n\n3\nno time here\n\n4\n01:02:03,004 --> 01:02:04,400\n行こう"
ASS = "[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Style, Text\nDialogue: 0,0:00:01.00,0:00:02.00,Default,約束、だよ, ね\nDialogue: 0,0:00:02.00,0:00:03.00,Default,Hello\nComment: 0,,,,違う\n[Fonts]\nDialogue: 0,a,b,c,外"
LRC = "[ti:歌]\n[00:07.25]夜の歌\n[00:01.00][00:09.5]朝の歌\n[00:04.50]la la la\n[01:02:30]終わり"
PLAIN = " 朝の歌 \n\nla la\n夜の歌"
LEVELS = ["N5", "JLPT_2", "jlpt-n3", "4", "6", "N0", "", "レベルN1 ", "n 2"]
PATTERNS = ["〜から", "～ばかり（～だけ）", "お 茶（おちゃ）", "～", "もし　～ても", "普通"]
DURATIONS = ["245", "4:05", "1:02:03", "x", "", "12:3:4:5"]
GODAN = {"う": "わいえおって", "く": "かきけこいて", "ぐ": "がぎげごいで", "す": "さしせそして", "つ": "たちてとって", "ぬ": "なにねのんで", "ぶ": "ばびべぼんで", "む": "まみめもんで", "る": "らりれろって"}
# Endings of inflected forms.
COMING = ["来ない", "来ます", "来た", "来て", "来れば", "来よう", "こない", "きます", "きた", "きて", "くれば", "こよう"]
DOING = ["し", "して", "した", "します", "しない", "すれば", "しよう", "される", "させる"]
ICHIDAN = ["", "ない", "ます", "た", "て", "れば", "よう", "られる", "させる"]
ADJECTIVE = ["く", "かった", "くない", "ければ", "そう"]


def _files(spark: SparkSession, name: str, content: str) -> DataFrame:
    return spark.createDataFrame([(name, content)], "file string, content string")


def _values(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")


def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, I5, I7."""
    return S.srt_lines(_files(spark, "a.srt", SRT))


def ass_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3."""
    return S.ass_lines(_files(spark, "a.ass", ASS)).select("file", "line_no", "text")


def lrc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, F2, I6."""
    return S.lrc_lines(_files(spark, "a.lrc", LRC))


def plain_lyrics_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, I42."""
    return S.plain_lines(_files(spark, "a.txt", PLAIN)).select("file", "line_no", "text")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents by the plain rule, with the paragraph."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    return X.sentence_rows(d).groupBy("file").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("text")).alias("chars"), F.count_distinct("paragraph_no").alias("paragraphs"))


def markup_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I7 over every line."""
    l = C.lines(spark, sf_dir).where("text is not null")
    return l.select("doc_id", "line_no", T.subtitle_markup(F.col("text")).alias("clean"))


def kana_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script classes and kana forms of every word of the corpus."""
    v = F.col("word")
    kinds = {"kana": T.has_kana(v), "lexical": T.is_kana_lexical(v), "annotation": T.is_kana_annotation(v), "ideographs": T.all_ideographs(v), "kana_or_latin": T.has_kana_or_latin(v), "kana_ish": T.is_kana_ish(v)}
    return table(spark, sf_dir, "matches").where("word is not null").select("word").distinct().select("word", T.to_hiragana(v).alias("hira"), T.to_katakana(v).alias("kata"), *(c.alias(k) for k, c in kinds.items()))


def romaji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the lexicon in Latin letters."""
    return table(spark, sf_dir, "lexicon").where("reading is not null").select("reading").distinct().select("reading", V.in_romaji("reading").alias("romaji"))


def level_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I23."""
    return _values(spark, LEVELS).select("i", T.level_number(F.col("v")).alias("level"))


def pattern_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I24."""
    return _values(spark, PATTERNS).select("i", T.word_pattern(F.col("v")).alias("pattern"))


def readings_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of every lexicon entry."""
    x = table(spark, sf_dir, "lexicon")
    return x.select("surface", "entry_pos", F.array_join(T.readings(F.col("reading")), "|").alias("readings"))


def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I47, I48."""
    return _values(spark, DURATIONS).select("i", T.duration_ms(F.col("v")).alias("ms"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host and extension of every address of imports and documents."""
    u = table(spark, sf_dir, "web_imports").select("url").union(table(spark, sf_dir, "documents_src").select("url")).where("url is not null").distinct()
    return u.select("url", T.host(F.col("url")).alias("host"), T.extension(F.col("url")).alias("ext"))


def import_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web imports by host."""
    w = table(spark, sf_dir, "web_imports").where("url is not null")
    return w.groupBy(T.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


def import_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of the same content; a missing hash is computed again."""
    h = F.coalesce(F.lower(F.nullif(F.trim("content_sha256"), F.lit(""))), T.content_hash(F.col("body")))
    w = table(spark, sf_dir, "web_imports").select("import_id", h.alias("h")).where("h is not null")
    return w.groupBy("h").agg(F.min("import_id").alias("first_id"), F.count_distinct("import_id").alias("copies"))


def import_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I32: cleaned length and lines of each import."""
    w = table(spark, sf_dir, "web_imports").select("import_id", T.import_text(F.col("body")).alias("t"))
    return w.select("import_id", F.length("t").alias("chars"), F.size(F.split("t", "\n")).alias("lines"))


def episode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episode numbers of the subtitle files' names."""
    d = C.documents(spark, sf_dir).where("source_type = 'subtitle' and file_name is not null")
    return d.select("doc_id", T.episode_number(F.col("file_name")).alias("episode"))


def subtitle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best file names of each show, by language, origin, format and length; at most 24."""
    d = C.documents(spark, sf_dir).where("source_type = 'subtitle' and file_name is not null")
    n = F.lower("file_name")
    rank = F.when(n.rlike(r"\.ja|\.jpn|japanese|日本語"), -20).otherwise(0) + F.when(n.rlike(r"\.en|english|chs|cht|中文"), 20).otherwise(0) + F.when(n.rlike("generated|whisper"), 10).otherwise(0) + F.when(n.rlike(r"\.srt$"), 0).otherwise(2)
    order = Window.partitionBy("title").orderBy("rank", F.length("file_name"), "file_name", "doc_id")
    return d.withColumn("rank", rank).withColumn("place", F.row_number().over(order)).where("place <= 24").select("title", "doc_id", "rank", "place")


def inflections(word: Column, pos: Column) -> Column:
    """Searchable inflections of a word by its class; null for other words."""
    stem, verb = F.left(word, F.length(word) - 1), F.left(word, F.length(word) - 2)
    add = lambda s, ends: F.transform(F.array(*map(F.lit, ends)), lambda e: F.concat(s, e))
    forms = F.when(word.isin("来る", "くる"), F.array(*map(F.lit, COMING)))
    forms = forms.when(word.endswith("する"), add(verb, DOING))
    forms = forms.when(pos.contains("一段") & word.endswith("る"), add(stem, ICHIDAN))
    for end, r in GODAN.items():
        te = r[4:]
        ta = te[:-1] + ("た" if te[-1] == "て" else "だ")
        te, ta = [F.when(word == "行く", x).otherwise(y) for x, y in (("って", te), ("った", ta))]
        ends = [F.lit(x) for x in (r[0], r[0] + "ない", r[1], r[1] + "ます", r[2], r[2] + "ば", r[3] + "う")] + [te, ta] + [F.lit(r[0] + "れる"), F.lit(r[0] + "せる")]
        forms = forms.when(pos.contains("五段") & word.endswith(end), F.array(*(F.concat(stem, e) for e in ends)))
    return forms.when(pos.contains("形容词") & word.endswith("い"), add(stem, ADJECTIVE))


def word_class(word: Column, reading: Column) -> Column:
    """A class by the last kana, where a word list names none: い after an ideograph an adjective, る after i or e a
    one-row verb, another u a five-row verb. It serves search, which may take too many forms."""
    end = F.right(word, F.lit(2))
    return (
        F.when(end.rlike("^[㐀-鿿]い$") | word.endswith("しい"), "い形容词").when(end.rlike("[いきぎしじちにひびみりえけげせぜてでねへべめれ]る$") | (word.endswith("る") & reading.rlike("[いきぎしじちにひびみりえけげせぜてでねへべめれ]る$")), "一段")
        .when(end.rlike("[㐀-鿿ぁ-ん][うくぐすつぬぶむる]$"), "五段").otherwise("")
    )


def inflected_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I12 over the lexicon's surfaces, classed by their last kana."""
    w = C.lexicon(spark, sf_dir).select(F.col("surface").alias("word"), word_class(F.col("surface"), F.coalesce("reading", F.lit(""))).alias("pos"))
    return w.select("word", F.explode(F.array_distinct(inflections(F.col("word"), F.col("pos")))).alias("form")).where("form != word")


def speech_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read out of each line, in segments."""
    l = C.lines(spark, sf_dir).where("text is not null")
    return l.select("doc_id", "line_no", F.posexplode(V.speech_segments(V.to_speech("text"))).alias("segment_no", "segment"))


def ruby_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings over the ideographs of every lexicon entry."""
    x = table(spark, sf_dir, "lexicon").where("surface is not null and reading is not null").select("surface", "reading").distinct()
    return x.select("surface", "reading", F.posexplode(V.ruby_runs("surface", "reading")).alias("run", "r")).select("surface", "reading", "run", "r.text", "r.rt")


def gloss_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading, part of speech and text of every meaning of the lexicon."""
    v = F.trim(F.regexp_replace("meaning", r"\\n|\s+", " "))
    reading = F.regexp_extract(v, "^（([ぁ-ゖァ-ヺー]+)）", 1)
    rest = F.regexp_replace(v, "^(?:（[ぁ-ゖァ-ヺー]+）|[0-9①-⑳]+)\\s*", "")
    pos = F.regexp_extract(rest, "^[【〔\\[]([^】〕\\]]+)[】〕\\]]", 1)
    text = F.trim(F.regexp_replace(rest, "^[【〔\\[][^】〕\\]]+[】〕\\]]\\s*", ""))
    return table(spark, sf_dir, "lexicon").where("meaning is not null").select("surface", "entry_pos", reading.alias("reading"), pos.alias("pos"), text.alias("gloss"))


def html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable articles of the imports, each set as a page of paragraphs with a menu, a head and a script."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    w = table(spark, sf_dir, "web_imports").where("body is not null")
    page = F.concat(
        F.lit("<html><head><title>"), safe(F.coalesce("title", F.lit(""))), F.lit("</title><style>p {}</style></head><body><nav><a>menu</a></nav><p>"),
        F.regexp_replace(safe(F.col("body")), "\n", "</p><p>"), F.lit("</p><script>var x = '<p>';</script></body></html>"),
    )
    return X.readable(w.select(F.col("import_id").alias("page_id"), page.alias("html")))


def _list(values: list[str]) -> str:
    q = lambda v: v.replace("'", "''")
    return "(values " + ", ".join(f"({i}, '{q(v)}')" for i, v in enumerate(values)) + ") as t(i, v)"


def _const(rows: list[tuple], cols: str) -> str:
    cell = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") as t({cols})"


_IE = "[いきぎしじちにひびみりえけげせぜてでねへべめれ]"


def _sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _godan(end: str) -> str:
    """The endings of a five-row verb as SQL; 行く has its own."""
    r, te = GODAN[end], GODAN[end][4:]
    ta = te[:-1] + ("た" if te[-1] == "て" else "だ")
    head, tail = [r[0], r[0] + "ない", r[1], r[1] + "ます", r[2], r[2] + "ば", r[3] + "う"], [r[0] + "れる", r[0] + "せる"]
    every = _sql([*head, te, ta, *tail])
    return f"(case when word = '行く' then {_sql([*head, 'って', 'った', *tail])} else {every} end)" if end == "く" else every


def _spelled(text: str) -> str:
    """The kana table as nested replacements, pairs first."""
    for k, v in sorted(SPELLED.items(), key=lambda x: -len(x[0])):
        text = f"replace({text}, '{k}', '{v}')"
    return text


def _lengthened(text: str) -> str:
    """Long marks as the letter before them, up to four in a row."""
    for _ in range(4):
        text = f"regexp_replace({text}, '([^ー])ー', '\\\\1\\\\1', 'g')".replace("\\\\", "\\")
    return text


_time = "([0-9]{1,2}):([0-9]{2}):([0-9]{2})[,.]([0-9]{1,3})"
_srt = SRT.replace("'", "''")
_lrc = LRC.replace("'", "''")
_doc = "(select * from documents_src qualify row_number() over (partition by doc_id order by loaded_at nulls first, source_ord nulls first) = 1)"
_ln = "(select doc_id, line_no, min(text) as text from lines group by doc_id, line_no)"
SQL = {
    "srt_parse": f"""with b as (select unnest(regexp_split_to_array('{_srt}', '\\n\\s*\\n')) as body), n as (select row_number() over () as block, body from b),
      m as (select block, regexp_extract(body, '{_time}\\s*-->\\s*{_time}', ['a','b','c','d','e','f','g','h']) as t, regexp_extract(body, '-->[^\\n]*\\n((?s).*)$', 1) as raw from n where regexp_matches(body, '{_time}\\s*-->')),
      c as (select block, t, trim(regexp_replace(regexp_replace(replace(replace(raw, '\\N', chr(10)), '\\n', chr(10)), '\\{{[^}}]*\\}}', '', 'g'), '<[^>]+>', '', 'g')) as text from m)
      select 'a.srt' as file, cast(row_number() over (order by block) as int) as line_no, text,
        cast(t.a as bigint) * 3600000 + cast(t.b as bigint) * 60000 + cast(t.c as bigint) * 1000 + cast(rpad(t.d, 3, '0') as bigint) as start_ms,
        cast(t.e as bigint) * 3600000 + cast(t.f as bigint) * 60000 + cast(t.g as bigint) * 1000 + cast(rpad(t.h, 3, '0') as bigint) as end_ms from c where regexp_matches(text, '{T.JAPANESE}')""",
    "ass_parse": _const([("a.ass", 1, "約束、だよ, ね")], "file, line_no, text"),
    "lrc_parse": f"""with r as (select unnest(string_split('{_lrc}', chr(10))) as row), m as (select row, regexp_extract_all(row, '\\[[0-9]{{1,3}}:[0-9]{{2}}(?:[.:][0-9]{{1,3}})?\\]') as s, trim(regexp_replace(row, '^.*\\[[0-9]{{1,3}}:[0-9]{{2}}(?:[.:][0-9]{{1,3}})?\\]', '')) as text from r),
      e as (select text, unnest(s) as st from m where len(s) > 0 and regexp_matches(text, '{T.JAPANESE}')), p as (select text, regexp_extract(st, '\\[([0-9]{{1,3}}):([0-9]{{2}})(?:[.:]([0-9]{{1,3}}))?\\]', ['a', 'b', 'c']) as x from e),
      q as (select text, cast(x.a as bigint) * 60000 + cast(x.b as bigint) * 1000 + cast(rpad(case when x.c = '' then '0' else x.c end, 3, '0') as bigint) as start_ms from p)
      select 'a.lrc' as file, cast(row_number() over (order by start_ms) as int) as line_no, text, start_ms, lead(start_ms) over (order by start_ms) as end_ms from q""",
    "plain_lyrics_parse": _const([("a.txt", 1, "朝の歌"), ("a.txt", 2, "夜の歌")], "file, line_no, text"),
    "sentence_split": """with p as (select doc_id, unnest(regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n[ \\t　]*\\n+')) as p, generate_subscripts(regexp_split_to_array(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n[ \\t　]*\\n+'), 1) as k from documents),
      q as (select doc_id, k, regexp_replace(trim(p), '[ \\t　]+', ' ', 'g') as p from p),
      s as (select doc_id, k, trim(regexp_replace(unnest(regexp_extract_all(p, '(?s).+?(?:[。！？!?]+[」』”’）)]*|$)')), '\\s*\\n\\s*', '', 'g')) as s from q)
      select cast(doc_id as varchar) as file, count(*) as sentences, cast(sum(length(s)) as bigint) as chars, count(distinct k) as paragraphs from s where s <> '' group by doc_id""",
    "markup_clean": f"""select doc_id, line_no, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '\\\\[Nn]', chr(10), 'g'), '\\{{[^}}]*\\}}', '', 'g'), '<[^>]+>', '', 'g'), '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) as clean
      from {_ln} where text is not null""",
    "kana_fold": f"""select word, translate(word, '{T.KATA}', '{T.HIRA}') as hira, translate(word, '{T.HIRA}', '{T.KATA}') as kata, regexp_matches(word, '[぀-ヿ]') as kana, regexp_full_match(word, '[぀-ヿー・]+') as lexical, regexp_full_match(word, '[぀-ヿー]+') as annotation,
      regexp_full_match(word, '[㐀-鿿々]+') as ideographs, regexp_matches(word, '[ぁ-ゖァ-ヺA-Za-z]') as kana_or_latin, regexp_full_match(word, '[ぁ-ゖァ-ヺー・]+') as kana_ish from (select distinct word from matches where word is not null)""",
    "html_articles": f"""with p as (select import_id as page_id, unnest(string_split(body, chr(10))) as p, generate_subscripts(string_split(body, chr(10)), 1) as i from web_imports where body is not null),
      q as (select page_id, i, trim(regexp_replace(p, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'), ' ') as p from p),
      a as (select page_id, string_agg(p, chr(10) || chr(10) order by i) as article from q where p <> '' group by page_id)
      select page_id, article from a where length(article) >= 80 and length(regexp_replace(article, '[^{T.JAPANESE[1:]}', '', 'g')) / length(article) >= 0.2""",
    "romaji": f"""with r as (select distinct reading from lexicon where reading is not null), a as (select reading, {_spelled("translate(reading, '" + T.KATA + "', '" + T.HIRA + "')")} as t from r),
      b as (select reading, replace(regexp_replace(t, 'っ+([b-df-hj-np-tv-z])', '\\1\\1', 'g'), 'っ', '') as t from a) select reading, ltrim({_lengthened("t")}, 'ー') as romaji from b""",
    "level_parse": f"""select i, cast(coalesce(nullif(regexp_extract(upper(trim(v)), '(?:JLPT[_\\s-]?|N)([1-5])\\b', 1), ''), nullif(regexp_extract(regexp_replace(upper(trim(v)), '^N', ''), '^\\s*([1-5])\\s*$', 1), '')) as int) as level from {_list(LEVELS)}""",
    "pattern_normalize": f"""with a as (select i, v, regexp_replace(regexp_replace(trim(regexp_replace(replace(v, '〜', '～'), '\\s+', ' ', 'g')), '\\s*[（(][^）)]*～[^）)]*[）)]\\s*$', ''), '\\s*[（(][ぁ-ゖァ-ヺー・/／;；\\s]+[）)]\\s*$', '') as t from {_list(PATTERNS)}),
      b as (select i, v, regexp_replace(t, '^[～ 　]+|[～ 　]+$', '', 'g') as t from a) select i, case when t = '' then trim(v) else t end as pattern from b""",
    "readings_split": "select surface, entry_pos, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(reading, ''), '[;；、,]'), lambda x: trim(x)), lambda x: x <> ''), '|') as readings from lexicon",
    "duration_parse": _const([(0, 245000), (1, 245000), (2, 3723000), (3, None), (4, None), (5, None)], "i, ms"),
    "url_parts": """select url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') as host, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '[^/.](\\.[^./]+)$', 1)) as ext
      from (select url from web_imports union select url from documents_src) where url is not null""",
    "import_domains": "select regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '') as host, count(*) as n from web_imports where url is not null group by 1",
    "import_dedupe": "with w as (select import_id, coalesce(lower(nullif(trim(content_sha256), '')), sha256(regexp_replace(body, '\\s+$', ''))) as h from web_imports) select h, min(import_id) as first_id, count(distinct import_id) as copies from w where h is not null group by h",
    "import_clean": """with a as (select import_id, array_to_string(list_transform(string_split(regexp_replace(body, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t　 ]+', ' ', 'g'))), chr(10)) as t from web_imports),
      b as (select import_id, regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') as t from a) select import_id, cast(length(t) as int) as chars, cast(len(string_split(t, chr(10))) as int) as lines from b""",
    "episode_parse": f"""select doc_id, cast(coalesce(nullif(regexp_extract(file_name, '[Ss][0-9]+[Ee]([0-9]{{1,4}})', 1), ''), nullif(regexp_extract(file_name, '(?:^|[^0-9])(?:第)?([0-9]{{1,4}})(?:話|集|[Vv][0-9]|\\s|\\.|-|_|$)', 1), '')) as int) as episode from {_doc} where source_type = 'subtitle' and file_name is not null""",
    "subtitle_rank": f"""with d as (select *, lower(file_name) as n from {_doc} where source_type = 'subtitle' and file_name is not null), r as (select title, doc_id, file_name, case when regexp_matches(n, '\\.ja|\\.jpn|japanese|日本語') then -20 else 0 end + case when regexp_matches(n, '\\.en|english|chs|cht|中文') then 20 else 0 end
      + case when regexp_matches(n, 'generated|whisper') then 10 else 0 end + case when regexp_matches(n, '\\.srt$') then 0 else 2 end as rank from d), p as (select title, doc_id, rank, row_number() over (partition by title order by rank, length(file_name), file_name, doc_id) as place from r) select * from p where place <= 24""",
    "gloss_clean": """with v as (select surface, entry_pos, trim(regexp_replace(meaning, '\\\\n|\\s+', ' ', 'g')) as v from lexicon where meaning is not null), r as (select *, regexp_replace(v, '^(?:（[ぁ-ゖァ-ヺー]+）|[0-9①-⑳]+)\\s*', '') as rest from v)
      select surface, entry_pos, regexp_extract(v, '^（([ぁ-ゖァ-ヺー]+)）', 1) as reading, regexp_extract(rest, '^[【〔\\[]([^】〕\\]]+)[】〕\\]]', 1) as pos, trim(regexp_replace(rest, '^[【〔\\[][^】〕\\]]+[】〕\\]]\\s*', '')) as gloss from r""",
    "inflected_forms": f"""with {CORE}, w as (select surface as word, coalesce(reading, '') as rd from lex), c as (select word, case when regexp_matches(right(word, 2), '^[㐀-鿿]い$') or word like '%しい' then 'い形容词'
        when regexp_matches(right(word, 2), '{_IE}る$') or (word like '%る' and regexp_matches(rd, '{_IE}る$')) then '一段' when regexp_matches(right(word, 2), '[㐀-鿿ぁ-ん][うくぐすつぬぶむる]$') then '五段' else '' end as pos from w),
      f as (select word, case when word in ('来る', 'くる') then {_sql(COMING)} when word like '%する' then [word[:-3] || e for e in {_sql(DOING)}] when pos = '一段' and word like '%る' then [word[:-2] || e for e in {_sql(ICHIDAN)}]
        {" ".join(f"when pos = '五段' and word like '%{k}' then [word[:-2] || e for e in {_godan(k)}]" for k in GODAN)} when pos = 'い形容词' then [word[:-2] || e for e in {_sql(ADJECTIVE)}] end as fs from c)
      select distinct word, form from (select word, unnest(fs) as form from f) where form <> word""",
}
QUERIES = [srt_parse, ass_parse, lrc_parse, plain_lyrics_parse, sentence_split, markup_clean, kana_fold, romaji, level_parse, pattern_normalize, readings_split, duration_parse, url_parts, import_domains, import_dedupe, import_clean, episode_parse, subtitle_rank, inflected_forms, speech_segments, ruby_alignment, gloss_clean, html_articles]
