"""Column functions of the text layer. All run in the JVM; offsets count code points from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The script classes of the corpus.
JAPANESE = "[぀-ヿ㐀-鿿々〆ヵヶ]"
IDEOGRAPH = "[㐀-鿿々〆]"
KATAKANA = "[ァ-ヺーヽヾ]"
KATA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRA = "".join(map(chr, range(0x3041, 0x3097)))
SENTENCE = r"(?s).+?(?:[。！？!?]+[」』”’）)]*|$)"
SRT_TIME = r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})"
LRC_STAMP = r"\[\d{1,3}:\d{2}(?:[.:]\d{1,3})?\]"


def has_japanese(c: Column) -> Column:
    """Any kana or ideograph."""
    return c.rlike(JAPANESE)


def has_ideograph(c: Column) -> Column:
    """C4: any ideograph; kana don't count."""
    return c.rlike(IDEOGRAPH)


def all_ideographs(c: Column) -> Column:
    """C5."""
    return c.rlike("^[㐀-鿿々]+$")


def has_kana(c: Column) -> Column:
    """C7."""
    return c.rlike("[぀-ヿ]")


def is_kana_lexical(c: Column) -> Column:
    """Every character a kana, a long mark or a middle dot."""
    return c.rlike("^[぀-ヿー・]+$")


def is_kana_annotation(c: Column) -> Column:
    """Kana and long marks, and no ideograph."""
    return c.rlike("^[぀-ヿー]+$") & ~has_ideograph(c)


def has_kana_or_latin(c: Column) -> Column:
    """C8."""
    return c.rlike("[ぁ-ゖァ-ヺA-Za-z]")


def is_kana_ish(c: Column) -> Column:
    """C11: kana, long marks and middle dots alone."""
    return c.rlike("^[ぁ-ゖァ-ヺー・]+$")


def is_katakana_word(c: Column) -> Column:
    """C13 over a whole word."""
    return c.rlike(f"^{KATAKANA}+$")


def to_hiragana(c: Column) -> Column:
    """I8, I9."""
    return F.translate(c, KATA, HIRA)


def to_katakana(c: Column) -> Column:
    """I10."""
    return F.translate(c, HIRA, KATA)


def char_at(text: Column, at: Column) -> Column:
    """The character at a 0-based place; empty outside the text."""
    return F.when((at >= 0) & (at < F.length(text)), F.substring(text, at + 1, F.lit(1))).otherwise("")


def tokens(text: Column) -> Column:
    """Maximal runs of Japanese characters, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({JAPANESE}+)"), 1)


def sentences(paragraph: Column) -> Column:
    """Sentences of a paragraph; line breaks inside one are closed up."""
    found = F.regexp_extract_all(F.coalesce(paragraph, F.lit("")), F.lit(SENTENCE), 0)
    tidy = F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"\s*\n\s*", "")))
    return F.filter(tidy, lambda s: s != "")


def subtitle_markup(text: Column) -> Column:
    """I7 without entities: line marks, override and markup tags, blank lines."""
    t = F.regexp_replace(text, r"\\[Nn]", "\n")
    t = F.regexp_replace(t, r"\{[^}]*\}", "")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    kept = F.filter(F.transform(F.split(t, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(kept, "\n")


def clock_ms(h: Column, m: Column, s: Column, fraction: Column) -> Column:
    """Hours, minutes, seconds and a fraction of one to three digits."""
    whole = h.cast("long") * 3_600_000 + m.cast("long") * 60_000 + s.cast("long") * 1000
    return whole + F.rpad(fraction, 3, "0").cast("long")


def level_number(c: Column) -> Column:
    """1 to 5 of JLPT_n, Nn or a number; else null."""
    t = F.upper(F.trim(c))
    named = F.nullif(F.regexp_extract(t, r"(?:JLPT[_\s-]?|N)([1-5])\b", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(F.regexp_replace(t, "^N", ""), r"^\s*([1-5])\s*$", 1), F.lit(""))
    return F.coalesce(named, bare).cast("int")


def word_pattern(c: Column) -> Column:
    """One tilde form, no trailing parentheses of tildes or kana, no tildes at the ends."""
    t = F.trim(F.regexp_replace(F.translate(c, "〜", "～"), r"\s+", " "))
    t = F.regexp_replace(t, r"\s*[（(][^）)]*～[^）)]*[）)]\s*$", "")
    t = F.regexp_replace(t, r"\s*[（(][ぁ-ゖァ-ヺー・/／;；\s]+[）)]\s*$", "")
    t = F.regexp_replace(t, "^[～ 　]+|[～ 　]+$", "")
    return F.when(t == "", F.trim(c)).otherwise(t)


def readings(c: Column) -> Column:
    """The readings of a word list, split on ; ； 、 ,."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;；、,]"), lambda x: F.trim(x)), lambda x: x != "")


def gloss_readings(c: Column) -> Column:
    """The readings of a glossary, split on / ／ ; ；, digits dropped, in hiragana, distinct."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[/／;；]"), lambda x: to_hiragana(F.trim(F.regexp_replace(x, r"[\d①-⑳]+", ""))))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def host(url: Column) -> Column:
    """Host of an address, without www."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def import_text(body: Column) -> Column:
    """I32 without NFC: unified breaks, blanks collapsed a line, at most one empty line."""
    t = F.regexp_replace(body, r"\r\n?", "\n")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t　 ]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text without white space at its end."""
    return F.sha2(F.regexp_replace(text, r"\s+$", ""), 256)


def slug(title: Column) -> Column:
    """I34."""
    return F.substring(F.regexp_replace(F.regexp_replace(title, r"(?U)[^\w]+", "-"), "^-+|-+$", ""), 1, 80)


def episode_number(name: Column) -> Column:
    """SxxEyy, else one to four digits that stand alone or before a counter."""
    a = F.regexp_extract(name, r"[Ss]\d+[Ee](\d{1,4})", 1)
    b = F.regexp_extract(name, r"(?:^|[^\d])(?:第)?(\d{1,4})(?:話|集|[Vv]\d|\s|\.|-|_|$)", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).cast("int")


def extension(url: Column) -> Column:
    """I45."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]*", "")
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def duration_ms(c: Column) -> Column:
    """Seconds, or h:m:s, in milliseconds; else null."""
    ok = F.trim(c).rlike(r"^\d+(?::\d{1,2}){0,2}$")
    total = F.aggregate(F.split(F.trim(c), ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + F.expr("0").cast("long") + x.try_cast("long"))
    return F.when(ok, total * 1000)


def truncated(text: Column, limit: int) -> Column:
    """I80."""
    t = F.trim(text)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit)), F.lit("..."))).otherwise(t)


def duplicate_key(sentence: Column) -> Column:
    """F11."""
    return F.regexp_replace(sentence, r"\s+", "")


def clock(ms: Column) -> Column:
    """Mm:ss, or hh:mm:ss from an hour on."""
    s = F.floor(ms / 1000)
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    short = F.concat_ws(":", two(F.floor(s / 60) % 60), two(s % 60))
    return F.when(ms.isNull(), None).when(s >= 3600, F.concat_ws(":", two(F.floor(s / 3600)), short)).otherwise(short)


def show_year(date: Column) -> Column:
    """I46."""
    return F.substring(date, 1, 4).try_cast("int")


