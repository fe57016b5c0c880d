"""Problem 5: texts that look alike but differ in their characters.

Method: every letter has a set of scripts it can be written in, its own and those of its
look-alikes. The sets are intersected over each token. A token whose own scripts are
mixed takes the spelling of the one script in the intersection that changes fewest
letters; a token of one script all of whose letters have Latin look-alikes is a
whole-script confusable, and its more frequent spelling in the corpus is taken. Kana and
ideographs legitimately meet in one token, so there the intersection runs over the kana
run a letter stands in. All other forms (width, composition, blanks, invisible
characters, radicals, compatibility ideographs) are normalised.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.session import settle, small, stored

# Look-alike letters of other scripts, and the Latin letter each looks like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXYaesijopcyxhdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα", "ABEZHIKMNOPTYXova"))
# Less exact look-alikes, which count in tokens of mixed scripts only.
LOOSE = dict(zip("кмтвнгпиьяіρικχυγητωεβμ", "kmtbhrnubRipikxuyntwebu"))
# Katakana and the ideograph, hiragana or dash that looks like it.
KATA_HAN = dict(zip("ニカロハエタトミチヌオムヒセー", "二力口八工夕卜三千又才厶匕七一"))
HIRA_KATA = dict(zip("へべぺり", "ヘベペリ"))
DASHES = "‐‑‒–—―─━−－"
HAN_KATA = {h: k for k, h in KATA_HAN.items()}
KATA_HIRA = {k: h for h, k in HIRA_KATA.items()}
NUMERALS = "一二三七八千"
#: Katakana words that count things and may follow a numeral.
COUNTERS = re.compile("[カヵヶケ]?[月所国年条箇]|メートル|キロ|ページ|パーセント|グラム|センチ|ミリ|リットル|ドル|ユーロ|ポイント|トン|ダース|セット|チーム")

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​‎‏‪-‮⁠-⁯︀-️﻿￹-￻\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f]|(?<!्)[‌‍]")
BREAKS = re.compile("\r\n?|[\x0b\x0c\x85  ]")
BLANKS = re.compile("[\t   -   　]")
WIDTH = re.compile("[｡-ﾟ]+|[０-９Ａ-Ｚａ-ｚ]+|[\U0001d400-\U0001d7ff]+")
RADICALS = re.compile("[⺀-⿟豈-﫿\U0002f800-\U0002fa1f]")
KATA = re.compile("[ァ-ヺー]")
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
TOKEN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ԯ]+")
MIXED = re.compile(f"[{''.join(HAN_KATA)}{''.join(KATA_HAN)}{''.join(HIRA_KATA)}{''.join(KATA_HIRA)}{DASHES}]")

#: CJK radicals of the supplement that compatibility mapping leaves; their ideographs.
SUPPLEMENT = dict(zip("⺅⺉⺌⺍⺖⺗⺘⺡⺣⺨⺮⺼⻌⻏⻖⻗⻝⻤⻨⻩⻫⻭⻯⻲", "亻刂小小忄小扌氵灬犭竹月辶阝阝雨食鬼麦黄斉歯竜亀"))


def _script(c: str) -> str:
    if "ァ" <= c <= "ヺ" or c == "ー":
        return "k"
    if "ぁ" <= c <= "ゟ":
        return "h"
    if "㐀" <= c <= "鿿" or c in "々〆":
        return "c"
    return "o"


def _to_katakana(text: str, i: int) -> str | None:
    """What the look-alike at i is, if it stands in a katakana run; else None."""
    c = text[i]
    left = text[i - 1] if i else ""
    right = text[i + 1] if i + 1 < len(text) else ""
    l, r = _script(left) if left else "", _script(right) if right else ""
    if c in DASHES:
        closed = not right or r in "khc" or right in "。、！？!?… 」』）♪"
        return "ー" if l == "k" and closed and left not in DASHES else None
    if c in HIRA_KATA:
        if l == "k" and r == "k" and (c != "へ" or _short_run(text, i)):
            return HIRA_KATA[c]
        if c in "べぺ" and (l == "k" and r != "k" and c == "ぺ" or l in ("", "o", "h") and r == "k"):
            return HIRA_KATA[c]
        # a particle can't open a clause
        if c == "へ" and r == "k" and l in ("", "o") and left not in "」』）":
            return HIRA_KATA[c]
        return None
    if c not in HAN_KATA or c in NUMERALS and COUNTERS.match(text, i + 1):
        return None
    k = HAN_KATA[c]
    if l == "k" and r == "k":
        return None if k == "ー" and left == "ー" else k
    if l == "k" and r in ("h", "o", ""):
        if c in NUMERALS and (right == "つ" or r != "h" and c != "一"):
            return None
        return None if c == "一" and left == "ー" else k
    if r == "k" and k != "ー":
        # look-alikes before it belong to the same run
        j = i
        while j and text[j - 1] in HAN_KATA and text[j - 1] not in NUMERALS:
            j -= 1
        if not j or _script(text[j - 1]) in "oh":
            return k
    return None


def _from_katakana(text: str, i: int) -> str | None:
    """What the katakana at i is, if it stands alone among ideographs or hiragana; else None."""
    c = text[i]
    left = text[i - 1] if i else ""
    right = text[i + 1] if i + 1 < len(text) else ""
    l, r = _script(left) if left else "", _script(right) if right else ""
    if l == "k" or r == "k":
        return None
    if c in KATA_HIRA:
        return KATA_HIRA[c]
    if c == "ー":
        return "一" if r == "c" else None
    counter = c == "カ" and (l == "c" or left.isdigit())
    return KATA_HAN[c] if r == "c" and not counter else None


def kana_spelling(text: str) -> str:
    """Kana, ideographs and dashes that look alike, in the script of the run they stand in."""
    places = [m.start() for m in MIXED.finditer(text)]
    for order in (places[::-1], places):  # neighbours may be look-alikes themselves
        for i in order:
            k = _to_katakana(text, i)
            if k:
                text = text[:i] + k + text[i + 1 :]
    for i in places:
        if text[i] in KATA_HAN or text[i] in KATA_HIRA:
            k = _from_katakana(text, i)
            if k:
                text = text[:i] + k + text[i + 1 :]
    return text


def _short_run(text: str, i: int) -> bool:
    """Whether a particle can't stand here: the katakana before it is too short for a word."""
    before = re.search("[ァ-ヺー]*$", text[:i]).group()
    return len(before) < 2


def letters_spelling(token: str) -> str:
    """One token of Latin, Greek and Cyrillic letters in one script, if one script can spell it."""
    own = {"g" if "Ͱ" <= c <= "Ͽ" else "y" if "Ѐ" <= c <= "ԯ" else "l" for c in token}
    if len(own) < 2:
        return token
    to = {"l": LOOSE | CYRILLIC | GREEK, "y": {v: k for k, v in CYRILLIC.items()}, "g": {v: k for k, v in GREEK.items()}}
    best = None
    for s in "lyg":
        spelt = "".join(c if ("g" if "Ͱ" <= c <= "Ͽ" else "y" if "Ѐ" <= c <= "ԯ" else "l") == s else to[s].get(c, "\0") for c in token)
        if "\0" not in spelt:
            n = sum(a != b for a, b in zip(spelt, token))
            if best is None or n < best[0]:
                best = (n, spelt)
    return best[1] if best else token


def latin_of(token: str) -> str | None:
    """The Latin spelling of a whole-script confusable of two or more letters, else None."""
    if len(token) < 2 or token.isascii() or any(c.isascii() for c in token):
        return None
    spelt = [(CYRILLIC | GREEK).get(c) for c in token]
    return "".join(spelt) if None not in spelt else None


def house_form(text: str) -> str:
    """Everything but whole-script confusables, which need counts of the corpus."""
    t = BREAKS.sub("\n", text)
    t = INVISIBLE.sub("", t)
    t = BLANKS.sub(" ", t)
    t = WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m.group()), t)
    t = RADICALS.sub(lambda m: SUPPLEMENT.get(m.group()) or unicodedata.normalize("NFKC", m.group()), t)
    t = unicodedata.normalize("NFC", t)
    if FOREIGN.search(t):
        t = TOKEN.sub(lambda m: letters_spelling(m.group()), t)
    return kana_spelling(t) if MIXED.search(t) else t


def normalise(rows: DataFrame) -> DataFrame:
    """(row_key, field, text, house_text, changed) of every row with a text.

    `rows`: row_key, field (a record once), text. Rows of null text are left out; an empty
    text is in house form.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm import lookalikes as k

        for b in batches:
            house = [k.house_form(t) for t in b["text"]]
            suspects = [sorted({w for w in k.TOKEN.findall(h) if k.latin_of(w)}) if k.FOREIGN.search(h) else [] for h in house]
            yield b.assign(house_text=house, suspects=suspects)

    first = stored(rows.where("text is not null").select("row_key", "field", "text").mapInPandas(run, "row_key string, field string, text string, house_text string, suspects array<string>"))
    listed = first.select(F.explode("suspects").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("string")
    def latin(s: pd.Series) -> pd.Series:
        from shiori.llm import lookalikes as k

        return s.map(k.latin_of)

    listed = settle(listed.withColumn("latin", latin("token")))
    words = first.select(F.explode(F.regexp_extract_all("house_text", F.lit("([A-Za-z]{2,})"), 1)).alias("latin"))
    known = words.join(small(listed.select("latin").distinct()), "latin", "left_semi").groupBy("latin").agg(F.count(F.lit(1)).alias("m"))
    wins = listed.join(known, "latin").where("m > n").select("token", "latin")
    need = first.where(F.size("suspects") > 0).select("row_key", "field", F.explode("suspects").alias("token"))
    swaps = need.join(wins, "token").groupBy("row_key", "field").agg(F.collect_list(F.struct("token", "latin")).alias("swaps"))

    @F.pandas_udf("string")
    def swap(text: pd.Series, how: pd.Series) -> pd.Series:
        from shiori.llm import lookalikes as k

        out = []
        for t, s in zip(text, how):
            d = {x["token"]: x["latin"] for x in s} if s is not None else {}
            out.append(k.TOKEN.sub(lambda m: d.get(m.group(), m.group()), t))
        return pd.Series(out)

    some = first.where(F.size("suspects") > 0).join(swaps, ["row_key", "field"], "left")
    some = some.select("row_key", "field", "text", swap("house_text", "swaps").alias("house_text"))
    rest = first.where(F.size("suspects") == 0).select("row_key", "field", "text", "house_text")
    return rest.unionByName(some).withColumn("changed", F.col("text") != F.col("house_text"))
