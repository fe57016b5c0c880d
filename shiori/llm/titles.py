"""Reading of work titles: script-free spellings, kind and number of a work."""

from __future__ import annotations

import re
import unicodedata

# Kana in order, and the consonants of their rows.
ROWS = {"": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ", "r": "ラリルレロ", "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ", "v": "ヷヸヴヹヺ"}
KANA = {k: c + v for c, row in ROWS.items() for k, v in zip(row, "aiueo")} | {"ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "wa", "ヰ": "i", "ヱ": "e", "ヲ": "o", "ン": "n", "ヂ": "zi", "ヅ": "zu", "ー": "", "ッ": "", "・": " "}
SMALL = dict(zip("ャュョァィゥェォ", ["ya", "yu", "yo", "a", "i", "u", "e", "o"]))
SAME = [("tch", "t"), ("shi", "si"), ("sh", "sy"), ("chi", "ti"), ("ch", "ty"), ("tsu", "tu"), ("dzu", "zu"), ("du", "zu"), ("ji", "zi"), ("j", "zy"), ("fu", "hu"), ("f", "hu"), ("wo", "o"), ("l", "r"), ("di", "zi")]
NUMBERS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6}
SEASON = [
    re.compile(r"第\s*([\d一二三四五六七八九])\s*[期季部]"),
    re.compile(r"(\d)\s*(?:st|nd|rd|th)?\s*(?:シーズン|season)"),
    re.compile(r"season\s*(\d)"),
    re.compile(r"(?<![a-z])s(\d)(?![a-z\d])"),
    re.compile(r"(?<![a-z])(iii|ii|iv|vi?)(?![a-z])(?=\s*$|\s*[\])(（「」~～]|\s)"),
]
KINDS = [("movie", re.compile(r"劇場版|剧场版|映画|電影|(?:the\s+)?movie")), ("ova", re.compile(r"(?<![a-z])(?:ova|oad)(?![a-z])")), ("side", re.compile(r"外伝|外传|gaiden|side\s*story")), ("special", re.compile(r"スペシャル|特別編|特别篇|(?<![a-z])specials?(?![a-z])"))]
REMARKS = re.compile(r"[(（]\s*tv\s*[)）]|\[[^\]]*\]|【[^】]*】|(?<![a-z])tv(?![a-z])|\(\s*\)")
YEAR = re.compile(r"[(（]\s*((?:19|20)\d\d)\s*[)）]")
SUBTITLE = re.compile(r"[~～〜]+[^~～〜]+[~～〜]+|[~～〜]+")
#: A kind of work between the marks that otherwise hold a subtitle.
KIND_ALONE = re.compile(r"[~～〜]+\s*(外伝|外传|劇場版|ova|gaiden)\s*[~～〜]+")
STOP = {"to", "no", "the", "and", "of", "a", "an", "wa", "ga", "ni", "tv", "in"}


def latin(text: str) -> str:
    """One spelling for the ways to write Japanese in Latin letters."""
    t = unicodedata.normalize("NFD", text.lower())
    t = re.sub("[̀-ͯ]", "", t)
    for a, b in SAME:
        t = t.replace(a, b)
    t = re.sub(r"n(?=')|'", "n", t) if "n'" in t else t.replace("'", "")
    t = re.sub(r"m(?=[bp])", "n", t)
    t = re.sub(r"o[ou]+", "o", t)
    t = re.sub(r"u{2,}", "u", t)
    return re.sub(r"([^aeiou\s])\1+", r"\1", t)


def kana(text: str) -> str:
    """Kana in Latin letters, before `latin` unifies them."""
    out = ""
    for c in text:
        if "ぁ" <= c <= "ゖ":
            c = chr(ord(c) + 0x60)
        if c in SMALL:
            s = SMALL[c]
            out = (out[:-1] if out and out[-1] in "aiueo" else out) + s
        else:
            out += KANA.get(c, "")
    return latin(out)


def morae(word: str) -> list[str]:
    return re.findall(r"[^aeiou]*[aeiou]|[^aeiou]+", word)


def keys(word: str) -> list[str]:
    """The word and what is left of it without one mora or one letter."""
    m = morae(word)
    out = {word}
    if len(word) >= 5:
        out |= {word[:i] + word[i + 1 :] for i in range(len(word))}
    if len(m) >= 4:
        out |= {"".join(m[:i] + m[i + 1 :]) for i in range(len(m))}
    return sorted(out)


def distance(a: str, b: str) -> int:
    """0 equal, 1 one letter or mora changed, missing, added or swapped with its neighbour, else 2."""

    def one(x: list[str] | str, y: list[str] | str) -> bool:
        if abs(len(x) - len(y)) > 1:
            return False
        i = 0
        while i < min(len(x), len(y)) and x[i] == y[i]:
            i += 1
        p, q = x[i:], y[i:]
        return p[1:] == q[1:] or p[1:] == q or p == q[1:] or len(p) > 1 and len(q) > 1 and p[0] == q[1] and p[1] == q[0] and p[2:] == q[2:]

    if a == b:
        return 0
    return 1 if one(a, b) or one(morae(a), morae(b)) else 2


def pieces(word: str, least: int = 4, most: int = 9) -> list[str]:
    """Stretches of a title written without blanks that may be its name."""
    starts = sorted({0, *(m.end() for m in re.finditer("[aeiou]|n(?![aeiou])", word)), *(m.start() for m in re.finditer("[aeiou]", word))})
    ends = [m.end() for m in re.finditer("[aeiou]|n(?![aeiou])", word)]
    return sorted({word[a:b] for a in starts for b in ends if b > a and least <= len(morae(word[a:b])) <= most})


def ideographs(t: str) -> list[str]:
    """Runs of ideographs of a Japanese title; none of a Chinese one."""
    found = re.findall("[㐀-鿿々]+", t)
    if not found or re.search("[的与]", t):
        return []
    try:
        "".join(found).encode("shift_jis")
    except UnicodeEncodeError:  # simplified forms
        return []
    return found


def read(name: str) -> dict:
    """season, kind, year, and the words of a name by script: kata, latin, hira; whole, if it has ideographs."""
    t = unicodedata.normalize("NFKC", name).lower().replace("_", " ")
    t = re.sub(r"[「」『』\"“”]", " ", t)
    year = None
    if m := YEAR.search(t):
        year = int(m.group(1))
        t = YEAR.sub(" ", t)
    t = REMARKS.sub(" ", t)
    t = KIND_ALONE.sub(r" \1 ", t)
    t = SUBTITLE.sub(" ", t)
    t = re.sub(r"[.\-–:!?！？,]+", " ", t).strip()
    kind = "main"
    for k, p in KINDS:
        if p.search(t):
            kind = k
            t = p.sub(" ", t)
    season = 1
    for p in SEASON:
        if m := p.search(t):
            season = NUMBERS.get(m.group(1)) or int(m.group(1))
            t = t[: m.start()] + " " + t[m.end() :]
            break
    else:
        if m := re.search(r"(?<=[^\d\s])\s*([2-9])\s*$", t):
            season = int(m.group(1))
            t = t[: m.start()]
    kata = [kana(x) for x in re.findall(r"[ァ-ヺー]{3,}", t)]
    words = [latin(x) for x in re.findall(r"[a-zÀ-ɏ']+", t)]
    hira = [kana(x) for x in re.findall(r"[ぁ-ゖー]{4,}", t)] if not any(len(morae(x)) >= 4 for x in kata) else []
    whole = "".join(c for c in t if c.isalnum() or c == "ー")
    return {"han": ideographs(t), "whole": [whole] if re.search("[㐀-鿿々]", whole) else [], "season": season, "kind": kind, "year": year, "kata": [x for x in kata if len(x) >= 4], "latin": [x for x in words if x not in STOP and len(x) >= 3], "hira": hira}
