"""Plain Python functions for what the JVM can't express: Unicode forms, HTML, charsets, romaji, fuzzy scores, ruby."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

# Hepburn spellings of kana, small vowels among them, and of a kana of the i row with a small y kana.
SPELLED = {
    k: c + v
    for c, row in {"": "あいうえお", "k": "かきくけこ", "s": "さしすせそ", "t": "たちつてと", "n": "なにぬねの", "h": "はひふへほ", "m": "まみむめも", "r": "らりるれろ", "g": "がぎぐげご", "z": "ざじずぜぞ", "d": "だぢづでど", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ"}.items()
    for k, v in zip(row, "aiueo")
} | dict(zip("ぁぃぅぇぉ", "aiueo")) | {"や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "o", "ん": "n", "し": "shi", "ち": "chi", "つ": "tsu", "ふ": "fu", "じ": "ji", "ぢ": "ji", "づ": "zu", "ゔ": "vu", "ゃ": "ya", "ゅ": "yu", "ょ": "yo"}
SPELLED |= {i + y: SPELLED[i][:-1] + ("" if i in "しちじ" else "y") + v for i in "きぎしじちにひびぴみり" for y, v in zip("ゃゅょ", "auo")}
KANA_RUN = re.compile("|".join(sorted(SPELLED, key=len, reverse=True)))
# Elements that end a paragraph, and those whose text isn't part of a page's text.
BLOCK_TAGS = set("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main ol p pre section table td th tr ul".split())
SKIP_TAGS = {"head", "nav", "script", "style", "svg", "title", "rt", "rp"}


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


def match_text(text: str) -> str:
    """NFKC, folded case, letters and digits only."""
    return re.sub(r"[\s\W_]+", "", fold(text))


def title_key(text: str) -> str:
    """NFKC, folded case, without punctuation and blanks."""
    return "".join(c for c in fold(text) if not c.isspace() and not unicodedata.category(c)[0] in "PS" or c in "♥♡")


def hiragana(text: str) -> str:
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


def romaji(text: str) -> str:
    """Kana in Hepburn spelling; other characters stay. Kana are spelled by longest match, then
    a small tsu doubles the consonant after it and a long mark the letter before it."""
    t = KANA_RUN.sub(lambda m: SPELLED[m.group()], hiragana(text))
    t = re.sub("っ+(?=([b-df-hj-np-tv-z]))", r"\1", t).replace("っ", "")
    return re.sub("(.)(ー+)", lambda m: m.group(1) * (1 + len(m.group(2))), t).lstrip("ー")


def search_value(text: str) -> str:
    """NFKC, lower case, kana folded."""
    return hiragana(unicodedata.normalize("NFKC", text).lower().strip())


def variants(text: str) -> list[str]:
    """The value, without punctuation, and in Latin letters."""
    v = search_value(text)
    if not v:
        return []
    compact = re.sub(r"[\s\W_]+", "", v)
    latin = re.sub(r"[\s\W_]+", "", romaji(v)) if re.search("[ぁ-ゖ]", v) else ""
    return list(dict.fromkeys(x for x in (v, compact, latin) if x))


def fuzzy(field: str, term: str) -> int:
    """Score of a subsequence match, 0 where the gate is closed: the term is long
    enough, the field is short, and kana or else ideographs of the term have their like in the field."""
    least = 5 if re.fullmatch("[a-z0-9]+", term) else 4
    script = next((s for s in ("[ぁ-ゖー]", "[㐀-鿿]") if re.search(s, term)), "")
    if not least <= len(term) <= len(field) <= 40 or not re.search(script, field):
        return 0
    m = re.search(".*?".join(map(re.escape, term)), field, re.S)
    if m is None:
        return 0
    span = m.end() - m.start()
    return max(12, int(46 * len(term) / span + 0.5) - min(span - len(term), 20))


class _Paragraphs(HTMLParser):
    """Texts of the paragraphs of a page; `hidden` holds the open elements whose text doesn't count."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = [""]
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TAGS:
            self.hidden.append(tag)
        self._part(tag)

    def handle_endtag(self, tag):
        if tag in self.hidden:
            del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
        self._part(tag)

    def _part(self, tag):
        if tag in BLOCK_TAGS and self.found[-1]:
            self.found.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.found[-1] += data


def html_text(markup: str) -> str:
    """Paragraphs of a page with a blank line between; block elements part them, ruby readings and scripts are skipped."""
    p = _Paragraphs()
    p.feed(markup)
    p.close()
    return "\n\n".join(t for t in (" ".join(x.split()) for x in p.found) if t)


def decode(raw: bytes, encodings: tuple[str, ...] = ("utf-8-sig", "cp932", "shift_jis"), errors: str = "ignore") -> str:
    """The first encoding that reads the bytes without an error."""
    for e in encodings:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", errors)


def ruby(surface: str, reading: str) -> list[tuple[str, str]]:
    """(text, reading) of each run, by the first of several readings; kana runs anchor the reading."""
    first = hiragana("".join(re.split("[;；,、，]", reading)[0].split()))
    runs = re.findall("[一-龯㐀-鿿々]+|[^一-龯㐀-鿿々]+", surface)
    if not first or not re.search("[一-龯㐀-鿿々]", surface):
        return [(surface, "")]
    anchors = [None if re.match("[一-龯㐀-鿿々]", r) else re.sub("[^ぁ-ゟー]", "", hiragana(r)) for r in runs]
    m = re.fullmatch("".join("(.+?)" if a is None else f"({re.escape(a)})" for a in anchors), first)
    if not m:
        return [(surface, first)]
    return [(r, g if a is None else "") for r, g, a in zip(runs, m.groups(), anchors)]


def spoken(text: str) -> str:
    """Text without what stands in parentheses, nested ones too."""
    out, depth = [], 0
    for c in text:
        if c in "(（":
            depth += 1
        elif c in ")）" and depth:
            depth -= 1
        elif not depth:
            out.append(c)
    return re.sub(r"\s+", " ", "".join(out)).strip()


def segments(text: str, soft: int = 70, hard: int = 120) -> list[str]:
    """Speech segments; a mark ends a sentence, a pause ends one after `soft`, nothing exceeds `hard`."""
    out, now = [], ""
    for c in text:
        now += c
        if c in "。！？!?\n" or len(now) >= soft and c in "、，,;； " or len(now) >= hard:
            out.append(now.strip())
            now = ""
    return [x for x in [*out, now.strip()] if x]
