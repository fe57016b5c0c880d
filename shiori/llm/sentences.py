"""Problem 6: sentence units across languages and scripts.

Method: a linear-chain model tags the gaps between words, and every place in a long run of
letters without any mark, as boundary or inside, and Viterbi decoding picks the best tags of a text. Emissions come from the marks in a gap,
where there are any that decide, and else from how often the letters before it end, and
those after it open, a sentence. That part is trained on the corpus's own punctuated text
with the punctuation stripped, so that it also serves where nothing but a blank, a line
break or a symbol separates clauses. Quotations and brackets are parsed first: inside one
that a surrounding sentence embeds all gaps are tagged inside.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.llm.lookalikes import FOREIGN, TOKEN, letters_spelling

#: Bound of the training sample, in texts; they are taken by a hash of their key.
TRAIN_TEXTS = 12_000
SURE = 14.0

# Half-width marks and full-width letters, and the forms they are read as.
SAME = str.maketrans("｡､｢｣･", "。、「」・") | {0xFEE0 + o: o for o in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]}
OTHERS = re.compile("[" + "".join(map(chr, SAME)) + "]")
HIDDEN = re.compile("[­͏​-‏‪-‮⁠-⁯︀-️﻿]")
BLANK = re.compile(r"\s")
STRONG = set("。！？!?।॥｡")
PAUSE = set("、,，;；:：､")
OPEN = dict(zip("「『（“„«‹(［[【〈《", "」』）”“»›)］]】〉》"))
OPENS = re.compile("[" + re.escape("".join(OPEN)) + "]")
CLOSE = set(OPEN.values())
DASH = set("-–—―－‐")
# Words with a point that no sentence ends with, before a name or a number.
TITLES = {"dr", "mr", "mrs", "ms", "prof", "st", "sr", "sra", "srta", "fr", "hr", "mme", "mlle", "mgr", "jr", "rev", "gen", "col", "capt", "lt", "sgt", "dra", "d", "dña"}
NUMBERED = {"no", "nr", "núm", "vol", "ep", "ver", "chap", "cap", "ca", "aprox", "approx", "fig", "p", "pp", "art", "sec", "nº", "bd", "kap", "env", "ch", "pág", "abb", "tel"}
INNER = {"e.g", "i.e", "z", "b", "bzw", "usw", "vs", "cf", "p", "ex", "u", "a.m", "p.m", "u.k", "u.s", "d.h", "z.b", "p.ex", "ej", "v"}
MONTHS = {"januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember", "jänner"}
#: What goes on with a sentence after a bracket; not what opens one, such as とにかく or もしかして.
PARTICLE = re.compile("と(?!にかく|ころ|ても|き|り)|って|など|なんて|を|が(?!ん)|は(?![いあやて])|に(?![ゃほこぎ])|の(?!で|に|ち|ん)|も(?![しうっ])|で(?![もすはき])|へ(?![えん])|から(?!だ)|まで|より|だ(?!から|が|って|け|め)|な(?![るんぜに])")
SAYS = re.compile("[^。！？]{0,14}?(?:说道|说|问道|喊道|答道|道|問|喊|叫道)[。！？，]")


def _word(c: str) -> bool:
    return c.isalnum() or "ऀ" <= c <= "ॣ" or "०" <= c <= "ॿ" or "゙" <= c <= "゜" or c in "々〆゛" or "̀" <= c <= "ͯ"


def _wide(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "ｦ" <= c <= "ﾟ" or "⺀" <= c <= "⿟" or "豈" <= c <= "﫿"


#: What may part sentences, with something after it that isn't its own closing.
INNER_MARK = re.compile(r"[。！？!?।॥｡.♪♫♬★☆♥♡～…‥\s」』”»“）)|][^。！？!?।॥｡…‥」』”»）)\s]*\w")


#: A text of spaced letters, with nothing between two words but a blank and marks that never part sentences.
PLAIN = re.compile("['\"’,;:-]*[A-Za-zÀ-ÖØ-öø-ɏ가-힣]+(?:[ '\"’,;:-]+[A-Za-zÀ-ÖØ-öø-ɏ가-힣]+)*[ '\"’,;:.!?…-]*")


class View:
    """A text without hidden characters; `at` has each character's place in the text."""

    def __init__(self, text: str):
        if HIDDEN.search(text):
            self.at = [i for i, c in enumerate(text) if not HIDDEN.match(c)]
            text = HIDDEN.sub("", text)
        else:
            self.at = range(len(text))
        if OTHERS.search(text):
            text = text.translate(SAME)
        if FOREIGN.search(text):  # look-alike letters, one for one
            text = TOKEN.sub(lambda m: letters_spelling(m.group()), text)
        self.s = text


def pairs(s: str) -> list[tuple[int, int]]:
    """Matched outermost brackets and quotation marks."""
    stack: list[int] = []
    out = []
    for i, c in enumerate(s):
        if stack and c == OPEN[s[stack[-1]]]:
            a = stack.pop()
            if not stack:
                out.append((a, i))
        elif c in OPEN:
            stack.append(i)
        elif c in CLOSE and any(OPEN[s[a]] == c for a in stack):
            while OPEN[s[stack[-1]]] != c:
                stack.pop()
            a = stack.pop()
            if not stack:
                out.append((a, i))
    if stack:  # one that isn't closed hides nothing of what follows
        a = stack[0]
        out = [p for p in out if p[1] < a]
        out += [(x + a + 1, y + a + 1) for x, y in pairs(s[a + 1 :])]
    return out


def embedded(s: str, a: int, b: int) -> bool:
    """Whether a surrounding sentence goes on before or after the bracket s[a:b+1]."""
    before = s[:a].rstrip()
    after = s[b + 1 :].lstrip()
    tight = s[b + 1 : b + 2]
    inside = s[a + 1 : b].rstrip()
    ended = bool(inside) and (inside[-1] in STRONG or inside[-1] in ".…♪")
    if before and before[-1] not in STRONG and before[-1] not in CLOSE and before[-1] not in ".♪…" and before[-1] not in DASH and "\n" not in s[len(before) : a]:
        return True
    if not after:
        return False
    if after[0] in PAUSE:
        return True
    if tight and PARTICLE.match(s, b + 1):
        return True
    if _wide(after[0]):
        if s[a] in "“‘" and tight == after[0]:
            return bool(SAYS.match(after)) or not ended
        return not ended and bool(tight.strip()) and s[a] not in "（("
    if after[0].isalpha() and after[0].islower() and not _wide(after[0]):
        return True
    return after[0] in STRONG or after[0] in ".…" and not ended


#: Runs of what isn't part of a word; the class agrees with `_word`.
BETWEEN = re.compile("(?:[^\\w\u0900-\u0963\u0966-\u097f\u3099-\u309c\u0300-\u036f]|_)+")


def gaps(s: str) -> list[tuple[int, int]]:
    """(end, start) of what lies between each two neighbouring words."""
    n = len(s)
    return [(a, b) for a, b in (m.span() for m in BETWEEN.finditer(s)) if a and b < n]


def opening(s: str, a: int, b: int) -> int:
    """Where in the gap s[a:b] the next sentence begins."""
    k = a
    for i in range(a, b):
        c = s[i]
        opens = c in OPEN and not (c in CLOSE and i > 0 and not s[i - 1].isspace() and (i + 1 == len(s) or not _word(s[i + 1])))
        if opens:
            break
        if c in STRONG or c in CLOSE or c in PAUSE or c in ".…‥":
            k = i + 1
    # symbols cling to what they touch
    while k < b and not s[k].isspace() and s[k] not in OPEN and s[k] not in DASH and s[k] not in "¿¡":
        k += 1
    while k < b and s[k].isspace():
        k += 1
    return k


def _token_before(s: str, a: int) -> str:
    m = re.search(r"[\w.]*$", s[:a])
    t = m.group().rstrip(".") if m else ""
    # only the Latin end of a token that begins in another script
    m = re.search(r"[A-Za-zÀ-ɏ.º]*$", t)
    return m.group() or t


def point(s: str, a: int, b: int) -> float | None:
    """Score of a gap whose first mark is a point after a word in Latin or another spaced script."""
    token = _token_before(s, a).lower()
    right = s[b]
    sep = s[a:b]
    spaced = any(c.isspace() for c in sep)
    marks = sep.strip()
    if marks.startswith(".."):
        return None
    if not spaced and len(marks) == 1:
        if right.isdigit() or right.isalpha() and not _wide(right):
            return -SURE
        if token in TITLES or token in NUMBERED or len(token) <= 1 and token.isalpha():
            return -SURE
        return SURE if _wide(right) and token else -SURE
    if token in TITLES or len(token) == 1 and s[a - 1].isupper() and token.isalpha():
        return -SURE
    if token in NUMBERED and (right.isdigit() or token != "p" and right.islower()):
        return -SURE
    if right.isalpha() and right.islower() and not _wide(right):
        return -SURE
    if token in INNER and token not in ("p.m", "a.m") and right.isupper() and s[b + 1 : b + 2] in (".", ""):
        return -SURE
    if token[-1:].isdigit():
        word = re.match(r"\w+", s[b:]).group().lower()
        if word in MONTHS and len(re.search(r"\d*$", token).group()) <= 2:
            return -SURE
    return SURE


class Model:
    """How often letters end or open a sentence, learned from punctuated text."""

    def __init__(self, counts: dict[str, tuple[float, float]]):
        self.n = counts
        e, t = counts.get(">", (1.0, 20.0))
        self.base = (e + 1) / (t + 20)

    def share(self, kind: str, letters: list[str]) -> float:
        p = self.base
        for x in letters:
            e, t = self.n.get(kind + x, (0.0, 0.0))
            p = (e + 4 * p) / (t + 4)
        return min(max(p, 1e-5), 1 - 1e-5)

    def logit(self, before: str, after: str) -> float:
        ends = self.share(">", [before[-k:] for k in range(1, min(5, len(before)) + 1)])
        starts = self.share("<", [after[:k] for k in range(1, min(3, len(after)) + 1)])
        lift = lambda p: math.log(p / (1 - p)) - math.log(self.base / (1 - self.base))
        return lift(ends) + 0.5 * max(-3.0, min(3.0, lift(starts)))


def letters_only(s: str) -> str:
    s = BETWEEN.sub("", s)
    return "".join(c.lower() for c in s) if "Σ" in s else s.lower()  # its form depends on what stands beside it


#: Lift over the base rate from which a bare blank, break or symbol is more likely a boundary.
BARE = {"blank": 1.6, "break": 1.1, "symbol": 0.6, "pause": 2.5, "nothing": 4.5}
#: So many letters of a script without blanks and nothing between them hold more than one sentence as a rule.
UNPARTED = re.compile("[぀-ヿ㐀-鿿々〆]{30,}")


class Gap:
    """What the marks of a gap say, whatever stands around it."""

    def __init__(self, sep: str):
        self.marks = marks = [c for c in sep if not c.isspace()]
        strong = [c for c in marks if c in STRONG]
        self.strong = bool(strong)
        self.turn = bool(re.search(r"\n\s*[-–—―]\s", sep))
        self.spaced = any(c.isspace() for c in sep)
        tail = sep[max(sep.rfind(c) for c in strong) + 1 :] if strong else ""
        self.open_tail = strong and not tail.strip(" 」』）”»“)") and not self.spaced
        self.sure = any(c in "।॥。！？" for c in strong)
        self.comma = "," in tail
        self.point = marks[:1] == ["."]
        self.closes = any(c in CLOSE for c in marks)
        self.bracket = self.closes or any(c in OPEN for c in marks)
        self.pause = any(c in PAUSE for c in marks)
        self.line = "\n" in sep
        self.part = self.line or any(c in "♪♫♬…" for c in marks)
        self.bare = marks in ([], ["-"]) and not self.line
        self.dots = any(c in "…‥" for c in marks)
        self.loose = self.spaced or any(c in "♪♫♬★☆" for c in marks)
        self.kind = "symbol" if any(c in "♪♫♬★☆♥♡～" for c in marks) else "pause" if self.dots else "break" if self.line else "blank"


#: Few gaps differ in a corpus.
gap = lru_cache(4096)(Gap)
QUOTED = re.compile("と(?![きこしてにも])|って")


def emission(s: str, a: int, b: int, model: Model) -> float:
    """Log-odds of a boundary in the gap s[a:b], which is empty between letters of an unparted run."""
    sep = s[a:b]
    if not sep:
        return model.logit(letters_only(s[max(0, a - 12) : a]), letters_only(s[b : b + 8])) - BARE["nothing"]
    left, right, g = s[a - 1], s[b], gap(sep)
    if g.turn:
        return SURE
    if g.strong:
        if g.open_tail and QUOTED.match(s, b):
            return -SURE
        if not g.sure and right.isalpha() and right.islower() and not _wide(right):
            return -SURE
        return -SURE if g.comma else SURE
    if g.point and not _wide(left):
        v = point(s, a, b)
        if v is not None:
            return v
    if g.point and g.spaced:
        return SURE
    if g.bracket and not g.pause:
        # brackets here belong to stand-alone ones: a side of it is a boundary
        return SURE if g.closes or model.logit(letters_only(s[max(0, a - 12) : a]), letters_only(s[b : b + 6])) > BARE["break"] else -2.0
    if g.pause:
        return -SURE
    latin = left.isalpha() and not _wide(left) and right.isalpha() and not _wide(right)
    if latin and (not g.part or right.islower() and left.isascii()):
        return -SURE
    if g.bare and not latin and not _wide(left) and not left.isdigit() and _wide(right):
        return -SURE  # a foreign word in a clause, such as a chorus or a name
    if not g.loose and not g.dots:
        return -SURE
    v = model.logit(letters_only(s[max(0, a - 12) : a]), letters_only(s[b : b + 8]))
    return v - BARE[g.kind if g.loose else "pause"]


def viterbi(scores: list[float], widths: list[int]) -> list[bool]:
    """Best tags of a chain of gaps; widths[i] letters lie between gap i-1 and gap i."""
    short = 4.0  # against two boundaries with nothing much between
    inside, boundary = 0.0, -1e9
    back: list[tuple[int, int]] = []
    for v, w in zip(scores, widths):
        to_b = (inside, boundary - (short if w < 2 and v < SURE else 0))
        k = int(to_b[1] > to_b[0])
        j = int(boundary > inside)
        back.append((j, k))
        inside, boundary = max(inside, boundary), max(to_b) + v
    state = int(boundary > inside)
    tags = []
    for j, k in reversed(back):
        tags.append(bool(state))
        state = k if state else j
    return tags[::-1]


def cuts(text: str, model: Model, verse: bool = False) -> list[int]:
    """Numbers of code points before each sentence but the first."""
    if verse or not text or not INNER_MARK.search(text) and not UNPARTED.search(text):
        return []
    if PLAIN.fullmatch(text):
        return []
    v = View(text)
    s = v.s
    closed: list[tuple[int, int]] = [p for p in pairs(s) if embedded(s, *p)] if OPENS.search(s) else []
    places = []
    bare = [(k, k) for m in UNPARTED.finditer(s) for k in range(m.start() + 4, m.end() - 3)]
    for a, b in sorted([*gaps(s), *bare]) if bare else gaps(s):
        if closed and any(x < a and b <= y for x, y in closed):
            continue
        places.append((a, b))
    scores, widths, last = [], [], 0
    for a, b in places:
        x = emission(s, a, b, model)
        after_embedded = [p for p in closed if p[1] in range(a, b)] if x > 0 else []
        if after_embedded:
            # what closes here goes on, unless the sentence ends with it
            y = after_embedded[-1][1]
            rest = s[y + 1 : b].strip()
            if not any(c in STRONG or c == "." for c in rest) and not _ends_with(s, after_embedded[-1], b):
                x = -SURE
        if x > 0 and any(p[0] in range(a, b) for p in closed):
            p = next(p for p in closed if p[0] in range(a, b))
            if not any(c in STRONG or c == "." or c == "\n" for c in s[a : p[0]]):
                x = -SURE
        scores.append(x)
        widths.append(a - last)
        last = b
    out = []
    if not any(x > 0 for x in scores):  # no boundary is better than inside
        return out
    for (a, b), tag in zip(places, viterbi(scores, widths)):
        if tag:
            k = opening(s, a, b)
            out.append(v.at[k])
    return out


def _ends_with(s: str, p: tuple[int, int], b: int) -> bool:
    """A quotation introduced by its sentence also ends it, if a capital or a new line follows."""
    x, y = p
    inner = s[x + 1 : y].rstrip()
    before = s[:x].rstrip()
    introduced = bool(before) and before[-1] in ":：" and inner[-1:] in STRONG | {".", "…"}
    return introduced and (s[b].isupper() or "\n" in s[y:b] or _wide(s[b]) or s[b].isdigit())


def examples(text: str, into: dict[str, list[float]]) -> None:
    """Adds a text's gaps to the counts: letters before and after, with the marks stripped."""
    v = View(text)
    s = v.s
    words = [i for i in range(len(s)) if _word(s[i])]
    if len(words) < 2:
        return
    low = "".join(s[i].lower() for i in words)
    for k in range(len(words)):
        a = words[k] + 1
        b = words[k + 1] if k + 1 < len(words) else len(s)
        sep = s[a:b]
        strong = any(c in STRONG for c in sep) or b < len(s) and sep[:1] == "." and not _wide(s[a - 1]) and (point(s, a, b) or 0) > 0 or b == len(s) and "." in sep
        if b == len(s) and not strong:
            continue
        if not sep and not _wide(s[a - 1]):
            continue
        for n in range(0, 6):
            if n <= k + 1:
                e = into.setdefault(">" + (low[k + 1 - n : k + 1] if n else ""), [0.0, 0.0])
                e[0] += strong
                e[1] += 1
        if k + 1 < len(words):
            for n in range(1, 4):
                e = into.setdefault("<" + low[k + 1 : k + 1 + n], [0.0, 0.0])
                e[0] += strong
                e[1] += 1


def train(rows: DataFrame, key: str = "row_key", text: str = "text", bound: int = TRAIN_TEXTS) -> dict[str, tuple[float, float]]:
    """Counts of the model from at most about `bound` texts; features seen less than five times are left out."""
    rows = rows.where(F.col(text).isNotNull())
    total = rows.count()
    every = max(1, -(-total // bound))
    sample = rows.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(text)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm import sentences as q

        n: dict[str, list[float]] = {}
        for b in batches:
            for t in b[text]:
                q.examples(t, n)
        yield pd.DataFrame([(k, e, t) for k, (e, t) in n.items()], columns=["f", "e", "t"])

    found = sample.mapInPandas(count, "f string, e double, t double").groupBy("f").agg(F.sum("e").alias("e"), F.sum("t").alias("t")).where("t >= 5")
    return {r["f"]: (r["e"], r["t"]) for r in found.collect()}


def boundaries(rows: DataFrame, counts: dict[str, tuple[float, float]], keys: list[str]) -> DataFrame:
    """(*keys, cut_pos): one row a boundary. `rows`: keys, text, verse (boolean).

    Null and empty texts have no boundary. A text's places count code points from 0.
    """
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm import sentences as q

        model = q.Model(counts)
        for b in batches:
            found = [q.cuts(t, model, bool(x)) for t, x in zip(b["text"], b["verse"])]
            n = pd.Series([len(x) for x in found], index=b.index)
            out = b[keys].loc[b.index.repeat(n)].reset_index(drop=True)
            out["cut_pos"] = pd.Series([p for x in found for p in x], dtype="int32")
            yield out

    return rows.where("text is not null").select(*keys, "text", "verse").mapInPandas(decode, schema + ", cut_pos int")


def units(rows: DataFrame, counts: dict[str, tuple[float, float]], keys: list[str]) -> DataFrame:
    """(*keys, sentence_no, start_pos, end_pos, sentence): every text's sentence units, blanks trimmed."""
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm import sentences as q

        model = q.Model(counts)
        for b in batches:
            out = []
            for key, t, x in zip(b[keys].itertuples(index=False), b["text"], b["verse"]):
                if x:  # a line of verse is a unit; prose among it is cut as elsewhere
                    places, at = [], 0
                    for line in t.splitlines(keepends=True):
                        places += [at + c for c in q.cuts(line, model)] if re.search("[。！？.!?]", line) else []
                        at += len(line)
                        places.append(at)
                    places = sorted({c for c in places if 0 < c < len(t)})
                else:
                    places = q.cuts(t, model)
                n = 0
                for a, e in zip([0, *places], [*places, len(t)]):
                    piece = t[a:e]
                    a += len(piece) - len(piece.lstrip())
                    piece = piece.strip()
                    if piece:
                        n += 1
                        out.append((*key, n, a, a + len(piece), piece))
            yield pd.DataFrame(out, columns=[*keys, "sentence_no", "start_pos", "end_pos", "sentence"])

    return rows.where("text is not null").select(*keys, "text", "verse").mapInPandas(decode, schema + ", sentence_no int, start_pos int, end_pos int, sentence string")
