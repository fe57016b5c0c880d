"""Problem 2: text decoded with a wrong character encoding.

Method: expectation-maximization with a latent encoding chain per record. A chain
(true, read) says: bytes in `true` were read as `read`. Where a chain can be undone
without loss, the record's likelihood under it is that of the restored text under a
character model of the corpus; under "clean" it is that of the text as stored. Chain
weights are learned per source and field, shrunk to the field's over all sources, so that
weak evidence is pooled; the character model is re-estimated from the restored texts.
Replacement characters are what an encoding leaves that can't be undone: chain "lossy".
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.session import settle

SINGLE = ["cp1252", "mac_roman", "koi8_r", "cp1251", "cp437", "cp866", "cp850", "iso8859_5", "iso8859_7", "cp1250"]
DOUBLE = ["cp932", "gb18030", "euc_jp", "big5", "euc_kr"]
TRUE = ["utf-8", "cp932", "euc_jp", "gb18030"]
LOSSY_WEIGHT = 25.0
#: Distinct characters a smoothed model reserves room for.
ROOM = 150_000.0

#: Replacement characters, and private ones that a legacy table yields for unassigned bytes.
LOSSY = re.compile("[\ufffd\ue000-\uf8ff]")

UTF8 = r"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})"
_ASCII = r"\x20-\x7e"


def _run(pair: str, single: str, other: str = "") -> re.Pattern:
    """Longest runs of an encoding's characters with one of two bytes at least; `single` are its one-byte
    characters. Every byte begins one kind of character only, so nothing is tried twice."""
    more = f"|{other}" if other else ""
    return re.compile(f"(?<![{single}])(?:[{single}]{more})*+(?:{pair})(?:{pair}|[{single}]{more})*+")


RUNS = {
    "utf-8": re.compile(UTF8 + "+"),
    "cp932": _run(r"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]", _ASCII + r"\xa1-\xdf"),
    "euc_jp": _run(r"[\xa1-\xfe]{2}", _ASCII, r"\x8e[\xa1-\xdf]"),
    "gb18030": _run(r"[\x81-\xfe][\x40-\x7e\x80-\xfe]", _ASCII),
}
UTF8_BYTES = re.compile(UTF8.encode() + rb"{2,}")
#: Characters that no single-byte reading of another encoding leaves out altogether.
_OTHER = "[^\x00-\x7f　-ヿ㐀-鿿가-힣ऀ-ॿ！-ﾟ‐-’“-„…※♪-♯​-‏⁠﻿]"
SUSPECT = re.compile(_OTHER)
#: What a character of several bytes leaves of them: two such characters side by side.
SUSPECTS = re.compile(_OTHER + "{2}")
#: What a stretch of two-byte characters leaves wherever it stands: suspects at most three apart.
CLUSTER = re.compile(_OTHER + "(?s:.){0,2}" + _OTHER)


def _table(read: str) -> dict[int, int]:
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(read))] = b
        except UnicodeDecodeError:
            pass
    if read == "cp1252":  # undefined bytes, and those of Latin-1, come out as they are
        for b in range(128, 256):
            out.setdefault(b, b)
    # what stays above U+00FF, and Latin-1 characters the reading can't produce, part runs
    for c in range(128, 256):
        out.setdefault(c, 0xFFFD)
    return out


_tables = {r: _table(r) for r in SINGLE}

#: Chains of a single-byte reading, by their bit; what the first and the second byte of a character of several are.
CHAINS = {(t, r): 1 << k for k, (r, t) in enumerate((r, t) for r in SINGLE for t in TRUE)}
EVERY = (1 << len(CHAINS)) - 1
_OF_UTF8 = sum(bit for (t, r), bit in CHAINS.items() if t == "utf-8")
_FIRST = {"utf-8": {*range(0xC2, 0xF5)}, "cp932": {*range(0x81, 0xA0), *range(0xE0, 0xFD)}, "euc_jp": {*range(0xA1, 0xFF)}, "gb18030": {*range(0x81, 0xFF)}}
_SECOND = {"utf-8": {*range(0x80, 0xC0)}, "cp932": {*range(0x40, 0x7F), *range(0x80, 0xFD)}, "euc_jp": {*range(0xA1, 0xFF)}, "gb18030": {*range(0x40, 0x7F), *range(0x80, 0xFF)}}


def _chains(c: str, bytes_of: dict[str, set[int]]) -> int:
    """The chains whose reading makes this character of one of the bytes."""
    return sum(bit for (t, r), bit in CHAINS.items() if _tables[r].get(ord(c), ord(c)) in bytes_of[t])


def _class(read: str, first: range, second: range) -> re.Pattern:
    """Characters whose two bytes in `read` lie in the ranges."""
    found = []
    for a in first:
        for b in second:
            try:
                c = bytes([a, b]).decode(read)
            except UnicodeDecodeError:
                continue
            if len(c) == 1 and c > "\x7f":
                found.append(c)
    return re.compile("[" + re.escape("".join(found)) + "]" if found else "(?!)")


#: Signs of UTF-8 read in a double-byte encoding (its lead bytes and what follows them), and
#: of Shift JIS (the lead bytes of kana). Correct text of the languages has few of the former.
UTF8_SIGNS = {r: _class(r, range(0xE0, 0xF0), range(0x80, 0xC0)) for r in DOUBLE}
SJIS_SIGNS = {r: _class(r, range(0x81, 0x84), range(0x40, 0xFD)) for r in DOUBLE}
HALF = re.compile("[ｦ-ﾟ]")
KANA = re.compile("[ぁ-ヿ]")
#: Any sign at all, in one pass: most texts have none.
TRACES = re.compile("[" + "".join(p.pattern[1:-1] for p in [*UTF8_SIGNS.values(), HALF, LOSSY] if p.pattern != "(?!)") + "]")
SJIS_ANY = re.compile("[" + "".join(p.pattern[1:-1] for p in SJIS_SIGNS.values() if p.pattern != "(?!)") + "]")


def classes(c: str) -> int:
    o = ord(c)
    if o < 0x80:
        return 0 if c.isalpha() else 1 if c.isdigit() else 2 if c in " \n" else 3
    if o < 0xA0:
        return 4
    if o < 0x250:
        return 5 if c.isalpha() else 6
    for k, (a, b) in enumerate([(0x3041, 0x309F), (0x30A0, 0x30FF), (0x3400, 0x9FFF), (0x3000, 0x3040), (0xFF00, 0xFF60), (0xFF61, 0xFF9F), (0x370, 0x3FF), (0x400, 0x4FF), (0xAC00, 0xD7A3), (0x900, 0x97F), (0x2000, 0x206F), (0x2190, 0x27BF), (0xE000, 0xF8FF)]):
        if a <= o <= b:
            return 7 + k
    return 20


START = 21


class _Classes(dict):
    def __missing__(self, o: int) -> str:
        self[o] = chr(classes(chr(o)))
        return self[o]


_classes = _Classes()


def _class_of(c: str) -> int:
    return ord(_classes[ord(c)])


def char_counts(text: str, into: Counter, sign: int = 1) -> None:
    pairs = zip(chr(START) + text.translate(_classes), text)
    if sign > 0:
        into.update(pairs)
    else:
        into.subtract(pairs)


class Model:
    """P(character | class of the one before), backed off to P(character)."""

    def __init__(self, counts: dict[tuple[int, str], float]):
        self.pair = {k: n for k, n in counts.items() if n > 0}
        self.uni: Counter = Counter()
        self.prev: Counter = Counter()
        for (p, c), n in self.pair.items():
            self.uni[c] += n
            self.prev[p] += n
        self.total = sum(self.uni.values()) + 0.1 * ROOM
        self.memo: dict = {}
        self.stretches: dict = {}
        #: The most log P(c | class) is for any class.
        self.best = _Best(self)
        self.bounds: dict[tuple[str, str], _Bounds] = {}
        self.rarity = _Rarity(self)
        #: Mean of -log P(character) over the corpus.
        self.usual = sum(n * self.rarity[c] for c, n in self.uni.items()) / self.total
        self.lifts = [_Lift(self, t, r) for r in DOUBLE for t in TRUE[1:] if t != r]
        self.top = _Top(self.lifts)
        #: The most a character gains; what is beyond LIFT tells no more.
        self.gains = _Table(np.float64, lambda c: min(max(-LIFT - 1, self.top[c]), LIFT + 1))

    def of(self, p: int, c: str) -> tuple[float, int]:
        """(log P(c | class p), class of c)."""
        v = self.memo.get((p, c))
        if v is None:
            back = (self.uni.get(c, 0) + 0.1) / self.total
            v = self.memo[(p, c)] = (math.log((self.pair.get((p, c), 0) + 20 * back) / (self.prev.get(p, 0) + 20)), classes(c))
        return v

    def score(self, text: str, p: int = START) -> float:
        s, memo, of = 0.0, self.memo, self.of
        for c in text:
            v = memo.get((p, c)) or of(p, c)
            s += v[0]
            p = v[1]
        return s

    def gain(self, text: str, start: int, end: int, dec: str, known: dict) -> float:
        """What text[start:end] gains as `dec`. known: sums of earlier calls over the same text; ends are sums of the longer."""
        p = _class_of(text[start - 1]) if start else START
        if (stored := known.get(start)) is None or len(stored) <= end - start:
            stored = known[start] = self.sums(text[start:end], p)
        read = known.get((start, dec[:1]))
        if read is None or not read[0].startswith(dec):
            read = known[start, dec[:1]] = dec, self.sums(dec, p)
        return read[1][len(dec)] - stored[end - start]

    def sums(self, text: str, p: int) -> list[float]:
        """The scores of all that begins the text."""
        s, memo, of, out = 0.0, self.memo, self.of, [0.0]
        for c in text:
            v = memo.get((p, c)) or of(p, c)
            s += v[0]
            p = v[1]
            out.append(s)
        return out

    def strange(self, text: str) -> bool:
        """Whether any stretch would be more usual under any chain of two double-byte encodings.

        This sums what single characters gain, so it is cheap and knows no edges; it only
        spares the texts without any such stretch the search for it.
        """
        if text.isascii():
            return False
        for lift in (self.top, *self.lifts):
            run = 0.0
            for c in text:
                run += lift[c]
                if run < 0:
                    run = 0.0
                elif run > LIFT:
                    break
            if lift is self.top and run <= LIFT:
                return False
            if lift is not self.top and run > LIFT:
                return True
        return False


class _Best(dict):
    def __init__(self, model: Model):
        self.model, self.before = model, {}
        self.rarest = min(range(START + 1), key=lambda p: model.prev.get(p, 0))
        for p, c in model.pair:
            self.before.setdefault(c, []).append(p)

    def __missing__(self, c: str) -> float:
        # the classes never seen before it differ only in their own number
        self[c] = max(self.model.of(p, c)[0] for p in [self.rarest, *self.before.get(c, ())])
        return self[c]


class _Rarity(dict):
    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, c: str) -> float:
        self[c] = -math.log((self.model.uni.get(c, 0) + 0.1) / self.model.total)
        return self[c]


class _Top(dict):
    """The most a character gains under any chain: no text gains more by one of them."""

    def __init__(self, lifts: list[_Lift]):
        self.lifts = lifts

    def __missing__(self, c: str) -> float:
        self[c] = max(x[c] for x in self.lifts)
        return self[c]


class _Lift(dict):
    """What a character gains under a chain, if a character of the restored text begins with it."""

    def __init__(self, model: Model, true: str, read: str):
        self.model, self.true, self.read = model, true, read

    def __missing__(self, c: str) -> float:
        rarity = self.model.rarity
        x = _encoded[self.read][c]
        if x == b"\xff":
            self[c] = -1e9
        elif c < "\x80":
            self[c] = 0.0
        else:
            codes, got, o = _codes[self.true], rarity[c], 0
            while o < len(x):
                n = 2 if len(x) - o > 1 and x[o : o + 2] in codes else 1
                d = codes.get(x[o : o + n])
                # half a character: its other half stands in the next one
                got -= rarity[d] if d else self.model.usual if o + 1 == len(x) and x[o] in _leads[self.true] else 1e9
                o += n
            self[c] = got
        return self[c]


#: Nats below which the single characters of a stretch tell nothing; a case needs more from the pairs.
LIFT = 6.0


#: Stretches whose best reading a task keeps.
MEMO = 200_000
#: Seven-bit Japanese between its escape sequences, the escape characters kept or lost.
SHIFTED = re.compile(r"\x1b?\$[@B]((?:[\x21-\x7e]{2})+?)(?:\x1b?\([BJ]|$)")


def _shifted(m: re.Match) -> str:
    try:
        return ("\x1b$B" + m.group(1) + "\x1b(B").encode("ascii").decode("iso2022_jp")
    except UnicodeError:
        return m.group()


#: Ends a stretch of characters of several bytes, which leave no three ASCII characters in a row.
APART = re.compile("[\x20-\x7e]{3,}")


def _undo_parts(text: str, true: str, read: str, model: Model | None, mapped: str | None = None) -> str | None:
    """Undoes every stretch of high bytes by itself; with a model, only where it gains."""
    mapped = text.translate(_tables[read]) if mapped is None else mapped
    last, out = 0, []
    memo = model.stretches if model else {}
    for m in RUNS[true].finditer(mapped):
        a, b = m.span()
        edges = [a, *(x for e in APART.finditer(mapped, a, b) for x in (e.start() + 1, e.end())), b]
        for a, b in zip(edges[::2], edges[1::2]):
            # the same stretches come again and again, such as the accented letters of a language
            key = (true, read, text[a - 1 : a], text[a:b])
            best = memo.get(key, 0)
            if best == 0:
                best = _undo_stretch(text, mapped, a, b, true, model)
                if len(memo) < MEMO:
                    memo[key] = best
            if best:
                out += [text[last : a + best[0]], best[2]]
                last = a + best[1]
    return "".join([*out, text[last:]]) if out else None


def _undo_stretch(text: str, mapped: str, a: int, b: int, true: str, model: Model | None) -> tuple[int, int, str] | None:
    """(start, end, restored) within text[a:b] of what gains most, if anything does."""
    high = [i for i in range(a, b) if mapped[i] >= "\x80"]
    if not high:
        return None
    top, best, scores = 0.0, None, {}
    # a correct character may stand before the stretch or after it
    for start in (high[0], *(high[1:2] if model else ())):
        for end in {min(b, high[-1] + 2), high[-1] + 1, *([high[-1]] if model else [])}:
            if end <= start:
                continue
            try:
                dec = mapped[start:end].encode("latin-1").decode(true)
            except UnicodeError:
                continue
            gain = model.gain(text, start, end, dec, scores) if model else float(end)
            if gain > top:
                top, best = gain, (start - a, end - a, dec)
    return best


def _undo_single(text: str, true: str, read: str, mapped: str | None = None) -> str | None:
    mapped = text.translate(_tables[read]) if mapped is None else mapped
    changed, last, out = False, 0, []
    for m in RUNS[true].finditer(mapped):
        a, b = m.span()
        try:
            dec = mapped[a:b].encode("latin-1").decode(true)
        except UnicodeError:
            try:
                b -= 1
                dec = mapped[a:b].encode("latin-1").decode(true)
            except UnicodeError:
                continue
        out += [text[last:a], dec]
        last, changed = b, True
    return "".join([*out, text[last:]]) if changed else None


def _two_codes() -> dict[str, bytes]:
    """Characters that cp932 has twice, with the code that encoding doesn't give."""
    out = {}
    for a in range(0xFA, 0xFD):
        for b in range(0x40, 0xFD):
            try:
                c = bytes([a, b]).decode("cp932")
            except UnicodeDecodeError:
                continue
            if len(c) == 1:
                own = c.encode("cp932")
                pairs = [bytes([a, b])] if own != bytes([a, b]) else [bytes([x, y]) for x in (0xED, 0xEE) for y in range(0x40, 0xFD) if bytes([x, y]).decode("cp932", "replace") == c]
                if pairs:
                    out[c] = pairs[0]
    return out


_twice = _two_codes()
TWICE = re.compile("[" + re.escape("".join(_twice)) + "]")


def _undo_double(text: str, true: str, read: str) -> str | None:
    if true == "utf-8":
        parts, n = [*map(_plain[read].__getitem__, text)], 0
        raw = b"".join(parts)
        if not UTF8_BYTES.search(raw):
            return None
        starts = [0]
        for x in parts:
            starts.append(starts[-1] + len(x))
        at = {s: i for i, s in enumerate(starts)}
        out, last = [], 0
        for m in UTF8_BYTES.finditer(raw):
            a, b = m.span()
            while a < b and a not in at:
                a += 1
            while b > a and b not in at:
                b -= 1
            if b - a < 4:
                continue
            dec = raw[a:b].decode("utf-8", "replace")
            if dec.count("�") * 4 > len(dec):
                continue
            out += [text[last:at[a]], dec]
            last, n = at[b], n + 1
        return "".join([*out, text[last:]]) if n else None
    whole = text.encode(read, "replace")
    if read == "cp932" and TWICE.search(text):
        whole = TWICE.sub("\0", text).encode(read, "replace")
        for c in TWICE.findall(text):  # the other code of characters that have two
            whole = whole.replace(b"\0", _twice[c], 1)
    lost = whole.count(b"?") - text.count("?")
    if lost * 3 > len(whole):  # no text is longer than its bytes
        return None
    dec = whole.decode(true, "replace")
    if (dec.count("�") + lost) * 3 > len(dec):
        return None
    kana, had = len(KANA.findall(dec)), len(KANA.findall(text))
    return dec if kana * 4 >= len(dec) and had * 3 < kana * 2 else None


def _decoded(true: str) -> dict[bytes, str]:
    """The characters of one to three bytes of an encoding."""
    codes = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(0x81, 0xFF) for b in range(0x40, 0xFF)]
    codes += [bytes([0x8F, a, b]) for a in range(0xA1, 0xFF) for b in range(0xA1, 0xFF)] if true == "euc_jp" else []
    out = {}
    for x in codes:
        try:
            c = x.decode(true)
        except UnicodeDecodeError:
            continue
        if len(c) == 1:
            out[x] = c
    return out


_codes = {t: _decoded(t) for t in TRUE[1:]}


_leads = {t: {x[0] for x in codes if len(x) > 1} for t, codes in _codes.items()}


class _Encoded(dict):
    """The bytes of characters; one no encoding has, where the reading can't have made it."""

    def __init__(self, read: str, twice: dict[str, bytes]):
        self.read, self.twice = read, twice

    def __missing__(self, c: str) -> bytes:
        try:
            self[c] = self.twice[c] if c in self.twice else c.encode(self.read)
        except UnicodeEncodeError:
            self[c] = b"\xff"
        return self[c]


_encoded = {r: _Encoded(r, _twice if r == "cp932" else {}) for r in DOUBLE}
#: The same with the code the encoding gives.
_plain = {r: _Encoded(r, {}) for r in DOUBLE}


#: A code of more than two bytes of an encoding begins so.
_LONG = {"cp932": re.compile(b"(?!)"), "euc_jp": re.compile(b"\x8f"), "gb18030": re.compile(b"[\x81-\xfe][0-9]")}


class _Bounds(dict):
    """Of a character under a chain, the most that its bytes may count: all together, those before the last and those
    after the first one (none of one byte only), and the first and the last byte."""

    def __init__(self, model: Model, true: str, read: str):
        self.best, self.codes, self.read = model.best, _codes[true], read

    def of(self, code: bytes) -> float:
        return self.best[self.codes[code]] if code in self.codes else -1e9

    def __missing__(self, c: str) -> tuple:
        x = _encoded[self.read][c]
        one = [self.of(x[k : k + 1]) for k in range(len(x))]
        # where there are four bytes, the second and the last are digits: they stand for themselves
        self[c] = max(self.of(x), sum(one)), sum(one[:-1]) if len(x) > 1 else None, sum(one[1:]), x[:1], x[-1:]
        return self[c]


def _may_gain(text: str, true: str, read: str, model: Model) -> bool:
    """Whether any stretch might gain more than its ends cost, if every restored character had the class before
    it that suits it best. One that stands across two characters counts half for each of them."""
    if (bounds := model.bounds.get((true, read))) is None:
        bounds = model.bounds[true, read] = _Bounds(model, true, read)
    memo, of, best, codes, cost = model.memo, model.of, model.best, _codes[true], math.log(len(text) + 1)
    p, run, half, all_of = START, -1e9, -1e9, [*map(bounds.__getitem__, text)]
    heads = [x[3] for x in all_of[1:]]
    heads.append(b"")
    for i, (c, (whole, first, last, _, end), head) in enumerate(zip(text, all_of, heads)):
        v = memo.get((p, c)) or of(p, c)
        # what the stretch so far gains, and less what the class after it may do
        if i and run + best[c] - v[0] - cost > -1e-6:
            return True
        p = v[1]
        d = codes.get(end + head) if head else None
        after = best[d] / 2 if d else -1e9
        if first is None:
            most = max(whole, half, after)
        else:
            most = max(whole, first + after, half + max(last, after if len(_encoded[read][c]) == 2 else -1e9))
        if not i:
            run = 0.0
        elif run < -cost:
            run = -cost
        run += most - v[0]
        half = after
    return run > -1e-6


#: Whether an encoding has one-byte characters beside ASCII, after which those of two bytes may begin anywhere.
_SHIFTS = {t: any(len(x) == 1 and x[0] > 0x7F for x in codes) for t, codes in _codes.items()}


def _undo_in_step(text: str, raw: list[bytes], true: str, model: Model) -> str | None:
    """What _undo_stretches finds where every restored character is made of one character."""
    memo, of, cost = model.memo, model.of, math.log(len(text) + 1)
    keep = undo = 0.0
    kept_class = undone_class = START
    kept: tuple | None = None  # (path, character)
    undone: tuple | None = None
    for c, d in zip(text, map(_codes[true].get, raw)):
        if keep - cost > undo:
            undo, undone_class, undone = keep - cost, kept_class, kept
        elif undo - cost > keep:
            keep, kept_class, kept = undo - cost, undone_class, undone
        v = memo.get((kept_class, c)) or of(kept_class, c)
        keep, kept_class, kept = keep + v[0], v[1], (kept, c)
        if d is None:
            undo = -math.inf
        else:
            v = memo.get((undone_class, d)) or of(undone_class, d)
            undo, undone_class, undone = undo + v[0], v[1], (undone, d)
    node, out = undone if undo > keep else kept, []
    while node is not None:
        out.append(node[1])
        node = node[0]
    got = "".join(reversed(out))
    return got if got != text else None


def _undo_stretches(text: str, true: str, read: str, model: Model) -> str | None:
    """Undoes the stretches whose restored characters the model prefers (Viterbi).

    A stretch may begin and end between any two characters; each such place inside the text
    costs the logarithm of the number of places.
    """
    raw = [*map(_encoded[read].__getitem__, text)]
    if not any(len(x) in (3, 8) for x in raw):  # rare letters of euc_jp, syllables of euc_kr that are spelt out
        if not _SHIFTS[true] and not any(x[0] == 0x8F or len(x) == 1 and 0x7F < x[0] < 0xFF for x in raw):
            return _undo_in_step(text, raw, true, model)
        if not _LONG[true].search(b"".join(raw)) and not _may_gain(text, true, read, model):
            return None
    stream, codes, memo, of, cost = b"".join(raw), _codes[true], model.memo, model.of, math.log(len(text) + 1)
    size = len(stream)
    kept: list = [None] * (size + 1)  # (value, class, path, character) of texts that end in a character kept
    undone: list = [None] * (size + 1)
    kept[0] = undone[0] = (0.0, START, None, "")
    o = 0
    for c, x in zip(text, raw):
        k, u = kept[o], undone[o]
        if u is None or k[0] - cost > u[0]:
            undone[o] = (k[0] - cost, *k[1:])
        elif u[0] - cost > k[0]:
            k = (u[0] - cost, *u[1:])
        v = memo.get((k[1], c)) or of(k[1], c)
        kept[o + len(x)] = (k[0] + v[0], v[1], k, c)
        for at in range(o, o + len(x)):
            u = undone[at]
            if u is None:
                continue
            for n in (1, 2, 3, 4):
                code = stream[at : at + n]
                d = codes.get(code)
                if n == 4 and d is None and true == "gb18030" and len(code) == 4 and code[0] > 0x80 and 0x30 <= code[1] <= 0x39:
                    d = code.decode(true, "replace")
                    d = d if len(d) == 1 and d != "\ufffd" else None
                if d is not None and at + n <= size:
                    v = memo.get((u[1], d)) or of(u[1], d)
                    old = undone[at + n]
                    if old is None or u[0] + v[0] > old[0]:
                        undone[at + n] = (u[0] + v[0], v[1], u, d)
                    break
        o += len(x)
    k, u = kept[size], undone[size]
    node = u if u is not None and u[0] > k[0] else k
    out = []
    while node is not None:
        out.append(node[3])
        node = node[2]
    got = "".join(reversed(out))
    return got if got != text else None


def edges(chain: str, text: str, restored: str) -> float:
    """What a stretch inside correct text must gain beyond others, as it might lie anywhere.

    A single character is no stretch: rare ones would be exchanged for usual ones.
    """
    if chain.startswith(("utf-8", "iso2022")):
        return 0.0
    most = min(len(text), len(restored))
    first = next((i for i in range(most) if text[i] != restored[i]), most)
    most -= first
    last = next((i for i in range(most) if text[-1 - i] != restored[-1 - i]), most)
    if len(restored) - first - last < 2:
        return math.inf
    return 0.0 if text[:first].isascii() and text[len(text) - last :].isascii() else 2 * math.log(len(text) + 1)


def readings(text: str, model: Model | None = None, chains: int = EVERY, gains: bool = True) -> dict[str, str]:
    """{chain: restored text} of the chains that can be undone.

    With a character model, stretches of two-byte characters are found by what they gain. `chains` and `gains`
    are what `signs` says of the text.
    """
    out: dict[str, str] = {}
    got = SHIFTED.sub(_shifted, text)
    if got != text:
        out["iso2022_jp>ascii"] = got
    if text.isascii():
        return out
    if chains and SUSPECT.search(text):
        utf8 = bool(SUSPECTS.search(text))
        much = len(SUSPECT.findall(text)) * 4 >= len(text) or bool(CLUSTER.search(text))
        done: dict[tuple[str, str], str | None] = {}
        for r in SINGLE if utf8 or much else ():
            mapped = None
            for t in TRUE:
                if not (utf8 if t == "utf-8" else much) or not chains & CHAINS[t, r]:
                    continue
                mapped = text.translate(_tables[r]) if mapped is None else mapped
                if (t, mapped) not in done:  # readings agree on the letters of many languages
                    done[t, mapped] = _undo_single(text, t, r, mapped) if t == "utf-8" else _undo_parts(text, t, r, model, mapped)
                got = done[t, mapped]
                if got is not None and got != text:
                    out[f"{t}>{r}"] = got
                    again, n = got, 1
                    while t == "utf-8" and n < 3 and (more := _undo_single(again, t, r)) not in (None, again):
                        again, n = more, n + 1
                        out[f"{t}>{r} x{n}"] = again
    if model and gains and model.strange(text):
        for r in DOUBLE:
            for t in TRUE[1:]:
                if t != r and (got := _undo_stretches(text, t, r, model)) is not None:
                    out[f"{t}>{r}"] = got
    traces = TRACES.search(text)
    odd = SJIS_ANY.search(text) and len(KANA.findall(text)) * 4 < len(text)
    if not traces and not odd:
        return out
    half = bool(HALF.search(text))
    wide = sum(c > "\x7f" for c in text)
    for r in DOUBLE:
        signs = {"utf-8": half and r == "cp932" or len(UTF8_SIGNS[r].findall(text)) >= 2}
        signs["cp932"] = odd and len(SJIS_SIGNS[r].findall(text)) * 3 >= wide
        signs["euc_jp"] = signs["gb18030"] = half or bool(LOSSY.search(text))
        for t in TRUE:
            if t != r and signs[t] and (got := _undo_double(text, t, r)) not in (None, text):
                had = out.get(f"{t}>{r}")
                if had is None or model.score(got) > model.score(had):
                    out[f"{t}>{r}"] = got
    return out


def _codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts one after the other, and where each text begins."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.cumsum(lengths) - lengths


class _Table:
    """A number for every character, worked out when it first comes."""

    def __init__(self, kind: type, of):
        self.known, self.value, self.of = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=kind), of

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        new = codes[~self.known[codes]]
        for o in np.unique(new).tolist():
            self.known[o], self.value[o] = True, self.of(chr(o))
        return self.value[codes]


_class_codes = _Table(np.uint8, classes)
_NOTED, _KANA, _SUSPECT, _UTF8, _SJIS = 1, 2, 4, 8, 8 << len(DOUBLE)


def _kind(c: str) -> int:
    """Whether a character is one that `readings` looks for wherever it stands, kana, a suspect, or a sign of UTF-8 or
    of Shift JIS in each of the double-byte encodings."""
    noted = c == "$" or HALF.match(c) or LOSSY.match(c)
    both = sum((_UTF8 << k) * bool(UTF8_SIGNS[r].match(c)) | (_SJIS << k) * bool(SJIS_SIGNS[r].match(c)) for k, r in enumerate(DOUBLE))
    return _NOTED * bool(noted) | _KANA * bool(KANA.match(c)) | _SUSPECT * bool(SUSPECT.match(c)) | both


_kinds = _Table(np.uint16, _kind)
_firsts = _Table(np.int64, lambda c: _chains(c, _FIRST))
_seconds = _Table(np.int64, lambda c: _chains(c, _SECOND))


def pair_counts(texts: list[str]) -> dict[tuple[int, str], int]:
    """What char_counts counts, over many texts at once, by the number of a class."""
    texts = [t for t in texts if t]
    if not texts:
        return {}
    codes, begin = _codes_of(texts)
    before = np.empty(len(codes), dtype=np.int64)
    before[1:] = _class_codes(codes[:-1])
    before[begin] = START
    pairs, n = np.unique(before << 21 | codes, return_counts=True)
    return {(p >> 21, chr(p & 0x1FFFFF)): k for p, k in zip(pairs.tolist(), n.tolist())}


def signs(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, none of them empty: whether it may have readings or lossy characters; the bits of the chains of
    a single-byte reading for which suspects stand close enough, and two bytes of a character side by side; whether
    its characters may gain more than LIFT one after the other. One surely has no readings that has none of the
    characters that `readings` looks for, no such chain, no two signs of UTF-8 in one encoding, not enough of Shift JIS,
    and no such gain."""
    codes, begin = _codes_of(texts)
    if not len(codes):
        return np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    kinds, end = _kinds(codes), np.append(begin[1:], len(codes))
    owner = np.repeat(np.arange(len(texts)), end - begin)
    some = lambda x: np.bincount(owner[x], minlength=len(texts))
    odd = np.bitwise_or.reduceat(kinds, begin) & _NOTED > 0
    little, wide = some(kinds & _KANA > 0) * 4 < end - begin, some(codes > 0x7F)
    for k in range(len(DOUBLE)):
        sjis = some(kinds & _SJIS << k > 0)
        # a kana needs one of the at most three high bytes of a character, and takes one ASCII character at most
        odd |= (some(kinds & _UTF8 << k > 0) >= 2) | little & (sjis > 0) & (sjis * 3 >= wide) & (wide * 12 >= end - begin - wide)
    first = _firsts(codes)
    first[:-1] &= _seconds(codes[1:])
    first[end - 1] = 0
    suspect = kinds & _SUSPECT > 0
    at = np.flatnonzero(suspect)
    text = owner[at]
    apart = np.where(text[1:] == text[:-1], at[1:] - at[:-1], 9)
    side, much = np.zeros(len(texts), dtype=bool), some(suspect)
    much = (much > 0) & (much * 4 >= end - begin)
    side[text[1:][apart == 1]] = much[text[1:][apart <= 3]] = True
    chains = np.bitwise_or.reduceat(first, begin) & (np.where(side, _OF_UTF8, 0) | np.where(much, EVERY & ~_OF_UTF8, 0))
    gains = _highest(model.gains(codes), begin, end) > LIFT - 1e-4
    return odd | (chains != 0) | gains, chains, gains


def _highest(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The highest sum of neighbouring values in each part, zero at least."""
    upto = np.cumsum(values)
    upto -= np.repeat(upto[begin] - values[begin], end - begin)
    # parts one below the other: the lowest sum so far is the part's own
    down = np.repeat(np.arange(len(begin)) * (2 * np.abs(upto).max() + 1), end - begin)
    before = np.empty(len(values))
    before[1:] = upto[:-1]
    before[begin] = 0.0
    high = np.maximum.reduceat(upto - (np.minimum.accumulate(before - down) + down), begin)
    return np.maximum(high + 4 * np.spacing(down[-1]), 0.0)  # not lower for being rounded


def quiet(texts: list[str], model: Model) -> np.ndarray:
    """Which of the texts, none of them empty, surely have no readings and no lossy characters."""
    return ~signs(texts, model)[0]


def _counted(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm import charsets as c

        n: Counter = Counter()
        for b in batches:
            n.update(c.pair_counts(b["text"].tolist()))
        yield pd.DataFrame([(p, c_, float(v)) for (p, c_), v in n.items()], columns=["p", "c", "n"])

    return rows.select("text").mapInPandas(count, "p int, c string, n double").groupBy("p", "c").agg(F.sum("n").alias("n"))


def _likelihoods(rows: DataFrame, counts: dict, least: float) -> DataFrame:
    """Rows with a chain worth keeping: gain = log-likelihood restored less stored."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm import charsets as c

        model = c.Model(counts)
        for b in batches:
            out = []
            loud, chains, gains = c.signs(b["text"].tolist(), model)
            b = b[loud]
            for key, src, field, t, which, gain in zip(b["row_key"], b["source"], b["field"], b["text"], chains[loud].tolist(), gains[loud].tolist()):
                lost = len(c.LOSSY.findall(t))
                base = None
                for chain, restored in c.readings(t, model, which, gain).items():
                    base = model.score(t) if base is None else base
                    gain = model.score(restored) - base - c.edges(chain, t, restored)
                    if gain > least:
                        out.append((key, src, field, chain, gain, t, restored))
                if lost:
                    out.append((key, src, field, "lossy", c.LOSSY_WEIGHT, t, None))
            yield pd.DataFrame(out, columns=["row_key", "source", "field", "chain", "gain", "text", "restored"])

    return rows.select("row_key", "source", "field", "text").mapInPandas(
        score, "row_key string, source string, field string, chain string, gain double, text string, restored string"
    )


def _weigh(found: DataFrame, sizes: DataFrame, rounds: int, shrink: float) -> DataFrame:
    """EM over the chain weights of sources; adds posterior of each row's chain."""
    fields = sizes.groupBy("field").agg(F.sum("n").alias("n_field"))
    chains = len(TRUE) * (len(SINGLE) + len(DOUBLE)) + 1
    top = found.groupBy("row_key", "field").agg(F.greatest(F.max("gain"), F.lit(0.0)).alias("top"))
    weighed = settle(found.join(sizes, ["source", "field"]).join(F.broadcast(fields), "field").join(top, ["row_key", "field"]))
    post = weighed.withColumn("w", F.lit(0.01 / chains)).withColumn("clean", F.lit(0.99))

    def posterior(df: DataFrame) -> DataFrame:
        like = df.withColumn("u", F.col("w") * F.exp(F.col("gain") - F.col("top")))
        total = like.groupBy("row_key", "field").agg(F.sum("u").alias("all_u"))
        whole = F.col("all_u") + F.col("clean") * F.exp(-F.col("top"))
        return like.join(total, ["row_key", "field"]).withColumn("post", F.col("u") / whole).drop("u", "all_u")

    post = settle(posterior(post))
    for _ in range(rounds):
        by_field = post.groupBy("field", "chain").agg(F.sum("post").alias("k_field"))
        by_source = post.groupBy("source", "field", "chain").agg(F.sum("post").alias("k"))
        base = weighed.join(F.broadcast(by_field), ["field", "chain"]).join(by_source, ["source", "field", "chain"])
        share = (F.col("k_field") + 0.01) / (F.col("n_field") + 1.0)
        base = base.withColumn("w", (F.col("k") + shrink * share) / (F.col("n") + shrink))
        cases = post.groupBy("source", "field").agg(F.sum("post").alias("k_all"))
        base = base.join(cases, ["source", "field"]).withColumn("clean", F.greatest(F.lit(0.01), 1 - (F.col("k_all") + shrink * 0.01) / (F.col("n") + shrink)))
        post = settle(posterior(base.drop("k_field", "k", "k_all")))
    return post


def repair(rows: DataFrame, rounds: int = 2, shrink: float = 50.0, threshold: float = 0.5) -> DataFrame:
    """(row_key, field, chain, posterior, restored) of the records read in a wrong encoding.

    `rows`: row_key and field (a record once), source, text. Null and empty texts are
    clean. restored is null where the text can't be had back (replacement characters).
    A record comes out once, with its most probable chain.
    """
    rows = rows.where("text is not null and text != ''").withColumn("source", F.coalesce("source", F.lit("")))
    sizes = settle(rows.groupBy("source", "field").agg(F.count(F.lit(1)).alias("n")))
    counts = {(r["p"], r["c"]): r["n"] for r in _counted(rows).collect()}  # bounded by Unicode
    found = settle(_likelihoods(rows, counts, -8.0))
    post = _weigh(found, sizes, 1, shrink)
    # M-step of the character model: cases count with their restored text
    w = post.where("post > 0.5").select("row_key", "field", "text", "restored", "post")

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm import charsets as c

        n: Counter = Counter()
        for b in batches:
            for t, r in zip(b["text"], b["restored"]):
                c.char_counts(t, n, -1)
                if r:
                    c.char_counts(r, n, 1)
        yield pd.DataFrame([(ord(p), c_, float(v)) for (p, c_), v in n.items()], columns=["p", "c", "n"])

    best = w.groupBy("row_key", "field").agg(F.max_by(F.struct("text", "restored"), "post").alias("b")).select("b.*")
    for r in best.mapInPandas(moved, "p int, c string, n double").groupBy("p", "c").agg(F.sum("n").alias("n")).collect():
        counts[(r["p"], r["c"])] = counts.get((r["p"], r["c"]), 0.0) + r["n"]
    again = found.select("row_key", "source", "field", "text").distinct()
    # few bytes but much work a row: spread by rows, not by bytes
    spark = rows.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    again = again.repartition(min(most, 1 + found.count() // 500), "row_key")
    post = _weigh(settle(_likelihoods(again, counts, -8.0)), sizes, rounds, shrink)
    one = post.groupBy("row_key", "field").agg(F.sum("post").alias("posterior"), F.max_by(F.struct("chain", "restored"), F.struct("post", "chain")).alias("b"), F.max(F.col("chain") == "lossy").alias("lossy"))
    return one.where(F.col("posterior") > threshold).select("row_key", "field", "b.chain", F.round("posterior", 6).alias("posterior"), F.when(~F.col("lossy"), F.col("b.restored")).alias("restored"))
