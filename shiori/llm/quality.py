"""Problem 10: per-document text statistics and text types.

Method: thresholds on statistics of a document's blocks (paragraphs between blank lines)
are noisy labelling functions with three outcomes: speaks for junk (lists, tables,
noise), for natural language, or abstains. Their accuracies are learned by
expectation-maximization on their agreements over all blocks. The E-step needs only how
often each pattern of votes occurs; the table of patterns is bounded by the number of
functions, not by the data, so EM runs on it exactly. A document's junk share is the
character-weighted posterior of its blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiori.session import settle

BULLET = re.compile(r"^\s*(?:[・*•◦▪‣●○◆◇□☐☑✓>]\s*|[-–—+]\s+|\[[ xX]?\]\s*|[(（]?\d{1,4}[.)）:、．]\s*|第\s*\d+\s*[話章回巻課]\s*|[①-⑳]\s*)")
TERMINAL = re.compile(r"[。．.!?！？…।॥♪][」』”’\"'»)）\]】]*\s*$|[」』”»]\s*$")
SENTENCE_END = re.compile(r"[。！？।॥]+|[.!?…]+(?=\s|$|[”\"»」』])")
WORD = re.compile(r"[一-鿿々]+|[ァ-ヺー]+|[ぁ-ゖ]+|[가-힣]+|[^\W\d_ぁ-ヿ一-鿿々가-힣]+(?:[’'][^\W\d_]+)?[ऀ-ःऺ-ॏ]*(?:[^\W\d_ぁ-ヿ一-鿿々가-힣]|[ऀ-ॏ])*|\d+(?:[.:,]\d+)*")
GAP = re.compile(r"\t|\s*\|\s*|(?<=\S)\s{3,}(?=\S)|(?<=\S),(?=\S)|\s/\s|;(?=\S)")
CELL = re.compile(r"^(?:[-–—]|[\d.,:/%+\-]*\d[\d.,:/%+\-]*)$")
#: Encoded bytes, program text, log lines and long symbol chains.
MACHINE = re.compile(r"[A-Za-z0-9+/=_\-]{28,}|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|[{};]\s*$|\w\(\)|[=;{}<>|\\]{2,}|https?://\S+", re.M)
VOTES = ["marker", "columns", "figures", "repeats", "endings", "common", "sentences", "wrapped", "fragments", "symbols", "records", "machine"]
WHY = {"en", "de", "fr", "es"}


class _Kinds(dict):
    """What each character is: (a letter, a letter or Devanagari sign, a digit, its script); looked up once a character."""

    def __missing__(self, c: str) -> tuple[bool, bool, bool, str]:
        script = "ja" if "ぁ" <= c <= "ヿ" else "zh" if "一" <= c <= "鿿" else "ko" if "가" <= c <= "힣" else "hi" if "ऀ" <= c <= "ॿ" else "latin" if c.isalpha() else ""
        self[c] = c.isalpha(), c.isalpha() or "ऀ" <= c <= "ॿ", c.isdigit(), script
        return self[c]


_kinds = _Kinds()


def script_of(n: dict[str, int]) -> str:
    """Language by the characters of each script, or "latin"."""
    if n.get("ja", 0) > 0.05 * sum(n.values()):
        return "ja"
    return max(n, key=lambda k: (n[k], k), default="latin")


class Common:
    """Common words by language, with a pattern for those of scripts without spaces."""

    def __init__(self, words: dict[str, set[str]]):
        self.words = words
        self.pattern = {k: re.compile("|".join(map(re.escape, sorted(words[k], key=len, reverse=True)))) for k in ("ja", "zh") if words.get(k)}


def common_share(text: str, words: list[str], lang: str, letters: int, common: Common) -> float:
    """Share of the words that are common; without spaces, share of characters in common words."""
    if lang in ("ja", "zh"):
        if not letters or lang not in common.pattern:
            return 0.0
        return sum(map(len, common.pattern[lang].findall(text))) / letters
    words = [w.lower() for w in words if w[0].isalpha()]
    if not words:
        return 0.0
    if lang == "ko":
        ends = tuple(common.words.get("ko", ()))
        return sum(text.count(e + " ") + text.count(e + ".") for e in ends) / max(1, len(text.split())) if ends else 0.0
    langs = [lang] if lang == "hi" else sorted(WHY)
    return max((sum(map(common.words.get(k, set()).__contains__, words)) / len(words) for k in langs), default=0.0)


class Measures:
    """Counts of one block, from which its statistics and votes are made; those of a text are sums over its blocks."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [x for x in text.split("\n") if x.strip()]
        self.ended = [bool(TERMINAL.search(x)) for x in self.lines]
        self.words = WORD.findall(text)
        self.chars = Counter("".join(text.split()))

    @classmethod
    def of(cls, text: str, parts: list["Measures"]) -> "Measures":
        if len(parts) == 1:
            return parts[0]
        out = cls("")
        out.text = text
        for p in parts:
            out.lines += p.lines
            out.ended += p.ended
            out.words += p.words
            out.chars.update(p.chars)
        return out

    def statistics(self, common: Common) -> dict[str, float]:
        n = self.chars.total()
        alpha = letters = digits = 0
        scripts: dict[str, int] = {}
        for c, k in self.chars.items():
            is_alpha, is_letter, is_digit, script = _kinds[c]
            if is_letter:
                letters += k
                alpha += k * is_alpha
            if script:
                scripts[script] = scripts.get(script, 0) + k
            digits += k * is_digit
        self.lang = script_of(scripts)
        return {
            "n_chars": n, "n_lines": len(self.lines), "n_words": len(self.words),
            "mean_word_length": sum(map(len, self.words)) / len(self.words) if self.words else 0.0,
            "symbol_ratio": (n - letters - digits) / n if n else 0.0,
            "digit_ratio": digits / n if n else 0.0,
            "terminal_share": sum(self.ended) / len(self.lines) if self.lines else 0.0,
            "common_share": common_share(self.text, self.words, self.lang, alpha, common),
        }


#: Six or more of one character in a row.
REPEATED = re.compile(r"(.)\1{5,}", re.S)
TAGGED = re.compile(r"\d|[（(][^（）()]{1,12}[）)]")


def votes(m: Measures, s: dict[str, float]) -> list[int]:
    """+1 junk, -1 natural, 0 abstains; in the order of VOTES."""
    block, lines, words = m.text, m.lines, m.words
    k = len(lines)
    chars = max(1, int(s["n_chars"]))
    stripped = [BULLET.sub("", x).strip() for x in lines]
    marked = sum(bool(BULLET.match(x)) for x in lines) / max(1, k)
    rows = [GAP.split(x) for x in lines]
    columns = sum(len(r) > 1 for r in rows) / max(1, k)
    cells = [c for r in rows for c in map(str.strip, r) if c]
    figures = sum(bool(CELL.match(c)) for c in cells) / max(1, len(cells))
    ends = len(SENTENCE_END.findall(block))
    runs = sum(len(r.group()) for r in REPEATED.finditer("".join(block.split()))) / chars
    variety = len(set(words)) / max(1, len(words))
    mean_line = chars / max(1, k)
    widths = [len(x) for x in lines[:-1]]
    even = k >= 2 and min(widths) >= 15 and max(widths) - min(widths) <= max(3, 0.2 * max(widths))
    machine = sum(len(x) for x in lines if MACHINE.search(x)) / max(1, sum(map(len, lines)))
    tagged = sum(not e and bool(TAGGED.search(x)) for x, e in zip(lines, m.ended)) / max(1, k)
    wide = m.lang in ("ja", "zh", "ko")
    long_line = 12 if wide else 40
    return [
        (1 if marked >= 0.6 and s["terminal_share"] < 0.4 and (k > 1 or s["common_share"] < 0.05) else 0) or (-1 if marked == 0 and mean_line > 2 * long_line and ends else 0),
        1 if k >= 2 and columns >= 0.7 and s["terminal_share"] < 0.3 or k == 1 and len(rows[0]) > 3 and not ends else 0,
        1 if figures >= 0.3 and len(cells) >= 3 else 0,
        1 if runs > 0.3 or len(words) >= 12 and variety < 0.35 and ends < len(words) / 30 else 0,
        1 if s["terminal_share"] == 0 and k >= 3 and mean_line < (8 if wide else 40) and s["common_share"] < 0.1 else -1 if s["terminal_share"] >= 0.6 else 0,
        -1 if s["common_share"] >= (0.08 if wide else 0.15) else 1 if s["common_share"] < (0.03 if wide else 0.08) and chars >= 12 else 0,
        -1 if ends * (60 if wide else 160) >= chars else 1 if ends == 0 and k >= 4 and mean_line < long_line / 2 else 0,
        -1 if even and not marked and columns < 0.3 and s["common_share"] >= 0.06 else 0,
        1 if k >= 3 and sum(len(x.split()) <= 4 and not TERMINAL.search(x) for x in stripped) >= 0.8 * k and (s["common_share"] < 0.1 or not wide) and len(set(stripped)) < 0.9 * k else 0,
        1 if s["symbol_ratio"] > 0.35 else -1 if s["symbol_ratio"] < 0.12 and ends else 0,
        1 if k >= 2 and tagged >= 0.6 else -1 if k >= 2 and tagged <= 0.1 and mean_line >= 7 and s["common_share"] >= 0.04 and columns < 0.3 and not marked and len(set(lines)) >= 0.8 * k else 0,
        1 if machine >= 0.5 else 0,
    ]


def measured(text: str, common: Common) -> tuple[dict[str, float], Counter]:
    """The statistics of a text, and how many characters of its blocks show each pattern of votes."""
    parts = [Measures(b) for b in blocks(text)]
    per: Counter = Counter()
    for m in parts:
        s = m.statistics(common)
        per[tuple(votes(m, s))] += s["n_chars"]
    return (s if len(parts) == 1 else Measures.of(text, parts).statistics(common)), per


def blocks(text: str) -> list[str]:
    return [b for b in re.split(r"\n[ \t　]*\n+", text.replace("\r\n", "\n")) if b.strip()]


#: Starting point and smoothing of the accuracies: P(vote for junk | class, not abstaining), natural then junk.
START = np.array([0.1, 0.9])


def learn(patterns: dict[tuple[int, ...], float], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior P(junk) of every pattern; `patterns` maps a pattern to how many blocks show it.

    An abstaining function says nothing of the class. Accuracies are smoothed to START and
    kept on its side of one half, so that the classes can't swap.
    """
    if not patterns:
        return {}
    keys = sorted(patterns)
    v = np.array(keys)
    w = np.array([patterns[k] for k in keys], dtype=float)
    theta = np.repeat(START[None], v.shape[1], axis=0)  # function, class
    prior = np.array([0.75, 0.25])
    strength = max(4.0, 0.02 * w.sum())
    post = None
    for _ in range(rounds):
        like = np.log(prior) + (v == 1) @ np.log(theta) + (v == -1) @ np.log1p(-theta)
        like -= like.max(axis=1, keepdims=True)
        post = np.exp(like)
        post /= post.sum(axis=1, keepdims=True)
        mass = post * w[:, None]
        prior = (mass.sum(axis=0) + strength * np.array([0.75, 0.25])) / (w.sum() + strength)
        yes = (v == 1).T @ mass + strength * START
        said = (v != 0).T @ mass + strength
        theta = yes / said
        theta[:, 0] = np.clip(theta[:, 0], 0.002, 0.45)
        theta[:, 1] = np.clip(theta[:, 1], 0.55, 0.998)
    return {k: float(p) for k, p in zip(keys, post[:, 1])}


def text_types(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its statistics, junk_share and text_type (natural or junk).

    Null and empty texts have statistics of 0, junk_share 0 and type natural. `common` is
    a small table of (lang, word), gathered on the driver.
    """
    known: dict[str, set[str]] = {}
    for r in common.where("lang is not null and word is not null").collect():
        known.setdefault(r["lang"], set()).add(r["word"].lower())
    names = list(Measures("").statistics(Common(known)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm import quality as q

        words = q.Common(known)
        for b in batches:
            out = []
            for k, t in zip(b["k"], b["t"].fillna("")):
                s, per = q.measured(t, words)
                out.append((k, *(float(s[n]) for n in names), [",".join(map(str, p)) for p in per], list(per.values())))
            yield pd.DataFrame(out, columns=["k", *names, "patterns", "sizes"])

    kind = docs.schema[key].dataType.simpleString()
    cols = ", ".join(f"{n} double" for n in names)
    rows = settle(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(measure, f"k {kind}, {cols}, patterns array<string>, sizes array<long>"))
    seen = rows.select(F.explode("patterns").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    post = {",".join(map(str, k)): v for k, v in learn({tuple(map(int, r["p"].split(","))): r["n"] for r in seen}).items()}
    table_ = rows.sparkSession.createDataFrame(sorted(post.items()) or [("", 0.0)], "p string, junk double")
    parts = rows.select("k", F.explode(F.arrays_zip("patterns", "sizes")).alias("x")).select("k", F.col("x.patterns").alias("p"), F.col("x.sizes").alias("n"))
    share = parts.join(F.broadcast(table_), "p").groupBy("k").agg((F.sum(F.when(F.col("junk") > 0.5, F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("junk_share"))
    whole = ["n_chars", "n_lines", "n_words"]
    out = rows.join(share, "k", "left").withColumn("junk_share", F.coalesce("junk_share", F.lit(0.0)))
    return out.select(
        F.col("k").alias(key), *(F.col(n).cast("long").alias(n) if n in whole else F.round(n, 6).alias(n) for n in names), F.round("junk_share", 6).alias("junk_share"),
        F.when(F.col("junk_share") > 0.5, "junk").otherwise("natural").alias("text_type"),
    )
