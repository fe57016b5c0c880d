"""The plain functions as Arrow-batched column functions. They are made when called, so that
workers can import modules that use them."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shiori.functions import pure
from shiori.functions.pure import decode, html_text  # noqa: F401


def mapped(f: Callable, kind: str = "string", null=None) -> Callable[..., Column]:
    """A column function of one argument; null gives `null`."""

    def call(c) -> Column:
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: null if x is None else f(x))

        run.__annotations__ = {"s": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, kind)(c)

    return call


def paired(f: Callable, kind: str) -> Callable[..., Column]:
    """A column function of two strings; null counts as empty."""

    def call(a, b) -> Column:
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([f(p or "", q or "") for p, q in zip(x, y)])

        run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
        return F.pandas_udf(run, kind)(a, b)

    return call


def _named_ruby(surface: str, reading: str) -> list[dict]:
    return [{"text": t, "rt": r} for t, r in pure.ruby(surface, reading)]


nfc = mapped(lambda x: unicodedata.normalize("NFC", x))
folded = mapped(pure.fold)
match_key = mapped(pure.match_text)
title_keys = mapped(pure.title_key)
in_romaji = mapped(pure.romaji)
unescaped = mapped(html.unescape)
page_text = mapped(pure.html_text)
to_speech = mapped(pure.spoken)
decoded = mapped(lambda x: pure.decode(bytes(x)))
search_variants = mapped(pure.variants, "array<string>", [])
speech_segments = mapped(pure.segments, "array<string>", [])
fuzzy_score = paired(pure.fuzzy, "int")
ruby_runs = paired(_named_ruby, "array<struct<text:string,rt:string>>")
