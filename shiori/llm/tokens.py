"""Sizes of texts in tokens of a public tokenizer, counted in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a rank file; loaded once a worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("shiori", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_token_counts(docs: DataFrame, key: str, text: str, keep: list[str] = (), path: str = VOCABULARY) -> DataFrame:
    """(key, *keep, n_tokens). Null text counts as empty; whole texts are encoded."""
    keep = list(keep)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm.tokens import encoder

        enc = encoder(path)
        for b in batches:
            n = [len(t) for t in enc.encode_ordinary_batch(b[text].fillna("").tolist(), num_threads=1)]
            yield b[[key, *keep]].assign(n_tokens=pd.Series(n, index=b.index, dtype="int64"))

    cols = docs.select(key, *keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != text)
    return cols.mapInPandas(count, schema + ", n_tokens long")
