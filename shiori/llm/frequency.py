"""Problem 7: occurrences and record counts of every term and n-gram.

Method: a suffix array over the token sequences of the records, with common-prefix
intervals. A suffix is what follows in its record from a token on. The suffixes are sorted
globally by a range partitioning; equal ones are counted before, so that one hot term is no
hot task. Neighbours in that order share a common prefix of some length; an n-gram is an
interval of neighbours that share at least n tokens, and its occurrences are the interval's
length. Its record count is that length less the within-record duplicates: of a record's own
suffixes in sorted order, each adjacency with a common prefix of l tokens repeats the n-grams
of lengths 1 to l (Yamamoto and Church). Intervals cut by the edge of a batch or partition
are joined by one pre-aggregated sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = "\u0001"
#: No longer n-gram comes out; suffixes are cut there, which keeps a record of very many tokens linear.
LONGEST = 256


def suffixes(tokens: DataFrame, record: list[str], pos: str, terms: list[str], longest: int = LONGEST) -> DataFrame:
    """(field_name, sfx, dup, n): suffixes of the records with how often they occur after a suffix of their
    own record that shares `dup` tokens with them. Each token ends with SEP."""
    rows = tokens.select(*record, F.col(pos).alias("_p"), *(F.col(t).alias(f"_t{i}") for i, t in enumerate(terms)))
    sets = [F.collect_set(F.when(F.col(f"_t{i}").isNotNull(), F.struct("_p", f"_t{i}"))).alias(f"_s{i}") for i in range(len(terms))]
    held = rows.groupBy(*record).agg(*sets)
    each = F.array(*(F.struct(F.lit(t).alias("field_name"), F.expr(f"transform(array_sort(_s{i}), x -> concat(x._t{i}, char({ord(SEP)})))").alias("toks")) for i, t in enumerate(terms)))
    lists = held.select(F.explode(each).alias("x")).select("x.field_name", "x.toks").where("size(toks) > 0")
    # sorted as arrays, so that neighbours are compared token by token
    own = f"array_sort(transform(sequence(1, size(toks)), i -> slice(toks, i, least({longest}, size(toks) - i + 1))))"
    lists = lists.select("field_name", F.expr(own).alias("s"))
    shared = "if(i = 0, 0, aggregate(sequence(1, least(size(x), size(s[i - 1]))), 0, (n, k) -> if(n = k - 1 and x[k - 1] = s[i - 1][k - 1], k, n)))"
    pairs = lists.select("field_name", F.expr(f"explode(transform(s, (x, i) -> named_struct('sfx', array_join(x, ''), 'dup', {shared})))").alias("y"))
    return pairs.groupBy("field_name", "y.sfx", "y.dup").agg(F.count(F.lit(1)).alias("n"))


def _intervals(longest: int):
    """Sums over the intervals of a sorted batch: (field_name, n-gram, n, occurrences, duplicates in the record)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            field, sfx, dup, n = (b[c].to_numpy() for c in ("field_name", "sfx", "dup", "n"))
            end = np.full(len(b), -1)
            for depth in range(1, longest + 1):
                end = np.array([s.find(SEP, e + 1) for s, e in zip(sfx, end)])
                if not (left := end >= 0).all():
                    field, sfx, dup, n, end = field[left], sfx[left], dup[left], n[left], end[left]
                if not len(sfx):
                    break
                gram = np.array([s[:e] for s, e in zip(sfx, end)], dtype=object)
                new = np.r_[True, (gram[1:] != gram[:-1]) | (field[1:] != field[:-1])]
                at = np.flatnonzero(new)
                yield pd.DataFrame({"field_name": field[at], "ngram": gram[at], "n": depth, "occ": np.add.reduceat(n, at), "dup": np.add.reduceat(n * (dup >= depth), at)})

    return walk


def ngram_frequency(tokens: DataFrame, record: list[str], pos: str, terms: list[str], report: int = LONGEST) -> DataFrame:
    """(field_name, ngram, n, occurrences, records) of the n-grams of length 1 to `report` of each column in `terms`.

    Null terms are no tokens and break nothing; a row given twice counts once; an empty
    table gives an empty result; columns besides the named ones are ignored. An n-gram
    never crosses a record. The tokens of an n-gram are joined by U+0001. Null record keys
    are one record.
    """
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes(tokens, record, pos, terms).repartitionByRange(parts, "field_name", "sfx", "dup").sortWithinPartitions("field_name", "sfx", "dup")
    pieces = ordered.mapInPandas(_intervals(min(report, LONGEST)), "field_name string, ngram string, n int, occ long, dup long")
    return pieces.groupBy("field_name", "ngram", "n").agg(F.sum("occ").alias("occurrences"), (F.sum("occ") - F.sum("dup")).alias("records"))


def marked_terms(matches: DataFrame, fields: list[str], rare_below: int = 3, common_share: float = 0.02) -> DataFrame:
    """Terms of each field with counts and a mark: rare, common or null between."""
    freq = ngram_frequency(matches, ["doc_id", "line_no"], "token_pos", fields, report=1)
    n_lines = matches.select("doc_id", "line_no").distinct().count()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > n_lines * common_share, "common")
    return freq.select("field_name", F.col("ngram").alias("term"), "occurrences", "records", mark.alias("mark"))
