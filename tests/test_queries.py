"""Every core query against its SQL on the small tables, and order-dependent ones for other partitionings."""

import os

import duckdb
import pandas as pd
import pytest

from shiori import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6f}"
    return str(v)


def rows(df, cols):
    return sorted(tuple(map(norm, r)) for r in df[cols].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    mine = catalog.queries()[name](spark, SF).toPandas()
    other = duck.execute(catalog.oracle_sql()[name]).df()
    cols = sorted(mine.columns)
    assert cols == sorted(other.columns)
    assert rows(mine, cols) == rows(other, cols)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    """Queries without SQL give rows, each once; what is in them is tested by brute force elsewhere."""
    got = catalog.queries()[name](spark, SF).toPandas()
    assert len(got) > 0 and not got.astype(str).duplicated().any()


@pytest.mark.parametrize("name", ["example_diverse_topk", "example_pool", "context_window", "word_source_counts", "study_queue", "annotate_spans"])
def test_partitions_do_not_matter(spark, name):
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = catalog.queries()[name](spark, SF).toPandas()
        out.append(rows(df, sorted(df.columns)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_diverse_examples_equal_picking_one_by_one(spark):
    from shiori.plans.sources import _scored

    rows = _scored(spark, SF).toPandas()
    want = set()
    for word, g in rows.groupby("word"):
        left = sorted(g.itertuples(), key=lambda r: (r.score, r.rank), reverse=True)
        sources, sentences, place = set(), set(), 0
        while left and place < 5:
            unique = [r for r in left if r.dup not in sentences]
            pool = [r for r in unique if (r.source_type, r.source_title) not in sources] or unique
            if not pool:
                break
            best = pool[0]
            place += 1
            want.add((word, place, best.example_id))
            sources.add((best.source_type, best.source_title))
            sentences.add(best.dup)
            left.remove(best)
    # the query fills up after all new sources, so places may differ, the sets may not
    got = catalog.queries()["example_diverse_topk"](spark, SF).toPandas()
    assert {(w, e) for w, _, e in want} == set(zip(got["word"], got["example_id"]))


def test_search_equals_scoring_every_field(spark):
    from shiori.functions import pure
    from shiori.plans import lookup

    entries = [(r.word, r.value, r.boost) for r in lookup.search_entries(spark, SF).collect()]
    assert len(entries) == len(set(entries)) and {b for _, _, b in entries} >= {48, 44, 42, 40, 14, 12, 8}

    def one(value, boost, term):
        if not value or len(term) > len(value) + 6:
            return 0
        if term in value:
            return boost + (120 if value == term else 95 if value.startswith(term) else 72)
        f = pure.fuzzy(value, term)
        return f + min(boost, 20) if f else 0

    want = {}
    for q in lookup.QUERY:
        by = {}
        for w, v, b in entries:
            for i, t in enumerate(q.split()):
                by.setdefault(w, {})[i] = max(by.get(w, {}).get(i, 0), max(one(v, b, x) for x in pure.variants(t)))
        want |= {(q, w): sum(s.values()) for w, s in by.items() if all(s.values())}
    got = {(r.query, r.word): r.score for r in lookup.search(lookup.search_entries(spark, SF), lookup.QUERY).collect()}
    assert got == want and len(got) > 20
