"""The problems SQL can express, against their SQL on the small tables."""

import os

import duckdb
import pytest

from shiori.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    mine = queries.queries()[name](spark, SF)
    cols = sorted(mine.columns)
    other = c.execute(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, mine.select(*cols).collect())) == sorted(map(key, other))


def test_found_queries_have_the_given_columns(spark):
    want = {
        "p1_found": ["left_id", "right_id"], "p2_found": ["src_table", "row_key"], "p3_found": ["kept_id", "import_id"], "p4_found": ["doc_id", "first_line_no", "last_line_no"],
        "p5_found": ["src_table", "row_key"], "p6_found": ["src_table", "row_key", "cut_pos"], "p7_found": ["field_name", "term", "mark"], "p10_found": ["doc_id"],
    }
    for name, cols in want.items():
        if name != "p3_found":  # twenty batches; its columns are checked with the operator
            df = queries.queries()[name](spark, SF)
            assert df.columns == cols
            assert df.count() == df.distinct().count()
