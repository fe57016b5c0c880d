"""Tagged tokens, stored payloads, neighbours and places."""

import random
import time

from pyspark.sql import functions as F

from shiori.operators import order, payloads, tagged


def test_tagger_as_a_plug_in(spark):
    def make():
        known = {"本": ("本", "ほん", "名詞"), "を": ("を", "を", "助詞"), "読ん": ("読む", "よん", "動詞"), "だ": ("だ", "だ", "助動詞"), "。": ("*", "*", "補助記号")}

        def run(text):
            out, at = [], 0
            while at < len(text):
                w = next((k for k in sorted(known, key=len, reverse=True) if text.startswith(k, at)), text[at])
                base, kana, pos = known.get(w, ("*", "*", "名詞"))
                out.append({"surface": w, "orth_base": base, "kana": kana, "pos1": pos, "pos2": "*"})
                at += len(w)
            return out

        return run

    rows = [("a", 1, "本を 読んだ。本"), ("a", 2, None), ("a", 3, ""), ("b", 1, "x本")]
    got = tagged.tag(spark.createDataFrame(rows, "doc_id string, line_no int, text string"), make).orderBy("doc_id", "line_no", "token_pos").collect()
    assert [(r.doc_id, r.surface, r.base, r.pos, r.start_pos, r.end_pos) for r in got] == [("a", "本", "本", "名詞", 0, 1), ("a", "を", "を", "助詞", 1, 2), ("a", "読ん", "読む", "動詞", 3, 5), ("a", "だ", "だ", "助動詞", 5, 6), ("a", "本", "本", "名詞", 7, 8), ("b", "本", "本", "名詞", 1, 2)]


def test_words_of_a_table_without_features(spark):
    got = tagged.words(spark.createDataFrame([(1, " 水 ", "*"), (2, "abc", None), (3, "火", "ひ")], "i int, surface string, kana string")).orderBy("i").collect()
    assert [(r.i, r.surface, r.base, r.reading, r.pos, r.pos_detail) for r in got] == [(1, "水", "水", None, None, None), (3, "火", "火", "ひ", None, None)]


def test_index_is_built_again_when_stale(spark, tmp_path):
    payload, index = f"file://{tmp_path}/p.json", f"file://{tmp_path}/i"
    (tmp_path / "p.json").write_text('{"word": "水", "n": 1}')
    built = []

    def build():
        built.append(1)
        return payloads.read_payload(spark, payload, "word string, n int")

    assert payloads.fresh_index(spark, payload, index, "1", build).count() == 1
    assert payloads.fresh_index(spark, payload, index, "1", build).count() == 1 and len(built) == 1
    payloads.fresh_index(spark, payload, index, "2", build)
    assert len(built) == 2
    time.sleep(1.1)
    (tmp_path / "p.json").write_text('[{"word": "水", "n": 1}, {"word": "火", "n": 2}]')
    assert payloads.fresh_index(spark, payload, index, "2", build).count() == 2 and len(built) == 3
    assert payloads.read_payload(spark, f"file://{tmp_path}/none.json", "word string").count() == 0


def test_neighbours_over_block_edges(spark):
    r = random.Random(2)
    rows, want = [], {}
    for g in ("a", "b"):
        places = sorted(r.sample(range(400), 60))
        values = [None if r.random() < 0.1 else f"{g}{p}" for p in places]
        for i, p in enumerate(places):
            rows.append((g, p, values[i]))
            want[g, p] = (values[max(0, i - 3) : i][::-1], values[i + 1 : i + 3])
    rows += [(None, 1, "x"), ("c", None, "y"), ("d", 5, "z")]
    want["d", 5] = ([], [])
    got = order.with_neighbours(spark.createDataFrame(rows, "g string, p int, v string"), "g", "p", "v", 3, 2, block=7)
    assert {(x.g, x.p): (list(x.near_before), list(x.near_after)) for x in got.collect()} == want


def test_places_over_groups(spark):
    rows = [("x", i % 5 if i % 7 else None, i) for i in range(50)] + [("y", 1, 3), (None, 1, 3)]
    df = spark.createDataFrame(rows, "g string, a int, b int")
    got = {(x.g, x.a, x.b): x.place for x in order.placed(df, {"a": F.col("a")}, [F.col("b")], ["g"]).collect()}
    mine = sorted((r for r in rows if r[0] == "x"), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert got == {**{r: i + 1 for i, r in enumerate(mine)}, ("y", 1, 3): 1, (None, 1, 3): 1}
