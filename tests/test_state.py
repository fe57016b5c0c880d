import json
import zipfile

import pytest

from shiori.operators import state as S
from shiori.operators.registry import Dictionaries
from shiori.plans import export as X


def archive(path, words):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("term_bank_1.json", json.dumps([[w, r, "n", "", s, [g], i, ""] for i, (w, r, s, g) in enumerate(words)]))
    return str(path)


def test_dictionaries(spark, tmp_path):
    d = Dictionaries(spark, str(tmp_path / "d"))
    a = d.add(archive(tmp_path / "a.zip", [("水", "みず", 5, "water"), ("水", "すい", 1, "aqua")]), "A one", 1)
    b = d.add(archive(tmp_path / "b.zip", [("水", "みず", 9, f"w{i}") for i in range(30)]), "B", 2)
    assert d.add(str(tmp_path / "a.zip"), "again")["id"] == a["id"] and len(d.all()) == 2
    assert (a["status"], a["entries"], a["headwords"]) == ("ready", 2, 1)
    bad = tmp_path / "c.zip"
    bad.write_bytes(b"no zip")
    assert d.add(str(bad), "C")["status"] == "error"
    wanted = spark.createDataFrame([("水", 0, "水\tみず"), ("水", 1, "水")], "word string, place int, lookup_key string")
    got = d.lookup(wanted).collect()
    assert [r.content for r in sorted((r for r in got if r.dict_id == a["id"]), key=lambda r: r.rank)] == ["water", "aqua"]
    assert sum(r.dict_id == b["id"] for r in got) == 8
    d.update(a["id"], enabled=False)
    assert {r.dict_id for r in d.lookup(wanted).collect()} == {b["id"]}
    d.remove(b["id"])
    assert d.lookup(wanted).count() == 0
    with pytest.raises(KeyError):
        d.remove("none")


def test_study_files(spark, tmp_path):
    f = str(tmp_path / "s.json")
    assert S.read_study(spark, f).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"statuses": {"水": "known", "火": "ignored"}, "study_counts": {"木": 9, "金": "2", "土": -1}, "study_schedule": {"金": {"last_seen": "2024-01-01", "due_date": "2024-01-02"}}}), "utf-8")
    rows = {r.word: (r.status, r.study_count, r.due_date) for r in S.read_study(spark, f).collect()}
    assert rows == {"水": ("known", 7, None), "木": ("known", 7, None), "金": ("learning", 2, "2024-01-02")}
    S.write_study(S.read_study(spark, f), f)
    assert {r.word: (r.status, r.study_count, r.due_date) for r in S.read_study(spark, f).collect()} == rows
    assert S.day_after("2024-02-28") == "2024-02-29" and S.clamp("x") == 0


def test_parts_are_replaced(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "z")], "k int, v string")
    assert sorted((r.k, r.v) for r in S.replace_part(old, new, "k").collect()) == [(1, "z"), (2, "c")]
    assert S.without(old, new, ["k"]).count() == 1
    assert {r.k: r.deleted for r in S.deletions(spark.createDataFrame([(2,), (3,)], "k int"), old, "k").collect()} == {2: True, 3: False}


def test_corpus_tables_and_lookup(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    X.write_corpus(spark, sf, str(tmp_path / "c"))
    some = X.word_shards(spark, sf).first()
    got = {r.word: (r.missing, r.n) for r in X.word_details(spark, str(tmp_path / "c"), [some.word, "無い語"]).collect()}
    assert got == {some.word: (False, some.n), "無い語": (True, None)}
