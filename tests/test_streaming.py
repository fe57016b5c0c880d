import datetime as dt
import random

from shiori.plans.study import fold
from shiori.streaming import refresh as R
from shiori.streaming.study import step, study_stream

T = dt.datetime(2024, 1, 1)


def test_refresh_takes_new_files_once_and_replaces_documents(spark, tmp_path):
    src, dst, chk = (str(tmp_path / x) for x in "sdc")
    kind = R.LINES
    spark.createDataFrame([("a", 1, "水と火", None, None, T), ("b", 1, "木", None, None, T)], kind).write.mode("append").parquet(src)
    R.refresh(spark, src, dst, chk).awaitTermination()
    assert {(r.doc_id, r.word, r.n) for r in R.contributions(spark, dst).collect()} == {("a", "水と火", 1), ("b", "木", 1)}
    spark.createDataFrame([("a", 1, "金", None, None, T)], kind).write.mode("append").parquet(src)
    R.refresh(spark, src, dst, chk).awaitTermination()
    assert {(r.doc_id, r.word) for r in R.contributions(spark, dst).collect()} == {("a", "金"), ("b", "木")}


def test_refresh_in_parts_equals_a_full_build(spark, tmp_path):
    later = T + dt.timedelta(days=1)
    parts = [
        [("a", 1, "水と火", None, None, T), ("a", 2, "木 木", None, None, T), ("b", 1, "金", None, None, T)],
        # a late line of a document, a line delivered again, one without a key
        [("a", 3, "土", None, None, T), ("b", 1, "金", None, None, later), (None, 1, "日", None, None, T)],
        # a corrected line, an older delivery that comes late, a line taken back
        [("a", 2, "木", None, None, later), ("b", 1, "銀", None, None, T), ("a", 1, None, None, None, later)],
    ]
    src, dst, chk = (str(tmp_path / x) for x in "sdc")
    for rows in parts:
        spark.createDataFrame(rows, R.LINES).write.mode("append").parquet(src)
        R.refresh(spark, src, dst, chk).awaitTermination()
    got = {(r.doc_id, r.word): r.n for r in R.contributions(spark, dst).collect()}
    R.refresh(spark, src, str(tmp_path / "d2"), str(tmp_path / "c2")).awaitTermination()
    assert got == {(r.doc_id, r.word): r.n for r in R.contributions(spark, str(tmp_path / "d2")).collect()} == {("a", "木"): 1, ("a", "土"): 1, ("b", "金"): 1}
    R.forget(spark, dst, spark.createDataFrame([("a",)], "doc_id string"), 3)
    assert {(r.doc_id, r.word) for r in R.contributions(spark, dst).collect()} == {("b", "金")}


def test_fold_equals_steps_on_random_sequences(spark):
    r = random.Random(4)
    acts = ["learning", "check", "check", "check", "known", "none"]
    events, want = [], {}
    for word in range(1000):
        state = (0, "none")
        for i in range(r.randint(1, 25)):
            a = r.choice(acts[: r.choice([2, 4, 6])])
            state = step(*state, a)
            events.append((word * 100 + i, T + dt.timedelta(hours=7 * (i // 2)), 1, word, a))
        want[word] = state
    r.shuffle(events)
    got = fold(spark.createDataFrame(events, "event_id long, ts timestamp, learner long, word_id int, action string"), ["learner", "word_id"])
    assert {x.word_id: (x.study_count, x.status) for x in got.collect()} == want


def test_stream_and_batch_agree(spark, tmp_path):
    acts = ["learning", "check", "check", "known", "learning", "check", "none", "check", *["check"] * 7, "learning"]
    events = [(i, T + dt.timedelta(minutes=i), 1 + i % 2, 5, a) for i, a in enumerate(acts * 3)]
    kind = "event_id long, ts timestamp, learner long, word_id int, action string"
    batch = spark.createDataFrame(events, kind)
    want = {(r.learner, r.word_id): (r.status, r.study_count) for r in fold(batch, ["learner", "word_id"]).collect()}
    batch.write.parquet(str(tmp_path / "e"))
    stream = study_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("study").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.learner, r.word_id): (r.status, r.study_count) for r in spark.table("study").collect()}
    assert got == want
    state = (0, "none")
    for a in acts:
        state = step(*state, a)
    assert state == (0, "learning")
