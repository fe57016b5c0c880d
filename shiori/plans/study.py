"""Study state, stored state tables and incremental refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.operators import corpus as C
from shiori.operators.order import placed
from shiori.plans.words import CORE
from shiori.session import table

TARGET = 7
OLD_SHOWS = [(1, "甲", 10, None), (2, "乙", None, 20), (3, "丙", 30, 30)]
NEW_SHOWS = [(2, "乙2", 21, None), (3, "丙", None, 31), (4, "丁", 40, None)]
MISSES = [("a", 1), ("b", 1), ("c", 2)]
FOUND = [("b", "x.lrc"), ("d", "y.txt")]
TRACKS = [("a",), ("b",), ("c",), ("d",), ("e",)]
LOCAL = [("水", "learning", 3), ("火", "known", 7), ("木", None, 2)]
REMOTE = [("水", None, 5), ("金", "learning", 1), ("木", "learning", 1)]


def study_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as study actions: signup starts a word, click checks it, purchase masters it, error clears it."""
    e = table(spark, sf_dir, "events")
    act = F.when(F.col("event_type") == "signup", "learning").when(F.col("event_type") == "click", "check").when(F.col("event_type") == "purchase", "known").when(F.col("event_type") == "error", "none")
    return e.select("event_id", "ts", F.col("user_id").alias("learner"), F.get_json_object("props", "$.k").cast("int").alias("word_id"), act.alias("action")).where("action is not null and word_id is not null")


#: States of a word: 0 none, 1 learning without checks, 2 to TARGET learning with checks, TARGET + 1 known.
STATES = TARGET + 2


def fold(events: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each word after its actions in order of (ts, event_id).

    known and none set the state, learning starts a word, or a mastered one again, and a check
    counts up to the target. An action is a map of the nine states to states, and such maps
    compose: the actions of a day are folded into one map, then the days' maps into one, so
    that a word with very many events is folded in parts.
    """
    known = STATES - 1
    act = lambda s, a: F.when(a == "known", known).when(a == "none", 0).when(a == "learning", F.when((s == 0) | (s == known), 1).otherwise(s)).otherwise(F.least(F.lit(known), F.greatest(s, F.lit(1)) + 1))
    every = F.array(*(F.lit(i) for i in range(STATES)))
    days = events.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "action"))).alias("acts"), F.max("ts").alias("last_ts"))
    days = days.withColumn("map", F.aggregate("acts", every, lambda m, e: F.transform(m, lambda s: act(s, e["action"]).cast("int"))))
    words = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "map"))).alias("maps"), F.max("last_ts").alias("last_ts"))
    g = words.withColumn("state", F.aggregate("maps", F.lit(0), lambda s, d: F.element_at(d["map"], s + 1)))
    status = F.when(F.col("state") == known, "known").when(F.col("state") > 0, "learning").otherwise("none")
    count = F.greatest(F.col("state") - 1, F.lit(0))
    return g.select(*keys, status.alias("status"), count.cast("int").alias("study_count"), F.to_date("last_ts").cast("string").alias("last_seen"), F.when(status == "learning", F.date_add(F.to_date("last_ts"), 1)).cast("string").alias("due_date"))


def study_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(study_events(spark, sf_dir), ["learner", "word_id"])


def study_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words a learner has to review, by due date, latest seen, count and word."""
    s = study_state_fold(spark, sf_dir).where(f"status = 'learning' and study_count < {TARGET}")
    order = Window.partitionBy("learner").orderBy("due_date", F.desc("last_seen"), "study_count", "word_id")
    return s.select("learner", "word_id", F.row_number().over(order).alias("place"), F.lead("word_id").over(order).alias("next_word"))


def study_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of one learner: greater counts, missing statuses filled."""
    kind = "word string, status string, n int"
    a, b = spark.createDataFrame(LOCAL, kind), spark.createDataFrame(REMOTE, kind).toDF("word", "r_status", "r_n")
    return a.join(b, "word", "full_outer").select("word", F.coalesce("status", "r_status").alias("status"), F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("r_n", F.lit(0))).alias("n"))


def browse_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded words of subtitles by level and count, with their page."""
    m = C.located(spark, sf_dir).where("source_type = 'subtitle'").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max("jlpt_level").alias("level")).where("level > 0")
    # a level's words are numbered by groups of equal count
    return placed(m, {"n": -F.col("n")}, [F.col("word")], ["level"]).select("word", "level", "n", "place", F.floor((F.col("place") - 1) / 600).cast("int").alias("page"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str], replace: list[str]) -> DataFrame:
    """`keep` columns take the new value unless it is null, `replace` columns take it always."""
    o = old.select(key, *(F.col(c).alias(f"o_{c}") for c in keep + replace), F.lit(True).alias("had"))
    n = new.select(key, *(F.col(c).alias(f"n_{c}") for c in keep + replace), F.lit(True).alias("got"))
    cols = [F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in keep] + [F.when(F.col("got"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in replace]
    return o.join(n, key, "full_outer").select(key, *cols)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key wins."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "bangumi_id int, title string, mal_id int, anidb_id int"
    return upsert(spark.createDataFrame(OLD_SHOWS, kind), spark.createDataFrame(NEW_SHOWS, kind), "bangumi_id", ["mal_id", "anidb_id"], ["title"])


def shows_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each show."""
    s = table(spark, sf_dir, "watched_shows")
    return latest(s, ["bangumi_id"], [F.desc("updated_at"), F.desc("title_jp")]).select("bangumi_id", "title_jp", "ep_status", "updated_at")


def lyric_miss_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A found lyric clears its miss; tracks still to fetch are neither found nor missed."""
    m, f, t = spark.createDataFrame(MISSES, "track string, tries int"), spark.createDataFrame(FOUND, "track string, path string"), spark.createDataFrame(TRACKS, "track string")
    left = m.join(f, "track", "left_anti")
    return t.join(f.withColumn("f", F.lit(1)), "track", "left").join(left.withColumn("m", F.lit(1)), "track", "left").select("track", F.when(F.col("f") == 1, "found").when(F.col("m") == 1, "missed").otherwise("open").alias("state"))


def contributions(m: DataFrame) -> DataFrame:
    """What each document adds to each word."""
    return m.groupBy("word", "doc_id", "source_type").agg(F.count(F.lit(1)).alias("n"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """H5, H6: documents (doc_id, version) that came, went or changed. Only the small tables of versions are read."""
    o, n = old.select("doc_id", F.col("version").alias("was")), new.select("doc_id", F.col("version").alias("is_now"))
    return o.join(n, "doc_id", "full_outer").where(~F.col("was").eqNullSafe(F.col("is_now"))).select("doc_id", F.col("was").isNotNull().alias("had"), F.col("is_now").isNotNull().alias("has"))


def refreshed(counts: DataFrame, base: DataFrame, now: DataFrame, touched: DataFrame) -> DataFrame:
    """Totals of words after a change. What the touched documents added before is taken
    away, what they add now is added; words of no touched document keep their row as it is."""
    one = touched.select("doc_id").distinct()
    less = base.join(one, "doc_id", "left_semi").select("word", "doc_id", "source_type", (-F.col("n")).alias("n"), F.lit(-1).alias("f"))
    more = contributions(now.join(one, "doc_id", "left_semi")).select("word", "doc_id", "source_type", "n", F.lit(1).alias("f"))
    delta = less.unionByName(more).groupBy("word").agg(F.sum("n").alias("n"), F.sum("f").alias("files"), *(F.sum(F.when(F.col("source_type") == t, F.col("n")).otherwise(0)).alias(f"n_{t}") for t in TYPES))
    cols = ["n", "files", *(f"n_{t}" for t in TYPES)]
    d = delta.select("word", *(F.col(c).alias(f"d_{c}") for c in cols))
    both = counts.join(d, "word", "full_outer").select("word", *((F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in cols))
    return both.where("n > 0")


TYPES = ("subtitle", "lyrics", "text")


def totals(c: DataFrame) -> DataFrame:
    """Counts of each word by source type, their sum being the word's count."""
    return c.groupBy("word").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("files"), *(F.sum(F.when(F.col("source_type") == t, F.col("n")).otherwise(0)).alias(f"n_{t}") for t in TYPES))


def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus before its latest deliveries and with its lyrics, brought up to date:
    documents delivered since are added, lyrics are taken away. Equals a build from scratch."""
    m = C.located(spark, sf_dir)
    d = C.documents(spark, sf_dir).select("doc_id", "source_type", "loaded_at")
    before = d.where("source_type != 'text'").select("doc_id", F.col("loaded_at").cast("string").alias("version"))
    after = d.where("source_type != 'lyrics'").select("doc_id", F.col("loaded_at").cast("string").alias("version"))
    base = contributions(m.join(before, "doc_id", "left_semi"))
    touched = changed(before.withColumn("version", F.coalesce("version", F.lit(""))), after.withColumn("version", F.coalesce("version", F.lit(""))))
    return refreshed(totals(base), base, m.join(after, "doc_id", "left_semi"), touched)


def _rows(rows: list[tuple], cols: str) -> str:
    cell = lambda v: "null" if v is None else str(v) if isinstance(v, int) else f"'{v}'"
    return "(select * from (values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") as t({cols}))"


_fold = f"""ev as (select event_id, ts, user_id as learner, cast(json_extract_string(props, '$.k') as int) as word_id, case event_type when 'signup' then 'learning' when 'click' then 'check' when 'purchase' then 'known' when 'error' then 'none' end as action from events),
e as (select *, row_number() over (partition by learner, word_id order by ts, event_id) as i, count(*) over (partition by learner, word_id) as m from ev where action is not null and word_id is not null),
w(learner, word_id, i, m, ts, n, st) as (
  select learner, word_id, i, m, ts, case action when 'known' then {TARGET} when 'check' then 1 else 0 end, case action when 'known' then 'known' when 'none' then 'none' else 'learning' end from e where i = 1
  union all
  select e.learner, e.word_id, e.i, e.m, e.ts,
    case e.action when 'known' then {TARGET} when 'none' then 0 when 'learning' then case when w.n >= {TARGET} then 0 else w.n end else least(w.n + 1, {TARGET}) end,
    case when e.action = 'known' then 'known' when e.action = 'none' then 'none' when e.action = 'check' and w.n + 1 >= {TARGET} then 'known' else 'learning' end
  from w join e on e.learner = w.learner and e.word_id = w.word_id and e.i = w.i + 1),
st as (select learner, word_id, st as status, cast(n as int) as study_count, cast(ts as date) as seen from w where i = m),
fo as (select learner, word_id, status, study_count, cast(seen as varchar) as last_seen, case when status = 'learning' then cast(seen + 1 as varchar) end as due_date from st)"""
SQL = {
    "study_state_fold": f"with recursive {_fold} select * from fo",
    "study_queue": f"with recursive {_fold} select learner, word_id, row_number() over w as place, lead(word_id) over w as next_word from fo where status = 'learning' and study_count < {TARGET} window w as (partition by learner order by due_date, last_seen desc, study_count, word_id)",
    "study_merge": f"select coalesce(a.word, b.word) as word, coalesce(a.status, b.status) as status, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) as n from {_rows(LOCAL, 'word, status, n')} a full outer join {_rows(REMOTE, 'word, status, n')} b on a.word = b.word",
    "browse_words": f"""with {CORE}, m as (select word, count(*) as n, max(jlpt_level) as level from loc where source_type = 'subtitle' group by word having max(jlpt_level) > 0), p as (select *, row_number() over (partition by level order by n desc, word) as place from m)
      select word, level, n, place, cast((place - 1) // 600 as int) as page from p""",
    "state_upsert": f"select coalesce(n.i, o.i) as bangumi_id, coalesce(n.m, o.m) as mal_id, coalesce(n.a, o.a) as anidb_id, case when n.i is not null then n.t else o.t end as title from {_rows(OLD_SHOWS, 'i, t, m, a')} o full outer join {_rows(NEW_SHOWS, 'i, t, m, a')} n on o.i = n.i",
    "shows_latest": "select bangumi_id, title_jp, ep_status, updated_at from watched_shows qualify row_number() over (partition by bangumi_id order by updated_at desc nulls last, title_jp desc nulls last) = 1",
    "lyric_miss_lifecycle": f"select t.a as track, case when f.a is not null then 'found' when m.a is not null then 'missed' else 'open' end as state from {_rows(TRACKS, 'a')} t left join {_rows(FOUND, 'a, p')} f on t.a = f.a left join {_rows(MISSES, 'a, n')} m on t.a = m.a",
    "incremental_refresh": f"""with {CORE} select word, count(*) as n, count(distinct doc_id) as files, count(*) filter (source_type = 'subtitle') as n_subtitle, count(*) filter (source_type = 'lyrics') as n_lyrics, count(*) filter (source_type = 'text') as n_text
      from loc where source_type in ('subtitle', 'text') group by word""",
}
QUERIES = [study_state_fold, study_queue, study_merge, browse_words, state_upsert, shows_latest, lyric_miss_lifecycle, incremental_refresh]
