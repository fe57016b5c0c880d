"""Sources, readers' units, examples and context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.functions import text as T
from shiori.operators import corpus as C
from shiori.operators.order import with_neighbours
from shiori.plans.words import CORE
from shiori.session import table


def _per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.documents(spark, sf_dir).select("doc_id", "source_type", "title", "file_name", "artist", "album", "episode")
    l = C.lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))
    m = C.matches(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"))
    return d.join(l, "doc_id", "left").join(m, "doc_id", "left").fillna(0, ["lines", "matches"])


def source_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, matches and distinct words of each document, with the key of its identity."""
    words = C.matches(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("word").alias("words"))
    key = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in ["source_type", "title", "artist", "album", "file_name", "episode"])), 256)
    return _per_document(spark, sf_dir).join(words, "doc_id", "left").select("doc_id", key.alias("source_key"), "lines", "matches", F.coalesce("words", F.lit(0)).alias("words"))


def source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines and matches of each (type, title, artist, album)."""
    keys = ["source_type", "title", "artist", "album"]
    return _per_document(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("matches").alias("matches"))


def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lyrics by album, else artist, else title; other types by title."""
    name = F.when(F.col("source_type") == "lyrics", F.coalesce("album", "artist", "title")).otherwise(F.col("title"))
    return _per_document(spark, sf_dir).groupBy("source_type", name.alias("name")).agg(F.count(F.lit(1)).alias("files"), F.count_distinct("title").alias("titles"), F.sum("lines").alias("lines"))


def episode_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and lines by title and episode, or by file without episode."""
    unit = F.coalesce(F.col("episode").cast("string"), F.concat(F.lit("file:"), F.col("file_name")))
    return _per_document(spark, sf_dir).groupBy("title", unit.alias("unit")).agg(F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"))


def preferred_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one document a subtitle's episode: lines, and bonuses by the file name."""
    name = F.lower(F.coalesce("file_name", F.lit("")))
    score = F.col("lines") + F.when(name.rlike(r"\.ja|jpn|日本語|japanese"), 80).otherwise(0) - F.when(name.rlike("bilingual|chs|cht|双语"), 120).otherwise(0) + F.when(name.rlike("webrip|web-dl"), 20).otherwise(0)
    order = Window.partitionBy("title", "episode").orderBy(F.desc("score"), "doc_id")
    d = _per_document(spark, sf_dir).where("source_type = 'subtitle' and episode is not null").withColumn("score", score)
    return d.withColumn("k", F.row_number().over(order)).where("k = 1").select("title", "episode", "doc_id", "score")


def shows_with_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each show's subtitle files and the names of its characters."""
    shows = table(spark, sf_dir, "watched_shows")
    latest = Window.partitionBy("bangumi_id").orderBy(F.desc("updated_at"), F.desc("title_jp"))
    s = shows.withColumn("k", F.row_number().over(latest)).where("k = 1").select("bangumi_id", "title_jp")
    d = C.documents(spark, sf_dir).where("bangumi_id is not null")
    names = d.select("bangumi_id", F.explode_outer("characters").alias("name")).groupBy("bangumi_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "、").alias("characters"))
    files = d.groupBy("bangumi_id").agg(F.count(F.lit(1)).alias("files"))
    return s.join(files, "bangumi_id").join(names, "bangumi_id").select("bangumi_id", "title_jp", "files", "characters")


def context_window(spark: SparkSession, sf_dir: str, preferred: int = 2, least: int = 40, most: int = 4) -> DataFrame:
    """lines before and after each line: at least `preferred` with `least` characters, at most `most`; blank lines don't count."""
    full = _spoken(spark, sf_dir)

    def take(near: Column) -> Column:
        """The shortest prefix, nearest first, that is long enough."""
        start = F.struct(F.array().cast("array<string>").alias("a"), F.lit(0).alias("n"))
        step = lambda s, x: F.when((F.size(s["a"]) >= preferred) & (s["n"] >= least), s).otherwise(F.struct(F.concat(s["a"], F.array(x)).alias("a"), (s["n"] + F.length(x)).alias("n")))
        return F.aggregate(near, start, step)["a"]

    near = with_neighbours(full, "doc_id", "line_no", "t", most, most)
    return near.select("doc_id", "line_no", F.array_join(F.reverse(take(F.col("near_before"))), "⏎").alias("before"), F.array_join(take(F.col("near_after")), "⏎").alias("after"))


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that aren't blank, with their trimmed text `t`."""
    return C.lines(spark, sf_dir).select("doc_id", "line_no", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")).alias("t")).where("t != ''")


def selection_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the two lines before and after each line."""
    l = C.lines(spark, sf_dir).select("doc_id", "line_no", F.coalesce("text", F.lit("")).alias("t"))
    near = with_neighbours(l, "doc_id", "line_no", "t", 2, 2)
    return near.select("doc_id", "line_no", F.array_join(F.reverse("near_before"), "⏎").alias("before"), F.array_join("near_after", "⏎").alias("after"))


def quality(sentence: Column, matched: Column, start_ms: Column, before: Column, after: Column) -> Column:
    """weight of an example."""
    s = F.trim(sentence)
    n = F.length(s)
    score = F.when((F.coalesce(matched, F.lit("")) != "") & s.contains(matched), 4.0).otherwise(0.0)
    score = score + F.when(n.between(8, 80), 6.0).when(n.between(4, 120), 3.0).otherwise(0.0) - F.abs(n - 32) / 24
    score = score + F.least(before, F.lit(2)) * 0.75 + F.least(after, F.lit(2)) * 0.75
    return score + F.when(start_ms.isNotNull(), 0.5).otherwise(0.0) + F.when(s.rlike("[。！？!?]$"), 0.5).otherwise(0.0)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "word_examples").groupBy("example_id").agg(F.min(F.struct("word", "sentence", "source_type", "source_title", "doc_id", "line_no", "matched_text", "episode", "start_ms")).alias("e")).select("example_id", "e.*")
    e = e.where("word is not null and sentence is not null")
    # an example's context is the lines around its own
    wanted = e.select("doc_id", "line_no").distinct()
    near = with_neighbours(_spoken(spark, sf_dir).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "line_no", "t", 2, 2)
    near = near.join(wanted, ["doc_id", "line_no"], "left_semi").select("doc_id", "line_no", F.size("near_before").alias("n_before"), F.size("near_after").alias("n_after"))
    e = e.join(near, ["doc_id", "line_no"], "left").fillna(0, ["n_before", "n_after"])
    score = quality(F.col("sentence"), F.col("matched_text"), F.col("start_ms"), F.col("n_before"), F.col("n_after"))
    rank = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in ["source_type", "source_title", "doc_id", "episode", "start_ms", "matched_text", "sentence"])), 256)
    return e.withColumn("score", F.round(score, 6)).withColumn("rank", rank).withColumn("dup", T.duplicate_key(F.col("sentence")))


def example_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, stable rank and duplicate key of every example."""
    return _scored(spark, sf_dir).select("example_id", "score", "rank", "dup")


def example_diverse_topk(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """F8: the best examples of a word, unseen sources first, no repeated sentences.

    Equals picking the best of an unseen source, else the best, again and again: one fold
    takes rows of new source and sentence in the order of their scores, a second fills up.
    A hot word isn't gathered: a row beyond the (2k + 1)th of its source or sentence can't
    be taken, as that would need more than k earlier picks, and of what is left each pick
    bars a bounded number of rows; so a bounded head of the order decides.
    """
    e = _scored(spark, sf_dir).withColumn("source", F.struct("source_type", "source_title"))
    best = Window.partitionBy("word", "dup", "source").orderBy(F.desc("score"), F.desc("rank"))
    e = e.withColumn("i", F.row_number().over(best)).where("i = 1")
    cut = 2 * k + 1
    down = [F.desc("score"), F.desc("rank"), F.col("example_id")]
    e = e.drop("i").withColumn("i", F.row_number().over(Window.partitionBy("word", "source").orderBy(*down))).where(F.col("i") <= cut)
    e = e.drop("i").withColumn("i", F.row_number().over(Window.partitionBy("word", "dup").orderBy(*down))).where(F.col("i") <= cut)
    e = e.drop("i").withColumn("i", F.row_number().over(Window.partitionBy("word").orderBy(*down))).where(F.col("i") <= k * (2 * cut + 1))
    item = F.struct((-F.col("score")).alias("o"), F.col("rank"), "source", "dup", "example_id")
    ordered = e.groupBy("word").agg(F.collect_list(item).alias("items"))
    ordered = ordered.withColumn("items", F.array_sort("items", lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).when(a["rank"] > b["rank"], -1).when(a["rank"] < b["rank"], 1).otherwise(0)))
    kind = ordered.schema["items"].dataType.simpleString()

    def fold(seed: Column, new_source: bool) -> Column:
        def step(acc: Column, x: Column) -> Column:
            seen = F.exists(acc, lambda y: (y["dup"] == x["dup"]) | (F.lit(new_source) & y["source"].eqNullSafe(x["source"])))
            return F.when((F.size(acc) < k) & ~seen, F.concat(acc, F.array(x))).otherwise(acc)

        return F.aggregate("items", seed, step)

    first = fold(F.array().cast(kind), True)
    both = ordered.withColumn("first", first).withColumn("picked", fold(F.col("first"), False))
    return both.select("word", F.posexplode("picked").alias("place", "x")).select("word", (F.col("place") + 1).alias("place"), "x.example_id")


def example_pool(spark: SparkSession, sf_dir: str, limit: int = 60) -> DataFrame:
    """F7, relational form: distinct sentences of a word by turns over its sources."""
    e = _scored(spark, sf_dir)
    once = Window.partitionBy("word", "sentence").orderBy("example_id")
    e = e.withColumn("i", F.row_number().over(once)).where("i = 1")
    turn = Window.partitionBy("word", "source_title").orderBy("example_id")
    e = e.withColumn("turn", F.row_number().over(turn))
    order = Window.partitionBy("word").orderBy("turn", "example_id")
    return e.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("word", "example_id", "turn", "place")


def example_reservoir(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    """F7 exactly: examples arrive in the order of their ids; a sentence that is held isn't taken again.
    A full pool takes an example of a source it hasn't, in the place of the last one of its
    most frequent source (the one whose first example stands first, on ties).

    Every arrival may matter, so a word's examples pass one task in their order, but none
    keeps more than the pool.
    """
    e = table(spark, sf_dir, "word_examples").where("word is not null and sentence is not null").groupBy("example_id").agg(F.min(F.struct("word", "sentence", F.coalesce("source_title", F.lit("")).alias("source"))).alias("e")).select("example_id", "e.*")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, pool = None, []
        for b in batches:
            done = []
            for w, i, sentence, source in zip(b["word"], b["example_id"], b["sentence"], b["source"]):
                if w != word:
                    done += [(word, k, x[0]) for k, x in enumerate(pool, 1)]
                    word, pool = w, []
                if any(x[1] == sentence for x in pool):
                    continue
                held = [x[2] for x in pool]
                if len(pool) < limit:
                    pool.append((i, sentence, source))
                elif source not in held:
                    most = max(held, key=held.count)
                    pool[len(held) - 1 - held[::-1].index(most)] = (i, sentence, source)
            yield pd.DataFrame(done, columns=["word", "place", "example_id"])
        yield pd.DataFrame([(word, k, x[0]) for k, x in enumerate(pool, 1)], columns=["word", "place", "example_id"])

    return e.repartition("word").sortWithinPartitions("word", "example_id").mapInPandas(fold, "word string, place int, example_id long")


def example_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of the other sources, with those of imported texts appended that they don't hold: one example
    of each (sentence without blanks, file, matched text)."""
    e = table(spark, sf_dir, "word_examples").where("word is not null and sentence is not null").groupBy("example_id").agg(F.min(F.struct("word", "sentence", "source_type", F.coalesce("doc_id", F.lit("")).alias("file"), F.coalesce("matched_text", F.lit("")).alias("matched"))).alias("e")).select("example_id", "e.*")
    e = e.withColumn("part", F.when(F.col("source_type") == "text", 1).otherwise(0)).withColumn("key", F.struct(T.duplicate_key(F.col("sentence")).alias("s"), "file", "matched"))
    first = Window.partitionBy("word", "key").orderBy("part", "example_id")
    return e.withColumn("_k", F.row_number().over(first)).where("_k = 1 or part = 0").select("word", "example_id", "part")


def examples_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples and timed examples of each document."""
    return table(spark, sf_dir, "word_examples").groupBy("doc_id").agg(F.count_distinct("example_id").alias("examples"), F.count_distinct(F.when(F.col("start_ms").isNotNull(), F.col("example_id"))).alias("timed"))


def document_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' lines rebuilt from examples, with the words matched and where the first begins."""
    e = _scored(spark, sf_dir)
    at = F.when(F.coalesce("matched_text", F.lit("")) == "", 0).otherwise(F.expr("instr(sentence, matched_text) - 1"))
    return e.withColumn("at", at).groupBy("doc_id", "line_no", "sentence").agg(F.count(F.lit(1)).alias("matches"), F.array_join(F.array_sort(F.collect_set("word")), "、").alias("words"), F.min("at").alias("first_at"))


def reader_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words, lines and length of each document."""
    w = C.matches(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("word").alias("words"))
    l = C.lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max("end_ms").alias("length_ms"))
    return l.join(w, "doc_id", "left").select("doc_id", "lines", "length_ms", F.coalesce("words", F.lit(0)).alias("words"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an example stands, for readers: title, episode and time."""
    e = _scored(spark, sf_dir)
    ep = F.when(F.col("episode").isNotNull(), F.concat(F.lit("EP"), F.when(F.col("episode") < 10, F.concat(F.lit("0"), F.col("episode").cast("string"))).otherwise(F.col("episode").cast("string"))))
    return e.select("example_id", F.concat_ws(" · ", F.col("source_title"), ep, T.clock(F.col("start_ms"))).alias("reference"))


_per = """per as (select d.doc_id, source_type, title, file_name, artist, album, episode, coalesce(l.lines, 0) as lines, coalesce(m.matches, 0) as matches from doc d
  left join (select doc_id, count(*) as lines from ln group by doc_id) l on d.doc_id = l.doc_id left join (select doc_id, count(*) as matches from mt group by doc_id) m on d.doc_id = m.doc_id)"""
_ex = f"""{CORE.strip()},
ns as (select doc_id, line_no, trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) as t from ln),
nb as (select doc_id, line_no, case when lag(line_no, 2) over w is not null then 2 when lag(line_no) over w is not null then 1 else 0 end + case when lead(line_no, 2) over w is not null then 2 when lead(line_no) over w is not null then 1 else 0 end as ctx from ns where t <> '' window w as (partition by doc_id order by line_no)),
ex as (select example_id, unnest(e) from (select example_id, min(struct_pack(word := word, sentence := sentence, source_type := source_type, source_title := source_title, doc_id := doc_id, line_no := line_no, matched_text := matched_text, episode := episode, start_ms := start_ms)) as e from word_examples group by example_id)),
sc as (select ex.*, regexp_replace(sentence, '\\s+', '', 'g') as dup,
  sha256(concat_ws('|', coalesce(source_type, '∅'), coalesce(source_title, '∅'), coalesce(ex.doc_id, '∅'), coalesce(cast(episode as varchar), '∅'), coalesce(cast(start_ms as varchar), '∅'), coalesce(matched_text, '∅'), sentence)) as rank,
  round(case when coalesce(matched_text, '') <> '' and contains(trim(sentence), matched_text) then 4.0 else 0.0 end
  + case when length(trim(sentence)) between 8 and 80 then 6.0 when length(trim(sentence)) between 4 and 120 then 3.0 else 0.0 end - cast(abs(length(trim(sentence)) - 32) as double) / 24
  + coalesce(ctx, 0) * 0.75 + case when start_ms is not null then 0.5 else 0.0 end + case when regexp_matches(trim(sentence), '[。！？!?]$') then 0.5 else 0.0 end, 6) as score from ex left join nb on ex.doc_id = nb.doc_id and ex.line_no = nb.line_no where word is not null and sentence is not null)"""
SQL = {
    "source_index": f"""with {CORE}, {_per} select doc_id, sha256(concat_ws('|', coalesce(source_type, '∅'), coalesce(title, '∅'), coalesce(artist, '∅'), coalesce(album, '∅'), coalesce(file_name, '∅'), coalesce(cast(episode as varchar), '∅'))) as source_key, lines, matches,
      coalesce((select count(distinct word) from mt where mt.doc_id = per.doc_id), 0) as words from per""",
    "source_inventory": f"with {CORE}, {_per} select source_type, title, artist, album, count(*) as files, cast(sum(lines) as bigint) as lines, cast(sum(matches) as bigint) as matches from per group by all",
    "source_groups": f"with {CORE}, {_per} select source_type, case when source_type = 'lyrics' then coalesce(album, artist, title) else title end as name, count(*) as files, count(distinct title) as titles, cast(sum(lines) as bigint) as lines from per group by 1, 2",
    "episode_groups": f"with {CORE}, {_per} select title, coalesce(cast(episode as varchar), 'file:' || file_name) as unit, count(*) as files, cast(sum(lines) as bigint) as lines from per group by 1, 2",
    "preferred_version": f"""with {CORE}, {_per}, s as (select *, lines + case when regexp_matches(lower(coalesce(file_name, '')), '\\.ja|jpn|日本語|japanese') then 80 else 0 end - case when regexp_matches(lower(coalesce(file_name, '')), 'bilingual|chs|cht|双语') then 120 else 0 end
      + case when regexp_matches(lower(coalesce(file_name, '')), 'webrip|web-dl') then 20 else 0 end as score from per where source_type = 'subtitle' and episode is not null)
      select title, episode, doc_id, score from s qualify row_number() over (partition by title, episode order by score desc, doc_id) = 1""",
    "shows_with_characters": f"""with {CORE}, s as (select * from watched_shows qualify row_number() over (partition by bangumi_id order by updated_at desc nulls last, title_jp desc nulls last) = 1),
      d as (select * from doc where bangumi_id is not null), n as (select bangumi_id, unnest(characters) as name from d)
      select s.bangumi_id, title_jp, count(*) as files, coalesce((select string_agg(name, '、' order by name) from (select distinct name from n where n.bangumi_id = s.bangumi_id and name is not null)), '') as characters from s join d on s.bangumi_id = d.bangumi_id group by 1, 2""",
    "selection_context": f"""with {CORE}, l as (select *, coalesce(text, '') as t from ln) select doc_id, line_no, coalesce(array_to_string(list(t) over (partition by doc_id order by line_no rows between 2 preceding and 1 preceding), '⏎'), '') as before,
      coalesce(array_to_string(list(t) over (partition by doc_id order by line_no rows between 1 following and 2 following), '⏎'), '') as after from l""",
    "context_window": f"""with {CORE}, l as (select doc_id, line_no, trim(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) as t from ln), f as (select * from l where t <> ''),
      g as (select doc_id, line_no, {", ".join(f"lag(t, {k}) over w as b{k}, lead(t, {k}) over w as a{k}" for k in range(1, 5))} from f window w as (partition by doc_id order by line_no)),
      h as (select *, {", ".join(f"case when {x}2 is null or length({x}1) + length({x}2) >= 40 then 2 when {x}3 is null or length({x}1) + length({x}2) + length({x}3) >= 40 then 3 else 4 end as n{x}" for x in "ba")} from g)
      select doc_id, line_no, concat_ws('⏎', case when nb >= 4 then b4 end, case when nb >= 3 then b3 end, b2, b1) as before, concat_ws('⏎', a1, a2, case when na >= 3 then a3 end, case when na >= 4 then a4 end) as after from h""",
    "example_quality": f"with {_ex} select example_id, score, rank, dup from sc",
    "example_pool": f"""with {_ex}, a as (select * from sc qualify row_number() over (partition by word, sentence order by example_id) = 1), b as (select *, row_number() over (partition by word, source_title order by example_id) as turn from a)
      select word, example_id, turn, row_number() over (partition by word order by turn, example_id) as place from b qualify row_number() over (partition by word order by turn, example_id) <= 60""",
    "example_reservoir": """with recursive e0 as (select example_id, min(struct_pack(word := word, sentence := sentence, source := coalesce(source_title, ''))) as e from word_examples where word is not null and sentence is not null group by example_id),
      e as (select e.word as word, e.sentence as sentence, e.source as source, example_id, row_number() over (partition by e.word order by example_id) as i, count(*) over (partition by e.word) as m from e0),
      f(word, i, m, pool) as (select word, i, m, [struct_pack(id := example_id, s := sentence, t := source)] from e where i = 1
        union all select e.word, e.i, e.m, case when list_contains([y.s for y in pool], e.sentence) then pool when len(pool) < 5 then list_append(pool, struct_pack(id := e.example_id, s := e.sentence, t := e.source)) when list_contains([y.t for y in pool], e.source) then pool
          else list_concat(pool[1:lastat(pool) - 1], [struct_pack(id := e.example_id, s := e.sentence, t := e.source)], pool[lastat(pool) + 1:]) end from f join e on e.word = f.word and e.i = f.i + 1)
      select word, cast(generate_subscripts(pool, 1) as int) as place, unnest(pool).id as example_id from f where i = m""".replace("lastat(pool)", "(len(pool) - list_position(list_reverse([y.t for y in pool]), [y.t for y in pool][list_position([len([z for z in pool if z.t = y.t]) for y in pool], list_max([len([z for z in pool if z.t = y.t]) for y in pool]))]) + 1)"),
    "example_merge": """with e0 as (select example_id, min(struct_pack(word := word, sentence := sentence, source_type := source_type, file := coalesce(doc_id, ''), matched := coalesce(matched_text, ''))) as e from word_examples where word is not null and sentence is not null group by example_id),
      e as (select example_id, e.word as word, regexp_replace(e.sentence, '\\s+', '', 'g') as s, e.file as file, e.matched as matched, case when e.source_type = 'text' then 1 else 0 end as part from e0)
      select word, example_id, part from (select *, row_number() over (partition by word, s, file, matched order by part, example_id) as k from e) where k = 1 or part = 0""",
    "examples_per_file": "select doc_id, count(distinct example_id) as examples, count(distinct case when start_ms is not null then example_id end) as timed from word_examples group by doc_id",
    "document_rebuild": f"with {_ex} select doc_id, line_no, sentence, count(*) as matches, string_agg(distinct word, '、' order by word) as words, cast(min(case when coalesce(matched_text, '') = '' then 0 else instr(sentence, matched_text) - 1 end) as int) as first_at from sc group by all",
    "reader_units": f"with {CORE} select l.doc_id, l.lines, l.length_ms, coalesce(w.words, 0) as words from (select doc_id, count(*) as lines, max(end_ms) as length_ms from ln group by doc_id) l left join (select doc_id, count(distinct word) as words from mt group by doc_id) w on l.doc_id = w.doc_id",
    "references": f"""with {_ex}, s as (select *, start_ms // 1000 as s from sc) select example_id, concat_ws(' · ', source_title, 'EP' || case when episode < 10 then '0' else '' end || cast(episode as varchar),
      case when s >= 3600 then case when s // 3600 < 10 then '0' else '' end || cast(s // 3600 as varchar) || ':' else '' end || case when s // 60 % 60 < 10 then '0' else '' end || cast(s // 60 % 60 as varchar) || ':' || case when s % 60 < 10 then '0' else '' end || cast(s % 60 as varchar)) as reference from s""",
}
QUERIES = [source_index, source_inventory, source_groups, episode_groups, preferred_version, shows_with_characters, context_window, selection_context, example_quality, example_diverse_topk, example_pool, example_reservoir, example_merge, examples_per_file, document_rebuild, reader_units, references]
