"""Queries of the training-data problems, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.llm.common import line_key, lines_once, table
from shiori.session import settle, ship, small, stored


def _work_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    shows = table(spark, sf_dir, "watched_shows")
    year = F.coalesce(F.col("s.air_year"), F.expr("try_cast(substr(s.air_date, 1, 4) as int)"))
    latest = shows.groupBy("bangumi_id").agg(F.max_by(F.struct("title_jp", "title_zh", "air_year", "air_date", "eps"), F.struct("updated_at", "title_jp")).alias("s"))
    shows = latest.select(F.col("bangumi_id").alias("rid"), F.lit("shows").alias("tbl"), F.array("s.title_jp", "s.title_zh").alias("names"), year.alias("year"), F.col("s.eps").alias("episodes"))
    anime = table(spark, sf_dir, "anime_records").groupBy("record_id").agg(F.max(F.struct("title", "synonyms", "air_year", "episodes")).alias("s"))
    anime = anime.select(F.col("record_id").alias("rid"), F.lit("anime").alias("tbl"), F.concat(F.array("s.title"), F.coalesce("s.synonyms", F.array().cast("array<string>"))).alias("names"), F.col("s.air_year").alias("year"), F.col("s.episodes").alias("episodes"))
    files = table(spark, sf_dir, "jimaku_entries").groupBy("entry_id").agg(F.max(F.struct("entry_name", "file_count")).alias("s"))
    files = files.select(F.col("entry_id").alias("rid"), F.lit("jimaku").alias("tbl"), F.array("s.entry_name").alias("names"), F.lit(None).cast("int").alias("year"), F.col("s.file_count").alias("episodes"))
    return shows.unionByName(anime).unionByName(files).where("rid is not null")


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidate pairs with the confidence that both records mean the same work."""
    from shiori.llm.matching import match

    return match(_work_records(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).where("confidence > 0.5").select("left_id", "right_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports to refuse, with the accepted import each repeats."""
    from shiori.llm.batches import deduplicate

    return deduplicate(table(spark, sf_dir, "web_imports"))


def _texts_for_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_once(spark, sf_dir).select(line_key().alias("row_key"), F.lit("lines").alias("field"), F.col("doc_id").alias("source"), "text")
    names = table(spark, sf_dir, "documents_src").groupBy("doc_id").agg(F.min("file_name").alias("text"), F.min("source_type").alias("source"))
    names = names.select(F.col("doc_id").alias("row_key"), F.lit("documents_src").alias("field"), "source", "text")
    return lines.unionByName(names).unionByName(_examples(spark, sf_dir))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example sentences as records; the evidence of an example pools with that of its document."""
    rows = table(spark, sf_dir, "word_examples").groupBy("example_id").agg(F.min("sentence").alias("text"), F.min("doc_id").alias("source"))
    return rows.select(F.col("example_id").cast("string").alias("row_key"), F.lit("word_examples").alias("field"), "source", "text")


def _well_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and examples (row_key, field, text) but for those read in a wrong encoding."""
    from shiori.llm.charsets import repair

    rows = stored(_texts_for_charsets(spark, sf_dir))
    cases = small(repair(rows).select("row_key", "field"))
    return rows.where("field != 'documents_src'").select("row_key", "field", "text").join(cases, ["row_key", "field"], "left_anti")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read in a wrong encoding, with chain, posterior and restored text."""
    from shiori.llm.charsets import repair

    return repair(stored(_texts_for_charsets(spark, sf_dir))).withColumnRenamed("field", "src_table")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_repaired(spark, sf_dir).where("src_table != 'word_examples'").select("src_table", "row_key")


def p5_house_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every well-read text in the house form, and whether it was in it."""
    from shiori.llm.lookalikes import normalise

    return normalise(_well_read(spark, sf_dir)).select(F.col("field").alias("src_table"), "row_key", "house_text", "changed")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_house_forms(spark, sf_dir).where("changed").select("src_table", "row_key")


def _sentence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-read lines and examples, with whether they are verse."""
    types = table(spark, sf_dir, "documents_src").groupBy("doc_id").agg(F.max(F.col("source_type") == "lyrics").alias("verse"))
    rows = _well_read(spark, sf_dir)
    lines = rows.where("field = 'lines'").withColumn("doc_id", F.regexp_replace("row_key", "#[^#]*$", "")).join(types, "doc_id", "left")
    ex = table(spark, sf_dir, "word_examples").groupBy(F.col("example_id").cast("string").alias("row_key")).agg(F.max(F.col("source_type") == "lyrics").alias("verse"))
    examples = rows.where("field = 'word_examples'").join(ex, "row_key", "left")
    cols = [F.col("field").alias("src_table"), "row_key", "text", F.coalesce("verse", F.lit(False)).alias("verse")]
    return lines.select(*cols).unionByName(examples.select(*cols))


def _document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.lit("documents").alias("src_table"), F.col("doc_id").cast("string").alias("row_key"), "text", F.coalesce(F.col("source_type") == "lyrics", F.lit(False)).alias("verse"))


def _sentence_model(texts: DataFrame, spark: SparkSession, sf_dir: str) -> dict:
    from shiori.llm.sentences import train

    docs = _document_texts(spark, sf_dir)
    return train(texts.unionByName(docs).select(F.concat_ws("#", "src_table", "row_key").alias("row_key"), "text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiori.llm.sentences import boundaries

    texts = _sentence_texts(spark, sf_dir)
    return boundaries(texts, _sentence_model(texts, spark, sf_dir), ["src_table", "row_key"])


def p6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every line, example and document."""
    from shiori.llm.sentences import units

    texts = _sentence_texts(spark, sf_dir)
    model = _sentence_model(texts, spark, sf_dir)
    return units(texts.unionByName(_document_texts(spark, sf_dir)), model, ["src_table", "row_key"])


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiori.llm.runs import collapse_runs

    return collapse_runs(lines_once(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_runs(spark, sf_dir).select("doc_id", "first_line_no", "last_line_no")


def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiori.llm.frequency import marked_terms

    return marked_terms(table(spark, sf_dir, "matches"), ["word", "matched_text"])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_terms(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p7_word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and lines of every sequence of words."""
    from shiori.llm.frequency import SEP, ngram_frequency

    m = table(spark, sf_dir, "matches")
    return ngram_frequency(m, ["doc_id", "line_no"], "token_pos", ["word"]).select(
        F.translate("ngram", SEP, " ").alias("ngram"), "n", "occurrences", "records"
    )


def _document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiori.llm.tokens import with_token_counts

    return with_token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"])


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["pack_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_sizes").collect()}


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in packs of the permitted capacities, chosen jointly."""
    from shiori.llm.packing import pack

    return pack(settle(_document_sizes(spark, sf_dir)), "doc_id", "n_tokens", _capacities(spark, sf_dir))


def p8_packs_of_each_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in packs of one capacity, for each capacity."""
    from shiori.llm.packing import pack

    sizes = settle(_document_sizes(spark, sf_dir))
    parts = [pack(sizes, "doc_id", "n_tokens", {n: c}) for n, c in sorted(_capacities(spark, sf_dir).items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the packs of p8_packs are, by capacity and over all, and how few tokens of room any packing needs at least."""
    packs = p8_packs(spark, sf_dir).where("pack_id is not null").groupBy("pack_name", "capacity_tokens", "pack_id").agg(F.sum("n_tokens").alias("used"))
    by = packs.groupBy("pack_name").agg(F.count(F.lit(1)).alias("packs"), F.sum("used").alias("tokens"), F.sum("capacity_tokens").alias("room"))
    smallest = min(_capacities(spark, sf_dir).values())
    least = (F.ceil(F.col("tokens") / smallest) * smallest).cast("long") if all(c % smallest == 0 for c in _capacities(spark, sf_dir).values()) else F.col("tokens")
    whole = by.agg(F.lit("all").alias("pack_name"), F.sum("packs").alias("packs"), F.sum("tokens").alias("tokens"), F.sum("room").alias("room")).withColumn("least_room", least)
    return by.withColumn("least_room", F.lit(None).cast("long")).unionByName(whole).withColumn("fill", F.round(F.col("tokens") / F.col("room"), 6))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiori.llm.mixing import mix

    return mix(settle(_document_sizes(spark, sf_dir)), table(spark, sf_dir, "source_weights"), "doc_id", "source", "n_tokens")[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiori.llm.mixing import mix

    return mix(settle(_document_sizes(spark, sf_dir)), table(spark, sf_dir, "source_weights"), "doc_id", "source", "n_tokens")[1]


def p10_text_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shiori.llm.quality import text_types

    return text_types(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_text_types(spark, sf_dir).where("text_type = 'junk'").select("doc_id")


P7_TERMS_SQL = """
with m as (select distinct doc_id, line_no, token_pos, word, matched_text from matches),
n as (select count(*) as n_lines from (select distinct doc_id, line_no from matches)),
f as (
  select 'word' as field_name, word as term, count(distinct (doc_id, line_no, token_pos)) as occurrences,
         count(distinct (doc_id, line_no)) as records from m where word is not null group by word
  union all
  select 'matched_text', matched_text, count(distinct (doc_id, line_no, token_pos)),
         count(distinct (doc_id, line_no)) from m where matched_text is not null group by matched_text)
select field_name, term, occurrences, records,
       case when records < 3 then 'rare' when records > n_lines * 0.02 then 'common' end as mark
from f, n
"""

P7_NGRAMS_SQL = """
with m as (select distinct doc_id, line_no, token_pos, word from matches where word is not null),
l as (select doc_id, line_no, list(word order by token_pos nulls first, word) as w from m group by doc_id, line_no),
s as (select doc_id, line_no, w, unnest(range(1, len(w) + 1)) as i from l),
e as (select doc_id, line_no, w, i, unnest(range(i, len(w) + 1)) as j from s),
g as (select doc_id, line_no, array_to_string(list_slice(w, i, j), ' ') as ngram, cast(j - i + 1 as int) as n from e)
select ngram, n, count(*) as occurrences, count(distinct (doc_id, line_no)) as records from g group by ngram, n
"""


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [p1_found, p1_matches, p2_found, p2_repaired, p3_found, p5_found, p5_house_forms, p6_found, p6_sentences, p4_found, p4_runs, p7_found, p7_terms, p7_word_ngrams, p8_packs, p8_packs_of_each_capacity, p8_fill, p9_mixture, p9_shares, p10_found, p10_text_types]
    return {f.__name__: _shipped(f) for f in names}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_terms": P7_TERMS_SQL,
        "p7_word_ngrams": P7_NGRAMS_SQL,
        "p7_found": f"select field_name, term, mark from ({P7_TERMS_SQL}) where mark is not null",
    }
