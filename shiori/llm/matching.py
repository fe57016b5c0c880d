"""Problem 1: matching entities across sources without keys.

Method: candidate pairs share a spelling of the work's own name but for one letter or
mora, its kind and its number. A pair's prior log-odds come from the name, year and
length of both records. Loopy belief propagation then passes messages over factors that
let a record match at most one work of each other table: a pair hears from each of its
two records how much the rivals claim it. Records of one table that describe the same
work aren't rivals. The messages are sums over a record's candidates, computed by
aggregations and joins, damped, until the largest change is small; the marginal is the
confidence.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiori.functions.vector import mapped, paired
from shiori.llm import titles
from shiori.session import release, settle

#: A word of a Latin title that is near a known name but not equal is taken for it if this few records hold it,
#: or if it stands beside few other words for their number (sf0.1: common nouns 0.76 others a record and more).
RARE_WORD, FEW_OTHERS = 30, 0.5
ROUNDS, STEP, DAMPING = 60, 3, 0.3


def parse(records: DataFrame) -> DataFrame:
    """records (rid, tbl, names array, year, episodes) with the readings of all names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shiori.llm import titles as t

        for b in batches:
            out = []
            for rid, tbl, names, year, eps in zip(b["rid"], b["tbl"], b["names"], b["year"], b["episodes"]):
                got = [t.read(n) for n in (names if names is not None else []) if n and n.strip()]
                if not got:
                    continue
                seasons, kinds = Counter(g["season"] for g in got), Counter(g["kind"] for g in got)
                season = max(seasons, key=lambda s: (s != 1 and seasons[s] * 2 >= 1, seasons[s], s))
                kind = max(kinds, key=lambda k: (k != "main", kinds[k], k))
                said = next((g["year"] for g in got if g["year"]), None)
                pick = lambda k: sorted({w for g in got for w in g[k]})
                out.append((rid, tbl, int(year) if pd.notna(year) else said, int(eps) if pd.notna(eps) else None, season, kind, pick("kata"), pick("latin"), pick("hira"), pick("han"), pick("whole")))
            f = pd.DataFrame(out, columns=["rid", "tbl", "year", "episodes", "season", "kind", "kata", "latin", "hira", "han", "whole"])
            for c in ("year", "episodes"):
                f[c] = f[c].astype("Int64")
            yield f

    return records.mapInPandas(run, "rid long, tbl string, year int, episodes int, season int, kind string, kata array<string>, latin array<string>, hira array<string>, han array<string>, whole array<string>")


_keys = mapped(titles.keys, "array<string>", [])
_pieces = mapped(titles.pieces, "array<string>", [])
_distance = paired(titles.distance, "int")


def _counted(parsed: DataFrame) -> DataFrame:
    """(core, n, named): Latin words, their records, and whether they may be names.

    The records of a work or franchise hold the same few words beside its name, however many
    they are; a common noun stands beside another name in nearly every record.
    """
    words = parsed.select("rid", F.explode("latin").alias("core"), F.concat("latin", "kata").alias("others"))
    counts = words.groupBy("core").agg(F.countDistinct("rid").alias("n"))
    often = counts.where(F.col("n") > RARE_WORD).select("core")
    beside = words.join(often, "core", "left_semi").select("core", F.explode("others").alias("other")).where("core != other").distinct()
    others = beside.groupBy("core").agg(F.count(F.lit(1)).alias("others"))
    named = (F.col("n") <= RARE_WORD) | (F.coalesce("others", F.lit(0)) < FEW_OTHERS * F.col("n"))
    return settle(counts.join(others, "core", "left").select("core", "n", named.alias("named")))


def names_of(parsed: DataFrame) -> DataFrame:
    """(rid, core): the words of each record that are names of works.

    A katakana word is one. A Latin word is one if it equals, or may be a name and is next to, a
    katakana name of any record; so is a stretch of a title in hiragana. A record without
    any is known by its longest word, and one of ideographs alone by its whole title.
    """
    kata = parsed.select("rid", F.explode("kata").alias("core"))
    runs = settle(parsed.select("rid", F.explode("hira").alias("run")).select("rid", "run", F.explode(_pieces("run")).alias("core")))
    # a Latin word that may be a name and is a stretch of a hiragana title elsewhere is a name as well, unless
    # it stands beside a katakana name somewhere, as common nouns do
    beside = parsed.where(F.size("kata") > 0).select(F.explode("latin").alias("core")).distinct()
    counts = _counted(parsed)
    spelt = counts.where((F.length("core") >= 8) & F.col("named")).join(runs, "core", "left_semi").join(beside, "core", "left_anti").select("core")
    known = settle(kata.select("core").union(spelt).distinct())
    known_keys = known.select(F.col("core").alias("name"), F.explode(_keys("core")).alias("key"))
    words = parsed.select("rid", F.explode("latin").alias("core"))
    exact = counts.join(known, "core", "left_semi").select("core")
    rare = counts.where("named").where(F.length("core") >= 6).join(known, "core", "left_anti")
    near = rare.select("core", F.explode(_keys("core")).alias("key")).join(known_keys.select("key").distinct(), "key", "left_semi").select("core")
    good = exact.union(near).distinct()
    latin = words.join(good, "core", "left_semi")
    longest = Window.partitionBy("rid", "run").orderBy(F.length("core").desc(), "core")
    in_known = runs.join(known, "core", "left_semi")
    first = in_known.withColumn("k", F.row_number().over(longest)).where("k = 1").select("rid", "run", "core")
    rest = runs.join(first.select("rid", "run"), ["rid", "run"], "left_anti").where(F.length("core") >= 8)
    fuzzy = rest.select("rid", "run", "core", F.explode(_keys("core")).alias("key")).join(known_keys.select("key").distinct(), "key", "left_semi").select("rid", "run", "core").distinct()
    fuzzy = fuzzy.withColumn("k", F.row_number().over(longest)).where("k = 1").select("rid", "core")
    got = settle(kata.unionByName(latin).unionByName(first.select("rid", "core")).unionByName(fuzzy).distinct())
    left = parsed.join(got.select("rid").distinct(), "rid", "left_anti")
    words_left = left.select("rid", F.explode(F.concat("latin", "hira")).alias("core"))
    last = words_left.withColumn("k", F.row_number().over(Window.partitionBy("rid").orderBy(F.length("core").desc(), "core"))).where("k = 1")
    got = settle(got.unionByName(last.select("rid", "core")))
    # records without any such word, and those that hold one of their titles as well
    titles_of = parsed.select("rid", F.explode("whole").alias("core"))
    bare = titles_of.join(got.select("rid").distinct(), "rid", "left_anti").select("core")
    bare_keys = bare.distinct().select(F.explode(_keys("core")).alias("key")).distinct()
    near_bare = titles_of.select("core").distinct().select("core", F.explode(_keys("core")).alias("key")).join(bare_keys, "key", "left_semi").select("core").distinct()
    return settle(got.unionByName(titles_of.join(near_bare, "core", "left_semi")))


def pairs(parsed: DataFrame, cores: DataFrame) -> DataFrame:
    """Pairs of records with a name in common or nearly so, of one kind and number; left_id < right_id."""
    words = cores.select("core").distinct()
    key = words.select("core", F.explode(_keys("core")).alias("key"))
    other = key.select(F.col("core").alias("core2"), "key")
    near = settle(key.join(other, "key").where("core <= core2").select("core", "core2").distinct().withColumn("dist", _distance("core", "core2")))
    both = near.union(near.where("core != core2").select("core2", "core", "dist"))
    r = cores.join(parsed.select("rid", "tbl", "year", "episodes", "season", "kind", "han"), "rid")
    a = r.select(*(F.col(c).alias(f"l_{c}") for c in ("rid", "tbl", "year", "episodes", "han")), "season", "kind", "core")
    b = r.select(*(F.col(c).alias(f"r_{c}") for c in ("rid", "tbl", "year", "episodes", "han")), "season", "kind", F.col("core").alias("core2"))
    # years apart make no pair; a null year goes with any
    fits = F.coalesce(F.abs(F.col("l_year") - F.col("r_year")) <= 1, F.lit(True))
    joined = a.join(both, "core").join(b, ["core2", "season", "kind"]).where((F.col("l_rid") < F.col("r_rid")) & fits)
    shared = F.size(F.array_intersect("l_han", "r_han"))
    fewer = F.least(F.size("l_han"), F.size("r_han"))
    words = F.when((fewer == 0) | (shared >= fewer), 0).when(shared > 0, 1).otherwise(2)
    return joined.withColumn("words", words).groupBy("l_rid", "r_rid", "l_tbl", "r_tbl", "l_year", "r_year", "l_episodes", "r_episodes").agg(F.min("dist").alias("dist"), F.min("words").alias("words"))


def prior(p: DataFrame) -> DataFrame:
    """Adds `odds`, the log-odds of a pair before its rivals are heard."""
    files = (F.col("l_tbl") == "jimaku") | (F.col("r_tbl") == "jimaku")
    gap = F.abs(F.col("l_episodes") - F.col("r_episodes"))
    wide = F.least("l_episodes", "r_episodes")
    years = F.abs(F.col("l_year") - F.col("r_year"))
    name = F.when(F.col("dist") == 0, 5.0).when(F.col("dist") == 1, 3.5).otherwise(0.5)
    # works by one name may differ in their other words, where both titles have them in ideographs
    rest = F.when(F.col("words") == 2, -4.0).when(F.col("words") == 1, -2.0).otherwise(0.0)
    year = F.when(years == 0, 2.5).when(years == 1, 0.5).otherwise(0.0)
    length = (
        F.when(gap.isNull(), 0.0).when(gap == 0, 1.5).when(gap == 1, 1.0)
        .when(files, F.when(gap <= 3, 0.5).when(gap <= 0.3 * wide + 2, 0.0).when(gap >= 8, -2.5).otherwise(-1.0))
        .otherwise(F.when(gap <= 2, -1.5).otherwise(-5.0))
    )
    return p.withColumn("odds", F.lit(-1.5) + name + rest + year + length)


def same_work(p: DataFrame, parsed: DataFrame) -> DataFrame:
    """(rid, work): records of one table that describe the same work share `work`."""
    inside = p.where("l_tbl = r_tbl and odds > 3").select("l_rid", "r_rid")
    links = settle(inside.union(inside.select("r_rid", "l_rid")).toDF("a", "b"))
    label = links.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("work")).withColumnRenamed("a", "rid")
    more = True
    while more:
        now = label.withColumn("was", F.col("work"))
        for _ in range(3):
            low = links.join(now.select(F.col("rid").alias("b"), "work"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("work").alias("low"))
            now = now.join(low, "rid").select("rid", F.least("work", "low").alias("work"), "was")
        now = settle(now)
        more = not now.where("work < was").isEmpty()
        label = now.select("rid", "work")
    return parsed.select("rid").join(label, "rid", "left").select("rid", F.coalesce("work", "rid").alias("work"))


def propagate(p: DataFrame, works: DataFrame) -> DataFrame:
    """Adds `confidence` to pairs (l_rid, r_rid, l_tbl, r_tbl, odds) of different tables."""
    wl, wr = works.toDF("l_rid", "l_work"), works.toDF("r_rid", "r_work")
    v = settle(p.join(wl, "l_rid").join(wr, "r_rid").withColumn("to_left", F.lit(0.0)).withColumn("to_right", F.lit(0.0)))

    def heard(v: DataFrame, record: str, table: str, work: str, claim: F.Column) -> DataFrame:
        """-log(1 + what rivals of the pair at `record` claim), rivals being other works of `table`."""
        x = v.withColumn("_c", F.exp(F.least(claim, F.lit(30.0))))
        same = x.groupBy(record, table, work).agg(F.max("_c").alias("_own"))
        whole = same.groupBy(record, table).agg(F.sum("_own").alias("_all"))
        rivals = same.join(whole, [record, table]).select(record, table, work, (-F.log1p(F.greatest(F.col("_all") - F.col("_own"), F.lit(0.0)))).alias("_m"))
        return v.join(rivals, [record, table, work])

    for n in range(ROUNDS // STEP):
        old = v
        for _ in range(STEP):
            a = heard(v, "l_rid", "r_tbl", "r_work", F.col("odds") + F.col("to_right")).withColumnRenamed("_m", "_l")
            a = heard(a, "r_rid", "l_tbl", "l_work", F.col("odds") + F.col("to_left")).withColumnRenamed("_m", "_r")
            v = a.withColumn("to_left", DAMPING * F.col("to_left") + (1 - DAMPING) * F.col("_l")).withColumn("to_right", DAMPING * F.col("to_right") + (1 - DAMPING) * F.col("_r")).drop("_l", "_r")
            v = settle(v)
        moved = v.select("l_rid", "r_rid", (F.col("to_left") + F.col("to_right")).alias("now")).join(old.select("l_rid", "r_rid", (F.col("to_left") + F.col("to_right")).alias("then")), ["l_rid", "r_rid"])
        change = moved.agg(F.max(F.abs(F.col("now") - F.col("then")))).first()[0]
        release(v.sparkSession)
        if change is None or change < 0.01:
            break
    else:
        warnings.warn(f"beliefs still change by {change:.3f} after {ROUNDS} rounds", stacklevel=2)
    return v.withColumn("confidence", F.round(1 / (1 + F.exp(-(F.col("odds") + F.col("to_left") + F.col("to_right")))), 6))


def match(records: DataFrame) -> DataFrame:
    """(left_id, right_id, confidence) of all candidate pairs of records of different tables.

    `records`: rid (unique over all tables), tbl, names (array), year, episodes. Null years,
    lengths and names are allowed; a record without any name matches nothing. left_id is
    the smaller id.
    """
    parsed = settle(parse(records))
    found = settle(prior(pairs(parsed, names_of(parsed))))
    release(parsed.sparkSession)
    works = same_work(found, parsed)
    across = found.where("l_tbl != r_tbl").select("l_rid", "r_rid", "l_tbl", "r_tbl", "odds")
    return propagate(across, works).select(F.col("l_rid").alias("left_id"), F.col("r_rid").alias("right_id"), "confidence")
