"""Operators on small tables: nulls, empty and long texts, ties, repeats, clashing names, brute force."""

import random
import re
from collections import Counter

import pytest

from shiori.llm import batches, charsets, frequency, lookalikes, matching, mixing, packing, quality, runs, sentences
from shiori.llm import tokens as tok


@pytest.fixture(autouse=True)
def small_shuffles(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


LINES = "doc_id string, line_no int, text string, start_ms long, end_ms long, blk string, d string"


def test_runs_over_block_edges_equal_brute_force(spark):
    r = random.Random(3)
    rows, want = [], []
    for doc in ("a", "b"):
        text, no, first, prev, count = None, 0, None, None, 0
        for _ in range(120):
            no += r.randint(1, 3)
            if text is None or r.random() < 0.4:
                text = "".join(r.choice("あいうえおかきくけこ") for _ in range(12))
                if count > 1:
                    want.append((doc, first, prev, count))
                first, count = no, 0
            shown = text + r.choice(["。", "！", " ♪", ""])
            rows.append((doc, no, shown, no * 10, no * 10 + 5, "x", "y"))
            prev, count = no, count + 1
        if count > 1:
            want.append((doc, first, prev, count))
    got = runs.collapse_runs(spark.createDataFrame(rows, LINES), block=7).collect()
    assert sorted((x.doc_id, x.first_line_no, x.last_line_no, x.n_lines) for x in got) == sorted(want)
    assert all(x.duration_ms == (x.last_line_no - x.first_line_no) * 10 + 5 for x in got)


def test_runs_of_nulls_and_nothing(spark):
    rows = [("a", 1, None, None, None, "", ""), ("a", 2, None, None, None, "", ""), ("a", 3, "水", None, None, "", ""), ("a", 4, "水。", None, None, "", ""), (None, 5, "水", 1, 2, "", "")]
    got = runs.collapse_runs(spark.createDataFrame(rows, LINES)).collect()
    assert [(x.first_line_no, x.last_line_no, x.duration_ms) for x in got] == [(3, 4, None)]
    assert runs.collapse_runs(spark.createDataFrame([], LINES)).count() == 0


def test_ngrams_equal_brute_force(spark):
    r = random.Random(5)
    rows = [("d", rec, p, r.choice(["a", "b", "c"]), 1) for rec in range(9) for p in range(r.randint(1, 9))]
    tf, df = Counter(), {}
    for rec in range(9):
        t = [x[3] for x in rows if x[1] == rec]
        for n in range(1, 10):
            for i in range(len(t) - n + 1):
                g = frequency.SEP.join(t[i : i + n])
                tf[g] += 1
                df.setdefault(g, set()).add(rec)
    kind = "doc_id string, line_no int, token_pos int, word string, occ int"
    data = spark.createDataFrame(rows + rows[:5] + [("d", 3, 99, None, 1)], kind)
    key = ["doc_id", "line_no"]
    got = {x.ngram: (x.occurrences, x.records) for x in frequency.ngram_frequency(data, key, "token_pos", ["word"]).collect()}
    assert got == {g: (tf[g], len(df[g])) for g in tf}
    ones = frequency.ngram_frequency(data, key, "token_pos", ["word", "doc_id"], report=1).collect()
    assert {x.ngram: (x.occurrences, x.records) for x in ones if x.field_name == "word"} == {g: (tf[g], len(df[g])) for g in tf if frequency.SEP not in g}
    assert [(x.ngram, x.records) for x in ones if x.field_name == "doc_id"] == [("d", 9)]
    assert frequency.ngram_frequency(spark.createDataFrame([], kind), key, "token_pos", ["word"]).count() == 0


def test_packs_hold_all_pieces(spark):
    r = random.Random(7)
    sizes = [(i, r.choice([1, 30, 100, 100, 100, 900, 5000, 9001]), "x") for i in range(300)] + [(900, None, "x"), (901, 0, "x")]
    got = packing.pack(spark.createDataFrame(sizes, "id long, n int, before string"), "id", "n", {"s": 256, "m": 1024, "l": 4096}).collect()
    whole, used, cap = Counter(), Counter(), {}
    for x in got:
        whole[x.id] += x.n_tokens
        if x.pack_id is not None:
            used[x.pack_id] += x.n_tokens
            cap[x.pack_id] = x.capacity_tokens
    assert whole == Counter({i: n or 0 for i, n, _ in sizes})
    assert all(used[p] <= cap[p] for p in cap)
    assert {x.id for x in got if x.piece_no > 0} == {i for i, n, _ in sizes if (n or 0) > 4096}
    assert sum(used.values()) / sum(cap.values()) > 0.97
    assert packing.pack(spark.createDataFrame([], "id long, n int"), "id", "n", {"s": 256}).count() == 0


def test_mixture_keeps_caps_and_shares(spark):
    docs = [(i, "big" if i % 3 else "small", 50 + i % 7, "x") for i in range(600)] + [(1000, None, 9, "x"), (1001, "small", None, "x")]
    w = [("big", 0.5, 1), ("small", 0.5, 2), ("none", 0.2, 3)]
    m, s = mixing.mix(spark.createDataFrame(docs, "id long, source string, n int, slot string"), spark.createDataFrame(w, "source string, target_weight double, max_repeats int"), "id", "source", "n")
    times = Counter((x.source, x.id) for x in m.where("token_start = 0").collect())
    assert max(v for (src, _), v in times.items() if src == "small") <= 2 and max(v for (src, _), v in times.items() if src == "big") == 1
    shares = {x.source: x.actual_share for x in s.collect()}
    assert abs(shares["big"] - 0.5) < 0.01 and shares["none"] == 0
    assert all(x.largest_deviation < 1 for x in s.collect())
    # parts of a text are its tokens, once a copy
    long = [(i, "big" if i % 2 else "small", 5000 + i, "x") for i in range(8)]
    parts = mixing.mix(spark.createDataFrame(long, "id long, source string, n int, slot string"), spark.createDataFrame(w, "source string, target_weight double, max_repeats int"), "id", "source", "n")[0].collect()
    sums, slots = Counter(), Counter()
    for x in parts:
        sums[x.source, x.id, x.copy_no] += x.n_tokens
        slots[x.slot, x.source] += x.n_tokens
    assert all(v == 5000 + i for (_, i, _), v in sums.items()) and len({t for t, _ in slots}) == len(slots) and max(slots.values()) == 1024
    empty = mixing.mix(spark.createDataFrame([], "id long, source string, n int"), spark.createDataFrame(w, "source string, target_weight double, max_repeats int"), "id", "source", "n")
    assert empty[0].count() == 0 and empty[1].count() == 3


def test_token_counts(spark):
    rows = [(1, "hello world", "a"), (2, None, "b"), (3, "", "c"), (4, "あ" * 3000, "d")]
    got = {x.id: x.n_tokens for x in tok.with_token_counts(spark.createDataFrame(rows, "id long, text string, n_tokens string"), "id", "text").collect()}
    assert got[1] == len(tok.encoder().encode_ordinary("hello world")) > 1 and got[2] == got[3] == 0 and got[4] > 0


def test_text_types(spark):
    prose = "今日は本を読みました。花を見ます。明日は海へ行きます。"
    docs = [(1, prose, "x"), (2, "\n".join(["・本", "・花", "・水"] * 5), "x"), (3, None, "x"), (4, "", "x"), (5, prose + "\n\n・本\n・花", "x"), (6, prose * 400, "x")]
    common = spark.createDataFrame([("ja", "は"), ("ja", "を"), ("ja", "ました"), (None, "x"), ("ja", None)], "lang string, word string")
    got = {x.doc_id: x.text_type for x in quality.text_types(spark.createDataFrame(docs, "doc_id long, text string, junk_share string"), common).collect()}
    assert got == {1: "natural", 2: "junk", 3: "natural", 4: "natural", 5: "natural", 6: "natural"}
    assert quality.text_types(spark.createDataFrame([], "doc_id long, text string"), common).count() == 0


ROWS = "row_key string, field string, source string, text string, gain string"


def test_wrong_readings_are_found_and_undone(spark):
    good = [(f"g{i}", "lines", "a", f"{t}は学校で本を{v}。", "") for i, (t, v) in enumerate((t, v) for t in ["昨日", "今日", "明日", "春", "夏"] for v in ["読みました", "見ます", "買いました", "借ります"])]
    orig = "夏は学校で本を見ます。"
    bad = [("b1", "lines", "a", orig.encode().decode("latin-1"), ""), ("b2", "lines", "a", "本��を見ます", ""), ("b3", "lines", None, "昨日は" + "学校で本を".encode().decode("cp1251", "replace") + "見ます。", ""), ("n", "lines", "a", None, ""), ("e", "lines", "a", "", ""), ("l", "lines", "a", "SÃO é über ﾊﾝｶｸ", "")]
    got = {x.row_key: x for x in charsets.repair(spark.createDataFrame(good + bad, ROWS)).collect()}
    assert set(got) == {"b1", "b2", "b3"}
    assert got["b1"].restored == orig and got["b2"].restored is None
    assert charsets.repair(spark.createDataFrame([], ROWS)).count() == 0


def test_house_forms_decide_whole_script_tokens_by_counts(spark):
    rows = [(f"r{i}", "lines", "CD PC") for i in range(5)] + [("a", "lines", "РС です"), ("b", "lines", "Привет"), ("c", "lines", None), ("d", "lines", ""), ("e", "lines", "ｶﾅ" * 2000)]
    got = {x.row_key: (x.house_text, x.changed) for x in lookalikes.normalise(spark.createDataFrame(rows, "row_key string, field string, text string")).collect()}
    assert got["a"] == ("PC です", True) and got["b"] == ("Привет", False) and got["d"] == ("", False) and got["e"] == ("カナ" * 2000, True) and "c" not in got
    assert lookalikes.normalise(spark.createDataFrame([], "row_key string, field string, text string")).count() == 0


def test_sentences_by_rows(spark):
    rows = [("a", "本を読みました。花を見ます。", False), ("b", None, False), ("c", "", False), ("d", "花\n水", True), ("e", "本を読みました。" * 500, False)]
    df = spark.createDataFrame(rows, "k string, text string, verse boolean")
    counts = sentences.train(df, "k")
    got = Counter(x.k for x in sentences.boundaries(df, counts, ["k"]).collect())
    assert got == Counter({"a": 1, "e": 499})
    u = sentences.units(df, counts, ["k"]).collect()
    assert [x.sentence for x in sorted((x for x in u if x.k in "ad"), key=lambda x: (x.k, x.sentence_no))] == ["本を読みました。", "花を見ます。", "花", "水"]
    text = {k: t for k, t, _ in rows}
    assert all(text[x.k][x.start_pos : x.end_pos] == x.sentence for x in u)


IMPORTS = "import_id long, batch_no int, content_sha256 string, url string, body string, s string"


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_batches_equal_brute_force(spark):
    r = random.Random(11)
    base = ["".join(r.choice("あいうえおかきくけこさしすせそ") for _ in range(r.choice([20, 44, 47, 90]))) for _ in range(8)]
    rows = []
    for i in range(60):
        t = list(r.choice(base))
        for _ in range(r.randint(0, len(t) // 7)):
            t[r.randrange(len(t))] = r.choice("たちつてと")
        url = r.choice([None, f"https://www.x.example/a?id={r.randint(1, 40)}&utm_source=z", f"http://x.example/a/?id={r.randint(1, 40)}"])
        rows.append((i, 1 + i // 20, None, url, "".join(t) + r.choice(["", " \n"]), "x"))
    rows += [(60, 3, None, None, None, "x"), (61, 3, "AB", None, None, "x"), (62, 3, "ab", None, None, "x"), (63, 3, None, None, "", "x"), (64, 3, None, None, " ", "x")]
    accepted, want = [], set()
    for i, _, sha, url, body, _ in rows:
        s = "".join(body.split()) if body is not None else None
        u, h = batches.page(url), sha.lower() if sha else None

        def same(a):
            _, s2, u2, h2 = a
            near = s is not None and s2 is not None and (s == s2 or edits(s, s2) <= max(len(s), len(s2)) // 10)
            return near or u is not None and u == u2 or h is not None and h == h2

        hit = [a[0] for a in accepted if same(a)]
        if hit:
            want.add((min(hit), i))
        else:
            accepted.append((i, s, u, h))
    got = {(x.kept_id, x.import_id) for x in batches.deduplicate(spark.createDataFrame(rows, IMPORTS)).collect()}
    assert got == want
    assert batches.deduplicate(spark.createDataFrame([], IMPORTS)).count() == 0


def test_works_match_across_scripts_and_remakes(spark):
    rows = [
        (1, "shows", ["ボスツオニヌの鏡", None], 1999, 12), (2, "shows", ["ボスツオニヌの鏡"], 2015, 24), (3, "shows", ["劇場版 ボスツオニヌの鏡"], 2000, 1), (4, "shows", [None], None, None),
        (11, "anime", ["Bosutsuoninu no Kagami", "ボスツオニヌの鏡"], 1999, 12), (12, "anime", ["BOSUTSUONINU NO KAGAMI"], 2015, 24), (13, "anime", ["Hadabufuruda Kishi S2", ""], None, 13),
        (21, "jimaku", ["Bosutsuoninu no Kagami [BD]"], None, 24), (22, "jimaku", ["Bosutsuonniu no Kagami Movie"], None, 1), (23, "jimaku", [""], None, 3),
    ]
    got = {(x.left_id, x.right_id): x.confidence for x in matching.match(spark.createDataFrame(rows, "rid long, tbl string, names array<string>, year int, episodes int")).collect()}
    assert {k for k, v in got.items() if v > 0.5} == {(1, 11), (2, 12), (2, 21), (12, 21), (3, 22)}
    assert matching.match(spark.createDataFrame([], "rid long, tbl string, names array<string>, year int, episodes int")).count() == 0


WORKS = "rid long, tbl string, names array<string>, year int, episodes int"


def test_names_that_many_records_hold_are_names(spark):
    rows = [(i, "shows", ["はだぶふるだのきし"], 2000 + 2 * i, 12) for i in range(40)] + [(100 + i, "anime", ["Hadabufuruda no Kishi"], 2000 + 2 * i, 12) for i in range(40)]
    got = {(x.left_id, x.right_id) for x in matching.match(spark.createDataFrame(rows, WORKS)).where("confidence > 0.5").collect()}
    assert got == {(i, 100 + i) for i in range(40)}


def test_titles_of_ideographs_alone_match(spark):
    rows = [(1, "shows", ["鬼滅の刃", None], 2019, 26), (2, "shows", ["夜想曲"], 2001, 12), (101, "anime", ["鬼滅の刃"], 2019, 26), (102, "anime", ["夜想曲", "Hadabufuruda"], 2001, 12), (103, "anime", ["雪国"], 2001, 12), (201, "jimaku", ["鬼滅の刃 [BD]"], None, 26)]
    got = {(x.left_id, x.right_id) for x in matching.match(spark.createDataFrame(rows, WORKS)).where("confidence > 0.5").collect()}
    assert got == {(1, 101), (1, 201), (101, 201), (2, 102)}


IMPORTS = "import_id long, batch_no int, content_sha256 string, url string, body string, step string"


def _imports(n_batches: int) -> list[tuple]:
    r = random.Random(11)
    words = [w for w in "雨が降る 山を登る 本を読む 魚が泳ぐ 犬が走る 花が咲く 船が着く 星が光る 風が吹く 鳥が鳴く 海を渡る 道を行く".split()]
    rows, bodies = [], []
    for b in range(n_batches):
        for k in range(12):
            if bodies and r.random() < 0.5:
                t = list(r.choice(bodies))
                for _ in range(r.randint(0, len(t) // 8)):
                    t[r.randrange(len(t))] = r.choice("あいうえお ")
                body = "".join(t)
            else:
                body = "".join(r.choice(words) + r.choice("、。") for _ in range(r.randint(2, 30)))
                bodies.append(body)
            url = r.choice([None, f"https://a.example/{r.randint(1, 30)}"])
            rows.append((b * 100 + k, b, None, url, body if r.random() < 0.9 else None, "x"))
    return rows


def _refused(rows: list[tuple]) -> dict[int, int]:
    """Brute force: each row against all accepted ones."""

    def near(a: str, b: str) -> bool:
        a, b = "".join(a.split()), "".join(b.split())
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1] <= max(len(a), len(b)) // 10

    kept, out = [], {}
    for i, _, _, url, body, _ in sorted(rows):
        hit = [k for k, u, t in kept if (url and u == url) or (body is not None and t is not None and near(body, t))]
        if hit:
            out[i] = min(hit)
        else:
            kept.append((i, url, body))
    return out


def test_batches_equal_brute_force_and_a_stopped_state_goes_on(spark, tmp_path):
    rows = _imports(3)
    want = _refused(rows)
    df = spark.createDataFrame(rows, IMPORTS)
    # batches cut into steps are decided alike
    assert {x.import_id: x.kept_id for x in batches.deduplicate(df, at_most=8).collect()} == want
    path = f"file://{tmp_path}/state"
    first = batches.Deduplicator(spark, path, sketch=batches.rarity(df))
    first.arrive(df.where("batch_no < 2").withColumn("step", df["batch_no"].cast("string")))
    first.accept("0")
    # a step that breaks off leaves rows behind, which are neither read nor kept
    first._append(spark.createDataFrame([(f"h:{x}", -1) for x in range(9)] + [("u:a.example/1", -1)], "key string, kept_id long"), "keys", "1-broken")
    batches.mark(spark, f"{path}/begun/1-broken")
    first.close()
    again = batches.Deduplicator(spark, path)
    assert again.done == ["0"] and again.left == ["1-broken"]
    again.arrive(df.where("batch_no = 2").withColumn("step", df["batch_no"].cast("string")))
    for step in ("0", "1", "2"):
        again.accept(step)
    assert {x.import_id: x.kept_id for x in again.decisions().collect()} == want
    again.close()
    assert batches.deduplicate(spark.createDataFrame([], IMPORTS)).count() == 0


def test_tokens_of_many_bodies_are_split(spark):
    import numpy as np

    body = "山を登る人と海を渡る人が駅の前で出会って長い話をした。"
    rows = [(i, 0, None, None, body.replace("長", c) + c, "0") for i, c in enumerate("高安短深遠近")]
    sketch = np.full(batches.SKETCH, 3 * batches.PART)
    state = batches.Deduplicator(spark, sketch=sketch)
    state.arrive(spark.createDataFrame(rows, IMPORTS))
    state.accept("0")
    assert sorted((x.kept_id, x.import_id) for x in state.decisions().collect()) == [(0, i) for i in range(1, 6)]
    state.close(all_but_decisions=True)


def test_small_batches_are_decided_in_one_step(spark):
    # the ids of later batches lie among those of earlier ones; the order is that of the batches
    rows = [(i * 7 % 101, b, s, u, t, "x") for i, (_, b, s, u, t, _) in enumerate(_imports(4))]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][1], rows[k][0]))
    refused = _refused([(n, *rows[k][1:]) for n, k in enumerate(order)])
    assert refused
    df = spark.createDataFrame(rows, IMPORTS)
    assert batches.in_steps(df, 100)[1] == ["0-0"] and batches.in_steps(df, 30)[1] == ["0-0", "2-0"]
    for at_most in (100, 30):
        assert {x.import_id for x in batches.deduplicate(df, at_most=at_most).collect()} == {rows[order[n]][0] for n in refused}


def test_near_bodies_meet_by_segments():
    import numpy as np

    r = random.Random(5)
    bodies = []
    for n in (36, 40, 44, 63, 200, 503, 504, 540, 1300):
        s = [r.choice("あいうえおかきくけこ") for _ in range(n)]
        bodies.append("".join(s))
        for _ in range(6):
            t = list(s)
            for _ in range(n // 10):
                at = r.randrange(len(t))
                t[at : at + r.randint(0, 1)] = [r.choice("さしすせそ")] * r.randint(0, 1)
            bodies.append("".join(t))
    bodies = [s for s in dict.fromkeys(bodies) if len(s) >= batches.SEG_FROM]
    half, ids = len(bodies) // 2, np.arange(len(bodies))
    b = [batches.blocks(ids[x], bodies[x], 5, np.zeros(batches.MET, dtype=np.int64), True) for x in (slice(half), slice(half, None))]
    got = {"within": set(), "past": set()}
    for k in range(5):
        part = [x[x["slot"] == k] for x in b]
        both = batches.pd.concat(part)
        within = batches.met_in(batches._gathered(both, "seg"), batches._gathered(both, "win"), 0.1, True)
        past = batches.met_in(batches._gathered(part[0], "seg"), batches._gathered(part[1], "win"), 0.1, False)
        got["within"] |= {tuple(sorted(x)) for x in zip(within["id"], within["other"])}
        got["past"] |= set(zip(past["other"], past["id"]))
    near = {(i, j) for i in ids for j in ids[:i][::-1] if abs(len(bodies[i]) - len(bodies[j])) < 60 and edits(bodies[i], bodies[j]) <= max(len(bodies[i]), len(bodies[j])) // 10}
    near = {(j, i) for i, j in near}
    assert len(near) > 40 and near <= got["within"]
    assert {(i, j) for i, j in near if i < half <= j} <= got["past"]


def test_quiet_texts_have_no_readings():
    r = random.Random(3)
    good = ["".join(r.choice("今日は学校で本を読みました。花が咲く海へ行きますé二夜$ｱABC1 財") for _ in range(r.randint(1, 25))) for _ in range(400)]
    bad = [t.encode(true, "replace").decode(read, "replace") for t in good[:60] for true, read in [("utf-8", "cp1252"), ("cp932", "gb18030"), ("euc_jp", "cp932"), ("utf-8", "cp932"), ("gb18030", "big5")]]
    texts = [*good, *bad, "本��を見ます", "\x1b$BF|K\\\x1b(B", "夜夜夜", "\ud800x"]
    counts = Counter()
    for t in good:
        charsets.char_counts(t, counts)
    counts = {(ord(p), c): v for (p, c), v in counts.items()}
    assert charsets.pair_counts(["", *good]) == counts and charsets.pair_counts([]) == {}
    model = charsets.Model({k: 50.0 * v for k, v in counts.items()})
    quiet = charsets.quiet(texts, model)
    for t, q in zip(texts, quiet):
        assert not q or not charsets.readings(t, model) and not charsets.LOSSY.search(t)
    assert quiet[:400].mean() > 0.1 and not quiet[400:].all() and len(charsets.quiet([], model)) == 0


def _letters_with_damage() -> tuple[list[str], charsets.Model]:
    r = random.Random(8)
    good = ["".join(r.choice("今日は学校で本を読みました。花が咲く海へ行きますé二夜ｱカーABC1 財한국") for _ in range(r.randint(1, 25))) for _ in range(300)]
    model = charsets.Model({k: 50.0 * v for k, v in charsets.pair_counts(good).items()})
    chains = [("utf-8", "cp1252"), ("cp932", "gb18030"), ("euc_jp", "cp932"), ("gb18030", "cp932"), ("cp932", "cp437"), ("euc_jp", "big5"), ("utf-8", "cp932"), ("gb18030", "koi8_r")]
    bad = [t[:4] + t[4:].encode(true, "replace").decode(read, "replace") for t in good[:60] for true, read in chains]
    return [*good, *bad, "un café chaud, très « bon » et chaud"], model


def test_signs_spare_no_readings():
    texts, model = _letters_with_damage()
    found = 0
    for t, loud, chains, gains in zip(texts, *charsets.signs(texts, model)):
        every = charsets.readings(t, model)
        found += bool(every)
        assert charsets.readings(t, model, int(chains), bool(gains)) == every
        assert loud or not every and not charsets.LOSSY.search(t)
    assert found > 300
    # one accented letter by itself, and Japanese with signs in no encoding's share, aren't searched
    assert charsets.quiet(["un café chaud", "今日は学校で本を読みました。"], model).all()


def test_stretches_are_the_same_without_bounds_and_steps(monkeypatch):
    texts, model = _letters_with_damage()
    pairs = [(t, true, read) for t in texts[200:] for read in charsets.DOUBLE for true in charsets.TRUE[1:] if true != read]
    quick = [charsets._undo_stretches(t, true, read, model) for t, true, read in pairs]
    monkeypatch.setattr(charsets, "_SHIFTS", dict.fromkeys(charsets.TRUE[1:], True))
    pruned = [charsets._may_gain(t, true, read, model) for t, true, read in pairs]
    monkeypatch.setattr(charsets, "_may_gain", lambda *_: True)
    assert [charsets._undo_stretches(t, true, read, model) for t, true, read in pairs] == quick
    assert sum(x is not None for x in quick) > 100 and 0 < sum(pruned) < len(pairs)


def test_characters_of_more_than_two_bytes_are_no_single_step():
    # a syllable that euc_kr spells out in eight bytes
    model = charsets.Model({(p, chr(o)): 90.0 for p in range(22) for o in range(0x3041, 0x3094)})
    assert charsets._undo_stretches("x똠y", "euc_jp", "euc_kr", model) == charsets._undo_stretches("x똠y", "gb18030", "euc_kr", model) == "xぴえでけy"


def test_plain_texts_are_not_taken_apart(monkeypatch):
    r = random.Random(5)
    words = ["the", "don't", "café", "well-known", "Ü", "No", "A", "한국", "Straße", "’s", ",", ";", "-", '"Yes"', "and:", "ΑΣ", "Mr.", "ok!", "3", "。", "…", "(so)"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 9))) + r.choice(["", ".", "!", " ?", "…"]) for _ in range(3000)]
    counts: dict = {}
    for t in texts:
        sentences.examples(t, counts)
    model = sentences.Model({k: (e, n) for k, (e, n) in counts.items()})
    got = [sentences.cuts(t, model) for t in texts]
    plain = [t for t in texts if sentences.PLAIN.fullmatch(t)]
    with monkeypatch.context() as m:
        m.setattr(sentences, "PLAIN", re.compile("(?!)"))
        assert [sentences.cuts(t, model) for t in texts] == got
    assert len(plain) > 100 and any(got)

    def taken(text: str) -> None:
        raise AssertionError(text)

    monkeypatch.setattr(sentences, "View", taken)
    assert not any(sentences.cuts(t, model) for t in plain)
