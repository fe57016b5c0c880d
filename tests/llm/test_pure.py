"""The parts that need no session, by brute force and by example."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shiori.llm import batches, charsets, lookalikes, mixing, packing, quality, runs, sentences, titles


@given(st.lists(st.sampled_from([0.0, 0.3, 0.9, runs.FORBIDDEN]), max_size=12))
@settings(max_examples=60, deadline=None)
def test_segmentation_is_optimal(d):
    d = np.array([0.0, *d])
    n = len(d)

    def cost(cuts):
        ends = [*cuts[1:], n]
        return sum(d[s + 1 : e].sum() + runs.PENALTY for s, e in zip(cuts, ends))

    best = min(cost([0, *(i + 1 for i in range(n - 1) if m >> i & 1)]) for m in range(1 << (n - 1)))
    assert cost(runs.segment(d)) == pytest.approx(best)


@given(st.dictionaries(st.integers(1, 4096), st.integers(1, 40), max_size=30))
@settings(max_examples=60, deadline=None)
def test_bins_hold_every_item_once(histogram):
    left = dict(histogram)
    for c, times, content in packing.plan_bins(histogram, [256, 1024, 4096]):
        assert sum(s * n for s, n in content.items()) <= c
        for s, n in content.items():
            left[s] -= n * times
    assert not any(left.values())


def test_bins_leave_little_room():
    r = random.Random(1)
    h = {}
    for _ in range(5000):
        s = min(4096, int(r.lognormvariate(5, 1)) + 1)
        h[s] = h.get(s, 0) + 1
    bins = packing.plan_bins(h, [256, 1024, 4096])
    used = sum(t * sum(s * n for s, n in c.items()) for _, t, c in bins)
    assert used / sum(c * t for c, t, _ in bins) > 0.98


@given(st.lists(st.integers(1, 900), min_size=1, max_size=9))
@settings(max_examples=80, deadline=None)
def test_mixture_stays_within_a_block_and_never_drifts(amounts):
    blocks = {f"s{i}": g for i, g in enumerate(amounts)}
    n = sum(amounts)
    for period, most in ((1 << 20, 1), (50, 2)):
        at = mixing.boundaries(blocks, period)
        order = [x for a, b in zip(at, at[1:]) for x in mixing.period_order(a, b)]
        assert [x[2] for x in order] == list(range(n))
        seen = dict.fromkeys(blocks, 0)
        for s, k, t in order:
            assert k == seen[s]
            seen[s] += 1
            assert all(abs(seen[x] * n - (t + 1) * g) < most * n for x, g in blocks.items())
        assert seen == blocks


def test_allocation_caps_and_shares():
    got = mixing.allocate([("a", 0.5, 100, 1), ("b", 0.5, 1000, 4), ("c", 0.3, 0, 3)], 1000)
    assert got == {"a": 100.0, "b": 900.0}
    assert mixing.allocate([("c", 1.0, 0, 3)]) == {}


@pytest.mark.parametrize("true, read", [("utf-8", "cp1252"), ("utf-8", "koi8_r"), ("utf-8", "mac_roman"), ("cp932", "cp1252"), ("euc_jp", "koi8_r"), ("cp932", "gb18030")])
def test_wrong_reading_is_undone(true, read):
    text = "昨日は学校で本を読みました。"
    raw = text.encode(true)
    table = {v: k for k, v in charsets._tables.get(read, {}).items() if v != 0xFFFD}
    bad = "".join(chr(table[b]) if b > 127 else chr(b) for b in raw) if table else raw.decode(read)
    assert text in charsets.readings(bad).values()


@pytest.fixture(scope="module")
def letters():
    texts = ["彼女は昨日の夜、駅前の小さな喫茶店で古い友達に会いました。", "明日も約束を守るつもりです。", "青い王国の本を読みます。", "我们明天一起去图书馆看书。", "他们今天在图书馆看书。", "La fille a montré l'été déjà passé.", "One two three.S01E02.1080p.WEB-DL.ja.srt"]
    n = charsets.Counter()
    for t in texts * 50:
        charsets.char_counts(t, n)
    return charsets.Model({(ord(p), c): v for (p, c), v in n.items()})


def _best(text, model):
    base = model.score(text)
    return max(((model.score(t) - base - charsets.edges(c, text, t), t) for c, t in charsets.readings(text, model).items()), default=(0.0, None))


@pytest.mark.parametrize("read", ["cp1252", "gb18030"])
def test_misread_part_of_a_correct_text_is_undone(letters, read):
    left, right = "彼女は昨日の夜、駅前の小さな喫茶店で古い友達に会いました。", "約束を守る"
    gain, text = _best(left + right.encode("cp932").decode(read), letters)
    assert gain > 8 and text == left + right


@pytest.mark.parametrize("text, true, read", [
    ("我们明天一起去图书馆看书。", "gb18030", "euc_jp"), ("他们今天在图书馆看书。", "gb18030", "cp932"), ("青い王国.S01E02.1080p.WEB-DL.ja.srt", "cp932", "gb18030"),
])
def test_misread_text_with_little_kana_is_undone(letters, text, true, read):
    raw = text.encode(true).decode(read, "ignore")
    gain, got = _best(raw, letters)
    assert gain > 8 and (got == text or raw.encode(read) != text.encode(true))


def test_correct_texts_gain_nothing(letters):
    for t in ["彼女は明日、駅前の喫茶店で友達に会います。", "La fille a déjà montré l'été.", "他们明天去图书馆。"]:
        assert _best(t, letters)[0] < 5


def test_seven_bit_and_double_reading():
    text = "春は友達と花の相談をします。"
    assert charsets.readings(text.encode("iso2022_jp").decode("ascii"))["iso2022_jp>ascii"] == text
    assert not charsets.readings("Hello, world") and not charsets.readings(text) and not charsets.readings("")


@pytest.mark.parametrize("text, want", [
    ("ア二メを並ベました", "アニメを並べました"), ("ドア二枚とノート一冊", "ドア二枚とノート一冊"), ("ス─ツをケ‐キ", "スーツをケーキ"), ("美術館ヘ戻る", "美術館へ戻る"),
    ("ＣＭのｶﾚﾝﾀﾞｰ｡", "CMのカレンダー。"), ("銀⾏で​し\xadた", "銀行でした"), ("thе СD", "the CD"), ("「Привет」とΣ", "「Привет」とΣ"), ("夕夕ボさん", "タタボさん"), ("", ""),
])
def test_house_form(text, want):
    assert lookalikes.house_form(text) == want


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_house_form_is_stable_and_never_fails(text):
    once = lookalikes.house_form(text)
    assert isinstance(once, str)
    quality.measured(text, quality.Common({"ja": {"は"}}))
    charsets.readings(text)
    titles.read(text)
    sentences.cuts(text, sentences.Model({}))


@pytest.fixture(scope="module")
def model():
    n = {}
    for t in ["昨日は本を読みました。今日は花を見ます。", "明日、母と相談をします！駅は遠いよ。"] * 20:
        sentences.examples(t, n)
    return sentences.Model({k: tuple(v) for k, v in n.items()})


@pytest.mark.parametrize("text, want", [
    ("読みました。見ます。", [6]), ("「読みました。見ます。」と言った。", []), ("「読みました。」「見ます。」", [8]), ("「読みました。」ハナさん、見ますか？", [8]), ("『待って！本』という曲", []),
    ("Dr. Smith came at 3.5 p.m. today. He left.", [34]), ("- 読みました\n- 見ます", [8]), ("本を\n読みました。", []), ("読みました♪ 今日は見ます", [7]), ("あの…本を、…見ます。", []), ("見ます。 The girl ran.", [5]),
    ("Ｄr. ハナが見ます。", []), ("Мr. ハナが見ます。", []), ("Ѕt.ハナが見ます。", []), ("“Come and look!” said Mrs. Ito. She left.", [32]), ("Am 3. Mai kam er. Gut.", [18]), ("", []),
])
def test_cuts(model, text, want):
    assert sentences.cuts(text, model) == want


def test_verse_has_no_cuts(model):
    assert sentences.cuts("読みました。見ます。", model, True) == []


def test_runs_without_marks_are_cut():
    n = {}
    for who in ("彼女は", "友達が", "先生は", "家族と"):
        for when in ("昨日", "今日", "明日", "春に"):
            for what in ("図書館で本を読みました", "海へ行きます", "花を見ました", "駅前で会いました"):
                sentences.examples(f"{when}{who}{what}。{when}も{what}。", n)
    model = sentences.Model({k: tuple(v) for k, v in n.items()})
    parts = ["昨日友達が図書館で本を読みました", "明日家族と海へ行きます", "今日彼女は駅前で会いました"]
    text = "".join(parts)
    assert sentences.cuts(text, model) == [len(parts[0]), len(parts[0]) + len(parts[1])]
    assert sentences.cuts(parts[0] + "が", model) == []


def test_pages():
    a = batches.page("https://www.x.example:443/a/b%2Dc/?utm_source=q&lang=ja&id=3#top")
    assert a == batches.page("http://X.example/a/b-c?id=3&lang=ja") != batches.page("http://x.example/a/b-c?id=4&lang=ja")
    assert batches.page(None) is None and batches.page(" ") is None


@given(st.text("abcde", min_size=46, max_size=120), st.data())
@settings(max_examples=60, deadline=None)
def test_prefixes_of_near_bodies_meet(s, data):
    sketch = np.zeros(batches.SKETCH, dtype=np.int32)
    t = list(s)
    for _ in range(data.draw(st.integers(0, len(s) // 12))):
        t[data.draw(st.integers(0, len(t) - 1))] = data.draw(st.sampled_from("abcdefg"))
    a = list(zip(*batches.prefix(s, sketch, batches.Q, batches.SLACK)))
    b = list(zip(*batches.prefix("".join(t), sketch, batches.Q, batches.SLACK)))
    n = batches.Q
    assert sum(x == y and abs(p - q) <= len(s) // 10 for x, p in a for y, q in b) > batches.SLACK or len(s) < n


def test_titles():
    a, b = titles.read("「ハダブフルダ・騎士 Ⅱ」"), titles.read("HADABUFURUDA KISHI S2 [BD]")
    assert a["season"] == b["season"] == 2 and a["kata"][0] in b["latin"]
    assert titles.read("劇場版 アネツ")["kind"] == "movie" and titles.read("X (2001) [WebRip]")["year"] == 2001
    assert titles.distance("ramusatunechi", "rasamutunechi") == 1


def test_text_types():
    known = {"ja": set("はがをにでとのもますですした"), "en": {"the", "a", "and"}}
    blocks = {"今日は本を読みました。花を見ます。": 0, "・本\n・花\n・水\n・空": 1, "12:30,本,4\n-,花,7\n3,水,9": 1, "The girl ran to the sea and a boat came.": 0, "8888888888888888888888888888888888888888888888": 1}
    seen = {}
    for b in blocks:
        (v,) = quality.measured(b, quality.Common(known))[1]
        seen[v] = seen.get(v, 0) + 10
    post = quality.learn(seen)
    for b, want in blocks.items():
        (v,) = quality.measured(b, quality.Common(known))[1]
        assert (post[v] > 0.5) == bool(want), b
