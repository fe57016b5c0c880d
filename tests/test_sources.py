import json
import zipfile
from io import BytesIO

from shiori.functions import pure
from shiori.sources import lexicons as L
from shiori.sources import subtitles as S
from shiori.sources import texts as X


def files(spark, name, content):
    return spark.createDataFrame([(name, content)], "file string, content string")


def test_srt_keeps_times_and_drops_other_languages(spark):
    text = "1\n00:00:01,000 --> 00:00:02,5\n約束\n\n2\n00:00:03,000 --> 00:00:04,000\nHello\n"
    assert [(r.text, r.start_ms, r.end_ms) for r in S.srt_lines(files(spark, "a.srt", text)).collect()] == [("約束", 1000, 2500)]


def test_lrc_end_is_next_start_after_latin_rows_went(spark):
    text = "[00:01.00]夜\n[00:04.50]la\n[00:07.25]朝\n"
    assert [(r.start_ms, r.end_ms) for r in S.lrc_lines(files(spark, "a.lrc", text)).orderBy("line_no").collect()] == [(1000, 7250), (7250, None)]


def test_unknown_suffix_null_and_empty_content_have_no_lines(spark):
    rows = spark.createDataFrame([("a.vtt", "約束"), ("b.srt", None), ("c.ass", ""), ("d.lrc", None)], "file string, content string")
    assert S.lines_of(rows).count() == 0


def test_entities_are_unescaped(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\n花&amp;鳥\n"
    assert S.srt_lines(files(spark, "a.srt", text)).first().text == "花&鳥"


def test_sentences_join_wrapped_lines(spark):
    rows = X.sentence_rows(files(spark, "a.txt", "一つ目。二つ\n目！\n\n三つ目")).collect()
    assert sorted(r.text for r in rows) == sorted(["一つ目。", "二つ目！", "三つ目"])


def book():
    raw = BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns:dc="x"><metadata><dc:title>本</dc:title><dc:creator>人</dc:creator></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="a" linear="no"/></spine></package>')
        z.writestr("O/a.xhtml", "<p>二。</p>")
        z.writestr("O/b.xhtml", "<p><ruby>一<rt>いち</rt></ruby>。</p>")
    return raw.getvalue()


def test_epub_follows_the_spine_and_skips_ruby(spark):
    assert X.open_epub(book()) == ("本", "人", ["一。", "二。"])
    assert X.open_epub(b"broken") == (None, None, [])
    rows = X.epub_rows(spark.createDataFrame([("a.epub", bytearray(book())), ("b.epub", None)], "file string, content binary")).orderBy("file").collect()
    assert (rows[0].content, rows[1].content) == ("一。\n\n二。", "")


def test_word_lists_in_three_shapes(spark, tmp_path):
    shapes = [{"words": [{"word": "水", "level": "N5"}]}, {"N5": ["水"]}, [{"expression": "水", "jlpt": "5", "kana": "みず"}]]
    for i, shape in enumerate(shapes):
        (tmp_path / f"{i}.json").write_text(json.dumps(shape), "utf-8")
        r = L.read_words(spark, str(tmp_path / f"{i}.json")).first()
        assert (r.surface, r.jlpt_level) == ("水", 5)


def test_jmdict_scan(spark, tmp_path):
    (tmp_path / "j.xml").write_text("<JMdict><entry><ent_seq>1</ent_seq><k_ele><keb>約束</keb><ke_pri>news1</ke_pri></k_ele><r_ele><reb>やくそく</reb></r_ele><sense><pos>noun</pos><gloss>promise</gloss></sense></entry><entry><ent_seq>2</ent_seq><r_ele><reb>む</reb></r_ele><sense><gloss>x</gloss></sense></entry></JMdict>", "utf-8")
    targets = spark.createDataFrame([("約束",)], "key string")
    r = L.jmdict_entries(L.read_jmdict(spark, str(tmp_path / "j.xml")), targets).collect()
    assert [(x.key, x.ent_seq, x.common, x.glosses) for x in r] == [("約束", 1, True, [["promise"]])]


def test_yomitan_archive(spark):
    raw = BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("term_bank_1.json", json.dumps([["水", "みず", "n", "", 5, [{"type": "structured-content", "content": [{"tag": "li", "content": "water"}]}], 1, ""], ["空", "", "", "", 0, [], 2, ""]]))
    rows = L.yomitan_rows(spark.createDataFrame([("d.zip", bytearray(raw.getvalue()))], "file string, content binary"), "d").collect()
    assert {(r.lookup_key, r.content) for r in rows} == {("水", "water"), ("水\tみず", "water")}


def test_anime_database(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"data": [{"title": "甲", "synonyms": ["乙"], "episodes": 12, "animeSeason": {"year": 2001}, "sources": ["https://myanimelist.net/anime/7"]}]}), "utf-8")
    r = L.read_anime_db(spark, str(tmp_path / "a.json")).first()
    assert (r.title, r.year, r.mal_id, r.anidb_id) == ("甲", 2001, 7, None)


def test_plain_functions():
    assert pure.decode("約束".encode("cp932")) == "約束"
    assert pure.romaji("きょうっと") == "kyoutto"
    assert pure.ruby("食べ物", "たべもの") == [("食", "た"), ("べ", ""), ("物", "もの")]
    assert pure.spoken("本（ほん（x））です") == "本です"
    assert pure.title_key("ぼっち・ざ・ろっく！") == "ぼっちざろっく"
    assert pure.fuzzy("yakusoku", "yksok") >= 12 and pure.fuzzy("やくそく", "yakusk") == 0
    assert all(len(s) <= 120 for s in pure.segments("あ" * 500))
    assert pure.romaji("ファイル") == "fuairu" and pure.romaji("ティー") == "teii" and pure.romaji("がっこう、ラーメン") == "gakkou、raamen"
    assert pure.ruby("良い", "よい; いい") == [("良", "よ"), ("い", "")] and pure.ruby("かな", "かな") == [("かな", "")] and pure.ruby("今日", "") == [("今日", "")]
    page = "<head><title>x</title></head><h1>第一章</h1><p>本文<b>です</b></p><figure><figcaption>図</figcaption></figure><script>a</script>終わり"
    assert pure.html_text(page) == "第一章\n\n本文です\n\n図\n\n終わり"


def test_glosses():
    from shiori.sources import glosses as g

    raw = {"（みる）①【他动2】看，观看": ("看，观看", "他动", "みる"), "(いま1) 现在": ("现在", "", "いま"), "⓪【名·ナ形】真；实在": ("真；实在", "名词|な形容词", ""), "（romantic）④【ナ形】浪漫的": ("浪漫的", "な形容词", ""), "": ("", "", "")}
    for text, want in raw.items():
        assert tuple(g.entry(text).values()) == want
    cases = {
        "花。\nきれいな花を見る\n看美丽的花。": "花。", "名·形动 安静。": "安静。", "1. 早上。\n朝は寒い\n早上很冷。\n2. 早晨": "早上。；早晨", "看。；【観る】 观赏。": "看；观赏。",
        "テレビ (terebi，“电视”) 的简称": "电视", "姓的另一种写法：姓氏": "姓氏", "见ビル。": "", "【job】见ジョブ。": "", "路灯。==日语==": "路灯。", "〔访れる〕拜访": "拜访", "同ね (ne)。": "",
        "→ たま [玉・珠]，宝石": "宝石", "洗う (arau) 的连用形 [五段动词]": "", "root": "", "灌木（Zanthoxylum）": "灌木", ":Template:音乐 小提琴。": "小提琴。", "比喻：抽象": "比喻：抽象", "": "", " ；; ": "",
    }
    for text, want in cases.items():
        assert g.wiktionary(text) == want, text
