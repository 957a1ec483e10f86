import time

import pytest

from attestra.llm.sentences import report_sentences, sentence_units, units

CASES = [
    ("Dr. Smith paid $3.5 million. He left for the U.S. Critics left at 9 a.m. The end.", ["Dr. Smith paid $3.5 million.", "He left for the U.S.", "Critics left at 9 a.m.", "The end."]),
    ("J. K. Ro and S. Q. Lee voted against it. Maps, coins, etc. The rest.", ["J. K. Ro and S. Q. Lee voted against it.", "Maps, coins, etc.", "The rest."]),
    ("Kosten: ca. 5,8 Mio. Euro, d. h. mehr. Am 5. Juli 2016 kam er.Dann ging er.", ["Kosten: ca. 5,8 Mio. Euro, d. h. mehr.", "Am 5. Juli 2016 kam er.", "Dann ging er."]),
    ("„Er kam nie. Das weiß er genau“, sagte Anna Boe. Dann Ruhe.", ["„Er kam nie. Das weiß er genau“, sagte Anna Boe.", "Dann Ruhe."]),
    ('He asked: "Why now?" “It is ours! It was!” shouted Bo. "Who paid?" Ann Lee\nasked. End.', ['He asked: "Why now?"', "“It is ours! It was!” shouted Bo.", '"Who paid?" Ann Lee\nasked.', "End."]),
    ("Hey You! returned in 2018. Really?! Yes. He waited ... and then left.", ["Hey You! returned in 2018.", "Really?!", "Yes.", "He waited ... and then left."]),
    ("(He did not answer.) She (b. 1990 in Rome) did.", ["(He did not answer.)", "She (b. 1990 in Rome) did."]),
    ("他说：“学校……没有了。”网上说法不符；真的吗？“不存在。很清楚！”李对记者说。", ["他说：“学校……没有了。”", "网上说法不符；真的吗？", "“不存在。很清楚！”李对记者说。"]),
    ("橋を守れ！とタニは叫んだ。タニは「なぜなのか。」と尋ねた。", ["橋を守れ！とタニは叫んだ。", "タニは「なぜなのか。」と尋ねた。"]),
    ("ในปี 2021 นาลาดีได้ยกเลิกภาษี ชาวเมืองคัดค้าน บริษัท U.S. abc Inc. เป็นผู้สร้าง", ["ในปี 2021 นาลาดีได้ยกเลิกภาษี", "ชาวเมืองคัดค้าน บริษัท U.S. abc Inc. เป็นผู้สร้าง".split(" ", 1)[0], "บริษัท U.S. abc Inc. เป็นผู้สร้าง"]),
    ("वर्ष 1995 में कर। डॉ. राम ने कहा। क्या रोकी?", ["वर्ष 1995 में कर।", "डॉ. राम ने कहा।", "क्या रोकी?"]),
    ("قال د. علي إن النسبة بلغت 39.2 في المئة. من دفع؟ كفى!", ["قال د. علي إن النسبة بلغت 39.2 في المئة.", "من دفع؟", "كفى!"]),
    ("Д-р Ро (р. 2039 г. в Зазе) изучал. Они против. мост стоит 66,1 млн. руб., т. е. больше.", ["Д-р Ро (р. 2039 г. в Зазе) изучал.", "Они против.", "мост стоит 66,1 млн. руб., т. е. больше."]),
    ("*** Notice. Read it. ***\n\n» By Ann\n \nText one\ngoes on. Two |", ["*** Notice.", "Read it. ***", "» By Ann", "Text one\ngoes on.", "Two |"]),
    ("Items:\n- one. two\n- three", ["Items:", "- one. two", "- three"]),
    ("See www.a-b.example/x.html?v=7.2 for more, e.g. this; that. Done", ["See www.a-b.example/x.html?v=7.2 for more, e.g. this; that.", "Done"]),
    ('He went.“It is ours! It was!” shouted Bo. It cost 30 euros."Who paid?" Ann Lee asked.', ["He went.", "“It is ours! It was!” shouted Bo.", "It cost 30 euros.", '"Who paid?" Ann Lee asked.']),
    ('Stop it!"It was," he said. Er ging.„Nie. Nein“, sagte er.', ["Stop it!", '"It was," he said.', "Er ging.", "„Nie. Nein“, sagte er."]),
    ('A quote " never closed. Next one.', ['A quote " never closed.', "Next one."]),
    ("Steps:\n1. Open the door.\n2. Close it. Wait.", ["Steps:", "1. Open the door.", "2. Close it.", "Wait."]),
    ("Items:\n1. One\n   a. Sub one. More.\n   b. Sub two.\n2. Two", ["Items:", "1. One", "a. Sub one.", "More.", "b. Sub two.", "2. Two"]),
    ("1) First\na) In it.\nb) Too.\n2) Second\nwrapped.", ["1) First", "a) In it.", "b) Too.", "2) Second\nwrapped."]),
    ("• one\n  - in. out\n  - in two\n• two", ["• one", "- in. out", "- in two", "• two"]),
    ("He was born on\n3. Oktober 1990. Later\n4. Mai came.", ["He was born on\n3. Oktober 1990.", "Later\n4. Mai came."]),
    ("Only:\n1. alone here.", ["Only:\n1. alone here."]),
    (" \n\t\n ", []),
    ("", []),
    ("...", ["..."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_units(text, want):
    got = units(text)
    assert [text[a:b] for a, b in got] == want
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))


@pytest.mark.parametrize(
    "text",
    ["!? " * 330_000, "（a" * 200_000 + " ] b" * 150_000, "[" * 500_000 + "”" * 500_000, "a.a" * 330_000, '"a…" x ' * 140_000, "„a “" * 150_000 + ".”“" * 100_000, "1. a\n2. b\n" * 100_000, "x" * 1_000_000, "“（" * 250_000 + "）" * 500_000, "a." + " " * 999_000 + "b"],
    ids=range(10),
)
def test_a_million_characters_of_marks(text):
    began = time.process_time()
    found = units(text)
    assert time.process_time() - began < 10  # some seconds on a slow machine; minutes if a part were read again and again
    assert found and all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_long_text():
    assert len(units("One two three. " * 60_000)) == 60_000
    assert units("x" * 1_000_000) == [(0, 1_000_000)]


def test_table(spark):
    rows = [("r1", "Go on. Or do.", 1), ("r1", "Go on. Or do.", 2), ("r2", None, 3), ("r3", "  ", 4), (None, "X y.", 5), (None, "Z.", 6)]
    df = spark.createDataFrame(rows, "report_id string, report_content string, id int")
    got = {(r.report_id, r.sent_idx, r.char_start, r.char_end) for r in report_sentences(df).collect()}
    assert got == {("r1", 0, 0, 6), ("r1", 1, 7, 13), (None, 0, 0, 4), (None, 0, 0, 2)}
    assert report_sentences(df.limit(0)).count() == 0
    assert sentence_units(df, "id", "report_content").count() == 6
