"""Sentence units (p8)."""

import pytest

from noteforge.llm import sentences as S

SEG = S.Segmenter()


def cut(text):
    return [text[a:b] for a, b in SEG.text(text)]


@pytest.mark.parametrize("parts", [
    ["We met Dr. Smith at 9 a.m. and left.", "It was 3.5 km away.", "See file img_2.jpg, e.g. the map."],
    ["No. 5 belongs to J. R. Miller.", "What a day!", "Was it?"],
    ["“Keep it!” shouted the man, who had gone.", "It rained... yet we stayed."],
    ["My friend said, “Wait. Turn around.” and left.", "Prices rose from $1,170.50 to $2,325.00."],
    ["The pilot left at 7 p.m.", "No. 8 is next."],
    ["(We met in the hall.)", "【It was late!】", "*Nobody came.*"],
    ["Am 9. Mai kam Frau Dr. Meier.", "Nr. 20 kostet inkl. Versand 4,4 Euro.", "Wir haben z. B. drei, d. h. genug."],
    ["Neben Brot, Käse usw. stand Wein.", "„Bitte nicht anfassen!“, rief jemand laut."],
])
def test_spaced_scripts(parts):
    assert cut(" ".join(parts)) == parts


@pytest.mark.parametrize("parts", [
    ["今天走了4.8公里。", "我问：“多少钱？”他答：“12块。”于是买了。", "真的吗？！", "走吧……", "好。"],
    ["“真的可以吗？”他抬头问道，还笑了。", "【这里很好！】", "型号v1.7，不错。"],
    ["「大丈夫？」と聞きました。", "「これ、6円ですよ。」と言い、包みました。", "ver2.3は軽いです。"],
])
def test_scripts_without_spaces(parts):
    assert cut("".join(parts)) == parts


def test_hindi_and_thai():
    hi = ["डॉ. नोरिन ने कहा।", "“यह मत छुओ!” दादी ने कहा।", "क्या यह 2.5 किलो है?"]
    assert cut(" ".join(hi)) == hi
    th = ["ราคา 3 บาทแต่แจกันอบอุ่น", "ฉันชอบแมว", "เราซื้อ 75 ห่อจากตลาด"]
    assert cut(" ".join(th)) == th


def test_lines_offsets_and_empties():
    text = "\n  品名: 杯 | 颜色: 红；尺寸: 2.5\r\nplain title\n\n a。​b。 \t"
    got = SEG.text(text)
    assert [text[a:b] for a, b in got] == ["品名: 杯 | 颜色: 红；尺寸: 2.5", "plain title", "a。", "​b。"]
    for t in (None, "", "  ", "。。。", "--\n--"):
        assert SEG.text(t) == []


def test_every_character_is_kept():
    import random

    random.seed(1)
    alphabet = "ab. A!?。“”（）9 \n字「」…"
    for _ in range(300):
        t = "".join(random.choice(alphabet) for _ in range(60))
        spans = SEG.text(t)
        assert all(a < b <= c for (a, b), (c, _) in zip(spans, spans[1:]))
        inside = "".join(t[a:b] for a, b in spans)
        assert sum(c.isalnum() for c in inside) == sum(c.isalnum() for c in t)


def test_long_line_is_whole():
    text = "This is one. " * 20_000
    assert len(SEG.text(text)) == 20_000


def test_table(spark, sf):
    df = spark.createDataFrame([(1, "One. Two.", 5), (2, None, 6), (3, "", 7)], "doc_id bigint, text string, start_char int")
    assert {tuple(r) for r in S.sentences(df).collect()} == {(1, 0, 4), (1, 5, 9)}
    assert S.sentences(df.limit(0)).count() == 0
    from noteforge.llm.queries import p8_found
    from noteforge.session import table

    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    got = p8_found(spark, sf).collect()
    assert {r["doc_id"] for r in got} == {i for i, t in docs.items() if t and any(c.isalnum() for c in t)}
    assert all(docs[r["doc_id"]][r["start_char"] : r["end_char"]].strip() == docs[r["doc_id"]][r["start_char"] : r["end_char"]] for r in got)
