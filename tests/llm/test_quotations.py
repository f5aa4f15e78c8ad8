"""Quotations of many sentences that the sentence goes on around, and sentences of many candidate places (p8)."""

import pytest

from noteforge.llm import sentences as S

SEG = S.Segmenter()


def cut(text):
    return [text[a:b] for a, b in SEG.text(text)]


@pytest.mark.parametrize("parts", [
    ["“甲。乙。丙。丁。戊。”他说好。", "他走了。"],
    ["他说：“甲甲。乙乙。丙丙。丁丁。”"],
    ["My friend said, “Wait. Turn around. Look up. Look down. Run. Stop. Go.” and left.", "It rained."],
    ["The sign (“Stop. Look. Listen. Wait. Walk. Run. Go.” in red) fell.", "It rained."],
])
def test_no_cut_inside(parts):
    assert cut(("" if parts[0][-1] in "。”" else " ").join(parts)) == parts


def test_more_candidate_places_than_a_window():
    text = "他说：“" + "好的。" * 200 + "”然后走了。"
    assert cut(text + "他来了。") == [text, "他来了。"]


def test_marks_without_partner_close_nothing():
    assert cut('A pipe of 5" is here. It is long. A pipe of 6" is there.') == ['A pipe of 5" is here.', "It is long.", 'A pipe of 6" is there.']
    assert cut("He left (for good. She stayed. It rained.") == ["He left (for good.", "She stayed.", "It rained."]


SIX = {
    "en": ("The tailor said, “", "Look up. ", "” and left. ", "It rained."),
    "de": ("Der Bäcker rief: „", "Komm her. ", "“ und ging. ", "Es regnete."),
    "zh": ("裁缝说：“", "好的。", "”然后走了。", "下雨了。"),
    "ja": ("職人は「", "わかった。", "」と言った。", "雨が降った。"),
    "hi": ("उसने कहा, “", "यह देखो। ", "” और चला गया। ", "बारिश हुई।"),
    "th": ("เขาพูดว่า“", "มาเร็ว!", "”แล้วเดินไป ", "ฝนตก"),
}


@pytest.mark.parametrize("lang", SIX)
@pytest.mark.parametrize("inner", [3, 7, 50, 200])
def test_any_number_of_inner_marks(lang, inner):
    before, part, after, last = SIX[lang]
    text = before + (part * inner).strip() + after
    assert cut(text + last) == [text.strip(), last]


def test_long_lines_are_searched_in_one_pass():
    text = "“" + "好的。" * 20_000 + "”他说。" + "下雨了。" * 20_000
    assert len(cut(text)) == 20_001


def test_opening_words_count_evenly():
    import numpy as np

    scores = []
    for n in (0, 10, 29, 30, 31, 100, 1000, 100_000):
        counts = np.zeros((2, S.BUCKETS), np.int64)
        counts[1, S.bucket("and")] = n
        scores.append(S.Segmenter(counts).opens("and"))
    assert scores == sorted(scores, reverse=True) and scores[0] == 0 and abs(scores[2] - scores[4]) < 0.05 and scores[-1] > -4
