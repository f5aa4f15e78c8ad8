"""Consistent forms and look-alike twins (p1), formatting copies (p5)."""

import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from noteforge.llm import copies, forms, lookalikes

READER = forms.LatticeReader()


def test_invisible_differences_fold():
    same = [
        ("ＡＢＣ１２３，ｶﾞ", "ABC123,ガ"), ("é", "é"), ("a​b﻿­", "ab"), ("a b　c d", "a b c d"),
        ("раураl", "paypal"), ("⽔⾊", "水色"), ("料", "料"), ("scоpe", "scope"), ("Ρаriѕ", "Paris"), ("Ｇrӧßｅ", "Größe"),
    ]
    for a, b in same:
        assert READER.text(a) == READER.text(b), (a, b)


def test_visible_differences_stay():
    for a, b in [("A", "a"), ("a  b", "a b"), ("a\tb", "a b"), ("a\nb", "a b"), ("m²", "m2"), ("②", "2"), ("㎏", "kg"), ("½", "1/2"), ("a.", "a"), ("…", "..."), ("О", "0"), ("日", "曰")]:
        assert READER.text(a) != READER.text(b), (a, b)


def test_natural_scripts_are_kept():
    texts = ["привет мир это просто строка", "сосна и роса", "το σπίτι είναι όμορφο", "the scope of peace"]
    from collections import Counter

    n = Counter()
    for t in texts * 50:
        n.update(forms.pure_tokens(t))
    reader = forms.LatticeReader(forms.bigram_counts(n))
    assert reader.text("привет сосна") == "привет сосна"  # сосна and роса hold letters with twins only in part
    assert reader.text("σπίτι") == "σπίτι"
    assert reader.text("реace") == "peace"


@given(st.text(alphabet="abcopexysijhАВЕКМНОРСТХаеорсухіјѕԁһο ́", max_size=20))
@settings(max_examples=300, deadline=None)
def test_form_depends_on_looks_only(t):
    looks = "".join(forms._TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", t))
    assert READER.text(t) == READER.text(unicodedata.normalize("NFC", looks))
    assert READER.text(READER.text(t)) == READER.text(t)


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "table_name string, id bigint, text string, form string")


def test_twins(spark):
    rows = [("d", 3, "scope"), ("d", 5, "scоpe"), ("d", 7, "scope"), ("d", 9, "SCOPE"), ("e", 1, "scоpe"), ("d", 11, None), ("d", 12, ""), ("d", 13, "…"), ("d", 14, "。"), ("d", 20, "x" * 200_000 + "а"), ("d", 21, "x" * 200_000 + "a")]
    got = {tuple(r) for r in lookalikes.lookalike_twins(table(spark, rows)).collect()}
    assert got == {("d", 3, 5), ("d", 20, 21)}
    assert lookalikes.lookalike_twins(table(spark, [])).count() == 0
    out = lookalikes.consistent_text(table(spark, rows), "text")
    assert out.where("id = 11").first()["consistent_text"] is None and out.where("id = 12").first()["consistent_text"] == ""


def test_twins_against_brute_force(spark, sf):
    from noteforge.llm.queries import _two_tables, p1_found

    groups = {}
    for name, i, t in _two_tables(spark, sf, "raw_text").collect():
        if t and forms.has_word(t):
            groups.setdefault((name, READER.text(t)), []).append((i, t))
    want = set()
    for (name, _), members in groups.items():
        members.sort()
        want |= {(name, members[0][0], i) for i, t in members[1:] if t != members[0][1]}
    assert want and {tuple(r) for r in p1_found(spark, sf).collect()} == want


def test_content_and_fields():
    assert forms.content("Ｈello,  WÖRLD!\n²") == forms.content("hello wörld²")
    assert forms.content("…！") == "" and forms.content(None) == "" and forms.content("́") == ""
    assert forms.fields("a: 1 | b: 2") == [("a", "1"), ("b", "2")]
    for t in ("a: 1", "a: 1 | a: 2", "plain | text", "他说：“好。”又走了\n我说：“好”", None, "", "a: | b: 2"):
        assert forms.fields(t) is None, t


def test_copies(spark):
    rows = [
        ("d", 1, "Name: A b; Size: 2"), ("d", 2, "size：２ / NAME： a B。"), ("d", 3, "Name: A b; Size: 3"), ("d", 4, "hello world"), ("d", 5, "Hello\tWorld!!"), ("d", 6, "world hello"),
        ("e", 4, "hello world"), ("d", 8, None), ("d", 9, "   "), ("d", 10, "--"), ("d", 11, "hello world"),
    ]
    want = {("d", 1, 2), ("d", 4, 5), ("d", 4, 11)}
    for bits in (128, 1):  # a one-bit fingerprint collides; verification sorts it out
        assert {tuple(r) for r in copies.copy_members(table(spark, rows), bits).collect()} == want
    assert {tuple(r) for r in copies.collapse_copies(table(spark, rows)).collect()} == {("d", 1, 2), ("d", 3, 1), ("d", 4, 3), ("d", 6, 1), ("e", 4, 1)}
    assert copies.copy_members(table(spark, [])).count() == 0


def test_copies_against_brute_force(spark, sf):
    from noteforge.llm.queries import _two_tables, p5_found

    groups = {}
    for name, i, t in _two_tables(spark, sf, "text").collect():
        f = forms.fields(t)
        key = tuple(sorted(n + v for n, v in f)) if f else (forms.content(t),)
        if key != ("",):
            groups.setdefault((name, key), []).append(i)
    want = {(n, min(m), i) for (n, _), m in groups.items() for i in m if i != min(m)}
    assert want and {tuple(r) for r in p5_found(spark, sf).collect()} == want


def test_hot_group_is_spread(spark):
    rows = [("d", i, random.choice(["same text", "Same  text"])) for i in range(600)] + [("d", 1000 + i, f"other {i}") for i in range(300)]
    got = copies.copy_members(table(spark, rows)).collect()
    assert len(got) == 599 and {r["first_id"] for r in got} == {0}


def test_similar_letters_are_read_by_their_neighbours():
    from collections import Counter

    from noteforge.llm.forms import LatticeReader, bigram_counts, fields

    known = Counter({w: 200 for w in "the paper page rain gate pipe apple fine girl coat people".split()}) + Counter({"παρα": 20, "ραδιο": 20})
    reader = LatticeReader(bigram_counts(known))
    for seen, meant in [("ρaper", "paper"), ("gαte", "gate"), ("fıne", "fine"), ("ɡirl", "girl"), ("cօat", "coat"), ("Ꭺpple", "Apple"), ("ꓑage", "Page"), ("a‑b", "a‐b"), ("ﺎ", "ا")]:
        assert reader.text(seen) == reader.text(meant) == meant
    assert reader.text("ραδιο") == "ραδιο" and reader.text("παρα") != reader.text("napa")
    assert fields("k" * 50 + ": one; m: two") == [("k" * 50, "one"), ("m", "two")]


def test_prose_with_colons_is_no_field_list():
    from noteforge.llm.forms import fields

    long = "Beside the jars etc. stood a lamp. “Hands off!” cried a tailor. Whether soup or tea: the cook knows"
    assert fields(long + "\nA second line. And more: so it ends") is None
    assert fields("甲。乙：丙\n丁：戊") is None and fields("size: 3 cm\ncolour: red") == [("size", "3cm"), ("colour", "red")]
