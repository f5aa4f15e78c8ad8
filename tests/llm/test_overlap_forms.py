"""Field lists with an edit in a name, a colon or a separator (p3)."""

import pytest

from noteforge.llm import overlap

LIST = "alpha: silver kettle with a long spout / body: enamelled steel, two litres / color: dark green"
SWAPPED = "color: dark green / body: enamelled steel, two litres / alpha: silver kettle with a long spout"


@pytest.mark.parametrize("other", [
    LIST.replace("alpha", "zlpha"),  # the first field would sort last
    SWAPPED.replace("color:", "color"),  # no list any more, but as SWAPPED in its order
    SWAPPED.replace(" / body", " body"),
    SWAPPED.replace("green", "grEEn!"),
])
def test_one_edit_in_a_field_list(spark, other):
    rows = [(1, "train", "a", LIST, None), (2, "train", "a", SWAPPED, None), (3, "valid", "a", other, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, split string, source string, text string, image_path string")
    got = [tuple(r) for r in overlap.cross_split_pairs(df).collect()]
    nearer = (1, 3) if other.startswith("zlpha") else (2, 3)
    assert nearer in got and len(got) == len(set(got))
    if other.endswith("spout") and "grEEn" in other:
        assert set(got) == {(1, 3), (2, 3)}  # fields in any order


def test_forms():
    assert overlap.comparable(None) == overlap.comparable(" .") == []
    assert len(overlap.comparable(LIST)) == 1  # its fields are in order
    assert overlap.comparable(SWAPPED)[1:] == overlap.comparable(LIST)
