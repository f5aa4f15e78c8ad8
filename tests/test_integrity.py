"""Validation rules on made tables."""

import pytest

from noteforge.operators import integrity
from noteforge.operators.ordering import WIDTH

SEAM = [WIDTH - 2, WIDTH - 1, WIDTH, WIDTH + 1, 2 * WIDTH, 3 * WIDTH + 5]


def found(spark, offsets, entries):
    table = spark.createDataFrame(offsets, "row bigint, begin bigint, end bigint")
    return {tuple(r) for r in integrity.offset_violations(table, table.select("row"), entries).collect()}


@pytest.mark.parametrize("at", range(1, len(SEAM)))
@pytest.mark.parametrize("shift", [1, -1])
def test_offsets_follow_each_other_across_buckets(spark, at, shift):
    rows = [(r, 3 * i, 3 * i + 3) for i, r in enumerate(SEAM)]
    assert found(spark, rows, 18) == set()
    rows[at:] = [(r, a + shift, b + shift) for r, a, b in rows[at:]]
    assert found(spark, rows, 18 + shift) == {("rows follow each other", str(SEAM[at - 1]), str(3 * at + shift))}


def test_offsets_begin_at_zero_and_end_at_entries(spark):
    rows = [(r, 3 * i, 3 * i + 3) for i, r in enumerate(SEAM)]
    assert found(spark, rows[1:], 18) == {("rows follow each other", "offsets", "3")}
    assert found(spark, rows[:-1], 18) == {("rows follow each other", str(SEAM[-2]), "18")}
    assert found(spark, [], 18) == {("rows follow each other", "offsets", "18")}
    assert found(spark, [], 0) == set()


def test_unknown_offset_is_a_gap(spark):
    assert ("rows follow each other", "0", None) in found(spark, [(0, 0, 2), (1, None, 4), (2, 4, 5)], 5)
