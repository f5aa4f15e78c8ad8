"""Tables of vectors whose first row is not of the usual length (r and t searches)."""

from noteforge.operators import retrieval as R

ROWS = [(1, [1.0]), (2, [1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0]), (4, []), (5, None), (6, [0.0, 1.0, 0.0]), (7, [1.0, 2.0])]


def test_most_frequent_length_counts_not_the_first(spark):
    df = spark.createDataFrame(ROWS, "row_id bigint, embedding array<float>").coalesce(1)
    assert R.usual_length(df, "embedding") == 3
    assert [r["i"] for r in R.unit_rows(df, "row_id", "embedding", "i").orderBy("i").collect()] == [2, 3, 6]


def test_equally_frequent_lengths_and_none(spark):
    df = spark.createDataFrame(ROWS, "row_id bigint, embedding array<float>")
    assert R.usual_length(df.where("row_id IN (1, 2)"), "embedding") == 3
    assert R.usual_length(df.where("row_id IN (4, 5)"), "embedding") is None
