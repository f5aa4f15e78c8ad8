"""Recall of every search mode is reported (r6)."""


def test_three_modes(spark, sf):
    from noteforge.plans import registry

    queries = registry.queries()
    got = [tuple(r) for r in queries["r6_recall_modes"](spark, sf).collect()]
    assert {r[0] for r in got} == {"text", "image", "joint"}
    assert sorted(r[1:] for r in got if r[0] == "joint") == sorted(tuple(r) for r in queries["r6_recall"](spark, sf).select("qid", "recall_at_5", "recall_at_10").collect())
