"""Orphan references: brute force over random tables, hot keys, ties, nulls, empty tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from noteforge.operators import references as R

DAY = dt.datetime(2024, 1, 1)


def tables(spark, refs, targets):
    r = spark.createDataFrame(refs, "id bigint, key string, at timestamp_ntz, extra string")
    t = spark.createDataFrame(targets, "key string, since timestamp_ntz, until timestamp_ntz, extra string")
    return R.references(r, "t", "id", R.trimmed(F.col("key")), "at"), R.spans(t, "t", F.col("key"), "since", "until")


def test_against_brute_force(spark):
    random.seed(4)
    when = lambda: DAY + dt.timedelta(days=random.randrange(60))
    refs = [(i, random.choice(["a", "b", " b ", "c", "", None, "hot", "hot", "hot"]), random.choice([when(), None, when()]), "x") for i in range(400)]
    targets = []
    for _ in range(40):
        since = random.choice([when(), None, when()])
        targets.append((random.choice(["a", "b", "hot", None, "unused"]), since, random.choice([None, when()]), "y"))
    r, t = tables(spark, refs, targets)
    want = set()
    for i, key, at, _ in refs:
        k = (key or "").strip()
        if k and at and not any(x == k and s and s <= at and (u is None or u > at) and (u is None or u > s) for x, s, u, _ in targets):
            want.add((i, k, at.strftime("%Y-%m")))
    for hot in (1_000_000, 20):  # whole and split keys
        got = [(x["row_key"], x["ref_key"], x["period"]) for x in R.orphans(r, t, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_moments(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    r, t = tables(spark, [(1, "k", d(1), ""), (2, "k", d(0), ""), (3, "k", d(2), ""), (4, "k", d(3), "")], [("k", d(1), d(2), ""), ("k", d(3), None, "")])
    assert {x["row_key"] for x in R.orphans(r, t).collect()} == {2, 3}


def test_state_merges(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    r, t = tables(spark, [(1, "k", d(1), ""), (2, "l", d(1), "")], [("k", d(1), d(2), "")])
    state = R.counts(r, t)
    assert {(x["key"], x["refs"]) for x in R.current_orphans(state).collect()} == {("k", 1), ("l", 1)}
    more = spark.createDataFrame([("t", "l", 0, 1), ("t", "k", -1, 0)], state.schema)
    assert R.current_orphans(R.merge_counts(state, more)).count() == 0


def test_deliveries_give_what_one_gives(spark):
    """Three deliveries with a state merged between them, whole and split keys, withdrawn references."""
    random.seed(9)
    when = lambda: DAY + dt.timedelta(hours=random.randrange(24 * 60))
    rows = [(i, random.choice(["a", "b", "c", "hot", "hot"]), when(), random.choice([None, when()])) for i in range(300)]
    targets = [(random.choice(["a", "b", "hot", "hot", "d"]), when(), random.choice([None, when()]), "") for _ in range(60)]
    r = spark.createDataFrame(rows, "id bigint, key string, at timestamp_ntz, gone timestamp_ntz")
    t = spark.createDataFrame(targets, "key string, since timestamp_ntz, until timestamp_ntz, extra string")
    refs, present = R.references(r, "t", "id", F.col("key"), "at", until="gone"), R.spans(t, "t", F.col("key"), "since", "until")
    want = {tuple(x) for x in R.orphans(refs, present).collect()}
    every = R.changes(refs, present)
    for hot in (1_000_000, 15):
        state, got = None, []
        for low, high in ((0, 15), (15, 40), (40, 999)):
            part = every.where((F.col("at") >= DAY + dt.timedelta(days=low)) & (F.col("at") < DAY + dt.timedelta(days=high)))
            got += [tuple(x) for x in R.delivered(part, state, hot).collect()]
            state = R.summed(part) if state is None else R.merge_counts(state, R.summed(part))
        assert len(got) == len(set(got)) and set(got) == want
    live = {}
    for i, key, at, gone in rows:
        live[key] = live.get(key, 0) + (gone is None)
    there = {k for k, s, u, _ in targets if u is None}
    assert {(x["key"], x["refs"]) for x in R.current_orphans(state).collect()} == {(k, n) for k, n in live.items() if n and k not in there}


def test_empty(spark):
    r, t = tables(spark, [], [])
    assert R.orphans(r, t).count() == 0
    r, t = tables(spark, [(1, "k", DAY, "")], [])
    assert [x["row_key"] for x in R.orphans(r, t).collect()] == [1]
    assert [(x["n_references"], x["n_orphans"]) for x in R.orphan_report(r, R.orphans(r, t)).collect()] == [(1, 1)]
