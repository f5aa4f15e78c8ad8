"""Leaks (p6), overlaps (p3), neighbours (p4), mixtures (p7) against brute force."""

import random

import numpy as np

from pyspark.sql import functions as F

from noteforge.llm import leaks, mixing, neighbours, overlap
from noteforge.llm.fmindex import FMIndex
from noteforge.llm.forms import content


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_index_finds_every_occurrence():
    random.seed(2)
    texts = ["".join(random.choice("abcä字") for _ in range(random.randrange(0, 60))) for _ in range(30)]
    ix = FMIndex.load(FMIndex([overlap._codes(t) for t in texts], list(range(30))).dump())
    for _ in range(200):
        p = "".join(random.choice("abcä字z") for _ in range(random.randrange(1, 5)))
        assert sorted(ix.find(overlap._codes(p))) == sorted((i, k) for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(p, k))
    assert [c.tolist() for c in ix.contents(np.arange(30))] == [overlap._codes(t).tolist() for t in texts]
    assert FMIndex([], []).find(overlap._codes("a")) == []


def test_edit_distance():
    random.seed(3)
    for _ in range(500):
        a = "".join(random.choice("abc") for _ in range(random.randrange(30)))
        b = "".join(random.choice("abc") for _ in range(random.randrange(30))) if random.random() < 0.5 else "".join(c for c in a if random.random() < 0.9)
        d, most = levenshtein(a, b), random.randrange(8)
        assert overlap.edit_distance(a, b, most) == min(d, most + 1)


def test_near_pairs_lose_nothing():
    random.seed(5)
    words = ["".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(12)]  # few words, so pieces are frequent
    base = ["".join(random.choice(words) for _ in range(random.randrange(1, 30))) for _ in range(60)]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            k = random.randrange(len(t) + 1)
            kind = random.randrange(3)
            if kind == 0:
                t.insert(k, random.choice("abcxyz"))
            elif k < len(t):
                t[k : k + 1] = [] if kind == 1 else [random.choice("abcxyz")]
        return "".join(t)

    texts = [edited(random.choice(base), random.randrange(0, 14)) for _ in range(120)]
    texts = [t for t in texts if t]
    ix = FMIndex([overlap._codes(t) for t in base], list(range(len(base))))
    got = {(i, j) for i, j, _ in overlap.near_pairs(ix, texts)}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(base) if levenshtein(a, b) * 10 <= max(len(a), len(b))}
    assert len(want) > 20 and got == want


def test_index_is_smaller_than_its_text():
    random.seed(4)
    texts = [overlap._codes("".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500))) for _ in range(200)]
    ix = FMIndex(texts, np.arange(200))
    assert sum(getattr(ix, name).nbytes for name in ix.ARRAYS) < 2.7 * sum(len(t) for t in texts)  # of 4 bytes a letter


def test_spans_of_maximal_matches():
    a, b = (overlap._codes(t) for t in ("abcdefghij--klmnop", "xabcdefghijklmnop!"))
    assert overlap.matches(a, b, [(3, 4), (5, 6), (13, 12)]) == [(0, 10), (12, 18)]
    ix = FMIndex([b], np.arange(1))
    assert overlap.near_matches(ix, ["xabcdefghijklmnop!"]) == [(0, 0, 0, 1, 18)]
    assert overlap.near_matches(ix, ["xabcdefgh_jklmnop!"])[0][:3] == (0, 0, 1)


def test_endless_repetitions_are_searched():
    ix = FMIndex([overlap._codes("a" * n) for n in (50, 95, 100, 105)], np.arange(4))
    assert {(i, j) for i, j, _ in overlap.near_pairs(ix, ["a" * 100])} == {(0, 1), (0, 2), (0, 3)}


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, split string, source string, text string, image_path string, side int")


def test_cross_split_pairs(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [
        (1, "train", "a", long, "p.jpg"), (2, "valid", "a", long.upper() + "!!", None), (3, "test", "b", long.replace("fox", "fix"), " q.jpg "), (4, "train", "b", None, "q.jpg"), (5, "test", "b", "", "p.jpg"),
        (6, "train", "a", long, "p.jpg"), (7, "other", "a", long, "p.jpg"), (8, None, "a", long, "p.jpg"), (9, "test", "a", "k: 1; m: two words", ""), (10, "train", "a", "M: two words / K: 1", " "), (11, "valid", "a", "entirely other words here", "P.jpg"),
        (12, "test", "c", "x" * 100_000 + "ab" * 100, None), (13, "train", "c", "x" * 100_000 + "ba" * 100, None),
    ]
    want = {(1, 2), (1, 3), (2, 6), (3, 6), (3, 4), (1, 5), (5, 6), (9, 10), (12, 13)}
    for chars in (2_000_000, 60):  # one shard and many
        got = [tuple(r) for r in overlap.cross_split_pairs(docs(spark, rows), shard_chars=chars).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    report = {(r["split"], r["source"]): (r["n_docs"], r["n_text"], r["n_image"], r["n_any"]) for r in overlap.overlap_report(docs(spark, rows)).collect()}
    assert report[("test", "b")] == (2, 1, 2, 2) and report[("valid", "a")] == (2, 1, 0, 1)
    assert overlap.cross_split_pairs(docs(spark, [])).count() == 0


def test_shared_key_pairs_split_hot_keys(spark):
    t = spark.createDataFrame([(i, "k") for i in range(40)] + [(100, "m")], "doc_id bigint, path string")
    e = spark.createDataFrame([(i, "k") for i in range(200, 230)] + [(300, "n")], "doc_id bigint, path string")
    got = {tuple(r) for r in overlap.shared_key_pairs(t, e, "path", pairs=100).collect()}
    assert got == {(i, j) for i in range(40) for j in range(200, 230)}


def test_leaks(spark):
    random.seed(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    item = "".join(random.choice(letters) for _ in range(120))
    zh = "".join(chr(0x4E00 + random.randrange(3000)) for _ in range(60))
    noise = lambda n: "".join(random.choice(letters) for _ in range(n))
    notes = [
        (1, noise(50) + item + noise(50)), (2, noise(9) + item[10:50] + noise(30) + item[70:110]), (3, item[:36] + noise(300)), (4, noise(500)), (5, None), (6, ""),
        (7, noise(20) + zh[5:20] + "，" + noise(9) + zh[30:50]), (8, zh[:10] + "x" + zh[20:30] + "y" + zh[40:50] + "z"), (9, (item[:60] + "q" + item[61:]).upper()), (10, noise(100_000) + item),
    ]
    n = spark.createDataFrame([(*r, 0) for r in notes], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, zh), (3, None), (4, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked(n, items).collect()}
    assert got == {(1, 1), (2, 1), (7, 2), (9, 1), (10, 1)}
    assert leaks.leaked(n, items.limit(0)).count() == 0 and leaks.leaked(n.limit(0), items).count() == 0
    assert leaks.leaked_documents(leaks.leaked(n, items)).where("doc_id = 7").first()["worst_item_id"] == 2


def test_banded_alignment_keeps_the_edit_budget():
    random.seed(11)
    item = "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    index = leaks.LeakIndex.load(leaks.LeakIndex([(7, item)]).dump())
    note = "0" * 30 + item[:12] + "?" + item[13:20] + item[21:34] + "0" * 30  # a replacement and a deletion in 34 characters
    assert index.leaks([note], 0.5, 2) == [(0, 7, 34, 60)]
    assert index.leaks([note], 0.5, 1) == []
    more = "0" * 9 + item[:12] + "??" + item[12:40] + "0" * 9  # two insertions
    assert index.leaks(["0" * 99, more, note], 0.5, 2) == [(1, 7, 40, 60), (2, 7, 34, 60)]
    assert index.leaks([more], 0.5, 0) == [] and index.leaks([item[:29] + "-" * 40, "-" * 40 + item], 0.5, 0) == [(1, 7, 60, 60)]


def test_alignment_against_edit_distance():
    """Every span that is reported lies within the budget of some part of the note."""
    random.seed(12)
    for _ in range(60):
        item = "".join(random.choice("abcd") for _ in range(50))
        part = list(item[5:45])
        for _ in range(3):
            part[random.randrange(len(part))] = random.choice(["", "x", "ab"])
        note = "zz" + "".join(part) + "zz"
        for edits in (0, 1, 2, 3):
            for s, e in leaks.stretches(leaks.codes(note), leaks.codes(item), -8, 8, 0, len(note), 12, edits):
                assert min(levenshtein(item[s:e], note[a:b]) for a in range(len(note)) for b in range(a + e - s - edits, min(len(note), a + e - s + edits) + 1)) <= edits


def test_many_items_in_one_pass(spark):
    random.seed(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = ["".join(random.choice(letters) for _ in range(60)) for _ in range(20_000)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    notes = spark.createDataFrame([(k, texts[k * 700] + " and " + texts[k * 700 + 1][:40]) for k in range(20)], "doc_id bigint, text string")
    found = leaks.leaked(notes, items, block_chars=300_000)  # four blocks
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(k, k * 700 + x) for k in range(20) for x in (0, 1)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_leaks_against_brute_force(spark, sf):
    from noteforge.llm.queries import p6_found
    from noteforge.session import table

    items = [(r["item_id"], content(r["text"])) for r in table(spark, sf, "eval_passages").collect()]
    want = set()
    for r in table(spark, sf, "documents").where("split = 'train'").collect():
        note = content(r["text"])
        for i, t in items:
            least = leaks.stretch_of(t)
            held = [False] * len(t)
            for k in range(len(t) - least + 1):
                if t[k : k + least] in note:
                    held[k : k + least] = [True] * least
            if sum(held) * 2 >= len(t):
                want.add((r["doc_id"], i))
    assert {tuple(r) for r in p6_found(spark, sf).collect()} == want


def brute(x, ids, k=5, least=0.85):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.lexsort((ids, -np.round(s[i], 12)))[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def clusters(n, seed, spread=0.25, dim=64):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(max(1, n // 12), dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[rng.integers(0, len(c), n)] + rng.normal(size=(n, dim)) * spread / np.sqrt(dim)
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(np.float32(a)) for a in r], 0) for i, r in enumerate(x)], "row_id bigint, embedding array<float>, key int")


def test_neighbour_recall(spark):
    x = clusters(1500, 1).astype(np.float32).astype(float)
    want = brute(x, np.arange(len(x)))
    for how in ({}, {"max_bucket": 40}, {"leaf": 20}):  # whole buckets, all buckets split, and paths of several hashes
        got = {tuple(r) for r in neighbours.similar_pairs(frame(spark, x), **how).collect()}
        assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_copies_of_a_vector_do_not_grow_with_depth():
    """Every bucket is over the limit, again and again; the paths of a vector stay as many, and near-copies part at last."""
    x = np.concatenate([clusters(3000, 3), 1 + 1e-4 * np.random.default_rng(4).normal(size=(2000, 64))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plan = neighbours.layout(len(x), 64, 2048, neighbours.COPIES)
    h = neighbours.Hasher(64, plan)
    for _ in range(neighbours.DEPTH):
        keys = h.keys(x, [0, 1])
        assert (keys >= 0).sum(axis=1).max() <= 2 * neighbours.COPIES
        found, n = np.unique(keys[keys >= 0], return_counts=True)
        if n.max() <= 100:
            break
        h.split({int(k): x[(keys == k).any(axis=1)].mean(axis=0) for k in found[n > 100]})
    assert n.max() <= 100


def test_layout_keeps_buckets_small():
    for dim in (2, 64, 512):
        last = 0
        for rows in (0, 10, 10**5, 10**6, 10**8, 10**10):
            plan = neighbours.layout(rows, dim)
            buckets = np.prod([2.0 * a for a in plan.axes])
            assert plan.probes <= neighbours.COPIES and plan.tables <= 3
            assert rows * plan.probes / buckets <= neighbours.LEAF or dim == 2
            assert len(plan.axes) >= last
            last = len(plan.axes)


def test_first_row_of_another_length(spark):
    rows = [(1, [1.0]), (2, [1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0]), (4, []), (5, None), (6, [0.0, 1.0, 0.0]), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "row_id bigint, embedding array<float>").coalesce(1)
    assert [tuple(r) for r in neighbours.similar_pairs(df).collect()] == [(2, 3)]
    assert neighbours.nearest(df.where("row_id IN (4, 5)")).count() == 0


def test_neighbour_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, [None, 1.0]), (9, [0.0, 0.5])]
    df = spark.createDataFrame(rows, "row_id bigint, embedding array<float>")
    assert {tuple(r) for r in neighbours.similar_pairs(df).collect()} == {(1, 2), (3, 9)}
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("row_id in (4, 5)")).count() == 0


def test_many_copies_of_one_vector(spark):
    x = clusters(120, 2)
    x[30:100] = x[30]
    want = brute(x, np.arange(len(x)))
    got = {tuple(r) for r in neighbours.similar_pairs(frame(spark, x), max_copies=20).collect()}
    assert len(got & want) >= 0.95 * len(want) and got <= want | {p for p in got if p[0] >= 30}
    near = neighbours.nearest(frame(spark, x), max_copies=20)
    assert {r["neighbour_id"] for r in near.where("row_id = 77").collect()} == {30, 31, 32, 33, 34}


def test_mixture(spark, sf):
    from noteforge.session import table

    m = mixing.Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    caps = {r["source"]: r["max_repeats"] for r in table(spark, sf, "mix_targets").collect()}
    chosen = m.chosen().collect()
    assert chosen and all(1 <= r["repeats"] <= caps[r["source"]] for r in chosen)
    assert len({r["doc_id"] for r in chosen}) == len(chosen)
    again = {(r["doc_id"], r["repeats"]) for r in m.chosen().collect()}
    assert again == {(r["doc_id"], r["repeats"]) for r in chosen}


def test_shares_of_the_test_tables(spark, sf):
    """Each source is within half its longest note, and a slot, of its share; what lacks is reported."""
    from noteforge.session import table

    m = mixing.Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))
    longest = {r["source"]: r["n"] for r in m.sized.groupBy("source").agg(F.max("n_tokens").alias("n")).collect()}
    shares = m.shares().collect()
    assert len(shares) == 12 and abs(sum(r["actual_share"] for r in shares) - 1) < 1e-9
    for r in shares:
        if r["aim_share"] > 0:
            assert abs(r["tokens"] - r["aim_share"] * m.plan.total) <= longest[r["source"]] / 2 + 3 * m.plan.block
            assert r["short_tokens"] == max(0, round(r["aim_share"] * sum(x["tokens"] for x in shares)) - r["tokens"])
        else:
            assert r["tokens"] == 0


def test_mixture_reaches_targets(spark):
    notes = spark.createDataFrame([(i, "big" if i < 3000 else "small" if i < 3300 else "unlisted", f"word{i % 97} " * (3 + i % 9)) for i in range(3500)] + [(9999, "big", None), (9998, None, "x")], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.2, 3), ("none", 0.2, 5)], "source string, target_share double, max_repeats int")
    m = mixing.Mixture(notes, targets, block=64)
    shares = {r["source"]: r for r in m.shares().collect()}
    assert abs(shares["big"]["actual_share"] - 0.75) < 0.01 and abs(shares["small"]["actual_share"] - 0.25) < 0.01 and shares["none"]["actual_share"] == 0
    assert shares["small"]["most_repeats"] <= 3 and "unlisted" not in shares
    uses = m.uses().collect()
    assert len(uses) == sum(r["repeats"] for r in m.chosen().collect())
    first = [r["source"] for r in sorted(uses, key=lambda r: r["slot"]) if r["slot"] < 40]
    assert {"big", "small"} <= set(first)
    assert mixing.Mixture(notes.limit(0), targets).chosen().count() == 0
    assert mixing.Mixture(notes, targets.limit(0)).shares().count() == 0


def test_schedule_discrepancy(spark):
    plan = mixing.plan_mix([("a", 0.5, 1, 1000, 10), ("b", 0.3, 1, 1000, 10), ("c", 0.2, 1, 1000, 10)], total=64_000, block=64)
    rows = sorted(mixing.schedule(spark, plan).collect())
    assert [r["slot"] for r in rows] == list(range(1000))
    for n in (10, 100, 1000):
        for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert abs(sum(r["source"] == s for r in rows[:n]) - w * n) <= 3
    for s in "abc":
        assert [r["turn"] for r in rows if r["source"] == s] == list(range(sum(r["source"] == s for r in rows)))
