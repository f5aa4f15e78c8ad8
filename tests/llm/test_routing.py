"""Routing of training texts to evaluation texts (p3): nothing within the budget is lost, little else is searched."""

import random

import numpy as np
import pytest

from noteforge.llm import overlap, routing
from noteforge.llm.fmindex import FMIndex, suffix_array

from tests.llm.test_search import levenshtein


def routed(texts, base, share=overlap.SHARE):
    """Routed pairs of the texts, both in order of size."""
    cut = routing.Cut([overlap._codes(t) for t in texts])
    lists = routing.PieceLists.load(routing.PieceLists([overlap._codes(t) for t in base]).dump())
    x, y = lists.pairs(cut, 0, len(texts), share)
    return set(zip(x.tolist(), y.tolist()))


@pytest.mark.parametrize("words", [12, 300])
def test_routing_loses_nothing(words, monkeypatch):
    monkeypatch.setattr(routing, "PLACES", 100)  # many parts
    random.seed(words)
    words = ["".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(words)]
    base = ["".join(random.choice(words) for _ in range(random.randrange(1, 30))) for _ in range(80)] + ["a" * n for n in range(1, 25)]

    def edited(t):
        t = list(t)
        for _ in range(len(t) // 10 + 1):
            k = random.randrange(len(t) + 1)
            kind = random.randrange(3)
            if kind == 0:
                t.insert(k, random.choice("abcxyz"))
            elif k < len(t):
                t[k : k + 1] = [] if kind == 1 else [random.choice("abcxyz")]
        return "".join(t)

    even = lambda t, at: "".join("!" if k % 10 == at else c for k, c in enumerate(t))  # noqa: E731  every edit as far from the others as can be, the hardest case
    texts = [edited(random.choice(base)) for _ in range(150)] + [even(random.choice(base), random.randrange(4, 10)) for _ in range(60)] + ["a" * n for n in range(1, 25)]
    texts, base = sorted((t for t in texts if t), key=len), sorted(base, key=len)
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(base) if levenshtein(a, b) * 10 <= max(len(a), len(b))}
    got = routed(texts, base)
    assert len(want) > 100 and want <= got
    index = FMIndex([overlap._codes(t) for t in base], np.arange(len(base)))
    among = np.sort([i * len(base) + j for i, j in got])
    assert {m[:2] for m in overlap.near_matches(index, texts, among=among)} == want


def test_texts_without_a_counterpart_are_not_searched():
    """Training texts went through backward search in every shard of fitting length, so work grew with both sides."""
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    words = [word() for _ in range(500)]
    text = lambda: "".join(random.choice(words) for _ in range(random.randrange(18, 22)))
    train, base = sorted((text() for _ in range(400)), key=len), sorted((text() for _ in range(400)), key=len)
    train[7] = base[5][:50] + "?" + base[5][51:]
    train.sort(key=len)
    got = routed(train, base)
    assert (train.index(base[5][:50] + "?" + base[5][51:]), 5) in got and len(got) < 20


def test_far_places():
    random.seed(4)
    long = "".join(random.choice("abcdefghij") for _ in range(70_000))
    texts = sorted([long[:69_000] + "?" + long[69_001:], "x" * 70_000, long[::-1]], key=len)
    assert routed(texts, [long]) == {(texts.index(long[:69_000] + "?" + long[69_001:]), 0)}


def test_copies_of_a_training_text_are_searched_once(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_ROWS", 5)
    long = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(k, "train", "a", long, None) for k in range(8)] + [(k, "train", "a", long[:-4] + "home", None) for k in range(8, 11)] + [(20, "test", "a", long, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, split string, source string, text string, image_path string")
    got = [tuple(r) for r in overlap.cross_split_pairs(df).collect()]
    assert sorted(got) == [(k, 20) for k in range(11)]


def test_suffix_array():
    random.seed(3)
    for letters in (1, 2, 5000):
        s = [random.randrange(letters) for _ in range(200)] + [7]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
