"""Pairs of a large group leave it a few of each class at a time."""

from __future__ import annotations

import random

import numpy as np

from terrane.llm import jaccard


def test_a_turn_grows_with_the_classes_and_reaches_all():
    left, right = np.triu_indices(300, 1)
    for turn in range(3):
        at = jaccard.first_of_each(left, right, 300, 2, turn)
        assert len(at) <= 2 * 300
        root = np.arange(300)
        for a, b in zip(left[at], right[at], strict=True):
            root[root == root[b]] = root[a]
        assert len(set(root)) == 1


def test_turns_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "EACH", 1)
    monkeypatch.setattr(jaccard, "led", lambda known: known.selectExpr("class AS a", "class AS b").filter("false"))
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 3)):
            words[at] = f"x{rng.randint(0, 999)}"
        texts.append(" ".join(words))
    seen, turns = jaccard.crossing, []
    monkeypatch.setattr(jaccard, "crossing", lambda *a: (turns.append(a[4]), seen(*a))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 4, (85, 100)).collect()}
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for t in texts)]
    root = list(range(40))
    for a in range(40):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root)) and len(turns) > 1
