"""Many equal outlines over a place: they are swept and quartered as one, and settled as before."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from terrane.operators import planar, spatial


def box(x0, y0, x1, y1):
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)


def settled(held, marks):
    """The pairs of those that hold a place one after the other, in the order of their hashes."""
    left = set(held)
    for mark, a, b in sorted((planar.pair_mark(marks[a], marks[b]), a, b) for a in held for b in held if a < b):
        if a in left and b in left:
            low, high = (a, b) if (int(marks[a]), a) < (int(marks[b]), b) else (b, a)
            left.discard(low if mark % 2 == 0 else high)
    return left.pop()


def test_owners_are_those_of_the_pairs_in_order():
    rng = np.random.default_rng(3)
    marks = rng.integers(-(2**63), 2**63, 1500)
    sets = [np.sort(rng.choice(1500, n, replace=False)) for n in (1, 2, 3, 7, 40, 41, 200)]
    for m in (marks, marks[:200]):  # hashed as they are met, and beforehand
        chosen = [s[s < len(m)] for s in sets]
        chosen = [s for s in chosen if len(s)]
        found = planar.owners(np.array([len(s) for s in chosen]), np.concatenate(chosen), m)
        assert found.tolist() == [settled(s.tolist(), m) for s in chosen]


def test_a_stack_of_boxes_is_one_sweep():
    marks = np.random.default_rng(4).integers(-(2**63), 2**63, 600)
    began = time.time()
    parts = planar.shared_out([[box(0, 0, 4, 3)]] * 300 + [[box(1, 1, 5, 4)]] * 300, marks)
    assert time.time() - began < 20  # each prefix of the stack was settled before, by all its pairs: many minutes
    for held, area in ((range(300), 6), (range(300, 600), 6), (range(600), 6)):
        keeper = settled(list(held), marks)
        assert sum(planar.signed_area([r]) for r in parts[keeper]) >= area - 1e-9
    assert sum(planar.signed_area(p) for p in parts) == 18


def test_stacks_are_not_quartered(spark):
    """Quarters hold no fewer of equal outlines: 200 of them went down to the last level, along all of their edge."""
    boxes = spark.range(200).select(F.col("id").alias("zone"), *[F.lit(v).alias(c) for v, c in ((0.5, "zx0"), (0.5, "zy0"), (4.5, "zx1"), (3.5, "zy1"))])
    rows = spatial.resolve_overlaps(boxes, 5.0).collect()
    assert len(rows) == 1 and tuple(rows[0])[1:] == (0.5, 0.5, 4.5, 3.5)
