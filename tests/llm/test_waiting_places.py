"""Only places that hold pairs back have another turn; all others have given theirs."""

from __future__ import annotations

import numpy as np

from terrane.llm import jaccard


def test_places_that_gave_all_their_pairs_are_left_out(spark):
    same = jaccard.parities(np.arange(1, 41, dtype=np.uint64))
    known = spark.createDataFrame([(k, 40, bytearray(same)) for k in range(32)], "class long, n long, parities binary")
    crowd, few = range(30), (30, 31)
    groups = spark.createDataFrame([(7, k, k) for k in crowd] + [(8, k, k) for k in few], "signature long, class long, root long")
    met = jaccard.crossing(groups, known, (85, 100), 1, 0).collect()
    pairs = {(r["a"], r["b"]) for r in met if r["a"] is not None}
    waits = [r for r in met if r["a"] is None]
    assert (30, 31) in pairs and len(pairs) <= 30 + 1 and len(waits) == 1
    waiting = spark.createDataFrame(waits, "a long, b long, lead long, part int, i int, j int")
    again = {(r["a"], r["b"]) for r in jaccard.crossing(groups, known, (85, 100), None, 1, waiting).collect()}
    assert again == {(a, b) for a in crowd for b in crowd if a < b}


def test_members_are_looked_up_once_for_all_blocks(spark, monkeypatch):
    """A class of a group of many blocks met its members once for each block, before."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    same = jaccard.parities(np.arange(1, 41, dtype=np.uint64))
    known = spark.createDataFrame([(k, 40, bytearray(same)) for k in range(64)], "class long, n long, parities binary")
    groups = spark.createDataFrame([(7, k, k) for k in range(64)], "signature long, class long, root long")
    plan = jaccard.crossing(groups, known, (85, 100), None, 0)
    assert plan.filter("a < b").count() == 64 * 63 // 2
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate explode") < text.index("Join Inner, (class")  # the plan is written from its end
