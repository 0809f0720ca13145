"""Slack is spent on shared signatures, then on crowded ones, and tables of groups keep what may be linked."""

from __future__ import annotations

import numpy as np

from terrane.llm import jaccard as J

KIND = "signature long, class long, slack int, root long, band int, n long"


def test_slack_of_a_set_is_what_agreements_leave():
    scheme = J.Scheme(80, 100)
    bounds = scheme.bounds()
    for size in (9, 40, 90, 300, 2000):
        for band in scheme.bands(size, bounds):
            k = min(scheme.differences(band, bounds), size // 4)
            assert scheme.slack(size, band, bounds) == 2 * scheme.parts(band, bounds) - k - 1 >= 0
    values, slack = J.signatures(np.random.default_rng(1).integers(1, 2**63, 90, dtype=np.uint64), scheme, bounds)
    assert len(values) == len(slack)


def test_classes_that_share_no_more_than_their_slack_leave(spark):
    # By class: slack, shared signatures.
    cases = {1: (0, 1), 2: (1, 1), 3: (2, 2), 4: (2, 3), 5: (-1, 1)}
    rows = [(s, c, slack, c, 9, 2) for c, (slack, shared) in cases.items() for s in range(shared)]
    got = J.staying(spark.createDataFrame(rows, KIND)).collect()
    assert sorted({r["class"] for r in got}) == [1, 4, 5]


def test_crowded_signatures_are_left_for_slack_only(spark):
    cases = {1: (0, 1), 2: (1, 1), 3: (2, 2), 4: (2, 3), 5: (-1, 1)}
    rows = [(s, c, slack, c, 9, J.CROWDED + 1) for c, (slack, crowded) in cases.items() for s in range(crowded)]
    rows += [(100, c, slack, c, 9, 2) for c, (slack, _) in cases.items()]
    got = J.uncrowded(spark.createDataFrame(rows, KIND)).collect()
    assert {c: sum(r["class"] == c and r.n > J.CROWDED for r in got) for c in cases} == {1: 1, 2: 0, 3: 0, 4: 3, 5: 1}
    assert sum(r.n == 2 for r in got) == len(cases)


def test_groups_of_one_component_go(spark):
    rows = [(1, 10, 0, 5, 9, 0), (1, 11, 0, 5, 9, 0), (2, 10, 0, 5, 9, 0), (2, 12, 0, 6, 9, 0), (3, 12, 0, 6, 9, 0)]
    got = J.several(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r.signature, r["class"], r.n) for r in got) == [(2, 10, 2), (2, 12, 2)]
