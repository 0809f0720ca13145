from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrane.llm import topk


def brute(ids, vectors, queries, k):
    out = []
    for q in queries:
        own = vectors[ids.index(q)]
        ranked = sorted(((-int(own @ vectors[i]), d) for i, d in enumerate(ids) if d != q))[:k]
        out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(ranked)]
    return sorted(out)


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 400), st.integers(1, 6), st.integers(0, 99), st.integers(1, 9))
def test_index_is_exact(n, width, seed, top):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-top, top + 1, (n, width))
    ids = rng.permutation(n).astype(np.int64)
    found = topk.ImpactIndex(ids, vectors).search(ids[:7], vectors[:7], 5)
    got = sorted((q, r + 1, int(d), int(s)) for q, who, score in found for r, (d, s) in enumerate(zip(who, score, strict=True)))
    assert got == brute(ids.tolist(), vectors, ids[:7].tolist(), 5)


def test_the_search_stops_early():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 32))
    vectors = np.floor(64 * (centres[rng.integers(0, 40, 3000)] / 6 + rng.normal(size=(3000, 32)) / 60)).astype(np.int64)
    index = topk.ImpactIndex(np.arange(3000), vectors)
    taken, plain = [], index.add
    index.add = lambda scores, queries, segment: (taken.append(segment), plain(scores, queries, segment))
    got = list(index.search(np.arange(20), vectors[:20], 5))
    assert taken == list(range(len(taken))) and 0 < len(taken) < len(index.segments)
    want = brute(list(range(3000)), vectors, list(range(20)), 5)
    assert sorted((q, r + 1, int(d), int(s)) for q, who, score in got for r, (d, s) in enumerate(zip(who, score, strict=True))) == want


def test_postings_hold_every_value_once_by_descending_impact():
    vectors = np.random.default_rng(3).integers(-40, 41, (50, 7))
    index = topk.ImpactIndex(np.arange(50), vectors)
    found, least = np.zeros_like(vectors), np.inf
    for rows, values, cuts in index.segments:
        assert np.abs(values).max() < 2 * np.abs(values).min() and np.abs(values).max() < least
        least = np.abs(values).min()
        for d in range(7):
            found[rows[cuts[d] : cuts[d + 1]], d] += values[cuts[d] : cuts[d + 1]]
    assert np.array_equal(found, vectors)


@pytest.mark.parametrize("deviation", [5e3, 5e5, 4e6])
def test_long_sums_of_large_values_are_exact(spark, deviation):
    """Sums of 64 products beyond 2**53: a double would be off."""
    vectors = np.random.default_rng(9).normal(scale=deviation, size=(60, 64))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search_embeddings(frame, every=20, k=5).collect())
    whole = [[int(np.floor(64 * x)) for x in v] for v in vectors]
    want = []
    for q in (0, 20, 40):
        ranked = sorted((-sum(a * b for a, b in zip(whole[q], whole[d], strict=True)), d) for d in range(60) if d != q)[:5]
        want += [(q, r + 1, d, -s) for r, (s, d) in enumerate(ranked)]
    assert got == sorted(want)


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(150, 8)) * 20) / 64
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.search_embeddings(frame, every=10, k=4).collect())
    assert got == brute(list(range(150)), np.floor(64 * vectors), list(range(0, 150, 10)), 4)


def test_rows_that_take_no_part(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (20, [0.25]), (1, [1.0, 0.5]), (40, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search_embeddings(frame).collect())
    assert got == [(0, 1, 1, 64 * 64 + 32 * 32), (0, 2, 20, 64 * 16), (0, 3, 40, 0), (20, 1, 0, 16 * 64), (20, 2, 1, 16 * 64), (20, 3, 40, 0), (40, 1, 0, 0), (40, 2, 1, 0), (40, 3, 20, 0)]
    assert topk.search_embeddings(frame.filter("false")).collect() == []
    assert topk.search_embeddings(frame.filter("vec_id = 0")).collect() == []


@pytest.mark.parametrize("size", [1e7, 1e12])
def test_large_values_stay_exact(spark, size):
    rows = [(0, [size, 1.0]), (1, [1.0, 3.0]), (2, [1.0, 2.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 2).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, int(64 * size) * 64 + 64 * 192), (2, int(64 * size) * 64 + 64 * 128)]
