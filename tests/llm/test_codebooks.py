"""Vector codes against Lloyd's rounds over all vectors, without distinct rows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrane.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, block string, position int"


def plain(rows, s):
    """rows: (vec_id, vector, label) -> sorted (vec_id, code, error, label_error, digest)."""
    kept = sorted(((i, [math.floor(s.scale * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[:2])
    if not kept:
        return []
    width = len(kept[0][1]) // s.parts
    cut = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[cut(v, p) for _, v, _ in kept[: s.entries]] for p in range(s.parts)]
    near = lambda part, book: min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(s.rounds):
        fresh = []
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for _, v, _ in kept:
                held[near(cut(v, p), book)[1]].append(cut(v, p))
            fresh.append([tuple(sum(c) // len(h) for c in zip(*h, strict=True)) if h else e for e, h in zip(book, held, strict=True)])
        books = fresh
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    found = [(i, label, [near(cut(v, p), books[p]) for p in range(s.parts)]) for i, v, label in kept]
    errors = {}
    for _, label, ds in found:
        errors[label] = errors.get(label, 0) + sum(d for d, _ in ds)
    return sorted((i, "".join(f"{k:02x}" for _, k in ds), sum(d for d, _ in ds), errors[label], digest) for i, label, ds in found)


def result(frame):
    assert frame.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(tuple(r) for r in frame.collect())


def rows_of(n, width, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    out = [(int(i), [float(x) for x in rng.normal(0, spread, width)], [None, 0, 1][i % 3]) for i in rng.permutation(n)]
    hot = out[0][1]  # a vector that a third of the rows share
    return [(i, hot if k % 3 == 0 else v, label) for k, (i, v, label) in enumerate(out)]


@pytest.mark.parametrize(("n", "width", "s"), [(150, 32, codebooks.Settings()), (40, 6, codebooks.Settings(parts=3, entries=4, rounds=3)), (20, 32, codebooks.Settings())])
def test_equals_the_plain_version(spark, n, width, s):
    rows = [*rows_of(n, width, n), (n, None, 1), (n + 1, [None, *[0.0] * (width - 1)], 1), (n + 2, [math.nan, *[0.0] * (width - 1)], 1), (n + 3, [math.inf] * width, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3, "vec_id")
    assert result(codebooks.compress_embeddings(table, s)) == plain(rows, s)


def test_repeated_rows_ties_and_one_label(spark):
    s = codebooks.Settings(parts=2, entries=3, rounds=2, scale=1.0)
    rows = [(1, [0.0, 0.0, 2.0, 2.0], 5), (1, [0.0, 0.0, 2.0, 2.0], 5), (2, [2.0, 2.0, 0.0, 0.0], 5), (3, [1.0, 1.0, 1.0, 1.0], 5), (4, [-1.5, 3.0, 1.0, 1.0], 5)]
    assert result(codebooks.compress_embeddings(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), s)) == plain(rows, s)


def test_empty_table_and_what_raises(spark):
    frame = lambda vectors: spark.createDataFrame([(i, v, 1, "x", 1) for i, v in enumerate(vectors)], SCHEMA)
    assert result(codebooks.compress_embeddings(frame([None]))) == []
    assert result(codebooks.compress_embeddings(frame([[0.0] * 32]).limit(0))) == []
    for vectors, what in (([[0.0] * 15], "multiple of 16"), ([[0.0] * 16, [0.0] * 32], "one length"), ([[1e30] * 16], "too large")):
        with pytest.raises(Exception, match=what):
            codebooks.compress_embeddings(frame(vectors).coalesce(1)).collect()
    with pytest.raises(ValueError, match="entries"):
        codebooks.Settings(entries=257)


def test_codes_stand_for_vectors_close_by(spark):
    rows = rows_of(300, 8, 1, 0.1)
    made = codebooks.Quantizer(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), codebooks.Settings(parts=4, entries=64, rounds=4))
    coded = made.encoded()
    back = {r["vec_id"]: r["vector"] for r in made.decoded(coded).collect()}
    errors = {r["vec_id"]: r["error"] for r in coded.collect()}
    for i, v, _ in rows:
        far = sum((math.floor(256 * np.float32(x)) - 256 * y) ** 2 for x, y in zip(v, back[i], strict=True))
        assert round(far) == errors[i]
    assert sum(errors.values()) < 0.3 * sum((256 * x) ** 2 for _, v, _ in rows for x in v)


@settings(deadline=None, max_examples=80)
@given(st.integers(1, 60), st.integers(1, 9), st.integers(1, 4), st.integers(0, 999))
def test_nearest_is_the_lowest_of_equals(n, k, width, seed):
    rng = np.random.default_rng(seed)
    parts, entries = rng.integers(-3, 4, (n, width)), rng.integers(-3, 4, (k, width))
    code, far = codebooks.nearest(parts, entries)
    all_ = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert code.tolist() == all_.argmin(1).tolist() and far.tolist() == all_.min(1).tolist()
