"""Components of sparse tables against numpy's decomposition of the dense, centred table."""

from __future__ import annotations

import numpy as np
import pytest

from terrane.operators import sparse_components as S


def wide(cells, species, seed, filled=0.1, rank=3):
    rng = np.random.default_rng(seed)
    level = rng.gamma(1.0, 2.0, (cells, rank)) @ rng.gamma(1.0, 2.0, (rank, species))
    return np.round(level * (rng.random((cells, species)) < filled), 3)


def frame(spark, table):
    cells, kinds = np.nonzero(table)
    rows = [(f"c{c:04d}", int(k) * 3 + 1, float(table[c, k])) for c, k in zip(cells, kinds, strict=True)]
    return spark.createDataFrame([*rows, (None, 1, 5.0), ("c0000", None, 5.0)], "cell string, species_id int, n_obs double").repartition(3)


def plain(table, k):
    centred = table - table.mean(0)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    return u[:, :k] * s[:k], (s**2 / (s**2).sum())[:k], v[:k].T


@pytest.mark.parametrize(("cells", "species", "k"), [(60, 300, 4), (40, 12, 3), (25, 900, 6)])
def test_equals_the_dense_decomposition(spark, monkeypatch, cells, species, k):
    monkeypatch.setattr(S, "SLOTS", 64)
    table = wide(cells, species, cells)
    table = table[table.any(1)][:, table.any(0)]
    rows = frame(spark, table)
    scores, shares, loadings = S.sparse_components(rows, components=k)
    want, want_shares, want_loadings = plain(table, k)
    got = np.array([r[1:] for r in scores.orderBy("cell").collect()])
    own = np.array([r[1:] for r in loadings.orderBy("species_id").collect()])
    assert np.allclose(shares, want_shares, atol=1e-9)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4 * np.abs(want).max())
    assert np.allclose(np.abs(own), np.abs(want_loadings), atol=1e-4)
    assert (own[np.abs(own).argmax(0), np.arange(k)] > 0).all() and np.allclose(got.mean(0), 0, atol=1e-8)


def test_number_of_components_by_variance(spark):
    table = wide(30, 200, 9)
    table = table[:, table.any(0)]
    _, shares, _ = plain(table, 30)
    scores, got, _ = S.sparse_components(frame(spark, table), variance=0.5)
    k = int(np.flatnonzero(np.cumsum(shares) >= 0.5)[0]) + 1
    assert len(got) == k and scores.columns == ["cell", *[f"PC{i + 1}" for i in range(k)]]


def test_twenty_thousand_species_without_a_dense_row(spark):
    rng = np.random.default_rng(2)
    rows = [(c, int(s), float(1 + (c % 4) * (s % 4 == c % 4))) for c in range(120) for s in rng.choice(20_000, 300, replace=False)]
    rows += [(120, s, 0.0) for s in range(20_000)]  # a cell that names every species, with nothing seen
    facts = spark.createDataFrame(rows, "cell int, species_id int, n_obs double")
    table = S.sparse_table(facts)
    assert table.width == 20_000 and table.cells == 121
    assert table.rows.selectExpr("max(size(slots))").first()[0] == 300
    scores, shares, _ = S.sparse_components(facts, components=3)
    got = {r["cell"]: r[1:] for r in scores.collect()}
    assert len(got) == 121 and shares == sorted(shares, reverse=True)
    groups = np.array([np.mean([got[c] for c in range(120) if c % 4 == g], 0) for g in range(4)])
    assert np.linalg.norm(groups[3] - groups[0]) > 1  # cells of one kind lie together


def test_constant_and_empty_tables(spark):
    same = spark.createDataFrame([(c, s, 2.0) for c in range(4) for s in range(3)], "cell int, species_id int, n_obs double")
    scores, shares, _ = S.sparse_components(same, components=2)
    assert shares == [0.0, 0.0] and all(abs(v) < 1e-9 for r in scores.collect() for v in r[1:])
    with pytest.raises(ValueError, match="no cell"):
        S.sparse_components(same.limit(0))


def test_the_shorter_side_is_held(spark, monkeypatch):
    """Twelve hundred species on sixty cells: no vector over the species comes to the driver."""
    lengths = []
    plain_image = S.image
    monkeypatch.setattr(S, "image", lambda table, basis, means: lengths.append(basis.shape[0]) or plain_image(table, basis, means))
    table = wide(60, 1200, 5)
    table = table[table.any(1)][:, table.any(0)]
    scores, shares, loadings = S.sparse_components(frame(spark, table), components=3)
    want, want_shares, want_loadings = plain(table, 3)
    assert set(lengths) == {len(table)}
    own = np.array([r[1:] for r in loadings.orderBy("species_id").collect()])
    signs = np.sign((own * want_loadings).sum(0))
    assert np.allclose(np.array([r[1:] for r in scores.orderBy("cell").collect()]), want * signs, atol=1e-4 * np.abs(want).max())
    assert np.allclose(shares, want_shares, atol=1e-9) and np.allclose(own, want_loadings * signs, atol=1e-4)
