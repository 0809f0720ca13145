"""Components of a table whose values lie close to each other: the rounds over the data are few."""

from __future__ import annotations

import numpy as np

from terrane.operators import sparse_components as S


def test_close_values_settle_in_few_rounds():
    rng = np.random.default_rng(0)
    table = rng.poisson(0.03, (1500, 6000)).astype(float)  # noise: no value stands out
    table -= table.mean(0)
    gram, none, asked = table @ table.T, np.zeros((1500, 0)), []

    def times(block):
        asked.append(block.shape[1])
        return gram @ block

    start = S._orthonormal(rng.normal(size=(1500, 13)), none)
    found, best = S._settled(times, start, none, 3, 13, 1e-7, 0.0, 300)
    want = np.linalg.eigvalsh(gram)[::-1][:3]
    assert np.allclose(found[:3], want, rtol=1e-9) and np.linalg.norm(gram @ best[:, :3] - best[:, :3] * want, axis=0).max() < 1e-6 * want[0]
    assert len(asked) < 50, len(asked)  # 59 when it was cut at four blocks
