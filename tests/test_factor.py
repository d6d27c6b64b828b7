"""Factor analysis of blocks: properties of a maximum, and recovery of a known model."""
from __future__ import annotations

import numpy as np
import pytest

from clipgraph.operators import factor


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(4)
    n, blocks = 4000, [5, 4, 3]
    s = rng.normal(size=(n, 2))
    x = s @ rng.normal(size=(2, 12)) + rng.normal(size=(n, 12)) * rng.uniform(0.4, 0.8, 12)
    for lo, d in ((0, 5), (5, 4), (9, 3)):
        x[:, lo:lo + d] += rng.normal(size=(n, 1)) @ rng.normal(size=(1, d))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "clip_id long, f array<double>").repartition(4)
    return df, x, factor.fit(df, "f", blocks, 2, [1, 1, 1], max_iters=150, tol=1e-7)


def test_likelihood_rises_and_fits(fitted):
    _, x, model = fitted
    assert (np.diff(model.likelihood) > -1e-9).all()
    s = np.cov(x.T, bias=True)
    sigma = model.covariance()
    direct = -0.5 * (12 * np.log(2 * np.pi) + np.linalg.slogdet(sigma)[1] + np.trace(np.linalg.solve(sigma, s)))
    assert direct >= model.likelihood[-1] - 1e-9
    # at a maximum the implied variances are the observed ones
    assert np.abs(np.diag(sigma) - np.diag(s)).max() < 0.02 * np.diag(s).max()
    assert np.abs(sigma - s).max() < 0.1 * np.abs(s).max()


def test_scores_are_conditional_means(fitted):
    df, x, model = fitted
    some = [0, 1, 2, 5, 6, 9]
    cov, xc = model.covariance(), x - x.mean(0)
    for seen in (list(range(12)), some):
        want = xc[:, seen] @ np.linalg.solve(cov[np.ix_(seen, seen)], model.shared[seen])
        got = {r["clip_id"]: r["z"] for r in factor.scores(df, "f", model, seen).collect()}
        assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-8)
