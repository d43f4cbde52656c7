"""Gram-route solvers against brute-force NumPy on raw rows."""

import numpy as np
import pytest

from calibra.operators import linear as L


def _data(seed=3, n=400, p=5):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p)) * rng.uniform(0.5, 20, size=p) + rng.uniform(-5, 50, size=p)
    X[:, 1] = X[:, 0] * 0.8 + rng.normal(size=n)           # collinearity
    y = X @ rng.normal(size=p) + rng.normal(scale=3, size=n) + 7
    return X, y


def _standardise(X):
    mu, sd = X.mean(0), X.std(0)
    sd[sd == 0] = 1
    return (X - mu) / sd, mu, sd


def _ista(Z, yc, l1, l2, iters=200000):
    n = len(yc)
    lip = np.linalg.eigvalsh(Z.T @ Z / n).max() + l2
    w = np.zeros(Z.shape[1])
    for _ in range(iters):
        g = -(Z.T @ (yc - Z @ w)) / n + l2 * w
        v = w - g / lip
        nw = np.sign(v) * np.maximum(np.abs(v) - l1 / lip, 0)
        if np.max(np.abs(nw - w)) < 1e-14:
            return nw
        w = nw
    return w


@pytest.mark.parametrize("spec", list(L.STUDY_LINEAR) + [L.LinearSpec("ridge10", "ridge", alpha=10.0)])
def test_solver_matches_brute_force(spark, spec):
    X, y = _data()
    names = [f"x{i}" for i in range(X.shape[1])]
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(X, y)],
                               ", ".join(f"{n} double" for n in names) + ", y double")
    coefs = L.fit_linear(L.gram_stats(df, names), names, (spec,)).first()
    Z, mu, sd = _standardise(X)
    yc = y - y.mean()
    n = len(y)
    if spec.kind == "ols":
        w = np.linalg.lstsq(Z, yc, rcond=None)[0]
    elif spec.kind == "ridge":
        w = np.linalg.solve(Z.T @ Z + spec.alpha * np.eye(Z.shape[1]), Z.T @ yc)
    elif spec.kind == "lasso":
        w = _ista(Z, yc, spec.alpha, 0.0)
    else:
        w = _ista(Z, yc, spec.alpha * spec.l1_ratio, spec.alpha * (1 - spec.l1_ratio))
    beta = w / sd
    b0 = y.mean() - beta @ mu
    got = np.array([coefs[f"b_{nm}"] for nm in names])
    assert np.allclose(got, beta, rtol=1e-6, atol=1e-8), (got, beta)
    assert abs(coefs.intercept - b0) < 1e-6 * max(1, abs(b0))
    assert n == 400
