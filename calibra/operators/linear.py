"""Linear family (OLS, Ridge, Lasso, ElasticNet) on sufficient statistics.

Spark does all data-proportional work: one aggregate per group (fold, held-out
group, or the whole training set) computes n, the means, the population
covariance matrix of the features and their covariance with the label
(``covar_pop`` is a numerically stable merge of moments). Each group's statistics
are one row of size O(p^2), so the per-group solve is a tiny NumPy step run inside
``applyInPandas`` on an executor; nothing goes through the driver.

Semantics follow the study's estimators on features standardised with the
training mean and *population* std (zero std -> 1):

* OLS:          min ||y - b - Xw||^2
* Ridge(a):     min ||y - b - Xw||^2 + a ||w||^2
* Lasso(a):     min 1/(2n) ||y - b - Xw||^2 + a ||w||_1
* ElasticNet(a, r): min 1/(2n) ||.||^2 + a r ||w||_1 + a (1 - r) / 2 ||w||^2

Coefficients are returned in raw feature units (``intercept``, ``b_<feature>``), so
prediction is one codegen'd linear expression over the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LinearSpec:
    name: str
    kind: str                 # ols | ridge | lasso | elasticnet
    alpha: float = 0.0
    l1_ratio: float = 1.0


# The study's linear estimators and their penalties.
STUDY_LINEAR = (
    LinearSpec("linear", "ols"),
    LinearSpec("ridge", "ridge", alpha=1.0),
    LinearSpec("lasso", "lasso", alpha=0.1),
    LinearSpec("elasticnet", "elasticnet", alpha=0.1, l1_ratio=0.5),
)


def _cov_name(i: int, j: int) -> str:
    return f"c_{i}_{j}"


def gram_stats(df: DataFrame, features: list[str], label: str = "y", by: list[str] = (),
               center: DataFrame | None = None) -> DataFrame:
    """n, means, covariance matrix (upper triangle) and feature-label covariances per group.

    Columns are shifted by a pilot centre (overall means: a one-row aggregate, broadcast)
    and reduced with plain sums of products — one buffer per statistic, so the aggregate
    stays in generated code; covariances are formed from the centred sums afterwards,
    which keeps them free of cancellation."""
    if not by and len(features) >= WIDE:
        return _wide_stats(df, [*features, label], center)
    g, center = _centred_sums(df, features, label, by, center)
    return _moments(g.crossJoin(center), len(features), by)


def leave_out_stats(df: DataFrame, features: list[str], by: str, label: str = "y") -> DataFrame:
    """``gram_stats`` of all rows *outside* each group, keyed by the group: total minus group on the centred
    sums, so the rows are read once and never copied."""
    g, center = _centred_sums(df, features, label, [by], None)
    sums = [c for c in g.columns if c != by]
    total = g.agg(*[F.sum(c).alias(f"_t{c}") for c in sums])
    rest = g.crossJoin(F.broadcast(total)).select(by, *[(F.col(f"_t{c}") - F.col(c)).alias(c) for c in sums])
    return _moments(rest.filter("n > 0").crossJoin(center), len(features), [by])


def _centred_sums(df, features, label, by, center):
    """Per group: n, sums and sums of products of the columns shifted by the pilot centre; and the centre."""
    cols = [*features, label]
    if center is None:
        center = df.agg(*[F.avg(c).alias(f"_p{i}") for i, c in enumerate(cols)])
    center = F.broadcast(center)
    x = df.crossJoin(center).select(
        *by, *[(F.col(c) - F.col(f"_p{i}")).alias(f"_z{i}") for i, c in enumerate(cols)])
    z = [F.col(f"_z{i}") for i in range(len(cols))]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(z[i]).alias(f"_s{i}") for i in range(len(cols))]
    aggs += [F.sum(z[i] * z[j]).alias(f"_S{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return x.groupBy(*by).agg(*aggs), center


#: Features from which products are summed as matrices: one aggregate a pair is too much code to compile.
WIDE = 8


def _wide_stats(df: DataFrame, cols: list[str], center: DataFrame | None) -> DataFrame:
    """The statistics of one group of many columns: every task adds up matrix products of its batches, one task their sums."""
    if center is None:
        center = df.agg(*[F.avg(c).alias(f"_p{i}") for i, c in enumerate(cols)])
    k = len(cols) - 1
    x = df.crossJoin(F.broadcast(center)).select(*[(F.col(c) - F.col(f"_p{i}")).alias(f"_z{i}") for i, c in enumerate(cols)])
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    names = ["mu_y", "var_y", *(f"mu_{i}" for i in range(k)), *(f"cy_{i}" for i in range(k)), *(_cov_name(i, j) for i, j in upper)]

    def add(batches):
        n, s, S = 0, np.zeros(k + 1), np.zeros((k + 1, k + 1))
        for b in batches:
            z = np.empty((b.num_rows, k + 1))
            for i in range(k + 1):
                c = b.column(i)
                z[:, i] = (c.fill_null(0.0) if c.null_count else c).to_numpy(zero_copy_only=False)  # as a SQL sum
            n, s, S = n + len(z), s + z.sum(0), S + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([S.ravel().tolist()])], names=["n", "sums", "products"])

    def finish(batches):
        n, s, S, pilot = 0, np.zeros(k + 1), np.zeros((k + 1, k + 1)), np.zeros(k + 1)
        for b in batches:
            for r in b.to_pylist():
                n, s, S = n + r["n"], s + np.array(r["sums"]), S + np.array(r["products"]).reshape(k + 1, k + 1)
                pilot = np.array([r[f"_p{i}"] for i in range(k + 1)], float)
        if not n:
            v = [None] * len(names)
        else:
            m = s / n
            C = S / n - np.outer(m, m)
            mu = pilot + m
            v = [mu[k], C[k, k], *mu[:k], *C[:k, k], *(C[i, j] for i, j in upper)]
        yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([c], pa.float64()) for c in v)], names=["n", *names])

    parts = x.mapInArrow(add, "n long, sums array<double>, products array<double>")
    return parts.crossJoin(F.broadcast(center)).repartition(1).mapInArrow(finish, ", ".join(["n long", *(f"{c} double" for c in names)]))


def _moments(g: DataFrame, k: int, by: list[str]) -> DataFrame:
    n = F.col("n")
    m = [F.col(f"_s{i}") / n for i in range(k + 1)]

    def cov(i, j):
        return F.col(f"_S{i}_{j}") / n - m[i] * m[j]

    out = [*[F.col(b) for b in by], n, (F.col(f"_p{k}") + m[k]).alias("mu_y"), cov(k, k).alias("var_y")]
    for i in range(k):
        out += [(F.col(f"_p{i}") + m[i]).alias(f"mu_{i}"), cov(i, k).alias(f"cy_{i}")]
        out += [cov(i, j).alias(_cov_name(i, j)) for j in range(i, k)]
    return g.select(*out)


def _kkt_polish(G: np.ndarray, c: np.ndarray, l1: float, l2: float, w: np.ndarray) -> np.ndarray | None:
    """Exact solution on the support of ``w``: (G_AA + l2 I) w_A = c_A - l1 sign(w_A); accepted
    only if the signs hold and every inactive coordinate satisfies |c_j - G_jA w_A| <= l1."""
    act = np.nonzero(w)[0]
    out = np.zeros_like(w)
    if len(act):
        sgn = np.sign(w[act])
        try:
            wa = np.linalg.solve(G[np.ix_(act, act)] + l2 * np.eye(len(act)), c[act] - l1 * sgn)
        except np.linalg.LinAlgError:
            return None
        if np.any(np.sign(wa) != sgn):
            return None
        out[act] = wa
    grad = c - G @ out
    ina = np.setdiff1d(np.arange(len(w)), act)
    if len(ina) and np.any(np.abs(grad[ina]) > l1 * (1 + 1e-9) + 1e-12):
        return None
    return out


def coordinate_descent(G: np.ndarray, c: np.ndarray, l1: float, l2: float, tol: float = 1e-9,
                       max_iter: int = 200000, start: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """min 1/2 w'Gw - c'w + l1 |w|_1 + l2/2 |w|^2 (G = X'X/n of standardised features), and whether the solution met
    the optimality conditions before the iterations ran out.

    Cyclic coordinate descent until the support settles, then an exact active-set solve
    (checked against the optimality conditions); CD continues if the check fails. ``start`` is a neighbouring
    problem's solution: where its support and signs hold, the exact solve on them is the answer at once."""
    p = len(c)
    if start is not None:
        pw = _kkt_polish(G, c, l1, l2, start)
        if pw is not None:
            return pw, True
    w = np.zeros(p)
    diag = np.diag(G) + l2
    it, check_every = 0, 50
    while it < max_iter:
        delta = 0.0
        for j in range(p):
            r = c[j] - G[j] @ w + G[j, j] * w[j]
            new = (np.sign(r) * max(abs(r) - l1, 0.0)) / diag[j] if diag[j] > 0 else 0.0
            delta = max(delta, abs(new - w[j]))
            w[j] = new
        it += 1
        if delta < tol or it % check_every == 0:
            pw = _kkt_polish(G, c, l1, l2, w)
            if pw is not None:
                return pw, True
            if delta < tol * 1e-3:
                break
    return w, False


def solve_moments(n: float, mu: np.ndarray, C: np.ndarray, cy: np.ndarray, mu_y: float,
                  spec: LinearSpec, start: np.ndarray | None = None) -> tuple[float, np.ndarray, bool, np.ndarray]:
    """Solve from training moments: feature means ``mu``, population covariance ``C``, feature-label covariance
    ``cy`` and label mean. Returns raw-unit intercept and coefficients, whether the solver converged, and the
    standardised coefficients (a start for the next problem)."""
    p = len(mu)
    sd = np.sqrt(np.clip(np.diag(C), 0, None))
    sd[sd == 0] = 1.0
    G = C / np.outer(sd, sd)           # covariance of standardised features
    c = cy / sd                         # covariance of standardised features with y
    done = True
    if spec.kind == "ols":
        w = np.linalg.lstsq(G, c, rcond=None)[0]
    elif spec.kind == "ridge":
        w = np.linalg.solve(n * G + spec.alpha * np.eye(p), n * c)
    elif spec.kind == "lasso":
        w, done = coordinate_descent(G, c, spec.alpha, 0.0, start=start)
    elif spec.kind == "elasticnet":
        w, done = coordinate_descent(G, c, spec.alpha * spec.l1_ratio, spec.alpha * (1 - spec.l1_ratio), start=start)
    else:
        raise ValueError(spec.kind)
    beta = w / sd
    return float(mu_y - beta @ mu), beta, done, w


def fit_linear(stats: DataFrame, features: list[str], specs=STUDY_LINEAR, by: list[str] = ()) -> DataFrame:
    """Solve every spec for every group of ``gram_stats`` (one row each; rows are dealt over the cores, and each solve
    starts from its neighbour's solution).

    Output: by..., model, intercept, b_<feature>..., converged (false: the iterations ran out first)."""
    p = len(features)
    key_fields = [f for f in stats.schema.fields if f.name in by]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields]
                       + ["model string", "intercept double"] + [f"`b_{f}` double" for f in features] + ["converged boolean"])
    specs, by = tuple(specs), list(by)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    numbers = ["n", "mu_y", *(f"mu_{i}" for i in range(p)), *(f"cy_{i}" for i in range(p)),
               *(_cov_name(i, j) for i, j in upper)]
    rows, cols = (np.array(x, int) for x in zip(*upper))

    def solve(batches):
        start: dict[str, np.ndarray] = {}
        for pdf in batches:
            out = []
            keys = zip(*(pdf[k] for k in by)) if by else iter(lambda: (), None)
            for key, v in zip(keys, pdf[numbers].to_numpy(float)):
                C = np.empty((p, p))
                C[rows, cols] = C[cols, rows] = v[2 + 2 * p:]
                for spec in specs:
                    if not np.isfinite(v).all():  # no training rows
                        out.append([*key, spec.name, None, *[None] * p, False])
                        continue
                    b0, beta, done, start[spec.name] = solve_moments(
                        v[0], v[2:2 + p], C, v[2 + p:2 + 2 * p], v[1], spec, start.get(spec.name))
                    out.append([*key, spec.name, b0, *beta, done])
            yield pd.DataFrame(out, columns=[*by, "model", "intercept", *(f"b_{f}" for f in features), "converged"])

    if by:
        stats = stats.repartition(stats.sparkSession.sparkContext.defaultParallelism, *by)
    return stats.select(*by, *numbers).mapInPandas(solve, schema)


def linear_prediction(features: list[str]) -> Column:
    e = F.col("intercept")
    for f in features:
        e = e + F.col(f"b_{f}") * F.col(f)
    return e


def predict(df: DataFrame, coefs: DataFrame, features: list[str], on: list[str] = (), ids: list[str] = (),
            label: str = "y") -> DataFrame:
    """Long (ids..., model, y, pred). The coefficient table has (groups x models) rows — bounded
    by the number of folds and specs, so it is broadcast."""
    cf = F.broadcast(coefs)
    j = df.join(cf, list(on)) if on else df.crossJoin(cf)
    return j.select(*ids, "model", label, linear_prediction(features).alias("pred"))
