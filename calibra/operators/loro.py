"""Leave-one-group-out linear models on the rescaled ``optimized10`` features, exactly, in
O(rows) work for any number of groups.

Held-out group g trains on every other row with rescale parameters theta_g = (a2, c2, a3, c3)
fitted without g. Nine of the ten features are affine in theta_g over a fixed base vector
b = (ref, s2, s3, s2 ref, s3 ref, ref^2, sqrt|ref|, s3/(ref+eps), 1/(ref+eps)), so
x = A(theta_g) b + d(theta_g), and the training moments of x follow from per-group moments
of b (one aggregation) as "total minus group".

The tenth feature, the row median of (ref, s2_r, s3_r), switches between three affine
branches. For a row whose branch is the same for every theta inside the bounding box of all
theta_g (checked by interval arithmetic: the three value intervals are pairwise disjoint) the
median is affine too, through branch-gated base columns (ref*[ref], s2*[s2], [s2], s3*[s3], [s3]).

The other rows meet a cell index over the groups' parameters: ``CELLS`` x ``CELLS`` cells, cut at equal shares of
the two scales. A row whose branch is fixed over a cell's box adds its base vector to that cell's moments; only rows
unstable within a cell are joined, by the cell's number, to the groups of that cell and expanded exactly. Both parts
leave the held-out group's own rows out again, as "cell minus group" and by the join.

The combined moments of all groups are solved where they lie (one row a group, each solve starting from its
neighbour's solution); coefficients come back as a table with one row per (group, model).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as FT
from ..functions.scalar import RATIO_EPS
from ..sources.observations import spark_parallelism
from ..sources.staging import staged
from . import linear as L
from .joins import attach
from .rescale import leave_out_params

FEATS = ["ref", "s2_r", "s3_r", "mean_r", "median_r", "s2_r_x_ref", "s3_r_x_ref", "ref_sq", "sqrt_ref",
         "s3_r_div_ref"]          # optimized10, in its order
BASE = ["ref", "s2", "s3", "s2ref", "s3ref", "refsq", "sqrtref", "s3div", "invref",
        "eref", "e2", "o2", "e3", "o3", "y"]
NB = len(BASE) - 1          # base columns mapped to features (y excluded)
CELLS = 8                   # cuts of each scale's range: CELLS * CELLS cells at most
THETA = ["a2", "c2", "a3", "c3"]


def _base_cols(branch):
    r, a, b = F.col("ref"), F.col("s2"), F.col("s3")
    den = r + F.lit(RATIO_EPS)
    k = F.col(branch)
    one = F.lit(1.0)
    return {
        "ref": r, "s2": a, "s3": b, "s2ref": a * r, "s3ref": b * r, "refsq": r * r,
        "sqrtref": F.sqrt(F.abs(r)), "s3div": F.try_divide(b, den), "invref": F.try_divide(one, den),
        "eref": F.when(k == 0, r).otherwise(0.0), "e2": F.when(k == 1, a).otherwise(0.0),
        "o2": F.when(k == 1, one).otherwise(0.0), "e3": F.when(k == 2, b).otherwise(0.0),
        "o3": F.when(k == 2, one).otherwise(0.0), "y": F.col("y"),
    }


def design(theta) -> tuple[np.ndarray, np.ndarray]:
    """A (10 x 14) and d (10) with x = A b + d for parameters (a2, c2, a3, c3)."""
    a2, c2, a3, c3 = theta
    A = np.zeros((10, NB))
    d = np.zeros(10)
    i = {n: j for j, n in enumerate(BASE)}
    A[0, i["ref"]] = 1
    A[1, i["s2"]] = a2; d[1] = c2
    A[2, i["s3"]] = a3; d[2] = c3
    A[3, i["ref"]] = 1 / 3; A[3, i["s2"]] = a2 / 3; A[3, i["s3"]] = a3 / 3; d[3] = (c2 + c3) / 3
    A[4, i["eref"]] = 1; A[4, i["e2"]] = a2; A[4, i["o2"]] = c2; A[4, i["e3"]] = a3; A[4, i["o3"]] = c3
    A[5, i["s2ref"]] = a2 / 100; A[5, i["ref"]] = c2 / 100
    A[6, i["s3ref"]] = a3 / 100; A[6, i["ref"]] += c3 / 100
    A[7, i["refsq"]] = 1
    A[8, i["sqrtref"]] = 1
    A[9, i["s3div"]] = a3; A[9, i["invref"]] = c3
    return A, d


def _branch(df: DataFrame) -> DataFrame:
    """Add the median's branch at any theta of the row's box (0 ref, 1 s2_r, 2 s3_r) and whether it is fixed
    over the whole box (the three value intervals are pairwise disjoint); the box columns go."""
    s2, s3, r = F.col("s2"), F.col("s3"), F.col("ref")
    lo2 = F.least(F.col("a2_lo") * s2, F.col("a2_hi") * s2) + F.col("c2_lo")
    hi2 = F.greatest(F.col("a2_lo") * s2, F.col("a2_hi") * s2) + F.col("c2_hi")
    lo3 = F.least(F.col("a3_lo") * s3, F.col("a3_hi") * s3) + F.col("c3_lo")
    hi3 = F.greatest(F.col("a3_lo") * s3, F.col("a3_hi") * s3) + F.col("c3_hi")
    apart = ((hi2 < r) | (lo2 > r)) & ((hi3 < r) | (lo3 > r)) & ((hi2 < lo3) | (hi3 < lo2))
    m2, m3 = (lo2 + hi2) / 2, (lo3 + hi3) / 2            # any point of the box orders stable rows alike
    med = F.greatest(F.least(r, m2), F.least(F.greatest(r, m2), m3))
    branch = F.when(med == r, 0).when(med == m2, 1).otherwise(2)
    return df.withColumns({"_branch": branch, "_stable": F.coalesce(apart, F.lit(False))}).drop(
        *[f"{c}_{e}" for c in THETA for e in ("lo", "hi")])


def _boxes(th: DataFrame, by: list[str]) -> DataFrame:
    return th.groupBy(*by).agg(*[f(c).alias(f"{c}_{e}") for c in THETA for f, e in ((F.min, "lo"), (F.max, "hi"))])


def _cells(th: DataFrame) -> DataFrame:
    """Each group's cell, from equal shares of the groups along both scales."""
    share = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    cuts = th.agg(F.percentile_approx("a2", share, 1000).alias("_q2"), F.percentile_approx("a3", share, 1000).alias("_q3"))

    def place(q, c):
        return F.size(F.filter(q, lambda v: v < F.col(c)))

    return th.crossJoin(F.broadcast(cuts)).withColumn("cell", place("_q2", "a2") * CELLS + place("_q3", "a3")).drop("_q2", "_q3")


_PAIRS = [(i, j) for i in range(len(BASE)) for j in range(i, len(BASE))]
_SUMS = ["sn", *(f"s_{i}" for i in range(len(BASE))), *(f"S_{i}_{j}" for i, j in _PAIRS)]


def _base_sums(rows: DataFrame, by: list[str], centre: DataFrame) -> DataFrame:
    """Count, sums and sums of products of the centred base vector, per ``by``."""
    base = _base_cols("_branch")
    # SQL strings: one call to the JVM each, where column objects would take several for every operator
    z = rows.select(*by, *[base[n].alias(n) for n in BASE]).crossJoin(F.broadcast(centre)).selectExpr(
        *by, *(f"{n} - c_{i} as z{i}" for i, n in enumerate(BASE)))
    return z.groupBy(*by).agg(F.expr("count(1) as sn"), *(F.expr(f"sum(z{i}) as s_{i}") for i in range(len(BASE))),
                              *(F.expr(f"sum(z{i} * z{j}) as S_{i}_{j}") for i, j in _PAIRS))


def _prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.selectExpr(*keys, *(f"{c} as {prefix}{c}" for c in _SUMS))


def loro_linear(df: DataFrame, group: str = "site", specs=L.STUDY_LINEAR, ids: list[str] = ()):
    """Exact leave-one-group-out fits of the linear family on optimized10.

    Returns (coefficients: group, model, intercept, b_<feature>, converged; long test predictions:
    ids..., group, model, y, pred). Groups whose complement has no rescale parameters, or under two rows, have no row."""
    ids = [c for c in ids if c != group]
    x = df.select(F.col(group).alias("_own"), "ref", "s2", "s3", "y", *ids)
    # rows lie by group: a task holds few groups, so its partial sums (over a hundred a group) stay fewer than its rows;
    # the hash spreads a large group over several tasks
    x = staged(x.repartitionByRange(4 * spark_parallelism(x), "_own", F.xxhash64("ref", "s2", "s3", "y")))
    params = staged(leave_out_params(x, "_own").drop("n_train"))
    th = staged(_cells(params.select(F.col("_own").alias("_g"), F.col("s2_scale").alias("a2"), F.col("s2_offset").alias("c2"),
                                     F.col("s3_scale").alias("a3"), F.col("s3_offset").alias("c3"))))
    rows = staged(_branch(x.drop(*ids).crossJoin(F.broadcast(_boxes(th, [])))))
    fixed = rows.filter("_stable")
    base = _base_cols("_branch")
    centre = staged(rows.agg(*[F.coalesce(F.avg(base[n]), F.lit(0.0)).alias(f"c_{i}") for i, n in enumerate(BASE)]))

    own = staged(_base_sums(fixed, ["_own"], centre))
    total = own.agg(*(F.expr(f"coalesce(sum({c}), 0) as t{c}") for c in _SUMS))
    # rows near a tie, once per cell (at most CELLS * CELLS boxes, a bound by parameter)
    near = rows.filter("not _stable").drop("_branch", "_stable").crossJoin(F.broadcast(_boxes(th, ["cell"])))
    near = staged(_branch(near))
    cell_own = staged(_base_sums(near.filter("_stable"), ["cell", "_own"], centre))
    cell_total = cell_own.groupBy("cell").agg(*(F.expr(f"sum({c}) as {c}") for c in _SUMS))
    ux = near.filter("not _stable").select("cell", "_own", "ref", "s2", "s3", "y").join(th, "cell").filter(
        ~F.col("_own").eqNullSafe(F.col("_g")))
    ux = FT.project(ux.withColumnsRenamed({"a2": "s2_scale", "c2": "s2_offset", "a3": "s3_scale", "c3": "s3_offset"}),
                    FT.optimized10(), keep=["_g", "y"])
    uaggs = ["count(1) as un", "sum(y) as uy", "sum(y * y) as uyy", *(f"sum({f}) as ux_{i}" for i, f in enumerate(FEATS)),
             *(f"sum({f} * y) as uxy_{i}" for i, f in enumerate(FEATS)),
             *(f"sum({a} * {b}) as uxx_{i}_{j}" for i, a in enumerate(FEATS) for j, b in enumerate(FEATS) if j >= i)]
    ug = ux.groupBy("_g").agg(*map(F.expr, uaggs))

    # all training moments of group g: total - own + cell - (cell, own); missing parts are zero
    z = th.crossJoin(F.broadcast(total))
    for part, prefix, on in ((own, "o", ["_own"]), (cell_total, "k", ["cell"]), (cell_own, "q", ["cell", "_own"]),):
        z = _left(z.withColumn("_own", F.col("_g")), _prefixed(part, prefix, on), on)
    z = z.selectExpr("_g", *THETA, *(
        f"cast(t{c} - coalesce(o{c}, 0) + coalesce(k{c}, 0) - coalesce(q{c}, 0) as double) as {c}" for c in _SUMS))
    z = _left(z, ug, ["_g"]).na.fill(0.0, [c for c in ug.columns if c not in ("_g", "un")]).na.fill(0, ["un"])
    gtype = df.schema[group].dataType.simpleString()
    coefs = staged(_solve_groups(z.crossJoin(F.broadcast(centre)), gtype, specs).withColumnRenamed("_g", group))

    # parameters and models of a group are one row, so the rows meet them in one join, before they are widened to features
    models = coefs.groupBy(group).agg(F.collect_list(F.struct("model", "intercept", *(f"b_{f}" for f in FEATS))).alias("_models"))
    fitted = params.join(models.withColumnRenamed(group, "_g"), F.expr("_own <=> _g")).drop("_g")
    fitted = staged(fitted)
    te = FT.project(attach(x, fitted, "_own"), FT.optimized10(), keep=["_own", "y", *ids, "_models"])
    preds = te.withColumn("_m", F.explode("_models")).select(*(c for c in te.columns if c != "_models"), "_m.*").withColumnRenamed(
        "_own", group).select(*ids, group, "model", "y", L.linear_prediction(FEATS).alias("pred"))
    return coefs, preds


def _left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join, null equal to null."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    return left.join(r, [F.expr(f"{k} <=> _r_{k}") for k in on], "left").drop(*[f"_r_{k}" for k in on])


def _solve_groups(stats: DataFrame, gtype: str, specs) -> DataFrame:
    nb, p = len(BASE), len(FEATS)
    schema = ", ".join([f"`_g` {gtype}", "model string", "intercept double"] + [f"`b_{f}` double" for f in FEATS]
                       + ["converged boolean"])
    specs = tuple(specs)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    numbers = [*THETA, *(f"c_{i}" for i in range(nb)), *_SUMS, "un", "uy", "uyy", *(f"ux_{i}" for i in range(p)),
               *(f"uxy_{i}" for i in range(p)), *(f"uxx_{i}_{j}" for i, j in upper)]
    sizes = [4, nb, 1, nb, len(_PAIRS), 1, 1, 1, p, p, len(upper)]
    ends = np.cumsum(sizes)

    def square(v, size, pairs):
        M = np.empty((size, size))
        a, b = (np.array(t) for t in zip(*pairs))
        M[a, b] = M[b, a] = v
        return M

    def solve(batches):
        start: dict[str, np.ndarray] = {}
        for pdf in batches:
            out = []
            for key, v in zip(pdf["_g"], pdf[numbers].to_numpy(float)):
                theta, c, n_s, s, S, n_u, uy, uyy, ux, uxy, uxx = (
                    v[e - k:e] for e, k in zip(ends, sizes))
                n_s, n_u, uy, uyy = n_s[0], n_u[0], uy[0], uyy[0]
                n = n_s + n_u
                if np.isnan(theta).any() or n < 2:
                    continue
                A, d = design(theta)
                S = square(S, nb, _PAIRS)
                m = A @ c[:NB] + d                      # feature centre
                cy = c[NB]
                sx = A @ s[:NB]
                Sxx = A @ S[:NB, :NB] @ A.T
                sxy = A @ S[:NB, NB]
                sy = s[NB]
                # unstable rows, raw sums -> the same centre
                if n_u > 0:
                    sx = sx + ux - n_u * m
                    Sxx = Sxx + square(uxx, p, upper) - np.outer(m, ux) - np.outer(ux, m) + n_u * np.outer(m, m)
                    sxy = sxy + uxy - cy * ux - m * uy + n_u * m * cy
                    sy = sy + uy - n_u * cy
                dx, dy = sx / n, sy / n
                C = Sxx / n - np.outer(dx, dx)
                cxy = sxy / n - dx * dy
                for spec in specs:
                    b0, beta, done, start[spec.name] = L.solve_moments(n, m + dx, C, cxy, cy + dy, spec, start.get(spec.name))
                    out.append([key, spec.name, b0, *beta, done])
            yield pd.DataFrame(out, columns=["_g", "model", "intercept", *(f"b_{f}" for f in FEATS), "converged"])

    return stats.select("_g", *numbers).repartition(stats.sparkSession.sparkContext.defaultParallelism, "_g").mapInPandas(
        solve, schema)
