"""Leave-one-site-out linear fits (total-minus-group algebra + unstable-row expansion) vs a direct
refit on every complement."""

import numpy as np

from pyspark.sql import functions as F

from calibra.functions import features as FT
from calibra.operators import classes as C
from calibra.operators import linear as L
from calibra.operators import loro as LO
from calibra.operators import rescale as RS
from calibra.sources.observations import driver_obs

from .conftest import SF_SMALL


def brute_force_loro(df, group, groups, specs=L.STUDY_LINEAR):
    """Refit directly on each complement (a scan per group)."""
    out = None
    for g in groups:
        tr = df.filter(F.col(group) != g)
        x = FT.project(tr.crossJoin(RS.rescale_params(tr)), FT.optimized10(), keep=["y"])
        c = L.fit_linear(L.gram_stats(x, LO.FEATS), LO.FEATS, specs).withColumn(group, F.lit(g))
        out = c if out is None else out.unionByName(c)
    return out


def same(coefs, want):
    fast = coefs.toPandas().sort_values(["site", "model"]).reset_index(drop=True)
    bf = want.toPandas().sort_values(["site", "model"]).reset_index(drop=True)
    sub = fast[fast.site.isin(bf.site.unique())].reset_index(drop=True)
    cols = [c for c in bf.columns if c.startswith("b_") or c == "intercept"]
    assert list(sub.model) == list(bf.model) and fast.converged.all()
    assert np.allclose(sub[cols].values, bf[cols].values, rtol=1e-6, atol=1e-8)


def test_loro_linear_equals_brute_force(spark):
    o = C.complete_cases(driver_obs(spark, SF_SMALL))
    coefs, preds = LO.loro_linear(o, "site")
    same(coefs, brute_force_loro(o, "site", sorted(r.site for r in coefs.select("site").distinct().collect())[:3]))
    assert preds.count() == o.count() * 4


def test_cells_hold_rows_near_a_tie(spark):
    """Few sites that differ much: the parameter box is wide, most rows are unstable over it, some within a cell too."""
    rng = np.random.default_rng(4)
    rows = [(int(g), *map(float, v)) for g in range(9) for v in zip(
        rng.normal(20 + g, 5, 14), rng.normal(200, 40 + 9 * g, 14), rng.normal(300, 60, 14), rng.normal(25, 6, 14))]
    o = spark.createDataFrame(rows, "site int, ref double, s2 double, s3 double, y double")
    coefs, preds = LO.loro_linear(o, "site")
    same(coefs, brute_force_loro(o, "site", [0, 4, 8]))
    assert preds.count() == len(rows) * 4


def test_plan_has_no_cartesian_product(spark):
    from calibra.plans.catalog import REGISTRY
    plan = REGISTRY["elasticnet_loro"][0](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_design_matches_projection():
    A, d = LO.design((0.5, 2.0, 0.25, -1.0))
    ref, s2, s3 = 3.0, 10.0, 40.0
    s2r, s3r = 0.5 * s2 + 2.0, 0.25 * s3 - 1.0
    med = sorted([ref, s2r, s3r])[1]
    branch = [ref, s2r, s3r].index(med)
    b = np.array([ref, s2, s3, s2 * ref, s3 * ref, ref * ref, np.sqrt(ref), s3 / (ref + 1e-5), 1 / (ref + 1e-5),
                  ref * (branch == 0), s2 * (branch == 1), float(branch == 1), s3 * (branch == 2), float(branch == 2)])
    x = A @ b + d
    want = [ref, s2r, s3r, (ref + s2r + s3r) / 3, med, s2r * ref / 100, s3r * ref / 100, ref * ref, np.sqrt(ref),
            s3r / (ref + 1e-5)]
    assert np.allclose(x, want)


def test_rows_lie_by_group(spark, monkeypatch):
    """Tasks over the staged rows share few sites, so that partial sums per site do not outnumber the rows."""
    held, tables = LO.staged, []
    monkeypatch.setattr(LO, "staged", lambda df: (tables.append(held(df)), tables[-1])[1])
    sites, each = 64, 40
    rng = np.random.default_rng(5)
    rows = [(i % sites, *map(float, rng.normal([20, 200, 300, 25], [5, 40, 60, 6]))) for i in range(sites * each)]
    o = spark.createDataFrame(rows, "site int, ref double, s2 double, s3 double, y double").repartition(16)
    LO.loro_linear(o, "site")
    places = tables[0].select("_own", F.input_file_name().alias("f")).distinct().count()
    files = tables[0].select(F.input_file_name().alias("f")).distinct().count()
    assert files > 4 and places < sites + files
