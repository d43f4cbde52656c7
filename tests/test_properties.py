"""Metamorphic properties on the driver tables (sf0.001)."""

import numpy as np
from pyspark.sql import functions as F

from calibra.operators import baselines as BL
from calibra.operators import classes as C
from calibra.operators import ensembles as EN
from calibra.operators import metrics as M
from calibra.operators import rescale as RS
from calibra.operators import splits as SP
from calibra.plans import evaluation as EV
from calibra.sources.observations import driver_obs

from .conftest import SF_SMALL


def _obs(spark):
    return C.complete_cases(driver_obs(spark, SF_SMALL))


def test_folds_partition_rows(spark):
    o = _obs(spark)
    f = SP.kfold(o, 5)
    assert f.count() == o.count()
    assert f.filter((F.col("fold") < 0) | (F.col("fold") > 4)).count() == 0


def test_leave_out_params_equal_direct_refit(spark):
    o = SP.kfold(_obs(spark), 5)
    lo = {r.fold: r for r in RS.leave_out_params(o, "fold").collect()}
    for g in range(5):
        d = RS.rescale_params(o.filter(F.col("fold") != g)).first()
        for c in ("s2_scale", "s2_offset", "s3_scale", "s3_offset"):
            assert abs(lo[g][c] - d[c]) < 1e-9 * max(1.0, abs(d[c]))


def test_rescaled_train_moments_match_ref(spark):
    o = _obs(spark)
    p = RS.rescale_params(o)
    r = RS.apply_params(o, p).agg(F.avg("ref"), F.stddev_samp("ref"), F.avg("s2_r"), F.stddev_samp("s2_r")).first()
    assert abs(r[0] - r[2]) < 1e-9 and abs(r[1] - r[3]) < 1e-9


def test_class_sse_sums_to_overall(spark):
    o = C.class_by_value(_obs(spark), cuts=(20.0, 40.0))
    lng = M.to_long(o, {"ref": "ref"}, ids=["cls", "y"]).withColumn("e2", (F.col("y") - F.col("pred")) ** 2)
    per = lng.groupBy("cls").agg(F.sum("e2").alias("s")).agg(F.sum("s")).first()[0]
    tot = lng.agg(F.sum("e2")).first()[0]
    assert abs(per - tot) < 1e-6 * tot


def test_metrics_invariant_to_repartitioning(spark):
    o = _obs(spark)
    lng = M.to_long(o, {"ref": "ref", "s2": "s2"}, ids=["y"])
    a = sorted(M.metric_bundle(lng, ["model"]).collect())
    b = sorted(M.metric_bundle(lng.repartition(7, "y"), ["model"]).collect())
    for x, y in zip(a, b):
        assert x.model == y.model and abs(x.rmse - y.rmse) < 1e-9 and x.n == y.n


def test_stratified_split_exact(spark):
    o = C.class_by_site_mean(_obs(spark), cuts=(28.9, 29.3)).drop("cls_ord")
    s = SP.stratified_holdout(o, "cls", "rk", 0.3)
    got = {(r.cls, r.is_test): r.n for r in s.groupBy("cls", "is_test").agg(F.count("*").alias("n")).collect()}
    tot = {r.cls: r.n for r in o.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    for c, n in tot.items():
        assert got[(c, True)] == int(np.ceil(0.3 * n))
    assert s.count() == o.count()


def test_weights_on_simplex_and_not_worse(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=500) * 10
    rows = [(float(t), float(t + rng.normal() * 2), float(t + rng.normal() * 5 + 3), float(rng.normal()))
            for t in y]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    w = EN.simplex_weights(df, ["a", "b", "c"]).first()
    ws = np.array([w.w_a, w.w_b, w.w_c])
    assert np.all(ws >= -1e-12) and abs(ws.sum() - 1) < 1e-9
    comb = EN.weighted(df, EN.simplex_weights(df, ["a", "b", "c"]), ["a", "b", "c"])
    mse = comb.agg(F.avg((F.col("y") - F.col("pred")) ** 2)).first()[0]
    best = min(df.agg(F.avg((F.col("y") - F.col(c)) ** 2)).first()[0] for c in "abc")
    assert mse <= best + 1e-9


def test_kfold_linear_each_row_predicted_once(spark):
    o = _obs(spark)
    _, preds = EV.kfold_linear(o, "optimized10", 5)
    n = o.count()
    per_model = {r.model: r.n for r in preds.groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert set(per_model) == {"linear", "ridge", "lasso", "elasticnet"}
    assert all(v == n for v in per_model.values())


def test_leave_out_bias_equals_direct(spark):
    o = _obs(spark)
    p = BL.leave_out_predictions(o, "site", ["site"], models=("ref_bias",))
    got = {r.site: r.b for r in p.groupBy("site").agg(F.avg(F.col("pred") - F.col("y")).alias("b")).collect()}
    site = next(iter(got))
    d = o.filter(F.col("site") != site).agg(F.avg(F.col("y") - F.col("ref"))).first()[0]
    own = o.filter(F.col("site") == site).agg(F.avg(F.col("ref") - F.col("y"))).first()[0]
    assert abs(got[site] - (own + d)) < 1e-9


def test_exact_quantiles_equal_percentile(spark):
    from calibra.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.integers(0, 5, 500).astype(float)])
    grp = rng.integers(0, 3, len(vals))
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(grp, vals)], "g int, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, r.q_idx): r.value for r in exact_quantiles(df, "v", probs, by=["g"]).collect()}
    ref = df.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()
    for r in ref:
        for i, want in enumerate(r.q):
            assert abs(got[(r.g, i)] - want) <= 1e-12 * max(1.0, abs(want)), (r.g, probs[i])


def test_quantile_keys_order_as_doubles(spark):
    from calibra.operators.quantiles import order_key
    rng = np.random.default_rng(9)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"),
           -float("inf"), float("nan"), 1.0, np.nextafter(1, 2), np.nextafter(1, 0), 2.0, np.nextafter(2, 0)]
    odd += [float(x) for x in np.ldexp(rng.normal(size=400), rng.integers(-1070, 1020, 400))]
    odd += [float(np.nextafter(2.0 ** e, d)) for e in range(-1000, 1000, 37) for d in (0, np.inf)]
    rows = spark.createDataFrame([(float(v),) for v in odd], "v double").withColumn("k", order_key(F.col("v"))).collect()
    rows = [(r.v, r.k) for r in rows]
    assert all(k is not None for _, k in rows)
    numbers = sorted((r for r in rows if r[0] == r[0]), key=lambda r: r[0])
    for (a, ka), (b, kb) in zip(numbers, numbers[1:]):
        assert (ka < kb) if a < b else (ka == kb)
    assert all(k > numbers[-1][1] for v, k in rows if v != v)


def test_quantiles_of_odd_values_and_no_groups(spark):
    from calibra.operators.quantiles import exact_quantiles
    df = spark.createDataFrame([(None,), (-3.5,), (-3.5,), (0.0,), (1e300,), (5e-324,), (2.0,)], "v double")
    probs = [0.0, 0.3, 0.5, 0.8, 1.0]
    got = {r.q_idx: r.value for r in exact_quantiles(df, "v", probs).collect()}
    want = df.agg(F.percentile("v", F.array(*map(F.lit, probs)))).first()[0]
    assert got == dict(enumerate(want))
    assert exact_quantiles(df.where("v > 1e301"), "v", probs).count() == 0
