"""Missing values keep their rows and do not distort numbers; nothing stays cached; filters reach the scan."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from calibra.operators import diagnostics as D
from calibra.operators import linear as L
from calibra.operators import metrics as M
from calibra.operators import quantiles as Q
from calibra.operators import splits as SP
from calibra.plans.catalog import snap

from .conftest import SF_SMALL


def test_metrics_count_complete_pairs_only(spark):
    rows = [(float(i), float(i) + (0.5 if i % 3 else -0.25)) for i in range(60)]
    whole = spark.createDataFrame(rows, "y double, pred double")
    holes = whole.unionByName(spark.createDataFrame([(900.0 + i, None) for i in range(60)], "y double, pred double"))
    assert M.metric_bundle(holes, []).first() == M.metric_bundle(whole, []).first()


def test_null_stratum_is_split_like_any_other(spark):
    d = spark.range(3000).select((F.col("id") * 7919 % 1000003).alias("rk"), F.col("id").alias("i"),
                                 F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("cls"))
    got = {r.cls: (r.n, r.t) for r in SP.stratified_holdout(d).groupBy("cls").agg(
        F.count("i").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert got == {None: (1000, 300), "c1": (1000, 300), "c2": (1000, 300)}


def test_quantiles_keep_the_null_group(spark):
    d = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.lit("a")).alias("g"), (F.col("id") * 37 % 1009).cast("double").alias("v"))
    d = d.unionByName(spark.createDataFrame([("tiny", 1.0), ("tiny", 4.0)], "g string, v double"))
    got = {(r.g, r.q_idx): r.value for r in Q.exact_quantiles(d, "v", [0.25, 0.5], ["g"]).collect()}
    want = {}
    for r in d.groupBy("g").agg(F.percentile("v", F.array(F.lit(.25), F.lit(.5))).alias("q")).collect():
        want |= {(r.g, i): x for i, x in enumerate(r.q)}
    assert got == pytest.approx(want) and (None, 0) in got


def test_box_stats_of_a_null_group(spark):
    d = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("a", 1.0)], "g string, v double")
    assert {r.g: r.n for r in D.box_stats(d, "v", ["g"]).collect()} == {None: 9, "a": 1}


def test_snap_leaves_large_and_special_values(spark):
    values = [1e13, -1e13, math.inf, -math.inf, 0.1234567, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(snap(F.col("v")).alias("v")).collect()
    assert [r.v for r in rows] == [1e13, -1e13, math.inf, -math.inf, 0.123457, None]
    assert math.isnan(spark.range(1).select(snap(F.lit(float("nan")))).first()[0])


def test_leave_out_stats_equal_the_complement(spark):
    d = spark.range(400).select((F.col("id") % 5).alias("g"), F.sin("id").alias("a"), F.cos("id").alias("b"),
                                (F.col("id") % 17).cast("double").alias("y"))
    out = {r.g: r for r in L.leave_out_stats(d, ["a", "b"], "g").collect()}
    for g in range(5):
        (want,) = L.gram_stats(d.where(F.col("g") != g), ["a", "b"]).collect()
        for k, v in want.asDict().items():
            assert out[g][k] == pytest.approx(v, abs=1e-10), (g, k)


def test_registered_queries_cache_nothing_and_push_filters(spark):
    for name in ("complete_cases", "metrics_by_class", "loro_params"):
        df = E.queries()[name](spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" not in plan and "PushedFilters" in plan
    scan = E.queries()["complete_cases"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull" in scan and "l_comment" not in scan
