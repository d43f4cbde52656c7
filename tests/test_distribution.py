"""Kolmogorov-Smirnov, stratified folds, counted rows and report runs against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from calibra.operators import kstest as KS
from calibra.operators import splits as SP
from calibra.operators import tally as T
from calibra.plans import report as R


def plain_two(a, b):
    a, b = (sorted(x for x in v if x is not None and x == x) for v in (a, b))
    return max(abs(np.searchsorted(a, v, "right") / len(a) - np.searchsorted(b, v, "right") / len(b)) for v in a + b)


def plain_one(v):
    v = np.sort([x for x in v if x is not None and x == x])
    z = (v - v.mean()) / v.std(ddof=1)
    p = np.array([(1 + math.erf(x / math.sqrt(2))) / 2 for x in z])
    n = len(v)
    right, left = np.searchsorted(v, v, "right") / n, np.searchsorted(v, v, "left") / n
    return max(np.abs(right - p).max(), np.abs(left - p).max())


@pytest.mark.parametrize("seed,ties", [(1, False), (2, True)])
def test_ks_equals_plain(spark, seed, ties):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=700), rng.normal(0.2, 1.3, size=500)
    if ties:
        a, b = np.round(a, 1), np.round(b, 1)
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("a", None), ("b", float("nan")), (None, 99.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = KS.two_sample(df, "v", F.col("g") == "a", F.col("g") == "b").first()
    assert (got.n_first, got.n_second) == (700, 500) and got.d == pytest.approx(plain_two(a, b), abs=1e-12)
    one = KS.one_sample(df.filter("g = 'a'"), "v").first()
    assert one.n == 700 and one.d == pytest.approx(plain_one(a), abs=5e-7)
    assert 0 <= one.p_value <= 1 and got.p_value < 0.05


def test_ks_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "g string, v double")
    assert KS.two_sample(df, "v", F.col("g") == "a", F.col("g") == "b").collect() == []
    assert KS.one_sample(df.filter("g = 'b'"), "v").collect() == []
    assert KS.one_sample(df, "v", cdf=lambda v: F.lit(0.25)).first().d == pytest.approx(0.75)


@pytest.mark.parametrize("ranges", [1, 7, 4096])
def test_stratified_folds_share_every_class(spark, ranges):
    rows = [(i * 7 % 1000, None if i % 5 == 0 else "hot" if i % 3 else "rare", float(i)) for i in range(1500)] + [(3, "one", 0.0)]
    df = spark.createDataFrame(rows, "rk long, cls string, y double")
    f = SP.stratified_kfold(df, "cls", 4, ranges=ranges, space=1000)
    got = {}
    for r in f.collect():
        got.setdefault(r.cls, []).append((r.rk, r.y, r.fold))
    assert {c: len(v) for c, v in got.items()} == {c: sum(1 for r in rows if r[1] == c) for c in {r[1] for r in rows}}
    for v in got.values():
        assert [fold for *_, fold in sorted(v)] == [i % 4 for i in range(len(v))]


def test_stratified_holdout_equals_plain(spark):
    rows = [(i * 13 % 50, None if i % 4 == 0 else "ab"[i % 2], float(i % 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "rk long, cls string, y double")
    got = sorted((r.cls or "", r.rk // 7 % 10, r.rk, r.y, r.is_test) for r in SP.stratified_holdout(df, buckets=10).collect())
    for c in ("", "a", "b"):
        own = [r for r in got if r[0] == c]
        # rows that are equal throughout may change places, their number on either side may not
        assert sum(r[4] for r in own) == math.ceil(0.3 * len(own))
        cut = own[math.ceil(0.3 * len(own)) - 1][:4]
        assert all(r[4] for r in own if r[:4] < cut) and not any(r[4] for r in own if r[:4] > cut)


def test_tally_counts_on_the_way(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (float("nan"), 1.0), (2.0, None), (3.0, -5.0)], "a double, b double")
    df = df.withColumn("f", F.log1p("b"))
    t = T.Tally()
    assert t.keep(df, ["a"], ["f"]).count() == 1
    assert t.get == {"n_in": 5, "n_missing": 2, "n_dropped": 2, "n_used": 1}
    assert T.row_counts(df, ["a"], ["f"]).first().asDict() == t.get
    by = {r.g: (r.n_in, r.n_missing) for r in T.row_counts(df.withColumn("g", F.col("b") > 0), ["a"], by=["g"]).collect()}
    assert by == {True: (3, 2), None: (1, 0), False: (1, 0)}


@pytest.fixture(scope="module")
def observations(spark):
    from calibra.sources.observations import driver_obs
    from .conftest import SF_SMALL
    return driver_obs(spark, SF_SMALL).drop("rk").cache()


def test_report_run_is_committed_whole_and_repeatable(spark, observations, tmp_path, monkeypatch):
    out = str(tmp_path)
    sizes = R.run_report(observations, out, "r1")
    tables = R.read_run(spark, out, "r1")
    assert {n: t.count() for n, t in tables.items()} == sizes
    assert tables["counts"].first().n_in == observations.count()
    before = sorted(map(tuple, tables["class_counts"].collect()))
    with pytest.raises(LookupError):
        R.read_run(spark, out, "r2")

    def broken(obs, profile):
        return {"counts": T.row_counts(obs.limit(1), ["y"]), "sensor_errors": obs.select(F.raise_error(F.lit("stop")).alias("x"))}

    monkeypatch.setitem(R.EVALUATIONS, "broken", broken)
    for run in ("r1", "r2"):
        with pytest.raises(Exception, match="stop"):
            R.run_report(observations, out, run, "broken")
        with pytest.raises(LookupError):  # begun again, not committed: no longer read
            R.read_run(spark, out, run)
    assert R.run_report(observations, out, "r1") == sizes
    R.run_report(observations, out, "r2")
    again = R.read_run(spark, out, "r1")
    assert sorted(map(tuple, again["class_counts"].collect())) == before


def test_full_report_equals_the_queries(spark, observations, tmp_path):
    sizes = R.run_report(observations, str(tmp_path), "r", "full")
    t = R.read_run(spark, str(tmp_path), "r")
    assert sizes["leave_one_site_out"] == 4 and sizes["kfold"] == 4
    ranked = t["holdout"].orderBy("rank").collect()
    key = t["key_figures"].first()
    assert key.model == ranked[0].model and key.rmse == pytest.approx(min(r.rmse for r in ranked))
    assert t["normality_ks"].first().n > 0
