"""Edge rows of FIXTURES.md, written inline."""

import datetime as dt
import math

from pyspark.sql import functions as F

from calibra.functions import bands as B
from calibra.functions import scalar as X
from calibra.operators import classes as C
from calibra.operators import metrics as M
from calibra.operators import rescale as RS
from calibra.operators import timeseries as TS
from calibra.sources.observations import lenient_double, read_obs_csv

SCHEMA = "site string, obs_date date, ref double, s2 double, s3 double, y double"


def obs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_class_edges_right_closed(spark):
    df = spark.createDataFrame([(25.0,), (75.0,), (0.0,), (-1.0,), (75.01,), (None,)], "y double")
    out = C.class_by_value(df).orderBy("y").collect()
    got = {r.y: r.cls for r in out}
    assert got[25.0] == "Mesotrophic" and got[75.0] == "Eutrophic" and got[75.01] == "Hypertrophic"
    assert got[0.0] is None and got[-1.0] is None and got[None] is None


def test_site_mean_edges(spark):
    d = dt.date(2020, 6, 1)
    df = obs(spark, [("a", d, 1.0, 1.0, 1.0, 20.0), ("a", d, 1.0, 1.0, 1.0, 30.0),   # mean 25 -> low
                     ("b", d, 1.0, 1.0, 1.0, 75.0), ("c", d, 1.0, 1.0, 1.0, 80.0)])
    got = {r.site: r.cls for r in C.class_by_site_mean(df).collect()}
    assert got == {"a": "Mesotrophic", "b": "Eutrophic", "c": "Hypertrophic"}


def test_lenient_coercion(spark):
    df = spark.createDataFrame([("3,5",), ("n/a",), (" 2.0 ",), ("NaN",), (None,)], "t string")
    vals = [r.v for r in df.select(lenient_double("t").alias("v")).collect()]
    assert vals == [3.5, None, 2.0, None, None]


def test_all_zero_sensors_ratio_finite(spark):
    d = dt.date(2020, 6, 1)
    df = obs(spark, [("a", d, 0.0, 0.0, 0.0, 200.0)])
    r = df.select(X.guarded_ratio("s3", "ref").alias("q"), X.row_median3("ref", "s2", "s3").alias("m")).first()
    assert r.q == 0.0 and r.m == 0.0


def test_median_and_std_of_three(spark):
    df = spark.createDataFrame([(1.0, 5.0, 5.0), (3.0, 1.0, 2.0), (9.0, 7.0, 8.0)], "a double, b double, c double")
    rows = df.select(X.row_median3("a", "b", "c").alias("m"), X.row_std3("a", "b", "c").alias("s")).collect()
    assert [r.m for r in rows] == [5.0, 2.0, 8.0]
    assert math.isclose(rows[0].s, 2.309401076758503)


def test_single_row_site_and_constant_y_r2_null(spark):
    preds = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 3.5), ("b", 3.0, 2.0)], "site string, y double, pred double")
    got = {r.site: r for r in M.metric_bundle(preds, ["site"]).collect()}
    assert got["a"].r2 is None and got["a"].rmse == 1.0
    assert got["b"].r2 is None and got["b"].n == 2


def test_zero_sensor_variance_scale_null(spark):
    d = dt.date(2020, 6, 1)
    df = obs(spark, [("a", d, 1.0, 5.0, 1.0, 1.0), ("b", d, 2.0, 5.0, 3.0, 2.0), ("c", d, 4.0, 5.0, 2.0, 3.0)])
    p = RS.rescale_params(df).first()
    assert p.s2_scale is None and p.s3_scale is not None


def test_guarded_ape_zero_y(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "y double, pred double")
    assert df.select(X.ape("y", "pred").alias("a")).first().a == 1.0 / 1e-6


def test_month_with_one_row_std_null(spark):
    df = obs(spark, [("a", dt.date(2020, 6, 3), 1.0, 1.0, 1.0, 5.0), ("a", dt.date(2020, 11, 3), 1.0, 1.0, 1.0, 5.0),
                     ("b", dt.date(2020, 11, 9), 1.0, 1.0, 1.0, 7.0)])
    got = {r.month.month: r for r in TS.monthly_profile(df).collect()}
    assert got[6].std_y is None and got[6].n == 1 and got[11].n == 2


def test_empty_after_cleaning(spark):
    df = obs(spark, [("a", dt.date(2020, 6, 1), None, 1.0, 1.0, 5.0)])
    c = C.complete_cases(df)
    assert c.count() == 0
    lng = M.to_long(c, {"ref": "ref"}, ids=["site", "y"])
    assert M.metric_bundle(lng, ["site"]).count() == 0


def test_bands(spark):
    df = spark.createDataFrame([(29.0,), (35.0,), (39.0,), (41.0,)], "v double")
    got = [r.b for r in df.select(B.band("v", (35.0, 40.0)).alias("b")).collect()]
    assert got == ["good", "fair", "fair", "poor"]
    got = [r.b for r in df.select(B.band(F.col("v") / 50, (0.6, 0.4), higher_is_better=True).alias("b")).collect()]
    assert got == ["fair", "good", "good", "good"]


def test_read_obs_csv(spark, tmp_path):
    p = tmp_path / "obs.csv"
    p.write_bytes("fecha, Embalse ,C2RCC,C2X,C2XC,Medicion\r\n2020-06-01,Peñas,\"3,5\",10,20,4\r\n"
                  "2020-06-01,B,n/a,1,2,3\r\n".encode("latin1"))
    df = read_obs_csv(spark, str(p))
    rows = df.orderBy("site").collect()
    assert df.columns == ["obs_date", "site", "ref", "s2", "s3", "y"]
    assert rows[0].ref is None and rows[1].site == "Peñas" and rows[1].ref == 3.5
    assert rows[1].obs_date == dt.date(2020, 6, 1)
    assert C.complete_cases(df).count() == 1


def test_write_table_roundtrip(spark, tmp_path):
    from calibra.sources.sinks import write_table
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, rmse double")
    p = write_table(df, str(tmp_path / "res"), fmt="csv", single_file=True)
    back = spark.read.option("header", True).csv(p)
    assert sorted(r.model for r in back.collect()) == ["a", "b"]
