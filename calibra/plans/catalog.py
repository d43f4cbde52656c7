"""Registered queries over the driver tables, each with its DuckDB oracle.

``REGISTRY[name] = (spark_fn, oracle_sql_or_None)``. Every Spark side is built
from the library's operators; every oracle spells out the same semantics in SQL
on the raw ``lineitem``/``part`` views. Double outputs are rounded to 6 decimals
on both sides so the order-free value hash is stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators import classes as C
from ..operators import metrics as M
from ..sources.observations import driver_obs
from ..sources.staging import staged
from . import sqlparts as S
from .profile import DRIVER as P

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, S.grid_round(sql) if sql else None)
        return fn
    return deco


def snap(c, digits: int = 6):
    """Snap a double to a 10^-digits grid with floor(x * 10^d + h) / 10^d, h = 0.500314159: the same
    IEEE operations in any engine. The offset past one half moves exact decimal ties (a mean that
    is exactly x.xxxxxx5) off the rounding boundary, so summation order cannot flip them. Values of 1e9 and
    more, infinities and NaN stay as they are."""
    k = float(10 ** digits)
    return F.when(F.abs(c) < F.lit(S.SNAP_BELOW), F.floor(c * F.lit(k) + F.lit(S.SNAP_HALF)) / F.lit(k)).otherwise(c)


def rounded(df: DataFrame, digits: int = 6, per_col: dict | None = None) -> DataFrame:
    per_col = per_col or {}
    return df.select([snap(F.col(f.name), per_col.get(f.name, digits)).alias(f.name)
                      if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                      for f in df.schema.fields])


def _obs(spark, sf, with_missing=False):
    """The observation view as a lazy plan: each query's own filters and columns reach the scan, and
    nothing stays pinned on executors after it."""
    return driver_obs(spark, sf, with_missing)


def _clean(spark, sf, with_missing=False):
    return C.complete_cases(_obs(spark, sf, with_missing))


# ---------------------------------------------------------------- step 1: minimum slice

@query("metrics_by_class", S.with_(S.obs_cte(), S.CC, S.site_cls_cte()) + f"""
, lng AS (SELECT cls, y, 'ref' AS model, ref AS pred FROM clsd
          UNION ALL SELECT cls, y, 's2', s2 FROM clsd
          UNION ALL SELECT cls, y, 's3', s3 FROM clsd)
SELECT model, cls, {S.metric_cols()} FROM lng GROUP BY model, cls""")
def metrics_by_class(spark, sf):
    """Error of each sensor used as the prediction, per site-mean class."""
    o = C.class_by_site_mean(_clean(spark, sf), cuts=P.site_cuts)
    lng = M.to_long(o, {"ref": "ref", "s2": "s2", "s3": "s3"}, ids=["cls", "y"])
    return rounded(M.metric_bundle(lng, ["model", "cls"]))


# ---------------------------------------------------------------- step 2: scalar, filter, class, band

from ..functions import bands as B  # noqa: E402
from ..functions import features as FT  # noqa: E402
from ..functions import scalar as X  # noqa: E402
from ..sources.observations import lenient_double  # noqa: E402


@query("scan_obs", S.with_(S.obs_cte()) + """
SELECT site, obs_date, round(ref, 6) AS ref, round(s2, 6) AS s2, round(s3, 6) AS s3, round(y, 6) AS y, rk FROM obs""")
def scan_obs(spark, sf):
    return rounded(_obs(spark, sf))


_TXT_SQL = """CASE WHEN rk % 7 = 0 THEN 'n/a'
       WHEN rk % 7 = 1 THEN replace(CAST({c} AS VARCHAR), '.', ',')
       WHEN rk % 7 = 2 THEN ' ' || CAST({c} AS VARCHAR) || ' '
       ELSE CAST({c} AS VARCHAR) END"""


def _as_text(c):
    s = F.col(c).cast("string")
    k = F.pmod(F.col("rk"), F.lit(7))
    return (F.when(k == 0, F.lit("n/a")).when(k == 1, F.regexp_replace(s, r"\.", ","))
             .when(k == 2, F.concat(F.lit(" "), s, F.lit(" "))).otherwise(s))


@query("coerce_numeric", S.with_(S.obs_cte()) + f"""
, txt AS (SELECT rk, {_TXT_SQL.format(c='ref')} AS t_ref, {_TXT_SQL.format(c='s3')} AS t_s3 FROM obs)
SELECT rk, round(TRY_CAST(replace(trim(t_ref), ',', '.') AS DOUBLE), 6) AS ref,
       round(TRY_CAST(replace(trim(t_s3), ',', '.') AS DOUBLE), 6) AS s3 FROM txt""")
def coerce_numeric(spark, sf):
    """Text columns with decimal commas, padding and junk coerced back to DOUBLE (junk -> NULL)."""
    t = _obs(spark, sf).select("rk", _as_text("ref").alias("t_ref"), _as_text("s3").alias("t_s3"))
    return rounded(t.select("rk", lenient_double("t_ref").alias("ref"), lenient_double("t_s3").alias("s3")))


@query("complete_cases", S.with_(S.obs_cte(with_missing=True), S.CC) + """
SELECT site, CAST(count(*) AS BIGINT) AS n FROM cc GROUP BY site""")
def complete_cases(spark, sf):
    return _clean(spark, sf, with_missing=True).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query("class_by_value", S.with_(S.obs_cte(), S.CC) + f"""
, c AS (SELECT *, {S.class_case('y', P.value_cuts)} AS cls FROM cc)
SELECT cls, {S.ord_case('cls')} AS cls_ord, CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS mean_y
FROM c GROUP BY cls""")
def class_by_value(spark, sf):
    c = C.class_by_value(_clean(spark, sf), cuts=P.value_cuts)
    return rounded(c.groupBy("cls", "cls_ord").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


@query("class_by_site_mean", S.with_(S.obs_cte(), S.CC, S.site_cls_cte()) + f"""
SELECT site, cls, {S.ord_case('cls')} AS cls_ord, CAST(count(*) AS BIGINT) AS n FROM clsd GROUP BY site, cls""")
def class_by_site_mean(spark, sf):
    c = C.class_by_site_mean(_clean(spark, sf), cuts=P.site_cuts)
    return c.groupBy("site", "cls", "cls_ord").agg(F.count(F.lit(1)).alias("n"))


@query("agree_flag", S.with_(S.obs_cte(), S.CC) + f"""
SELECT CAST(ref < {P.flag_cuts[0]} AND s2 < {P.flag_cuts[1]} AND s3 < {P.flag_cuts[2]} AS INTEGER) AS all_agree,
       CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS mean_y FROM cc GROUP BY 1""")
def agree_flag(spark, sf):
    f = C.with_agree_flag(_clean(spark, sf), P.flag_cuts)
    return rounded(f.groupBy("all_agree").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


@query("zone_counts", S.with_(S.obs_cte(), S.CC) + f"""
SELECT CASE WHEN s2 < {P.zone_cuts[0]} AND s3 < {P.zone_cuts[1]} THEN 'reliable' ELSE 'extreme' END AS zone,
       CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS mean_y, round(avg(y - ref), 6) AS bias FROM cc GROUP BY 1""")
def zone_counts(spark, sf):
    z = C.with_zone(_clean(spark, sf), P.zone_cuts)
    return rounded(z.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"),
                                         F.avg(F.col("y") - F.col("ref")).alias("bias")))


def _ln1p(c):
    return f"ln(1 + {c})"


def _ratio(a, b):
    return f"{a} / ({b} + 1e-5)"


_MEAN3 = "((ref + s2 + s3) / 3)"
_STD3 = f"sqrt(((ref - {_MEAN3}) * (ref - {_MEAN3}) + (s2 - {_MEAN3}) * (s2 - {_MEAN3}) + (s3 - {_MEAN3}) * (s3 - {_MEAN3})) / 2)"
_MED3 = "greatest(least(ref, s2), least(greatest(ref, s2), s3))"


def _sel(items):
    return ",\n  ".join(f"round({e}, 6) AS {n}" for n, e in items)


@query("scalar_features", S.with_(S.obs_cte(), S.CC) + "SELECT rk, " + _sel([
    ("log_s2", _ln1p("s2")), ("log_s3", _ln1p("s3")), ("sqrt_ref", "sqrt(abs(ref))"),
    ("s2_div_ref", _ratio("s2", "ref")), ("ref_sq", "ref * ref"), ("ref_x_log_s2", f"ref * {_ln1p('s2')}"),
    ("s2_x_ref", "s2 * ref / 1000"), ("mean3", _MEAN3), ("std3", _STD3), ("median3", _MED3)]) + " FROM cc")
def scalar_features(spark, sf):
    r, a, b = F.col("ref"), F.col("s2"), F.col("s3")
    return rounded(_clean(spark, sf).select(
        "rk", X.log1p(a).alias("log_s2"), X.log1p(b).alias("log_s3"), X.sqrt_abs(r).alias("sqrt_ref"),
        X.guarded_ratio(a, r).alias("s2_div_ref"), X.square(r).alias("ref_sq"), (r * X.log1p(a)).alias("ref_x_log_s2"),
        (a * r / 1000).alias("s2_x_ref"), X.row_mean3(r, a, b).alias("mean3"), X.row_std3(r, a, b).alias("std3"),
        X.row_median3(r, a, b).alias("median3")))


_EXT16 = [("ref", "ref"), ("s2", "s2"), ("s3", "s3"), ("log_s2", _ln1p("s2")), ("log_s3", _ln1p("s3")),
          ("sqrt_ref", "sqrt(abs(ref))"), ("s2_div_ref", _ratio("s2", "ref")), ("s3_div_ref", _ratio("s3", "ref")),
          ("s3_div_s2", _ratio("s3", "s2")), ("ref_x_log_s2", f"ref * {_ln1p('s2')}"),
          ("ref_x_log_s3", f"ref * {_ln1p('s3')}"), ("ref_sq", "ref * ref"),
          ("mean3", _MEAN3), ("std3", _STD3), ("median3", _MED3)]
_FLAG = f"CAST(ref < {P.flag_cuts[0]} AND s2 < {P.flag_cuts[1]} AND s3 < {P.flag_cuts[2]} AS INTEGER) AS all_agree"


@query("features_ext16", S.with_(S.obs_cte(), S.CC) + f"SELECT rk, {_FLAG}, " + _sel(_EXT16) + " FROM cc")
def features_ext16(spark, sf):
    return rounded(FT.project(_clean(spark, sf), FT.ext16(P.flag_cuts), keep=["rk"]))


@query("features_orig16", S.with_(S.obs_cte(), S.CC) + "SELECT rk, " + _sel(
    [e for e in _EXT16 if e[0] not in ("ref_x_log_s3",)] + [("s2_x_ref", "s2 * ref / 1000"), ("s3_x_ref", "s3 * ref / 1000")])
    + " FROM cc")
def features_orig16(spark, sf):
    return rounded(FT.project(_clean(spark, sf), FT.orig16(), keep=["rk"]))


@query("features_figure10", S.with_(S.obs_cte(), S.CC) + "SELECT rk, " + _sel(
    [("ref", "ref"), ("s2", "s2"), ("s3", "s3"), ("log_s2", _ln1p("s2")), ("log_s3", _ln1p("s3")),
     ("s2_div_ref", _ratio("s2", "ref")), ("s3_div_ref", _ratio("s3", "ref")), ("s2_x_ref", "s2 * ref"),
     ("s3_x_ref", "s3 * ref"), ("ref_sq", "ref * ref")]) + " FROM cc")
def features_figure10(spark, sf):
    return rounded(FT.project(_clean(spark, sf), FT.figure10(), keep=["rk"]))


@query("ape_guarded", S.with_(S.obs_cte(), S.CC) + """
SELECT site, round(avg(abs(y - ref) / greatest(y, 1e-6)) * 100, 6) AS mape,
       round(max(abs(y - ref) / greatest(y, 1e-6)) * 100, 6) AS max_ape FROM cc GROUP BY site""")
def ape_guarded(spark, sf):
    a = X.ape("y", "ref")
    return rounded(_clean(spark, sf).groupBy("site").agg((F.avg(a) * 100).alias("mape"),
                                                         (F.max(a) * 100).alias("max_ape")))


@query("residuals", S.with_(S.obs_cte(), S.CC) + """
SELECT rk, round(y - ref, 6) AS residual, round(abs(y - ref), 6) AS abs_residual, round(ref - y, 6) AS error FROM cc""")
def residuals(spark, sf):
    return rounded(_clean(spark, sf).select(
        "rk", X.residual("y", "ref").alias("residual"), F.abs(X.residual("y", "ref")).alias("abs_residual"),
        (F.col("ref") - F.col("y")).alias("error")))


@query("month_labels", S.with_(S.obs_cte(), S.CC) + """
SELECT CAST(date_trunc('month', obs_date) AS DATE) AS month, strftime(CAST(date_trunc('month', obs_date) AS DATE), '%Y-%m') AS label,
       CAST(count(*) AS BIGINT) AS n FROM cc GROUP BY 1, 2""")
def month_labels(spark, sf):
    m = _clean(spark, sf).withColumn("month", X.month_key("obs_date"))
    return m.groupBy("month").agg(F.count(F.lit(1)).alias("n")).withColumn("label", X.month_label("month"))


_SITE_METRICS = """, st AS (SELECT site, sqrt(avg((y - ref) * (y - ref))) AS rmse,
  CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - sum((y - ref) * (y - ref)) / (var_pop(y) * count(*)) END AS r2
  FROM cc GROUP BY site)"""


def _site_metrics(spark, sf):
    lng = M.to_long(_clean(spark, sf), {"ref": "ref"}, ids=["site", "y"])
    return M.metric_bundle(lng, ["site"])


@query("rmse_bands", S.with_(S.obs_cte(), S.CC) + _SITE_METRICS + f"""
SELECT CASE WHEN rmse < {P.rmse_cuts[0]} THEN 'good' WHEN rmse < {P.rmse_cuts[1]} THEN 'fair' ELSE 'poor' END AS band,
       CAST(count(*) AS BIGINT) AS n_sites, round(avg(rmse), 6) AS mean_rmse FROM st GROUP BY 1""")
def rmse_bands(spark, sf):
    b = _site_metrics(spark, sf).withColumn("band", B.band("rmse", P.rmse_cuts))
    return rounded(b.groupBy("band").agg(F.count(F.lit(1)).alias("n_sites"), F.avg("rmse").alias("mean_rmse")))


@query("r2_bands", S.with_(S.obs_cte(), S.CC) + _SITE_METRICS + f"""
SELECT CASE WHEN r2 IS NULL THEN NULL WHEN r2 > {P.r2_cuts[0]} THEN 'good' WHEN r2 > {P.r2_cuts[1]} THEN 'fair' ELSE 'poor' END AS band,
       CAST(count(*) AS BIGINT) AS n_sites, round(avg(r2), 6) AS mean_r2 FROM st GROUP BY 1""")
def r2_bands(spark, sf):
    b = _site_metrics(spark, sf).withColumn("band", B.band("r2", P.r2_cuts, higher_is_better=True))
    return rounded(b.groupBy("band").agg(F.count(F.lit(1)).alias("n_sites"), F.avg("r2").alias("mean_r2")))


# ---------------------------------------------------------------- step 3: rescale, rescaled features, scaler

from ..operators import rescale as RS  # noqa: E402
from ..operators import scaling as SC  # noqa: E402
from ..operators import splits as SP  # noqa: E402

_PARAMS_SQL = """pr AS (SELECT stddev_samp(ref) / stddev_samp(s2) AS s2_scale,
    avg(ref) - avg(s2) * (stddev_samp(ref) / stddev_samp(s2)) AS s2_offset,
    stddev_samp(ref) / stddev_samp(s3) AS s3_scale,
    avg(ref) - avg(s3) * (stddev_samp(ref) / stddev_samp(s3)) AS s3_offset
  FROM sp WHERE NOT is_test),
rsc AS (SELECT sp.*, s2 * s2_scale + s2_offset AS s2_r, s3 * s3_scale + s3_offset AS s3_r FROM sp CROSS JOIN pr)"""


def _split(spark, sf):
    return SP.holdout(_clean(spark, sf), "rk", P.test_frac)


def _train_params(sp):
    return RS.rescale_params(sp.filter(~F.col("is_test")))


@query("rescale_params", S.with_(S.obs_cte(), S.CC, S.SPLIT, _PARAMS_SQL) + """
SELECT round(s2_scale, 6) AS s2_scale, round(s2_offset, 6) AS s2_offset,
       round(s3_scale, 6) AS s3_scale, round(s3_offset, 6) AS s3_offset FROM pr""")
def rescale_params(spark, sf):
    """Moment-matching parameters of s2 and s3 onto ref, fitted on the training split only."""
    return rounded(_train_params(_split(spark, sf)))


@query("rescale_apply", S.with_(S.obs_cte(), S.CC, S.SPLIT, _PARAMS_SQL) + """
SELECT rk, is_test, round(s2_r, 6) AS s2_r, round(s3_r, 6) AS s3_r FROM rsc""")
def rescale_apply(spark, sf):
    sp = _split(spark, sf)
    return rounded(RS.apply_params(sp, _train_params(sp)).select("rk", "is_test", "s2_r", "s3_r"))


_MR = "((ref + s2_r + s3_r) / 3)"
_SDR = f"sqrt(((ref - {_MR}) * (ref - {_MR}) + (s2_r - {_MR}) * (s2_r - {_MR}) + (s3_r - {_MR}) * (s3_r - {_MR})) / 2)"
_MEDR = "greatest(least(ref, s2_r), least(greatest(ref, s2_r), s3_r))"
RESCALED_SQL = {
    "rescaled8": [("ref", "ref"), ("s2_r", "s2_r"), ("s3_r", "s3_r"), ("mean_r", _MR), ("std_r", _SDR),
                  ("s2_r_x_ref", "s2_r * ref / 100"), ("s3_r_x_ref", "s3_r * ref / 100"), ("ref_sq", "ref * ref")],
    "rescaled16": [("ref", "ref"), ("s2_r", "s2_r"), ("s3_r", "s3_r"), ("log_s2_r", _ln1p("s2_r")),
                   ("log_s3_r", _ln1p("s3_r")), ("sqrt_ref", "sqrt(abs(ref))"), ("s2_r_div_ref", _ratio("s2_r", "ref")),
                   ("s3_r_div_ref", _ratio("s3_r", "ref")), ("s3_r_div_s2_r", _ratio("s3_r", "s2_r")),
                   ("s2_r_x_ref", "s2_r * ref / 100"), ("s3_r_x_ref", "s3_r * ref / 100"), ("ref_sq", "ref * ref"),
                   ("ref_x_log_s2_r", f"ref * {_ln1p('s2_r')}"), ("mean_r", _MR), ("std_r", _SDR), ("median_r", _MEDR)],
    "optimized10": [("ref", "ref"), ("s2_r", "s2_r"), ("s3_r", "s3_r"), ("mean_r", _MR), ("median_r", _MEDR),
                    ("s2_r_x_ref", "s2_r * ref / 100"), ("s3_r_x_ref", "s3_r * ref / 100"), ("ref_sq", "ref * ref"),
                    ("sqrt_ref", "sqrt(abs(ref))"), ("s3_r_div_ref", _ratio("s3_r", "ref"))],
}


def _rescaled_features(spark, sf, name):
    sp = _split(spark, sf)
    j = RS.apply_params(sp, _train_params(sp), keep_params=True)
    return FT.project(j, FT.feature_set(name), keep=["rk", "is_test"])


def _feat_query(name):
    @query(f"features_{name}", S.with_(S.obs_cte(), S.CC, S.SPLIT, _PARAMS_SQL)
           + "SELECT rk, is_test, " + _sel(RESCALED_SQL[name]) + " FROM rsc")
    def fn(spark, sf):
        return rounded(_rescaled_features(spark, sf, name))
    fn.__name__ = f"features_{name}"
    return fn


for _n in ("rescaled8", "rescaled16", "optimized10"):
    _feat_query(_n)


_OPT = RESCALED_SQL["optimized10"]


@query("standardize", S.with_(S.obs_cte(), S.CC, S.SPLIT, _PARAMS_SQL) + ", ft AS (SELECT rk, is_test, "
       + ", ".join(f"{e} AS {n}" for n, e in _OPT) + " FROM rsc),\nst AS (SELECT "
       + ", ".join(f"avg({n}) AS mu_{n}, CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END AS sd_{n}"
                   for n, _ in _OPT) + " FROM ft WHERE NOT is_test)\nSELECT rk, is_test, "
       + ", ".join(f"round(({n} - mu_{n}) / sd_{n}, 6) AS {n}" for n, _ in _OPT) + " FROM ft CROSS JOIN st")
def standardize(spark, sf):
    """optimized10 features z-scored with training mean and population std, applied to both sides."""
    f = _rescaled_features(spark, sf, "optimized10")
    cols = FT.names("optimized10")
    st = SC.fit_scaler(f.filter(~F.col("is_test")), cols)
    return rounded(SC.apply_scaler(f, st, cols))


# ---------------------------------------------------------------- step 4: splits, folds, leave-out

@query("split_holdout", S.with_(S.obs_cte(), S.CC, S.SPLIT) + """
SELECT is_test, CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS mean_y FROM sp GROUP BY is_test""")
def split_holdout(spark, sf):
    return rounded(_split(spark, sf).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


@query("split_stratified", S.with_(S.obs_cte(), S.CC, S.site_cls_cte()) + f"""
, rn AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY ((rk // 7) % 1000), rk, site, obs_date, ref, s2, s3, y) AS r,
               count(*) OVER (PARTITION BY cls) AS nc FROM clsd)
SELECT cls, r <= ceil(nc * {P.test_frac}) AS is_test, CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS mean_y
FROM rn GROUP BY 1, 2""")
def split_stratified(spark, sf):
    """Exact 70/30 split within every site-mean class (no global window)."""
    s = _stratified(spark, sf)
    return rounded(s.groupBy("cls", "is_test").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


_FOLD = f"""fo AS (SELECT *, rk % {P.k} AS fold FROM cc)"""


@query("kfold_sizes", S.with_(S.obs_cte(), S.CC, _FOLD) + """
SELECT fold, CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS mean_y FROM fo GROUP BY fold""")
def kfold_sizes(spark, sf):
    f = SP.kfold(_clean(spark, sf), P.k)
    return rounded(f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


def _naive_leave_out(group: str, src: str) -> str:
    """Oracle: refit directly on every complement (group x rows join)."""
    return f"""ks AS (SELECT DISTINCT {group} AS g FROM {src}),
lo AS (SELECT ks.g AS {group}, CAST(count(*) AS BIGINT) AS n_train,
    stddev_samp(o.ref) / stddev_samp(o.s2) AS s2_scale,
    avg(o.ref) - avg(o.s2) * (stddev_samp(o.ref) / stddev_samp(o.s2)) AS s2_offset,
    stddev_samp(o.ref) / stddev_samp(o.s3) AS s3_scale,
    avg(o.ref) - avg(o.s3) * (stddev_samp(o.ref) / stddev_samp(o.s3)) AS s3_offset,
    avg(o.y - o.ref) AS bias
  FROM ks JOIN {src} o ON o.{group} <> ks.g GROUP BY ks.g)"""


@query("kfold_rescale", S.with_(S.obs_cte(), S.CC, _FOLD, _naive_leave_out("fold", "fo")) + """
SELECT fo.fold, CAST(count(*) AS BIGINT) AS n_test, round(any_value(s2_scale), 6) AS s2_scale,
       round(any_value(s2_offset), 6) AS s2_offset, round(any_value(s3_scale), 6) AS s3_scale,
       round(any_value(s3_offset), 6) AS s3_offset,
       round(avg(s2 * s2_scale + s2_offset), 6) AS mean_s2_r, round(avg(s3 * s3_scale + s3_offset), 6) AS mean_s3_r
FROM fo JOIN lo USING (fold) GROUP BY fo.fold""")
def kfold_rescale(spark, sf):
    """Leak-free per-fold rescale: parameters from the other folds, applied to the fold's test rows."""
    f = SP.kfold(_clean(spark, sf), P.k)
    lp = RS.leave_out_params(f, "fold").drop("n_train")
    j = RS.apply_params(f, lp, on="fold", keep_params=True)
    return rounded(j.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_test"),
        *[F.first(c).alias(c) for c in ("s2_scale", "s2_offset", "s3_scale", "s3_offset")],
        F.avg("s2_r").alias("mean_s2_r"), F.avg("s3_r").alias("mean_s3_r")))


@query("loro_params", S.with_(S.obs_cte(), S.CC, _naive_leave_out("site", "cc")) + """
SELECT site, n_train, round(s2_scale, 6) AS s2_scale, round(s2_offset, 6) AS s2_offset,
       round(s3_scale, 6) AS s3_scale, round(s3_offset, 6) AS s3_offset FROM lo""")
def loro_params(spark, sf):
    """Rescale parameters for every held-out site from one pass of per-site moments."""
    return rounded(RS.leave_out_params(_clean(spark, sf), "site"))


_INNER = f"""inn AS (SELECT *, (rk // 500) % {P.k} AS inner_fold, y - ref AS d FROM sp WHERE NOT is_test),
ib AS (SELECT k.inner_fold, avg(o.d) AS bias FROM (SELECT DISTINCT inner_fold FROM inn) k
       JOIN inn o ON o.inner_fold <> k.inner_fold GROUP BY k.inner_fold)"""


@query("oof_coverage", S.with_(S.obs_cte(), S.CC, S.SPLIT, _INNER) + """
SELECT inner_fold, CAST(count(*) AS BIGINT) AS n, round(any_value(bias), 6) AS bias,
       round(sqrt(avg((y - (ref + bias)) * (y - (ref + bias)))), 6) AS oof_rmse
FROM inn JOIN ib USING (inner_fold) GROUP BY inner_fold""")
def oof_coverage(spark, sf):
    """Out-of-fold predictions inside the training split: every training row is predicted
    exactly once by a bias fitted on the other inner folds."""
    tr = SP.inner_folds(_split(spark, sf).filter(~F.col("is_test")), P.k)
    tr = tr.withColumn("d", F.col("y") - F.col("ref"))
    b = RS.leave_out_means(tr, "inner_fold", ["d"]).select("inner_fold", F.col("d").alias("bias"))
    p = tr.join(F.broadcast(b), "inner_fold").withColumn("pred", F.col("ref") + F.col("bias"))
    e = F.col("y") - F.col("pred")
    return rounded(p.groupBy("inner_fold").agg(F.count(F.lit(1)).alias("n"), F.first("bias").alias("bias"),
                                               F.sqrt(F.avg(e * e)).alias("oof_rmse")))


# ---------------------------------------------------------------- step 5: metrics and summaries

from ..operators import baselines as BL  # noqa: E402

_HOLD = _PARAMS_SQL + """,
tb AS (SELECT avg(y - ref) AS bias, regr_intercept(y, ref) AS b0, regr_slope(y, ref) AS b1 FROM sp WHERE NOT is_test),
te AS (SELECT rsc.*, tb.bias, tb.b0, tb.b1 FROM rsc CROSS JOIN tb WHERE is_test),
pl AS (SELECT site, rk, y, 'ref' AS model, ref AS pred FROM te
  UNION ALL SELECT site, rk, y, 's2', s2 FROM te
  UNION ALL SELECT site, rk, y, 's3', s3 FROM te
  UNION ALL SELECT site, rk, y, 'ref_bias', ref + bias FROM te
  UNION ALL SELECT site, rk, y, 'line_ref', b0 + b1 * ref FROM te
  UNION ALL SELECT site, rk, y, 's2_r', s2_r FROM te
  UNION ALL SELECT site, rk, y, 's3_r', s3_r FROM te)"""
HOLD_CTES = (S.obs_cte(), S.CC, S.SPLIT, _HOLD)


def _e2(y="y", p="pred"):
    return f"({y} - {p}) * ({y} - {p})"


_HM = f"""hm AS (SELECT model, count(*) AS n, sqrt(avg({_e2()})) AS rmse, avg(abs(y - pred)) AS mae,
   CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - sum({_e2()}) / (var_pop(y) * count(*)) END AS r2
   FROM pl GROUP BY model)"""


def _holdout_preds(spark, sf, ids=("site", "rk"), with_cls=False, models=BL.BASELINE_MODELS):
    sp = _split(spark, sf)
    if with_cls:
        sp = C.class_by_site_mean(sp, cuts=P.site_cuts)
    fit = BL.fit_closed_form(sp.filter(~F.col("is_test")))
    return BL.predictions(sp.filter(F.col("is_test")), fit, list(ids), models=models)


def _holdout_metrics(spark, sf):
    return M.metric_bundle(_holdout_preds(spark, sf), ["model"])


@query("metric_bundle", S.with_(S.obs_cte(), S.CC) + f"""
, lng AS (SELECT y, 'ref' AS model, ref AS pred FROM cc UNION ALL SELECT y, 's2', s2 FROM cc
          UNION ALL SELECT y, 's3', s3 FROM cc)
SELECT model, {S.metric_cols()} FROM lng GROUP BY model""")
def metric_bundle(spark, sf):
    """RMSE, MAE, R2, MAPE, MBE and max error of each raw sensor over all complete rows."""
    lng = M.to_long(_clean(spark, sf), {"ref": "ref", "s2": "s2", "s3": "s3"}, ids=["y"])
    return rounded(M.metric_bundle(lng, ["model"]))


@query("all_baselines", S.with_(*HOLD_CTES) + f"SELECT model, {S.metric_cols()} FROM pl GROUP BY model")
def all_baselines(spark, sf):
    """All closed-form models scored on the holdout test rows, stacked in one long table."""
    return rounded(_holdout_metrics(spark, sf))


@query("metrics_rollup", S.with_(S.obs_cte(), S.CC, S.SPLIT, _HOLD,
                                 f"sm AS (SELECT site, {S.class_case('avg(y)', P.site_cuts, False)} AS cls FROM cc GROUP BY site)")
       + f"""
, plc AS (SELECT pl.*, sm.cls FROM pl LEFT JOIN sm USING (site))
SELECT model, CASE WHEN GROUPING(cls) = 1 THEN 'ALL' ELSE cls END AS cls, {S.metric_cols()}
FROM plc GROUP BY GROUPING SETS ((model), (model, cls))""")
def metrics_rollup(spark, sf):
    """Overall and per-class metrics of every model in one aggregation (grouping sets)."""
    p = _holdout_preds(spark, sf, ids=("site", "rk", "cls"), with_cls=True)
    return rounded(M.metrics_rollup(p, ["model"], ["cls"]))


_FO_LO = (_FOLD, _naive_leave_out("fold", "fo"))
_CVP = f"""cvp AS (SELECT fold, y, 'ref' AS model, ref AS pred FROM fo
  UNION ALL SELECT fold, y, 'ref_bias', ref + bias FROM fo JOIN lo USING (fold)
  UNION ALL SELECT fold, y, 's2_r', s2 * s2_scale + s2_offset FROM fo JOIN lo USING (fold)
  UNION ALL SELECT fold, y, 's3_r', s3 * s3_scale + s3_offset FROM fo JOIN lo USING (fold)),
cvm AS (SELECT model, fold, sqrt(avg({_e2()})) AS rmse, avg(abs(y - pred)) AS mae,
  CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - sum({_e2()}) / (var_pop(y) * count(*)) END AS r2
  FROM cvp GROUP BY model, fold),
cvs AS (SELECT model, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std, avg(mae) AS mae_mean,
  stddev_pop(mae) AS mae_std, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std FROM cvm GROUP BY model)"""


def _cv_summary(spark, sf):
    f = SP.kfold(_clean(spark, sf), P.k)
    per_fold = M.metric_bundle(BL.leave_out_predictions(f, "fold", ["fold"]), ["model", "fold"])
    return M.summarize_folds(per_fold, ["model"])


@query("cv_summary", S.with_(S.obs_cte(), S.CC, *_FO_LO, _CVP) + """
SELECT model, round(rmse_mean, 6) AS rmse_mean, round(rmse_std, 6) AS rmse_std, round(mae_mean, 6) AS mae_mean,
       round(mae_std, 6) AS mae_std, round(r2_mean, 6) AS r2_mean, round(r2_std, 6) AS r2_std FROM cvs""")
def cv_summary(spark, sf):
    """K-fold: every fold's models fitted on the other folds; mean and population std over folds."""
    return rounded(_cv_summary(spark, sf))


_LORO = f"""lp AS (SELECT site, y, ref + bias AS pred FROM cc JOIN lo USING (site)),
lm AS (SELECT site, {S.metric_cols(rounded=False)} FROM lp GROUP BY site)"""


def _loro_metrics(spark, sf):
    p = BL.leave_out_predictions(_clean(spark, sf), "site", ["site"], models=("ref_bias",))
    return M.metric_bundle(p, ["site"])


@query("loro_metrics", S.with_(S.obs_cte(), S.CC, _naive_leave_out("site", "cc"), _LORO) + "SELECT site, n, "
       + ", ".join(f"round({m}, 6) AS {m}" for m in S.METRIC_NAMES[1:]) + " FROM lm")
def loro_metrics(spark, sf):
    """Leave-one-site-out: bias-corrected ref fitted without the site, scored on the site (R2 NULL for n=1)."""
    return rounded(_loro_metrics(spark, sf))


def _loro_summary_df(lm):
    from ..operators.quantiles import quantile_columns
    q = quantile_columns(lm, "rmse", [0.25, 0.5, 0.75], ["rmse_q1", "rmse_median", "rmse_q3"])
    return lm.agg(F.count(F.lit(1)).alias("n_sites"), F.avg("rmse").alias("rmse_mean"),
                  F.stddev_pop("rmse").alias("rmse_std"), F.min("rmse").alias("rmse_min"),
                  F.max("rmse").alias("rmse_max"), F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"),
                  F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std")).crossJoin(q)


@query("loro_summary", S.with_(S.obs_cte(), S.CC, _naive_leave_out("site", "cc"), _LORO) + """
SELECT CAST(count(*) AS BIGINT) AS n_sites, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std,
  round(min(rmse), 6) AS rmse_min, round(max(rmse), 6) AS rmse_max, round(avg(mae), 6) AS mae_mean,
  round(stddev_pop(mae), 6) AS mae_std, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std,
  round(quantile_cont(rmse, 0.25), 5) AS rmse_q1, round(quantile_cont(rmse, 0.5), 5) AS rmse_median,
  round(quantile_cont(rmse, 0.75), 5) AS rmse_q3 FROM lm""")
def loro_summary(spark, sf):
    """Distribution of per-site held-out errors (NULL R2 skipped, exact quartiles).
    Quartiles interpolate between two sites and are compared on a 1e-5 grid."""
    d = _loro_summary_df(_loro_metrics(spark, sf))
    q = ["rmse_q1", "rmse_median", "rmse_q3"]
    return rounded(d, per_col={c: 5 for c in q})


@query("size_error_corr", S.with_(S.obs_cte(), S.CC, _naive_leave_out("site", "cc"), _LORO) + """
SELECT CAST(count(*) AS BIGINT) AS n_sites,
       round(CASE WHEN count(*) > 2 THEN corr(CAST(n AS DOUBLE), rmse) END, 6) AS corr_n_rmse FROM lm""")
def size_error_corr(spark, sf):
    lm = _loro_metrics(spark, sf)
    return rounded(lm.agg(F.count(F.lit(1)).alias("n_sites"),
                          F.when(F.count(F.lit(1)) > 2, F.corr(F.col("n").cast("double"), "rmse")).alias("corr_n_rmse")))


@query("improvement_pct", S.with_(*HOLD_CTES, _HM) + """
SELECT h.model, round(h.rmse, 6) AS rmse, round(((b.rmse - h.rmse) * 100) / b.rmse, 6) AS improvement_pct
FROM hm h CROSS JOIN (SELECT rmse FROM hm WHERE model = 'ref') b""")
def improvement_pct(spark, sf):
    """Percent RMSE improvement of every model over the ref baseline (one-row baseline broadcast)."""
    hm = _holdout_metrics(spark, sf)
    base = hm.filter(F.col("model") == "ref").select(F.col("rmse").alias("base_rmse"))
    j = hm.crossJoin(F.broadcast(base))
    return rounded(j.select("model", "rmse", X.pct_improvement("base_rmse", "rmse").alias("improvement_pct")))


@query("scheme_compare", S.with_(*HOLD_CTES, _HM, *_FO_LO, _CVP) + """
SELECT model, round(h.rmse, 6) AS holdout_rmse, round(c.rmse_mean, 6) AS cv_rmse,
       round(((c.rmse_mean - h.rmse) * 100) / h.rmse, 6) AS cv_vs_holdout_pct
FROM hm h JOIN cvs c USING (model)""")
def scheme_compare(spark, sf):
    """Same models under holdout and K-fold: how far the CV error is from the holdout error."""
    hm = _holdout_metrics(spark, sf).select("model", F.col("rmse").alias("holdout_rmse"))
    cv = _cv_summary(spark, sf).select("model", F.col("rmse_mean").alias("cv_rmse"))
    j = hm.join(cv, "model")
    return rounded(j.withColumn("cv_vs_holdout_pct",
                                F.try_divide((F.col("cv_rmse") - F.col("holdout_rmse")) * 100, F.col("holdout_rmse"))))


@query("bias_fit", S.with_(S.obs_cte(), S.CC, S.SPLIT) + f"""
, tz AS (SELECT *, CASE WHEN s2 < {P.zone_cuts[0]} AND s3 < {P.zone_cuts[1]} THEN 'reliable' ELSE 'extreme' END AS zone
         FROM sp WHERE NOT is_test)
SELECT round(avg(y - ref), 6) AS bias_all,
       round(avg(CASE WHEN zone = 'extreme' THEN y - ref END), 6) AS bias_extreme,
       round(avg(CASE WHEN zone = 'reliable' THEN y - ref END), 6) AS bias_reliable,
       CAST(count(*) FILTER (WHERE zone = 'extreme') AS BIGINT) AS n_extreme,
       CAST(count(*) FILTER (WHERE zone = 'reliable') AS BIGINT) AS n_reliable FROM tz""")
def bias_fit(spark, sf):
    """Mean bias of ref on the training rows, overall and within each zone (one pass)."""
    t = C.with_zone(_split(spark, sf).filter(~F.col("is_test")), P.zone_cuts)
    d = F.col("y") - F.col("ref")
    ext, rel = F.col("zone") == "extreme", F.col("zone") == "reliable"
    return rounded(t.agg(F.avg(d).alias("bias_all"), F.avg(F.when(ext, d)).alias("bias_extreme"),
                         F.avg(F.when(rel, d)).alias("bias_reliable"),
                         F.count(F.when(ext, 1)).alias("n_extreme"), F.count(F.when(rel, 1)).alias("n_reliable")))


@query("bias_corrected_metrics", S.with_(*HOLD_CTES) + f"""
SELECT model, {S.metric_cols()} FROM pl WHERE model IN ('ref', 'ref_bias') GROUP BY model""")
def bias_corrected_metrics(spark, sf):
    p = _holdout_preds(spark, sf, models=("ref", "ref_bias"))
    return rounded(M.metric_bundle(p, ["model"]))


@query("key_metrics", S.with_(*HOLD_CTES, _naive_leave_out("site", "cc"), _LORO) + f"""
, rs AS (SELECT y - pred AS r FROM pl WHERE model = 'ref_bias'),
mo AS (SELECT count(*) AS n, avg(r) AS mu, sqrt(avg(r * r)) AS rmse FROM rs),
cm AS (SELECT any_value(n) AS n, any_value(rmse) AS rmse, avg((r - mu) * (r - mu)) AS m2,
              avg((r - mu) * (r - mu) * (r - mu)) AS m3, avg((r - mu) * (r - mu) * (r - mu) * (r - mu)) AS m4
       FROM rs CROSS JOIN mo),
jb AS (SELECT n, rmse, n / 6.0 * ((m3 / pow(m2, 1.5)) * (m3 / pow(m2, 1.5)) + (m4 / (m2 * m2) - 3) * (m4 / (m2 * m2) - 3) / 4) AS jb FROM cm),
ls AS (SELECT avg(rmse) AS loro_mean, stddev_pop(rmse) AS loro_std FROM lm)
SELECT round(loro_mean, 6) AS loro_rmse_mean, round(loro_std, 6) AS loro_rmse_std, round(jb, 4) AS jb_stat,
       round(exp(-jb / 2), 6) AS jb_pvalue, round(rmse, 6) AS test_rmse,
       round(CASE WHEN rmse > 0 THEN 100 * (loro_mean - rmse) / rmse END, 6) AS loro_vs_test_pct
FROM jb CROSS JOIN ls""")
def key_metrics(spark, sf):
    """One row: held-out-site error, residual normality (Jarque-Bera) and test error of ref_bias."""
    from ..operators import diagnostics as D
    p = _holdout_preds(spark, sf, models=("ref_bias",)).withColumn("r", F.col("y") - F.col("pred"))
    nb = D.jarque_bera(p, "r").select("jb_stat", "jb_pvalue")
    t = p.agg(F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("test_rmse"))
    lm = _loro_metrics(spark, sf).agg(F.avg("rmse").alias("loro_rmse_mean"), F.stddev_pop("rmse").alias("loro_rmse_std"))
    j = lm.crossJoin(nb).crossJoin(t)
    j = j.withColumn("loro_vs_test_pct", F.when(F.col("test_rmse") > 0, F.lit(100) * (F.col("loro_rmse_mean") - F.col("test_rmse")) / F.col("test_rmse")))
    return rounded(j, per_col={"jb_stat": 4})


@query("summary_report", S.with_(*HOLD_CTES, _HM, *_FO_LO, _CVP, _naive_leave_out("site", "cc").replace("ks AS", "ks2 AS").replace("lo AS", "lo2 AS").replace("FROM ks JOIN", "FROM ks2 ks JOIN")) + f"""
, lm AS (SELECT site, sqrt(avg((y - (ref + bias)) * (y - (ref + bias)))) AS rmse FROM cc JOIN lo2 USING (site) GROUP BY site)
SELECT arg_min(h.model, h.rmse) AS best_model, round(min(h.rmse), 6) AS best_rmse,
       round(any_value(b.rmse), 6) AS baseline_rmse,
       round(((any_value(b.rmse) - min(h.rmse)) * 100) / any_value(b.rmse), 6) AS improvement_pct,
       round(any_value(c.rmse_mean), 6) AS cv_rmse_ref_bias, round((SELECT avg(rmse) FROM lm), 6) AS loro_rmse_ref_bias
FROM hm h CROSS JOIN (SELECT rmse FROM hm WHERE model = 'ref') b CROSS JOIN (SELECT rmse_mean FROM cvs WHERE model = 'ref_bias') c""")
def summary_report(spark, sf):
    """The run's summary row: best holdout model, improvement over ref, CV and held-out-site error."""
    hm = _holdout_metrics(spark, sf)
    best = hm.agg(F.min_by("model", "rmse").alias("best_model"), F.min("rmse").alias("best_rmse"))
    base = hm.filter(F.col("model") == "ref").select(F.col("rmse").alias("baseline_rmse"))
    cv = _cv_summary(spark, sf).filter(F.col("model") == "ref_bias").select(F.col("rmse_mean").alias("cv_rmse_ref_bias"))
    lo = _loro_metrics(spark, sf).agg(F.avg("rmse").alias("loro_rmse_ref_bias"))
    j = best.crossJoin(base).crossJoin(cv).crossJoin(lo)
    return rounded(j.withColumn("improvement_pct", X.pct_improvement("baseline_rmse", "best_rmse")))


# ---------------------------------------------------------------- step 6: descriptive statistics and diagnostics

from ..operators import diagnostics as D  # noqa: E402
from ..operators import timeseries as TS  # noqa: E402


@query("dataset_counts", S.with_(S.obs_cte(), S.CC) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT site) AS BIGINT) AS n_sites,
       CAST(count(DISTINCT date_trunc('month', obs_date)) AS BIGINT) AS n_months FROM cc""")
def dataset_counts(spark, sf):
    c = _clean(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("site").alias("n_sites"),
                 F.countDistinct(X.month_key("obs_date")).alias("n_months"))


@query("class_counts", S.with_(S.obs_cte(), S.CC, S.site_cls_cte()) + """
SELECT cls, CAST(count(*) AS BIGINT) AS n FROM clsd GROUP BY cls ORDER BY n DESC""")
def class_counts(spark, sf):
    c = C.class_by_site_mean(_clean(spark, sf), cuts=P.site_cuts)
    return c.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("site_mean", S.with_(S.obs_cte(), S.CC) + """
SELECT site, round(avg(y), 6) AS site_mean, CAST(count(*) AS BIGINT) AS site_n FROM cc GROUP BY site""")
def site_mean(spark, sf):
    return rounded(C.site_means(_clean(spark, sf)))


_DESC_STATS = [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"),
               ("min", "min({c})"), ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"),
               ("75%", "quantile_cont({c}, 0.75)"), ("max", "max({c})")]


@query("describe_long", S.with_(S.obs_cte(), S.CC) + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, '{s}' AS stat, round({e.format(c=c)}, 5) AS value FROM cc"
    for c in ("ref", "s2", "s3", "y") for s, e in _DESC_STATS))
def describe_long(spark, sf):
    """describe() of the four numeric columns in long layout (variable, stat, value)."""
    return rounded(D.describe_long(_clean(spark, sf), ["ref", "s2", "s3", "y"]), digits=5)


@query("site_share", S.with_(S.obs_cte(), S.CC) + f"""
, c AS (SELECT *, {S.class_case('y', P.value_cuts)} AS cls FROM cc),
g AS (SELECT cls, count(DISTINCT site) AS n_sites FROM c GROUP BY cls)
SELECT cls, CAST(n_sites AS BIGINT) AS n_sites, round(n_sites * 100.0 / sum(n_sites) OVER (), 6) AS share_pct FROM g""")
def site_share(spark, sf):
    """Distinct sites per row-value class and their share of the class-site pairs (a site counts in
    every class it has rows in). The window runs over the 3-row result only."""
    c = C.class_by_value(_clean(spark, sf), cuts=P.value_cuts)
    g = c.groupBy("cls").agg(F.countDistinct("site").alias("n_sites"))
    from pyspark.sql import Window
    return rounded(g.withColumn("share_pct", F.col("n_sites") * 100.0 / F.sum("n_sites").over(Window.partitionBy())))


_MONTHLY = """mp AS (SELECT CAST(date_trunc('month', obs_date) AS DATE) AS month, avg(y) AS mean_y, stddev_samp(y) AS std_y,
   CAST(count(*) AS BIGINT) AS n, avg(ref) AS mean_ref, avg(s2) AS mean_s2, avg(s3) AS mean_s3 FROM cc GROUP BY 1)"""


@query("monthly_profile", S.with_(S.obs_cte(), S.CC, _MONTHLY) + """
SELECT month, round(mean_y, 6) AS mean_y, round(std_y, 6) AS std_y, n, round(mean_ref, 6) AS mean_ref,
       round(mean_s2, 6) AS mean_s2, round(mean_s3, 6) AS mean_s3 FROM mp""")
def monthly_profile(spark, sf):
    return rounded(TS.monthly_profile(_clean(spark, sf)))


@query("tick_labels", S.with_(S.obs_cte(), S.CC, _MONTHLY) + """
, ps AS (SELECT month, CAST(row_number() OVER (ORDER BY month) AS BIGINT) AS pos, count(*) OVER () AS nm FROM mp)
SELECT month, pos, strftime(month, '%Y-%m') AS label FROM ps WHERE (pos - 1) % greatest(1, nm // 10) = 0""")
def tick_labels(spark, sf):
    return TS.tick_labels(TS.monthly_profile(_clean(spark, sf)), target=10)


@query("fit_line", S.with_(*HOLD_CTES) + """
SELECT model, round(regr_slope(pred, y), 6) AS slope, round(regr_intercept(pred, y), 6) AS intercept,
       round(corr(y, pred), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM pl GROUP BY model""")
def fit_line(spark, sf):
    """Least-squares line of predicted on observed for every model (the 1:1 panel's fit)."""
    return rounded(D.fit_line(_holdout_preds(spark, sf), "y", "pred", ["model"]))


_RES = """rs AS (SELECT y - pred AS r FROM pl WHERE model = 'ref_bias')"""
_RES0 = """rs AS (SELECT y - pred AS r FROM pl WHERE model = 'ref')"""


@query("residual_hist", S.with_(*HOLD_CTES, _RES0) + """
, ex AS (SELECT min(r) AS mn, max(r) AS mx FROM rs),
b AS (SELECT CAST(least(floor((r - mn) / ((mx - mn) / 20)), 19) AS BIGINT) AS bin, mn, mx FROM rs CROSS JOIN ex)
SELECT bin, CAST(count(*) AS BIGINT) AS n, round(any_value(mn) + bin * ((any_value(mx) - any_value(mn)) / 20), 6) AS lo,
       round(any_value(mn) + (bin + 1) * ((any_value(mx) - any_value(mn)) / 20), 6) AS hi FROM b GROUP BY bin""")
def residual_hist(spark, sf):
    """20-bin histogram of the ref baseline's test residuals (a constant bias shift leaves the
    counts of an equal-width min-max histogram unchanged)."""
    r = _holdout_preds(spark, sf, models=("ref",)).withColumn("r", F.col("y") - F.col("pred"))
    return rounded(D.histogram(r, "r", 20))


@query("box_stats", S.with_(S.obs_cte(), S.CC, S.SPLIT, _HOLD,
                            f"sm AS (SELECT site, {S.class_case('avg(y)', P.site_cuts, False)} AS cls FROM cc GROUP BY site)") + """
, rs AS (SELECT sm.cls, y - pred AS r FROM pl JOIN sm USING (site) WHERE model = 'ref_bias'),
q AS (SELECT cls, count(*) AS n, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS q3 FROM rs GROUP BY cls),
w AS (SELECT cls, min(CASE WHEN r >= q1 - 1.5 * (q3 - q1) THEN r END) AS wlo, max(CASE WHEN r <= q3 + 1.5 * (q3 - q1) THEN r END) AS whi,
        count(*) FILTER (WHERE r < q1 - 1.5 * (q3 - q1) OR r > q3 + 1.5 * (q3 - q1)) AS nout FROM rs JOIN q USING (cls) GROUP BY cls)
SELECT cls, CAST(n AS BIGINT) AS n, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3,
       round(q3 - q1, 5) AS iqr, round(wlo, 5) AS whisker_lo, round(whi, 5) AS whisker_hi, CAST(nout AS BIGINT) AS n_outliers,
       round(median - 1.57 * (q3 - q1) / sqrt(n), 5) AS notch_lo, round(median + 1.57 * (q3 - q1) / sqrt(n), 5) AS notch_hi
FROM q JOIN w USING (cls)""")
def box_stats(spark, sf):
    """Box-plot numbers of the bias-corrected residuals per site class."""
    p = _holdout_preds(spark, sf, ids=("site", "rk", "cls"), with_cls=True, models=("ref_bias",))
    r = p.withColumn("r", F.col("y") - F.col("pred"))
    return rounded(D.box_stats(r, "r", ["cls"]), digits=5)


@query("normality_jb", S.with_(*HOLD_CTES) + """
, rs AS (SELECT model, y - pred AS r FROM pl),
mo AS (SELECT model, count(*) AS n, avg(r) AS mu FROM rs GROUP BY model),
cm AS (SELECT model, any_value(n) AS n, avg((r - mu) * (r - mu)) AS m2, avg((r - mu) * (r - mu) * (r - mu)) AS m3,
              avg((r - mu) * (r - mu) * (r - mu) * (r - mu)) AS m4 FROM rs JOIN mo USING (model) GROUP BY model),
sk AS (SELECT model, n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS ek FROM cm)
SELECT model, CAST(n AS BIGINT) AS n, round(skew, 5) AS skew, round(ek, 5) AS excess_kurt,
       round(n / 6.0 * (skew * skew + ek * ek / 4), 2) AS jb_stat, round(exp(-(n / 6.0 * (skew * skew + ek * ek / 4)) / 2), 6) AS jb_pvalue
FROM sk""")
def normality_jb(spark, sf):
    """Jarque-Bera normality of every model's residuals (scalable stand-in for Shapiro-Wilk)."""
    r = _holdout_preds(spark, sf).withColumn("r", F.col("y") - F.col("pred"))
    return rounded(D.jarque_bera(r, "r", ["model"]), per_col={"skew": 5, "excess_kurt": 5, "jb_stat": 2})


_QQ = D.normal_grid(20)


@query("qq_grid", S.with_(*HOLD_CTES, _RES) + """
, g(i, p, theo_q) AS (VALUES """ + ", ".join(f"({i}, {p!r}, {z!r})" for i, p, z in _QQ) + """)
   , qs AS (SELECT quantile_cont(r, [""" + ", ".join(repr(p) for _, p, _ in _QQ) + """]) AS q FROM rs)
SELECT CAST(i AS BIGINT) AS i, round(p, 6) AS p, round(q[i], 5) AS sample_q, round(theo_q, 6) AS theo_q FROM g CROSS JOIN qs""")
def qq_grid(spark, sf):
    """Quantile-quantile points of the bias-corrected residuals against the normal distribution."""
    r = _holdout_preds(spark, sf, models=("ref_bias",)).withColumn("r", F.col("y") - F.col("pred"))
    return rounded(D.qq_grid(r, "r", 20), per_col={"sample_q": 5})


@query("extents", S.with_(*HOLD_CTES) + """
SELECT model, round(min(least(y, pred)), 6) AS lo, round(max(greatest(y, pred)), 6) AS hi FROM pl GROUP BY model""")
def extents(spark, sf):
    return rounded(D.extents(_holdout_preds(spark, sf), "y", "pred", ["model"]))


# ---------------------------------------------------------------- step 7: ranking, matrices, importance tables

from ..operators import ranking as RK  # noqa: E402

_RANK_SQL = """, rk1 AS (SELECT *, CAST(row_number() OVER (ORDER BY rmse, model) AS BIGINT) AS rank FROM hm)"""


@query("model_ranking", S.with_(*HOLD_CTES, _HM) + _RANK_SQL + """
SELECT model, round(rmse, 6) AS rmse, rank FROM rk1""")
def model_ranking(spark, sf):
    return rounded(RK.rank_by(_holdout_metrics(spark, sf), "rmse").select("model", "rmse", "rank"))


@query("best_model", S.with_(*HOLD_CTES, _HM) + """
SELECT model, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM hm ORDER BY rmse, model LIMIT 1""")
def best_model(spark, sf):
    return rounded(RK.best(_holdout_metrics(spark, sf)).select("model", "rmse", "r2"))


@query("topk_models", S.with_(*HOLD_CTES, _HM) + """
SELECT model, round(rmse, 6) AS rmse FROM hm ORDER BY rmse, model LIMIT 3""")
def topk_models(spark, sf):
    return rounded(RK.top_k(_holdout_metrics(spark, sf), "rmse", 3).select("model", "rmse"))


@query("valid_models", S.with_(*HOLD_CTES, _HM) + """
SELECT model, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM hm WHERE r2 > -2""")
def valid_models(spark, sf):
    return rounded(RK.valid(_holdout_metrics(spark, sf)).select("model", "rmse", "r2"))


# a preference list as a user would write it; one name is absent from the results on purpose
PREFERRED = ["line_ref", "ref_bias", "ridge_a0.1", "ref"]


@query("preferred_models", S.with_(*HOLD_CTES, _HM) + """
, pref(pos, model) AS (VALUES """ + ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(PREFERRED)) + """)
SELECT CAST(pos AS BIGINT) AS pos, model, round(rmse, 6) AS rmse, rmse IS NOT NULL AS present
FROM pref LEFT JOIN hm USING (model)""")
def preferred_models(spark, sf):
    """Models of a preference list in list order; missing names are reported, not dropped silently."""
    r = RK.preferred(spark, _holdout_metrics(spark, sf).select("model", "rmse"), PREFERRED)
    return rounded(r.select("pos", "model", "rmse", "present"))


_CLS_METRICS = f"""sm AS (SELECT site, {S.class_case('avg(y)', P.site_cuts, False)} AS cls FROM cc GROUP BY site),
cm AS (SELECT model, cls, sqrt(avg({_e2()})) AS rmse FROM pl JOIN sm USING (site) GROUP BY model, cls)"""


def _class_metrics(spark, sf):
    p = _holdout_preds(spark, sf, ids=("site", "rk", "cls"), with_cls=True)
    return M.metric_bundle(p, ["model", "cls"])


@query("rmse_matrix", S.with_(*HOLD_CTES, _CLS_METRICS) + "SELECT cls, " + ", ".join(
    f"round(max(CASE WHEN model = '{m}' THEN rmse END), 6) AS {m}" for m in BL.BASELINE_MODELS) + " FROM cm GROUP BY cls")
def rmse_matrix(spark, sf):
    """Class x model RMSE matrix (pivot with explicit model list)."""
    cm = _class_metrics(spark, sf)
    return rounded(RK.pivot_matrix(cm, "cls", "model", "rmse", list(BL.BASELINE_MODELS)))


@query("best_worst_class", S.with_(*HOLD_CTES, _CLS_METRICS) + """
SELECT model, arg_min(cls, rmse) AS best_cls, arg_max(cls, rmse) AS worst_cls, round(avg(rmse), 6) AS mean_rmse
FROM cm GROUP BY model""")
def best_worst_class(spark, sf):
    return rounded(RK.best_worst(_class_metrics(spark, sf), "model", "cls", "rmse"))


# importance stand-in computable in SQL: |corr(feature, y)| on the training rows, per feature set
_IMP_SETS = {"orig16": [n for n, _ in _EXT16 if n != "ref_x_log_s3"] + ["s2_x_ref", "s3_x_ref"],
             "ext16": [n for n, _ in _EXT16] + ["all_agree"]}
_IMP_EXPR = dict(_EXT16 + [("s2_x_ref", "s2 * ref / 1000"), ("s3_x_ref", "s3 * ref / 1000"),
                           ("all_agree", _FLAG.rsplit(" AS ", 1)[0])])
_IMP_SQL = "fe AS (SELECT y, " + ", ".join(f"{e} AS {n}" for n, e in _IMP_EXPR.items()) + \
    " FROM sp WHERE NOT is_test),\nimp AS (" + "\n UNION ALL ".join(
        f"SELECT '{a}' AS approach, '{f}' AS feature, abs(corr({f}, y)) AS importance FROM fe"
        for a, fs in _IMP_SETS.items() for f in fs) + """),
it AS (SELECT *, importance * 100 / sum(importance) OVER (PARTITION BY approach) AS share_pct,
   CAST(row_number() OVER (PARTITION BY approach ORDER BY importance DESC, feature) AS BIGINT) AS rank FROM imp),
ic AS (SELECT *, sum(share_pct) OVER (PARTITION BY approach ORDER BY importance DESC, feature
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pct FROM it)"""


def _corr_importance(spark, sf):
    """|corr(feature, y)| of every feature of two sets, all in one aggregate pass over the training rows."""
    tr = _split(spark, sf).filter(~F.col("is_test"))
    feats = {n: c for n, c in FT.ext16(P.flag_cuts) + FT.orig16()}
    f = tr.select("y", *[c.alias(n) for n, c in feats.items()])
    wide = f.agg(*[F.abs(F.corr(n, "y")).alias(n) for n in feats])
    longs = [wide.select(F.lit(a).alias("approach"), F.explode(F.map_from_arrays(
        F.array(*[F.lit(n) for n in fs]), F.array(*[F.col(n) for n in fs]))).alias("feature", "importance"))
        for a, fs in _IMP_SETS.items()]
    out = longs[0]
    for x in longs[1:]:
        out = out.unionByName(x)
    return RK.importance_table(out, ["approach"])


@query("importance_rank", S.with_(S.obs_cte(), S.CC, S.SPLIT, _IMP_SQL) + """
SELECT approach, feature, round(importance, 6) AS importance, rank FROM ic""")
def importance_rank(spark, sf):
    return rounded(_corr_importance(spark, sf).select("approach", "feature", "importance", "rank"))


@query("importance_share", S.with_(S.obs_cte(), S.CC, S.SPLIT, _IMP_SQL) + """
SELECT approach, feature, round(share_pct, 6) AS share_pct FROM ic""")
def importance_share(spark, sf):
    return rounded(_corr_importance(spark, sf).select("approach", "feature", "share_pct"))


@query("importance_cumulative", S.with_(S.obs_cte(), S.CC, S.SPLIT, _IMP_SQL) + """
SELECT approach, rank, round(cum_pct, 6) AS cum_pct FROM ic""")
def importance_cumulative(spark, sf):
    return rounded(_corr_importance(spark, sf).select("approach", "rank", "cum_pct"))


@query("features_for_80", S.with_(S.obs_cte(), S.CC, S.SPLIT, _IMP_SQL) + """
SELECT approach, min(CASE WHEN cum_pct >= 80 THEN rank END) AS n_features FROM ic GROUP BY approach""")
def features_for_80(spark, sf):
    return RK.features_needed(_corr_importance(spark, sf), ["approach"], 80.0)


@query("importance_concentration", S.with_(S.obs_cte(), S.CC, S.SPLIT, _IMP_SQL) + """
SELECT approach, round(sum(CASE WHEN rank <= 5 THEN share_pct END), 6) AS top5_pct,
       CAST(count(*) FILTER (WHERE share_pct > 5) AS BIGINT) AS n_above FROM ic GROUP BY approach""")
def importance_concentration(spark, sf):
    return rounded(RK.concentration(_corr_importance(spark, sf), ["approach"], 5, 5.0))


# ---------------------------------------------------------------- step 8: linear family (Gram route)

from ..operators import linear as L  # noqa: E402
from . import evaluation as EV  # noqa: E402


def _det3(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"(({a}) * (({e}) * ({i}) - ({f}) * ({h})) - ({b}) * (({d}) * ({i}) - ({f}) * ({g})) + ({c}) * (({d}) * ({h}) - ({e}) * ({g})))"


def _ols3_sql(cols, src_filter):
    cv = [[f"covar_pop({a}, {b})" for b in cols] for a in cols]
    cy = [f"covar_pop({a}, y)" for a in cols]
    stats = ", ".join([f"avg(y) AS my"] + [f"avg({c}) AS m{i}" for i, c in enumerate(cols)]
                      + [f"{cv[i][j]} AS c{i}{j}" for i in range(3) for j in range(3)]
                      + [f"{cy[i]} AS y{i}" for i in range(3)])
    C = [[f"c{i}{j}" for j in range(3)] for i in range(3)]
    dets = []
    for k in range(3):
        Mk = [[(f"y{i}" if j == k else C[i][j]) for j in range(3)] for i in range(3)]
        dets.append(f"{_det3(Mk)} / {_det3(C)} AS b{k}")
    return f"""g AS (SELECT {stats} FROM {src_filter}),
cf AS (SELECT *, {", ".join(dets)} FROM g)"""


@query("ols3_coeffs", S.with_(S.obs_cte(), S.CC, S.SPLIT, _ols3_sql(["ref", "s2", "s3"], "sp WHERE NOT is_test")) + """
SELECT 'linear' AS model, round(my - b0 * m0 - b1 * m1 - b2 * m2, 6) AS intercept,
       round(b0, 6) AS b_ref, round(b1, 6) AS b_s2, round(b2, 6) AS b_s3 FROM cf""")
def ols3_coeffs(spark, sf):
    """Least squares of y on the three raw sensors over the training rows, from one Gram aggregate."""
    coefs, _ = EV.holdout_linear(_split(spark, sf), "raw3", specs=(L.LinearSpec("linear", "ols"),))
    return rounded(coefs.drop("converged"))


def _linear_cv(spark, sf, names=None):
    specs = tuple(s for s in L.STUDY_LINEAR if names is None or s.name in names)
    _, preds = EV.kfold_linear(_clean(spark, sf), "optimized10", P.k, specs)
    return EV.cv_summary(preds)


# the three raw sensors with every penalty of the study, solved in SQL: normal equations for every choice of signs
# (-1, 0, 1) of the three weights, kept where signs and optimality conditions hold
PENALISED = (L.LinearSpec("linear", "ols"), L.LinearSpec("ridge_0.1", "ridge", alpha=0.1),
             L.LinearSpec("ridge_1", "ridge", alpha=1.0), L.LinearSpec("ridge_10", "ridge", alpha=10.0),
             L.LinearSpec("lasso", "lasso", alpha=0.1), L.LinearSpec("elasticnet", "elasticnet", alpha=0.1, l1_ratio=0.5))


def _penalised_sql(src: str, group: str = "0") -> str:
    """CTEs ending in ``cf`` (grp, model, b0..b2, icpt) for the training rows ``src`` per ``group``."""
    cols = ["ref", "s2", "s3"]
    stats = [f"{group} AS grp", "count(*) AS n", "avg(y) AS my"]
    stats += [f"avg({c}) AS m{i}, coalesce(nullif(sqrt(var_pop({c})), 0), 1) AS d{i}, covar_pop({c}, y) AS y{i}"
              for i, c in enumerate(cols)]
    stats += [f"covar_pop({a}, {b}) AS c{i}{j}" for i, a in enumerate(cols) for j, b in enumerate(cols)]
    std = ", ".join([f"c{i}{j} / (d{i} * d{j}) AS g{i}{j}" for i in range(3) for j in range(3)]
                    + [f"y{i} / d{i} AS r{i}" for i in range(3)])
    mods = ", ".join(f"('{s.name}', {float(s.alpha if s.kind == 'ridge' else 0)}, "
                     f"{float(s.alpha * s.l1_ratio if s.kind in ('lasso', 'elasticnet') else 0)}, "
                     f"{float(s.alpha * (1 - s.l1_ratio) if s.kind == 'elasticnet' else 0)})" for s in PENALISED)
    A = [[f"(abs(p{i}) * abs(p{j}) * g{i}{j}" + (f" + abs(p{i}) * l2 + 1 - abs(p{i}))" if i == j else ")")
          for j in range(3)] for i in range(3)]
    rhs = [f"(abs(p{i}) * (r{i} - l1 * p{i}))" for i in range(3)]
    w = [f"{_det3([[rhs[i] if j == k else A[i][j] for j in range(3)] for i in range(3)])} / {_det3(A)} AS w{k}"
         for k in range(3)]
    fits = " AND ".join(f"(CASE WHEN p{i} = 0 THEN abs(r{i} - g{i}0 * w0 - g{i}1 * w1 - g{i}2 * w2) <= l1 * (1 + 1e-9) + 1e-12 "
                        f"ELSE sign(w{i}) = p{i} END)" for i in range(3))
    return f"""st AS (SELECT {', '.join(stats)} FROM {src} GROUP BY 1),
sd AS (SELECT *, {std} FROM st),
md(model, ar, l1, a2) AS (VALUES {mods}),
sg(p) AS (VALUES (-1), (0), (1)),
sy AS (SELECT sd.*, model, l1, ar / n + a2 AS l2, x.p AS p0, y.p AS p1, z.p AS p2 FROM sd, md, sg x, sg y, sg z
       WHERE l1 > 0 OR (x.p = 1 AND y.p = 1 AND z.p = 1)),
so AS (SELECT *, {', '.join(w)} FROM sy),
cf AS (SELECT grp, model, w0 / d0 AS b0, w1 / d1 AS b1, w2 / d2 AS b2,
         my - w0 / d0 * m0 - w1 / d1 * m1 - w2 / d2 * m2 AS icpt FROM so WHERE l1 = 0 OR ({fits}))"""


_PEN_HOLDOUT = S.with_(S.obs_cte(), S.CC, S.SPLIT, "tr AS (SELECT * FROM sp WHERE NOT is_test)", _penalised_sql("tr"))
_PEN_PRED = "icpt + b0 * ref + b1 * s2 + b2 * s3"


@query("penalised_coeffs", _PEN_HOLDOUT + """
SELECT model, round(icpt, 6) AS intercept, round(b0, 6) AS b_ref, round(b1, 6) AS b_s2, round(b2, 6) AS b_s3 FROM cf""")
def penalised_coeffs(spark, sf):
    """Coefficients of OLS, Ridge (0.1, 1, 10), Lasso and ElasticNet on the raw sensors, fitted on the training rows."""
    coefs, _ = EV.holdout_linear(_split(spark, sf), "raw3", specs=PENALISED)
    return rounded(coefs.drop("converged"))


@query("penalised_holdout", _PEN_HOLDOUT + f"""
, pr AS (SELECT model, y, {_PEN_PRED} AS pred FROM sp, cf WHERE is_test)
SELECT model, {S.metric_cols()} FROM pr GROUP BY model""")
def penalised_holdout(spark, sf):
    """The same models scored on the test rows."""
    _, preds = EV.holdout_linear(_split(spark, sf), "raw3", specs=PENALISED)
    return rounded(M.metric_bundle(preds, ["model"]))


def _penalised_cv_sql(k: int) -> str:
    return S.with_(S.obs_cte(), S.CC, f"fo AS (SELECT *, rk % {k} AS fold FROM cc)",
                   f"tr AS (SELECT f.*, t.g FROM fo f, (SELECT unnest(range(0, {k})) AS g) t WHERE f.fold <> t.g)",
                   _penalised_sql("tr", "g")) + f"""
, pr AS (SELECT model, fold, y, {_PEN_PRED} AS pred FROM fo JOIN cf ON fold = grp),
pf AS (SELECT model, fold, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae,
         1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM pr GROUP BY model, fold)
SELECT model, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std, round(avg(mae), 6) AS mae_mean,
       round(stddev_pop(mae), 6) AS mae_std, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std
FROM pf GROUP BY model"""


def _penalised_cv(spark, sf, k):
    _, preds = EV.kfold_linear(_clean(spark, sf), "raw3", k, PENALISED)
    return rounded(EV.cv_summary(preds))


@query("penalised_cv", _penalised_cv_sql(P.k))
def penalised_cv(spark, sf):
    """Five-fold cross-validation of all penalties on the raw sensors."""
    return _penalised_cv(spark, sf, P.k)


@query("penalised_loro", S.with_(
    S.obs_cte(), S.CC, "si AS (SELECT DISTINCT site AS g FROM cc)",
    "tr AS (SELECT c.ref, c.s2, c.s3, c.y, si.g FROM cc c, si WHERE c.site <> si.g)", _penalised_sql("tr", "g")) + f"""
, pr AS (SELECT model, site, y, {_PEN_PRED} AS pred FROM cc JOIN cf ON site = grp),
ps AS (SELECT model, site, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae,
         CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) END AS r2
       FROM pr GROUP BY model, site)
SELECT model, CAST(count(*) AS BIGINT) AS n_sites, round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std,
       round(avg(mae), 6) AS mae_mean, round(avg(r2), 6) AS r2_mean FROM ps GROUP BY model""")
def penalised_loro(spark, sf):
    """Leave-one-site-out of all penalties on the raw sensors, summarised over sites."""
    _, preds = EV.leave_out_linear(_clean(spark, sf), "raw3", "site", PENALISED)
    per = M.metric_bundle(preds, ["model", "site"])
    return rounded(per.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_sites"), F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
        F.avg("mae").alias("mae_mean"), F.avg("r2").alias("r2_mean")))


@query("penalised_cv10", _penalised_cv_sql(10))
def penalised_cv10(spark, sf):
    return _penalised_cv(spark, sf, 10)


@query("linear_cv")
def linear_cv(spark, sf):
    """5-fold CV of OLS, Ridge, Lasso, ElasticNet on the optimized10 features (leak-free per fold)."""
    return _linear_cv(spark, sf)


@query("ridge_cv")
def ridge_cv(spark, sf):
    return _linear_cv(spark, sf, ["ridge"])


@query("lasso_cv")
def lasso_cv(spark, sf):
    return _linear_cv(spark, sf, ["lasso"])


@query("elasticnet_cv")
def elasticnet_cv(spark, sf):
    return _linear_cv(spark, sf, ["elasticnet"])


@query("linear_holdout")
def linear_holdout(spark, sf):
    """Holdout fit of the linear family on optimized10, scored on the test rows."""
    _, preds = EV.holdout_linear(staged(_split(spark, sf)), "optimized10")
    return M.metric_bundle(preds, ["model"])


# ---------------------------------------------------------------- step 9a: zone-adaptive correction (exact)

from ..operators import ensembles as EN  # noqa: E402

_TZ = f"""tz AS (SELECT *, CASE WHEN s2 < {P.zone_cuts[0]} AND s3 < {P.zone_cuts[1]} THEN 'reliable' ELSE 'extreme' END AS zone,
   ln(1 + s2) AS ls2, ln(1 + s3) AS ls3 FROM sp)"""
_ADAPT = _ols3_sql(["ref", "ls2", "ls3"], "tz WHERE NOT is_test AND zone = 'reliable'").replace(
    "g AS (SELECT avg(y) AS my", "g AS (SELECT count(*) AS nr, avg(y) AS my") + """,
be AS (SELECT avg(y - ref) AS bias FROM tz WHERE NOT is_test AND zone = 'extreme'),
pa AS (SELECT zone, y, CASE WHEN zone = 'reliable' THEN (CASE WHEN nr > 10 THEN
          (my - b0 * m0 - b1 * m1 - b2 * m2) + b0 * ref + b1 * ls2 + b2 * ls3 END) ELSE ref + bias END AS pred
       FROM tz CROSS JOIN cf CROSS JOIN be WHERE is_test)"""


def _adaptive_preds(spark, sf):
    sp = staged(_split(spark, sf))
    coefs, bias = EN.fit_adaptive(sp.filter(~F.col("is_test")), P.zone_cuts)
    return EN.predict_adaptive(sp.filter(F.col("is_test")), coefs, bias, P.zone_cuts).filter(F.col("pred").isNotNull())


@query("adaptive_holdout", S.with_(S.obs_cte(), S.CC, S.SPLIT, _TZ, _ADAPT) + f"""
SELECT CASE WHEN GROUPING(zone) = 1 THEN 'ALL' ELSE zone END AS zone, {S.metric_cols()}
FROM pa WHERE pred IS NOT NULL GROUP BY GROUPING SETS ((zone), ())""")
def adaptive_holdout(spark, sf):
    """Zone-adaptive correction: least squares on (ref, log s2, log s3) in the reliable zone, bias-corrected
    ref in the extreme zone; scored overall and per zone in one grouping-sets aggregate."""
    p = _adaptive_preds(spark, sf).withColumn("model", F.lit("adaptive"))
    return rounded(M.metrics_rollup(p, ["model"], ["zone"]).drop("model"))


@query("adaptive_extreme", S.with_(S.obs_cte(), S.CC, S.SPLIT, _TZ, _ADAPT) + f"""
SELECT 'extreme' AS zone, {S.metric_cols()} FROM pa WHERE zone = 'extreme'""")
def adaptive_extreme(spark, sf):
    """The extreme-zone branch of the adaptive model alone (bias-corrected ref)."""
    p = _adaptive_preds(spark, sf).filter(F.col("zone") == "extreme")
    return rounded(M.metric_bundle(p, ["zone"]))


# ---------------------------------------------------------------- step 9b: learners, ensembles, sweeps (rows-only)

from . import modeling as MD  # noqa: E402
from ..operators import forest as FO  # noqa: E402
from ..operators import learners as LR  # noqa: E402


@query("huber_holdout")
def huber_holdout(spark, sf):
    """Huber regression (epsilon 1.35) on standardised optimized10 features, scored on the test rows."""
    _, p = MD.learner_holdout(_split(spark, sf), "optimized10", LR.STUDY_HUBER, standardize=True)
    return M.metric_bundle(p, ["model"])


def _study(spark, sf):
    """The holdout study of the driver tables; its frames, models and base predictions are stored once."""
    from . import study as ST
    return ST.Study(spark, _split(spark, sf), (ST.source_key(spark, f"{sf}/lineitem.parquet", f"{sf}/part.parquet"), "holdout"),
                    sets={"ext16": {"flag_cuts": P.flag_cuts}})


@query("gbt_holdout")
def gbt_holdout(spark, sf):
    """Gradient boosting (100 rounds, depth 3) on optimized10, scored on the test rows."""
    return M.metric_bundle(MD.boosted_predictions(_study(spark, sf), "optimized10", LR.STUDY_GBT), ["model"])


@query("rf_importance")
def rf_importance(spark, sf):
    """Random-forest feature importances of optimized10 as share, rank and cumulative share."""
    trees = _study(spark, sf).forest("optimized10", FO.STUDY_FOREST)
    return RK.importance_table(FO.importance(trees, FT.names("optimized10"), "random_forest"), ["model"])


@query("coef_importance")
def coef_importance(spark, sf):
    """|standardised coefficient| importances of ElasticNet and Ridge on three feature sets."""
    return MD.coef_importance(_study(spark, sf))


@query("stacking_holdout")
def stacking_holdout(spark, sf):
    """Least squares over the out-of-fold predictions of forest, boosted trees and ridge."""
    return M.metric_bundle(MD.stacking(_study(spark, sf).base_predictions()), ["model"])


@query("stacking_forest_holdout")
def stacking_forest_holdout(spark, sf):
    """The same stack with a forest as meta-learner."""
    return M.metric_bundle(MD.stacking_forest(_study(spark, sf).base_predictions()), ["model"])


@query("voting_holdout")
def voting_holdout(spark, sf):
    """Mean of the base models' test predictions; no out-of-fold fits."""
    return M.metric_bundle(MD.voting(_study(spark, sf).base_predictions(out_of_fold=False)), ["model"])


@query("weighted_holdout")
def weighted_holdout(spark, sf):
    """Simplex-weighted ensemble (weights fitted on out-of-fold predictions) with its weights."""
    w, p = MD.weighted(_study(spark, sf).base_predictions())
    return M.metric_bundle(p, ["model"]).crossJoin(w)


@query("approach_compare")
def approach_compare(spark, sf):
    return MD.approach_compare(_study(spark, sf))


@query("ensemble_study")
def ensemble_study(spark, sf):
    """The whole ensemble study as one table ranked by test RMSE."""
    return MD.ensemble_study(_study(spark, sf), P.zone_cuts)


@query("model_sweep")
def model_sweep(spark, sf):
    return MD.model_sweep(_study(spark, sf), _clean(spark, sf), P.k)


@query("elasticnet_loro")
def elasticnet_loro(spark, sf):
    """Leave-one-site-out ElasticNet (and the rest of the linear family) on optimized10, exact per
    held-out site, summarised over sites (mean/std/median of RMSE, NULL-skipping R2 mean)."""
    from ..operators import loro as LO
    _, preds = LO.loro_linear(_clean(spark, sf), "site")
    from ..operators.quantiles import quantile_columns
    per_site = M.metric_bundle(preds, ["model", "site"])
    med = quantile_columns(per_site, "rmse", [0.5], ["rmse_median"], by=["model"])
    return per_site.groupBy("model").agg(F.count(F.lit(1)).alias("n_sites"), F.avg("rmse").alias("rmse_mean"),
                                         F.stddev_pop("rmse").alias("rmse_std"),
                                         F.avg("mae").alias("mae_mean"), F.avg("r2").alias("r2_mean"),
                                         F.stddev_pop("r2").alias("r2_std")).join(med, "model")


@query("stream_scoring", _PEN_HOLDOUT + f"""
, pr AS (SELECT model, y, {_PEN_PRED} AS pred,
           DATE '1970-01-01' + CAST((date_diff('day', DATE '1970-01-01', obs_date) // 30) * 30 AS INTEGER) AS w FROM obs, cf)
SELECT strftime(w, '%Y-%m-%d') AS window_start, model, {S.metric_cols()} FROM pr GROUP BY w, model""")
def stream_scoring(spark, sf):
    """Structured Streaming: lineitem arrives as a file stream, is scored with the penalised models fitted on the
    batch training split (stream-static broadcast joins), and its errors are aggregated per 30-day event-time
    window. Runs the stream over everything available."""
    from ..streaming import scoring as ST
    coefs, _ = EV.holdout_linear(_split(spark, sf), "raw3", specs=PENALISED)
    win = ST.windowed_errors(ST.score(ST.driver_obs_stream(spark, sf), None, coefs, "raw3"))
    out = ST.run_to_table(win, spark.conf.get("spark.checkpoint.dir"))
    return rounded(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")))


# ---------------------------------------------------------------- per-class reports of trained models

@query("linear_cv10")
def linear_cv10(spark, sf):
    """10-fold CV of the linear family on optimized10 (the study runs 5 and 10 folds)."""
    _, preds = EV.kfold_linear(_clean(spark, sf), "optimized10", 10)
    return EV.cv_summary(preds)


def _stratified(spark, sf):
    """Class-stratified split of the complete rows."""
    c = C.class_by_site_mean(_clean(spark, sf), cuts=P.site_cuts)
    return staged(SP.stratified_holdout(c, "cls", "rk", P.test_frac))


@query("trophic_elasticnet")
def trophic_elasticnet(spark, sf):
    """Per-class check of the primary model: ElasticNet on optimized10 fitted on the class-stratified
    training split, scored overall and per site class (grouping sets, one pass)."""
    s = _stratified(spark, sf)
    _, preds = EV.holdout_linear(s, "optimized10", specs=(L.STUDY_LINEAR[3],), ids=("rk", "cls"))
    return M.metrics_rollup(preds, ["model"], ["cls"])


@query("class_model_matrix")
def class_model_matrix(spark, sf):
    """Class x model RMSE matrix of the trained linear family plus the ref baseline, on the stratified split."""
    s = _stratified(spark, sf)
    _, preds = EV.holdout_linear(s, "optimized10", ids=("rk", "cls"))
    base = s.filter(F.col("is_test")).select("rk", "cls", F.lit("ref").alias("model"), "y", F.col("ref").alias("pred"))
    per = M.metric_bundle(preds.unionByName(base), ["model", "cls"])
    models = [sp.name for sp in L.STUDY_LINEAR] + ["ref"]
    return RK.pivot_matrix(per, "cls", "model", "rmse", models)


# ---------------------------------------------------------------- stratified folds, distribution tests, counted rows

@query("kfold_stratified", S.with_(S.obs_cte(), S.CC, S.site_cls_cte()) + f"""
, fo AS (SELECT cls, y, (row_number() OVER (PARTITION BY cls ORDER BY rk, site, obs_date, ref, s2, s3, y) - 1) % {P.k} AS fold FROM clsd)
SELECT cls, CAST(fold AS BIGINT) AS fold, CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS mean_y FROM fo GROUP BY cls, fold""")
def kfold_stratified(spark, sf):
    """K-fold stratified by class: exact quotas per class and fold."""
    c = C.class_by_site_mean(_clean(spark, sf), cuts=P.site_cuts).select("cls", "rk", "site", "obs_date", "ref", "s2", "s3", "y")
    f = SP.stratified_kfold(staged(c), "cls", P.k)
    return rounded(f.groupBy("cls", "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


from ..operators import kstest as KS  # noqa: E402


def _phi_sql(z: str) -> str:
    t = f"(1.0 / (1.0 + {KS.ERF_P} * abs({z}) / sqrt(2.0::DOUBLE)))"
    poly = "0.0"
    for a in reversed(KS.ERF_A):
        poly = f"(({poly} + {a}) * {t})"
    erf = f"(1.0 - {poly} * exp(-({z}) * ({z}) / 2))"
    return f"(CASE WHEN {z} >= 0 THEN (1.0 + {erf}) / 2 ELSE (1.0 - {erf}) / 2 END)"


def _ks_p_sql(d: str, n: str) -> str:
    lam = f"((sqrt({n}) + 0.12 + 0.11 / sqrt({n})) * {d})"
    tail = " + ".join(f"{2.0 * (-1) ** (k - 1)} * exp({-2.0 * k * k} * lam * lam)" for k in range(1, 41))
    return f"(SELECT CASE WHEN lam < 0.2 THEN 1.0 ELSE least(greatest({tail}, 0.0), 1.0) END FROM (SELECT {lam} AS lam))"


@query("normality_ks", S.with_(*HOLD_CTES, _RES) + f"""
, st AS (SELECT count(*) AS n, avg(r) AS m, stddev_samp(r) AS s FROM rs),
c AS (SELECT r, count(*) AS c FROM rs GROUP BY r),
u AS (SELECT c.*, sum(c) OVER (ORDER BY r) AS upto, n, (r - m) / s AS z FROM c CROSS JOIN st),
d AS (SELECT max(n)::DOUBLE AS n, max(greatest(abs(upto / n - {_phi_sql('z')}), abs((upto - c) / n - {_phi_sql('z')}))) AS d FROM u)
SELECT CAST(n AS BIGINT) AS n, round(d, 6) AS d, round({_ks_p_sql('d', 'n')}, 6) AS p_value FROM d""")
def normality_ks(spark, sf):
    """Kolmogorov-Smirnov distance of the bias-corrected residuals from the normal distribution."""
    r = _holdout_preds(spark, sf, models=["ref_bias"]).withColumn("r", F.col("y") - F.col("pred"))
    return rounded(KS.one_sample(r, "r"))


@query("ks_two_sample", S.with_(S.obs_cte(), S.CC, S.site_cls_cte()) + f"""
, c AS (SELECT y - ref AS v, count(*) FILTER (cls = 'Mesotrophic') AS a, count(*) FILTER (cls = 'Hypertrophic') AS b
        FROM clsd WHERE cls IN ('Mesotrophic', 'Hypertrophic') GROUP BY v),
u AS (SELECT sum(a) OVER w AS ua, sum(b) OVER w AS ub, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c WINDOW w AS (ORDER BY v)),
d AS (SELECT max(na)::DOUBLE AS na, max(nb)::DOUBLE AS nb, max(abs(ua / na - ub / nb)) AS d FROM u HAVING max(na) > 0 AND max(nb) > 0)
SELECT CAST(na AS BIGINT) AS n_first, CAST(nb AS BIGINT) AS n_second, round(d, 6) AS d,
       round({_ks_p_sql('d', '(na * nb / (na + nb))')}, 6) AS p_value FROM d""")
def ks_two_sample(spark, sf):
    """Do the errors of the trusted sensor follow the same distribution at the clearest and the most loaded sites?"""
    c = C.class_by_site_mean(_clean(spark, sf), cuts=P.site_cuts).withColumn("v", F.col("y") - F.col("ref"))
    return rounded(KS.two_sample(c, "v", F.col("cls") == "Mesotrophic", F.col("cls") == "Hypertrophic"))


from ..operators import tally as TL  # noqa: E402


@query("row_counts", S.with_(S.obs_cte(with_missing=True), S.CC, S.site_cls_cte(), """al AS (
  SELECT sm.cls, ref, s2, s3, y, ln(1 + s2 - 400) AS f FROM (SELECT * REPLACE (CASE WHEN s2 > 399 THEN s2 END AS s2) FROM obs) o LEFT JOIN sm USING (site))""") + """
SELECT cls, CAST(count(*) AS BIGINT) AS n_in, CAST(count(*) FILTER (ref IS NULL OR s3 IS NULL OR y IS NULL) AS BIGINT) AS n_missing,
       CAST(count(*) FILTER (ref IS NOT NULL AND s3 IS NOT NULL AND y IS NOT NULL AND f IS NULL) AS BIGINT) AS n_dropped,
       CAST(count(*) FILTER (ref IS NOT NULL AND s3 IS NOT NULL AND y IS NOT NULL AND f IS NOT NULL) AS BIGINT) AS n_used
FROM al GROUP BY cls""")
def row_counts(spark, sf):
    """Rows read, missing an input, dropped for a feature out of its domain (a shifted logarithm), and used, per site class."""
    from ..functions.scalar import log1p
    o = _obs(spark, sf, with_missing=True)
    sites = C.class_by_site_mean(C.complete_cases(o), cuts=P.site_cuts).select("site", "cls").distinct()
    o = o.join(sites, "site", "left").withColumn("z", F.col("s2") - 400).withColumn("f", log1p("z"))
    return TL.row_counts(o, ["ref", "s3", "y"], ["f"], by=["cls"])


from ..operators import loro as LO  # noqa: E402


@query("learner_certificates", "SELECT * FROM (VALUES " + ", ".join(
    f"('huber', '{c}', TRUE)" for c in [*LO.FEATS, "intercept", "scale"])
    + ", ('gradient_boosting', 'loss of 100 rounds', TRUE)) AS t(model, component, ok)")
def learner_certificates(spark, sf):
    """Optimality of the iterative learners: zero gradient of the Huber fit, falling training loss of boosting."""
    return MD.certificates(_study(spark, sf))
