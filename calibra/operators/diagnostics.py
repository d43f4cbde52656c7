"""Residual diagnostics and distribution summaries.

Everything is an aggregate over residuals, so it scales with partial aggregation.
The study's Shapiro-Wilk test and probability plot are single-machine routines;
they are re-aimed as Jarque-Bera (from Spark's population skewness and excess
kurtosis; chi-square(2) p-value = exp(-JB/2)) and a quantile grid against normal
quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles, null_safe_join, quantile_columns


def jarque_bera(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    s, k, n = F.skewness(col), F.kurtosis(col), F.count(col)
    g = df.groupBy(*by).agg(n.alias("n"), s.alias("skew"), k.alias("excess_kurt"))
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("excess_kurt") * F.col("excess_kurt") / 4)
    return g.withColumn("jb_stat", jb).withColumn("jb_pvalue", F.exp(-F.col("jb_stat") / 2))


def describe_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample std, min, 25 %, 50 %, 75 %, max of each column, in long layout
    (variable, stat, value). The columns are stacked (variable, value) so one aggregate and one
    exact-quantile pass serve all of them."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v"))
                                            for c in cols])).alias("_s")).select("_s.variable", "_s.v")
    basic = stacked.groupBy("variable").agg(
        F.count("v").cast("double").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantile_columns(stacked, "v", [0.25, 0.5, 0.75], ["25%", "50%", "75%"], by=["variable"])
    wide = basic.join(q, "variable")
    stats = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    return wide.unpivot(["variable"], [F.col(f"`{s_}`") for s_ in stats], "stat", "value")


def histogram(df: DataFrame, col: str, bins: int = 20, by: list[str] = ()) -> DataFrame:
    """Equal-width histogram between min and max, last bin closed (as NumPy).
    Two passes: the (per-group) extent, broadcast back (one row per group), then counts per bin."""
    ext = df.groupBy(*by).agg(F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = df.crossJoin(F.broadcast(ext)) if not by else null_safe_join(df, ext, list(by))
    w = (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    b = F.least(F.floor(F.try_divide(F.col(col) - F.col("_mn"), w)), F.lit(bins - 1))
    j = j.withColumn("bin", F.coalesce(b, F.lit(0)).cast("bigint"))
    g = j.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("_mn").alias("_mn"), F.first("_mx").alias("_mx"))
    w = (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    return g.select(*by, "bin", "n", (F.col("_mn") + F.col("bin") * w).alias("lo"),
                    (F.col("_mn") + (F.col("bin") + 1) * w).alias("hi"))


def box_stats(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Box-plot numbers per group: quartiles, IQR, whiskers (extreme values within 1.5 IQR),
    outlier count and notch (median +- 1.57 IQR / sqrt(n)). Quartiles are one row per
    group (bounded by the number of groups), joined for the second pass; a null group is a group."""
    d = df.select(*by, F.col(col).alias("_v"))
    q = quantile_columns(d, "_v", [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=by)
    q = null_safe_join(q, d.groupBy(*by).agg(F.count("_v").alias("n")), list(by))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = null_safe_join(d, q, list(by))
    lo, hi = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    v = F.col("_v")
    w = j.groupBy(*by).agg(F.min(F.when(v >= lo, v)).alias("whisker_lo"), F.max(F.when(v <= hi, v)).alias("whisker_hi"),
                           F.count(F.when((v < lo) | (v > hi), 1)).alias("n_outliers"))
    out = null_safe_join(q, w, list(by))
    notch = 1.57 * F.col("iqr") / F.sqrt(F.col("n"))
    return out.withColumn("notch_lo", F.col("median") - notch).withColumn("notch_hi", F.col("median") + notch)


def normal_grid(m: int = 20) -> list[tuple[int, float, float]]:
    """(i, p_i, z_i) with p_i = (i - 0.5) / m and z_i the standard normal quantile (m literals)."""
    from statistics import NormalDist
    nd = NormalDist()
    return [(i, (i - 0.5) / m, nd.inv_cdf((i - 0.5) / m)) for i in range(1, m + 1)]


def qq_grid(df: DataFrame, col: str, m: int = 20) -> DataFrame:
    """Sample quantiles of ``col`` at m probability points against normal quantiles (exact
    quantiles; the grid itself is m literal rows)."""
    grid = normal_grid(m)
    q = exact_quantiles(df, col, [p for _, p, _ in grid])
    theo = df.sparkSession.createDataFrame([(i - 1, z) for i, _, z in grid], "q_idx int, theo_q double")
    return q.join(F.broadcast(theo), "q_idx").select((F.col("q_idx") + 1).cast("bigint").alias("i"), "p",
                                                      F.col("value").alias("sample_q"), "theo_q")


def extents(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Common axis range of two columns per group."""
    return df.groupBy(*by).agg(F.min(F.least(a, b)).alias("lo"), F.max(F.greatest(a, b)).alias("hi"))


def fit_line(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares line y ~ x per group (slope, intercept, r)."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                               F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
