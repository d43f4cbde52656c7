"""Named feature sets as plain projections (F1-F7) and the population-std scaler (F8).

A feature set is an ordered list of ``(name, Column)``; ``project`` turns it into
a ``select``. Rescaled sets read per-row parameter columns ``s2_scale, s2_offset,
s3_scale, s3_offset`` (joined from a broadcast params table: one row for a plain
fit, one row per fold for cross-validation), so the same projection serves every
validation scheme.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import agree_flag, guarded_ratio, log1p, row_mean3, row_median3, row_std3, sqrt_abs, square

Feature = tuple[str, Column]


def rescaled(sensor: str) -> Column:
    return F.col(sensor) * F.col(f"{sensor}_scale") + F.col(f"{sensor}_offset")


def raw3() -> list[Feature]:
    return [("ref", F.col("ref")), ("s2", F.col("s2")), ("s3", F.col("s3"))]


def ext16(flag_cuts=(50.0, 500.0, 1000.0)) -> list[Feature]:
    r, a, b = F.col("ref"), F.col("s2"), F.col("s3")
    la, lb = log1p(a), log1p(b)
    return raw3() + [
        ("log_s2", la), ("log_s3", lb), ("sqrt_ref", sqrt_abs(r)),
        ("s2_div_ref", guarded_ratio(a, r)), ("s3_div_ref", guarded_ratio(b, r)), ("s3_div_s2", guarded_ratio(b, a)),
        ("ref_x_log_s2", r * la), ("ref_x_log_s3", r * lb), ("ref_sq", square(r)),
        ("all_agree", agree_flag(r, a, b, flag_cuts)),
        ("mean3", row_mean3(r, a, b)), ("std3", row_std3(r, a, b)), ("median3", row_median3(r, a, b)),
    ]


def orig16() -> list[Feature]:
    r, a, b = F.col("ref"), F.col("s2"), F.col("s3")
    la, lb = log1p(a), log1p(b)
    return raw3() + [
        ("log_s2", la), ("log_s3", lb), ("sqrt_ref", sqrt_abs(r)),
        ("s2_div_ref", guarded_ratio(a, r)), ("s3_div_ref", guarded_ratio(b, r)), ("s3_div_s2", guarded_ratio(b, a)),
        ("s2_x_ref", a * r / 1000), ("s3_x_ref", b * r / 1000), ("ref_sq", square(r)), ("ref_x_log_s2", r * la),
        ("mean3", row_mean3(r, a, b)), ("std3", row_std3(r, a, b)), ("median3", row_median3(r, a, b)),
    ]


def figure10() -> list[Feature]:
    r, a, b = F.col("ref"), F.col("s2"), F.col("s3")
    return raw3() + [
        ("log_s2", log1p(a)), ("log_s3", log1p(b)),
        ("s2_div_ref", guarded_ratio(a, r)), ("s3_div_ref", guarded_ratio(b, r)),
        ("s2_x_ref", a * r), ("s3_x_ref", b * r), ("ref_sq", square(r)),
    ]


def rescaled8() -> list[Feature]:
    r, a, b = F.col("ref"), rescaled("s2"), rescaled("s3")
    return [
        ("ref", r), ("s2_r", a), ("s3_r", b), ("mean_r", row_mean3(r, a, b)), ("std_r", row_std3(r, a, b)),
        ("s2_r_x_ref", a * r / 100), ("s3_r_x_ref", b * r / 100), ("ref_sq", square(r)),
    ]


def rescaled16() -> list[Feature]:
    r, a, b = F.col("ref"), rescaled("s2"), rescaled("s3")
    la = log1p(a)
    return [
        ("ref", r), ("s2_r", a), ("s3_r", b), ("log_s2_r", la), ("log_s3_r", log1p(b)), ("sqrt_ref", sqrt_abs(r)),
        ("s2_r_div_ref", guarded_ratio(a, r)), ("s3_r_div_ref", guarded_ratio(b, r)),
        ("s3_r_div_s2_r", guarded_ratio(b, a)),
        ("s2_r_x_ref", a * r / 100), ("s3_r_x_ref", b * r / 100), ("ref_sq", square(r)), ("ref_x_log_s2_r", r * la),
        ("mean_r", row_mean3(r, a, b)), ("std_r", row_std3(r, a, b)), ("median_r", row_median3(r, a, b)),
    ]


def optimized10() -> list[Feature]:
    r, a, b = F.col("ref"), rescaled("s2"), rescaled("s3")
    return [
        ("ref", r), ("s2_r", a), ("s3_r", b), ("mean_r", row_mean3(r, a, b)), ("median_r", row_median3(r, a, b)),
        ("s2_r_x_ref", a * r / 100), ("s3_r_x_ref", b * r / 100), ("ref_sq", square(r)), ("sqrt_ref", sqrt_abs(r)),
        ("s3_r_div_ref", guarded_ratio(b, r)),
    ]


SETS = {"raw3": raw3, "ext16": ext16, "orig16": orig16, "figure10": figure10,
        "rescaled8": rescaled8, "rescaled16": rescaled16, "optimized10": optimized10}
RESCALED_SETS = {"rescaled8", "rescaled16", "optimized10"}


def feature_set(name: str, **kw) -> list[Feature]:
    return SETS[name](**kw)


def names(name: str, **kw) -> list[str]:
    return [n for n, _ in feature_set(name, **kw)]


def project(df: DataFrame, feats: list[Feature], keep: list[str] = ()) -> DataFrame:
    """Select ``keep`` columns plus the features (one codegen'd projection)."""
    return df.select(*[F.col(c) for c in keep], *[c.alias(n) for n, c in feats])


def complete_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows where a feature is NULL (e.g. log1p of a rescaled value below -1)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(c)
    return df.filter(cond)
