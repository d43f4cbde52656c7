"""Closed-form predictors (M1, M2, a one-feature least-squares line, rescaled sensors).

Their fits are single aggregates (bias = mean(y - ref), slope/intercept via
``regr_slope``/``regr_intercept``, moment-matching parameters), so they can be fitted
for a holdout, every fold or every held-out group in one pass and scored exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .rescale import SENSORS, leave_out_means, leave_out_params, rescale_params

BASELINE_MODELS = ("ref", "s2", "s3", "ref_bias", "line_ref", "s2_r", "s3_r")


def fit_closed_form(train: DataFrame, by: list[str] = ()) -> DataFrame:
    """bias, line intercept/slope and rescale parameters, one row (per ``by`` group)."""
    g = train.groupBy(*by).agg(F.avg(F.col("y") - F.col("ref")).alias("bias"),
                               F.regr_intercept("y", "ref").alias("b0"), F.regr_slope("y", "ref").alias("b1"))
    p = rescale_params(train, by=by)
    return g.crossJoin(p) if not by else g.join(p, by)


def predictions(df: DataFrame, params: DataFrame, ids: list[str], on: list[str] | None = None,
                models=BASELINE_MODELS) -> DataFrame:
    """Long (ids..., model, y, pred) for the closed-form models; params are broadcast
    (one row, or one per fold: bounded)."""
    j = df.crossJoin(F.broadcast(params)) if not on else df.join(F.broadcast(params), on)
    exprs = {
        "ref": F.col("ref"), "s2": F.col("s2"), "s3": F.col("s3"),
        "ref_bias": F.col("ref") + F.col("bias"),
        "line_ref": F.col("b0") + F.col("b1") * F.col("ref"),
        "s2_r": F.col("s2") * F.col("s2_scale") + F.col("s2_offset"),
        "s3_r": F.col("s3") * F.col("s3_scale") + F.col("s3_offset"),
    }
    return M.to_long(j, {m: exprs[m] for m in models}, ids=[*ids, "y"])


def leave_out_fit(df: DataFrame, group: str) -> DataFrame:
    """Closed-form fits on the complement of every group (bias and rescale parameters), one
    row per group from one pass of group moments."""
    d = df.withColumn("_d", F.col("y") - F.col("ref"))
    b = leave_out_means(d, group, ["_d"]).select(group, F.col("_d").alias("bias"))
    p = leave_out_params(df, group).drop("n_train")
    return b.join(p, group)


def leave_out_predictions(df: DataFrame, group: str, ids: list[str],
                          models=("ref", "ref_bias", "s2_r", "s3_r")) -> DataFrame:
    """Each row predicted by the models fitted without its group (k-fold or leave-one-group-out).

    The per-group fit table is one row per group; folds are few, held-out groups such as
    sites are not bounded, so it is attached with a checked size (``joins.attach``).
    """
    from .joins import attach
    fits = leave_out_fit(df, group)
    j = attach(df, fits, group)
    exprs = {
        "ref": F.col("ref"), "ref_bias": F.col("ref") + F.col("bias"),
        "s2_r": F.col("s2") * F.col("s2_scale") + F.col("s2_offset"),
        "s3_r": F.col("s3") * F.col("s3_scale") + F.col("s3_offset"),
    }
    return M.to_long(j, {m: exprs[m] for m in models}, ids=[*ids, "y"])


__all__ = ["BASELINE_MODELS", "fit_closed_form", "predictions", "leave_out_fit", "leave_out_predictions", "SENSORS"]
