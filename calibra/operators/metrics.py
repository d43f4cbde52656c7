"""Error metrics as one-pass aggregates over a long predictions table.

A predictions table has one row per (observation, model) with ``y`` and ``pred``.
Every metric of the bundle comes out of a single ``agg`` (partial aggregation
on the map side, one shuffle on the grouping keys), so scoring any number of
models, classes, folds or sites is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import APE_FLOOR

METRICS = ["n", "rmse", "mae", "r2", "mape", "mbe", "max_error"]


def to_long(df: DataFrame, preds: dict[str, Column | str], ids: list[str],
            model_col: str = "model", pred_col: str = "pred") -> DataFrame:
    """Stack several prediction columns into (ids..., model, pred) rows (narrow, no shuffle)."""
    wide = df.select(*ids, *[(F.col(v) if isinstance(v, str) else v).cast("double").alias(f"__p{i}")
                             for i, v in enumerate(preds.values())])
    names = list(preds)
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias(model_col), F.col(f"__p{i}").alias(pred_col))
                                  for i, n in enumerate(names)]))
    return wide.select(*ids, stacked.alias("__s")).select(*ids, f"__s.{model_col}", f"__s.{pred_col}")


def metric_aggs(y: str = "y", pred: str = "pred", ape_floor: float = APE_FLOOR) -> list[Column]:
    """Only rows with both values count, in ``n`` and in the variance too."""
    e = F.col(y) - F.col(pred)
    return [
        F.count(e).alias("n"),
        F.sum(e * e).alias("_sse"),
        F.avg(e * e).alias("_mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.col(y), F.lit(ape_floor))).alias("_mape"),
        F.avg(F.col(pred) - F.col(y)).alias("mbe"),
        F.max(F.abs(e)).alias("max_error"),
        F.var_pop(F.when(F.col(pred).isNotNull(), F.col(y))).alias("_var_y"),
    ]


def finish_metrics(agg: DataFrame, keys: list[str]) -> DataFrame:
    """R2 = 1 - SSE / SST with SST = n * var_pop(y) (stable merge of moments); NULL when n < 2 or
    y is constant, as a one-row or flat group has no defined R2."""
    return agg.select(
        *keys, "n",
        F.sqrt("_mse").alias("rmse"),
        "mae",
        F.when((F.col("n") > 1) & (F.col("_var_y") > 0),
               F.lit(1.0) - F.col("_sse") / (F.col("_var_y") * F.col("n"))).alias("r2"),
        (F.col("_mape") * 100).alias("mape"),
        "mbe", "max_error",
    )


def metric_bundle(preds: DataFrame, keys: list[str], y: str = "y", pred: str = "pred",
                  ape_floor: float = APE_FLOOR) -> DataFrame:
    """n, RMSE, MAE, R2, MAPE (%), MBE (pred - y), max |error| per key group."""
    g = preds.groupBy(*keys) if keys else preds.groupBy()
    return finish_metrics(g.agg(*metric_aggs(y, pred, ape_floor)), keys)


def metrics_rollup(preds: DataFrame, outer: list[str], inner: list[str], y: str = "y",
                   pred: str = "pred", all_label: str = "ALL") -> DataFrame:
    """Overall and per-``inner`` metrics in one pass: GROUPING SETS ((outer), (outer, inner))."""
    keys = outer + inner
    g = preds.groupingSets([[F.col(k) for k in outer], [F.col(k) for k in keys]], *keys)
    agg = g.agg(*metric_aggs(y, pred), *[F.grouping(k).alias(f"_g_{k}") for k in inner])
    agg = agg.withColumns({k: F.when(F.col(f"_g_{k}") == 1, F.lit(all_label)).otherwise(F.col(k).cast("string"))
                           for k in inner})
    return finish_metrics(agg, keys)


def summarize_folds(per_fold: DataFrame, keys: list[str], metrics=("rmse", "mae", "r2"),
                    population: bool = True) -> DataFrame:
    """Mean and std of fold metrics (population std, as the study's fold summary);
    NULL metrics are skipped, never turned into NaN."""
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), sd(m).alias(f"{m}_std")]
    return per_fold.groupBy(*keys).agg(*aggs)
