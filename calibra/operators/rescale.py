"""Moment matching of the noisy sensors to the trusted one.

scale = sd(ref) / sd(s)  (sample std), offset = mean(ref) - mean(s) * scale.

Parameters are computed from training rows only. For K folds or G held-out
groups, per-group moments are aggregated once (one shuffle, partial
aggregation) and the training moments of every split come out as
"total minus group" — no split rescans the data. Moments are centred on the
overall mean before subtraction so large offsets do not cancel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import rescaled

SENSORS = ("s2", "s3")


def _param_cols(ref_mean, ref_sd, means: dict, sds: dict, sensors=SENSORS):
    out = []
    for s in sensors:
        scale = F.try_divide(ref_sd, sds[s])
        out += [scale.alias(f"{s}_scale"), (ref_mean - means[s] * scale).alias(f"{s}_offset")]
    return out


def rescale_params(df: DataFrame, ref: str = "ref", sensors=SENSORS, by: list[str] = ()) -> DataFrame:
    """One row of parameters (or one per ``by`` group) fitted on the given rows."""
    aggs = [F.avg(ref).alias("_m_ref"), F.stddev_samp(ref).alias("_sd_ref")]
    for s in sensors:
        aggs += [F.avg(s).alias(f"_m_{s}"), F.stddev_samp(s).alias(f"_sd_{s}")]
    g = df.groupBy(*by).agg(*aggs)
    return g.select(*by, *_param_cols(F.col("_m_ref"), F.col("_sd_ref"),
                                      {s: F.col(f"_m_{s}") for s in sensors},
                                      {s: F.col(f"_sd_{s}") for s in sensors}, sensors))


def apply_params(df: DataFrame, params: DataFrame, on: str | None = None, sensors=SENSORS,
                 keep_params: bool = False) -> DataFrame:
    """Attach parameters to every row and add ``{s}_r`` columns.

    ``params`` has one row (``on=None``) or one row per key (fold ids): its size is
    bounded by the number of folds, so it is broadcast.
    """
    p = F.broadcast(params)
    j = df.crossJoin(p) if on is None else df.join(p, on, "inner")
    j = j.withColumns({f"{s}_r": rescaled(s) for s in sensors})
    if not keep_params:
        j = j.drop(*[f"{s}_{k}" for s in sensors for k in ("scale", "offset")])
    return j


def group_moments(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Per-group count, mean and centred second moment M2 = n * var_pop of each column.

    One scan with Spark's numerically stable mean/variance aggregates; one row per group.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), (F.var_pop(c) * F.count(c)).alias(f"q_{c}")]
    return df.groupBy(group).agg(*aggs)


def leave_out_params(df: DataFrame, group: str, ref: str = "ref", sensors=SENSORS) -> DataFrame:
    """Rescale parameters fitted on all rows *except* each group (leave-one-group-out and K-fold).

    Group moments are combined into totals (M2 = sum M2_g + sum n_g (m_g - m)^2) and
    each complement is total minus group:
    m_t = m + n_g (m - m_g) / n_t,  M2_t = M2 - M2_g - n_g (m_g - m)^2 - n_t (m_t - m)^2.
    One scan of the data for any number of groups; one row per group out. A group
    whose complement has < 2 rows gets NULL parameters.
    """
    cols = [ref, *sensors]
    g = group_moments(df, group, cols)
    tot = g.agg(F.sum("n").alias("tot_n"), *[F.try_divide(F.sum(F.col("n") * F.col(f"m_{c}")), F.sum("n")).alias(f"tm_{c}")
                                         for c in cols])
    j = g.crossJoin(F.broadcast(tot))
    tot2 = j.agg(*[F.sum(F.col(f"q_{c}") + F.col("n") * (F.col(f"m_{c}") - F.col(f"tm_{c}")) ** 2).alias(f"tq_{c}")
                   for c in cols])
    j = j.crossJoin(F.broadcast(tot2))
    nt = F.col("tot_n") - F.col("n")
    mean, sd = {}, {}
    for c in cols:
        mt = F.col(f"tm_{c}") + F.try_divide(F.col("n") * (F.col(f"tm_{c}") - F.col(f"m_{c}")), nt)
        q = (F.col(f"tq_{c}") - F.col(f"q_{c}") - F.col("n") * (F.col(f"m_{c}") - F.col(f"tm_{c}")) ** 2
             - nt * (mt - F.col(f"tm_{c}")) ** 2)
        mean[c] = mt
        sd[c] = F.when(nt > 1, F.sqrt(F.greatest(F.try_divide(q, nt - 1), F.lit(0.0))))
    return j.select(F.col(group), nt.alias("n_train"),
                    *_param_cols(mean[ref], sd[ref], {s: mean[s] for s in sensors},
                                 {s: sd[s] for s in sensors}, sensors))


def leave_out_means(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Mean of each column over all rows *outside* each group (one scan, one row per group):
    m_t = m + n_g (m - m_g) / n_t. Used for out-of-fold biases and baselines."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m_{c}") for c in cols]
    g = df.groupBy(group).agg(*aggs)
    tot = g.agg(F.sum("n").alias("tot_n"),
                *[F.try_divide(F.sum(F.col("n") * F.col(f"m_{c}")), F.sum("n")).alias(f"tm_{c}") for c in cols])
    j = g.crossJoin(F.broadcast(tot))
    nt = F.col("tot_n") - F.col("n")
    return j.select(group, nt.alias("n_out"),
                    *[(F.col(f"tm_{c}") + F.try_divide(F.col("n") * (F.col(f"tm_{c}") - F.col(f"m_{c}")), nt)).alias(c)
                      for c in cols])
