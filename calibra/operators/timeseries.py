"""Monthly profile (A6) and every-k-th label selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import month_key, month_label


def monthly_profile(df: DataFrame, date: str = "obs_date") -> DataFrame:
    """Per month: mean, sample std (NULL for one row) and count of y, and the sensors' means."""
    return (df.withColumn("month", month_key(date)).groupBy("month")
              .agg(F.avg("y").alias("mean_y"), F.stddev_samp("y").alias("std_y"), F.count(F.lit(1)).alias("n"),
                   F.avg("ref").alias("mean_ref"), F.avg("s2").alias("mean_s2"), F.avg("s3").alias("mean_s3")))


def tick_labels(months: DataFrame, target: int = 10) -> DataFrame:
    """Every step-th month (step = max(1, n_months // target)), with its yyyy-MM label.

    Runs on the month table (one row per month, small); the single-partition window
    is over that table only, never over observations."""
    w = Window.orderBy("month")
    m = months.select("month").withColumn("pos", F.row_number().over(w))
    n = months.agg(F.count(F.lit(1)).alias("_n"))
    m = m.crossJoin(F.broadcast(n)).withColumn("step", F.greatest(F.lit(1), F.expr(f"_n div {target}")))
    return (m.filter(F.pmod(F.col("pos") - 1, F.col("step")) == 0)
             .select("month", F.col("pos").cast("bigint").alias("pos"), month_label("month").alias("label")))
