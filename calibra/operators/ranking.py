"""Ranking, selection and matrices over result tables.

Result tables are small (models x classes x folds), but the operators are written
as partitioned DataFrame code all the same: windows are partitioned by the
grouping of the result (approach, model), never over observations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rank_by(df: DataFrame, metric: str, partition: list[str] = (), ascending: bool = True,
            tiebreak: str = "model", out: str = "rank") -> DataFrame:
    o = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    w = Window.partitionBy(*partition).orderBy(o, F.col(tiebreak))
    return df.withColumn(out, F.row_number().over(w).cast("bigint"))


def top_k(df: DataFrame, metric: str, k: int, ascending: bool = True, tiebreak: str = "model") -> DataFrame:
    """The k best rows (TakeOrderedAndProject: a bounded heap per partition, no full sort)."""
    o = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(o, F.col(tiebreak)).limit(k)


def best(df: DataFrame, metric: str = "rmse", key: str = "model") -> DataFrame:
    return top_k(df, metric, 1, tiebreak=key)


def valid(df: DataFrame, r2_floor: float = -2.0) -> DataFrame:
    """Drop degenerate models (R2 at or below the floor)."""
    return df.filter(F.col("r2") > r2_floor)


def preferred(spark: SparkSession, results: DataFrame, names: list[str], key: str = "model") -> DataFrame:
    """Keep the listed names in list order; names missing from the results stay visible with present = false."""
    order = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], f"pos bigint, {key} string")
    j = F.broadcast(order).join(results, key, "left")
    return j.withColumn("present", F.col("rmse").isNotNull())


def pivot_matrix(df: DataFrame, row: str, col: str, value: str, col_values: list[str]) -> DataFrame:
    """row x col matrix with explicit pivot values (no extra job to discover them)."""
    return df.groupBy(row).pivot(col, col_values).agg(F.first(value))


def best_worst(df: DataFrame, by: str, item: str, metric: str) -> DataFrame:
    return df.groupBy(by).agg(F.min_by(item, metric).alias(f"best_{item}"), F.max_by(item, metric).alias(f"worst_{item}"),
                              F.avg(metric).alias(f"mean_{metric}"))


# ------------------------------------------------------------------ importance tables

def importance_table(imp: DataFrame, group: list[str], feature: str = "feature", value: str = "importance") -> DataFrame:
    """share (%), rank, cumulative share per group from raw importances."""
    g = Window.partitionBy(*group)
    o = Window.partitionBy(*group).orderBy(F.col(value).desc(), F.col(feature))
    t = imp.withColumn("share_pct", F.try_divide(F.col(value) * 100, F.sum(value).over(g)))
    t = t.withColumn("rank", F.row_number().over(o).cast("bigint"))
    return t.withColumn("cum_pct", F.sum("share_pct").over(o.rowsBetween(Window.unboundedPreceding, 0)))


def features_needed(table: DataFrame, group: list[str], pct: float = 80.0) -> DataFrame:
    """Smallest rank whose cumulative share reaches ``pct``; NULL when it is never reached."""
    return table.groupBy(*group).agg(F.min(F.when(F.col("cum_pct") >= pct, F.col("rank"))).alias("n_features"))


def concentration(table: DataFrame, group: list[str], top: int = 5, above: float = 5.0) -> DataFrame:
    return table.groupBy(*group).agg(F.sum(F.when(F.col("rank") <= top, F.col("share_pct"))).alias(f"top{top}_pct"),
                                     F.count(F.when(F.col("share_pct") > above, 1)).alias("n_above"))
