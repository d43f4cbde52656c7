"""Kolmogorov-Smirnov statistics, exact and distributed.

The empirical distribution needs every value's global rank. Equal values are first counted together map-side; the
distinct values are dealt by ranges, so a partition holds neighbours and all partitions are in order. Each
partition's counts are summed up inside the partition and the totals of the partitions before it (one row a
partition) are joined back. The largest distance is then a plain aggregate: no global sort or window over rows.

Null and NaN values take no part; ties are one step of the distribution. A sample without values has no statistic.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

# The rational approximation 7.1.26 of the error function in Abramowitz and Stegun (error below 1.5e-7).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.when(z >= 0, (F.lit(1.0) + erf) / 2).otherwise((F.lit(1.0) - erf) / 2)


def kolmogorov_p(d: Column, n: Column, terms: int = 40) -> Column:
    """Asymptotic p-value with Stephens' small-sample correction; ``n`` is the effective sample size."""
    root = F.sqrt(n)
    lam = (root + 0.12 + F.lit(0.11) / root) * d
    tail = F.lit(0.0)
    for k in range(1, terms + 1):
        tail = tail + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def running_counts(df: DataFrame, value: str, counts: list[str]) -> DataFrame:
    """Distinct values with their ``counts`` and, as ``upto_<count>``, the running sums over all smaller or equal values."""
    dealt = staged(df.repartitionByRange(F.col(value)).select(value, *counts, F.spark_partition_id().alias("_part")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in counts]).select(
        "_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in counts])
    inside = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in counts}).join(F.broadcast(offsets), "_part")
    return summed.select(value, *counts, *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"upto_{c}") for c in counts])


def _values(df: DataFrame, col: str) -> DataFrame:
    v = F.col(col).cast("double")
    return df.select(v.alias("v")).filter(v.isNotNull() & ~F.isnan(v))


def one_sample(df: DataFrame, col: str, cdf: Callable[[Column], Column] | None = None) -> DataFrame:
    """n, d, p_value of the values of ``col`` against ``cdf``; by default the normal distribution with the sample's own
    mean and (sample) standard deviation (then the p-value is conservative)."""
    x = _values(df, col).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    r = running_counts(x, "v", ["c"])
    total = r.agg(F.sum("c").alias("n"), F.try_divide(F.sum(F.col("v") * F.col("c")), F.sum("c")).alias("m"))
    r = r.crossJoin(F.broadcast(total))
    if cdf is None:
        spread = r.agg(F.sqrt(F.try_divide(F.sum(F.col("c") * (F.col("v") - F.col("m")) ** 2), F.max("n") - 1)).alias("s"))
        r = r.crossJoin(F.broadcast(spread))
        p = normal_cdf(F.try_divide(F.col("v") - F.col("m"), F.col("s")))
    else:
        p = cdf(F.col("v"))
    gap = F.greatest(F.abs(F.col("upto_c") / F.col("n") - p), F.abs((F.col("upto_c") - F.col("c")) / F.col("n") - p))
    d = r.agg(F.max("n").alias("n"), F.max(gap).alias("d")).filter("n is not null")
    return d.select("n", "d", kolmogorov_p(F.col("d"), F.col("n")).alias("p_value"))


def two_sample(df: DataFrame, col: str, first: Column, second: Column) -> DataFrame:
    """n_first, n_second, d, p_value of the values of ``col`` in the rows where ``first`` and where ``second`` holds."""
    v = F.col(col).cast("double")
    both = df.select(v.alias("v"), F.coalesce(first, F.lit(False)).cast("long").alias("a"),
                     F.coalesce(second, F.lit(False)).cast("long").alias("b")).filter(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.col("a") + F.col("b") > 0))
    r = running_counts(both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "v", ["a", "b"])
    total = r.agg(F.sum("a").alias("n_first"), F.sum("b").alias("n_second"))
    gap = F.abs(F.try_divide(F.col("upto_a"), F.col("n_first")) - F.try_divide(F.col("upto_b"), F.col("n_second")))
    d = r.crossJoin(F.broadcast(total)).agg(F.max("n_first").alias("n_first"), F.max("n_second").alias("n_second"),
                                            F.max(gap).alias("d")).filter("n_first > 0 and n_second > 0")
    n = F.col("n_first") * F.col("n_second") / (F.col("n_first") + F.col("n_second"))
    return d.select("n_first", "n_second", "d", kolmogorov_p(F.col("d"), n).alias("p_value"))
