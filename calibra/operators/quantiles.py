"""Exact quantiles (linear interpolation, as ``percentile`` / ``np.percentile``) by multi-group radix selection.

Spark's exact ``percentile`` keeps all distinct values of a group in one buffer. Here every value becomes a 64-bit key
of the same order, and all (group, probability) targets are narrowed together in three passes over one stored column:

1. histogram of the keys' upper 22 bits per group; a running count over the buckets finds the bucket of each target;
2. histogram of the next 21 bits of the rows in those buckets only;
3. counts of the single keys left, which are the order statistics around position (n - 1) p.

Every pass is a map-side aggregate; a running count covers buckets of one group, never rows. There is one plan for
all group sizes, no sketch and no bound on a group: a value repeated by a third of all rows is one key.

Null values take no part, NaN is above all numbers (as in Spark's order), null groups are groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

HIGH, MID = 42, 21  # bits below the first and the second histogram's buckets


def order_key(c: Column) -> Column:
    """A long that orders as the double does: exponent and fraction, negated for negative numbers."""
    a = F.abs(c)
    two = F.lit(2.0)
    guess = F.floor(F.log2(a))
    # the logarithm may be rounded across a power of two
    e = (F.when(F.pow(two, guess) > a, guess - 1).when(F.pow(two, guess + 1) <= a, guess + 1).otherwise(guess)).cast("long")
    normal = F.shiftleft(e + 1023, 52) + ((a / F.pow(two, e) - 1) * F.lit(float(2 ** 52))).cast("long")
    tiny = (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")  # below 2 ** -1022: multiples of 2 ** -1074
    size = (F.when(F.isnan(c), F.lit((1 << 63) - 1)).when(a == float("inf"), F.lit(2047 << 52))
            .when(a < 2.0 ** -1022, tiny).otherwise(normal))
    return F.when(c < 0, -size).otherwise(size)


def _found(hist: DataFrame, keys: list[str], bucket: str, targets: DataFrame | None, probs: list[float]) -> DataFrame:
    """Targets narrowed to the bucket that holds their rank; ``rank`` becomes the rank within it."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    run = w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    h = hist.withColumn("_cum", F.sum("_c").over(run))
    if targets is None:
        h = h.withColumn("n", F.sum("_c").over(w))
        sides = [F.struct(F.lit(i).alias("q_idx"), F.lit(float(p)).alias("p"), F.lit(up).alias("up"))
                 for i, p in enumerate(probs) for up in (False, True)]
        h = h.withColumn("_t", F.explode(F.array(*sides))).select(*h.columns, "_t.*")
        at = (F.col("n") - 1) * F.col("p")
        h = h.withColumn("rank", F.when(F.col("up"), F.ceil(at)).otherwise(F.floor(at)).cast("long"))
    else:
        h = null_safe_join(h, targets, keys)
    before = F.col("_cum") - F.col("_c")
    return h.filter((before <= F.col("rank")) & (F.col("rank") < F.col("_cum"))).withColumn(
        "rank", F.col("rank") - before).drop("_c", "_cum")


def exact_quantiles(df: DataFrame, col: str | Column, probs: list[float], by: list[str] = ()) -> DataFrame:
    """One row per (group, probability): by..., q_idx (0-based), p, n, value. No row for a group without a value."""
    by = list(by)
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    x = staged(df.select(*by, c.alias("_v")).filter(F.col("_v").isNotNull()).withColumn("_k", order_key(F.col("_v"))))
    high, mid = F.shiftright("_k", HIGH).alias("_b1"), F.shiftright("_k", MID).alias("_b2")
    x = x.select(*by, high, mid, "_k", "_v")
    count = F.count(F.lit(1)).alias("_c")
    t1 = _found(x.groupBy(*by, "_b1").agg(count), by, "_b1", None, probs)
    x2 = null_safe_join(x, t1.select(*by, "_b1").distinct(), [*by, "_b1"])
    t2 = _found(x2.groupBy(*by, "_b1", "_b2").agg(count), [*by, "_b1"], "_b2", t1, probs)
    x3 = null_safe_join(x, t2.select(*by, "_b2").distinct(), [*by, "_b2"])
    t3 = _found(x3.groupBy(*by, "_b2", "_k").agg(count, F.min("_v").alias("_v")), [*by, "_b2"], "_k",
                t2.drop("_b1"), probs)
    got = t3.groupBy(*by, "q_idx").agg(
        F.first("p").alias("p"), F.first("n").alias("n"), F.min(F.when(~F.col("up"), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("up"), F.col("_v"))).alias("_hi"))
    at = (F.col("n") - 1) * F.col("p")
    value = F.when(F.floor(at) == F.ceil(at), F.col("_lo")).otherwise(
        (F.ceil(at) - at) * F.col("_lo") + (at - F.floor(at)) * F.col("_hi"))
    return got.select(*by, "q_idx", "p", "n", value.alias("value"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys``, null equal to null."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # no groups: the right side is a row per target
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    return left.join(r, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]).drop(*[f"_r_{k}" for k in keys])


def quantile_columns(df: DataFrame, col: str | Column, probs: list[float], names: list[str],
                     by: list[str] = ()) -> DataFrame:
    """Wide form: by..., one column per probability (named by ``names``)."""
    q = exact_quantiles(df, col, probs, by)
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("q_idx") == i, F.col("value"))).alias(nm)
                                for i, nm in enumerate(names)])
