"""Validation splits as deterministic per-row expressions over an integer key.

No split shuffles or samples: a row's side (or fold) is a pure function of its
key, so a lost executor recomputes exactly the same assignment, and the same
integers come out of any SQL engine. Callers supply the key (``rk`` for the
driver view, or ``row_key(...)`` over any columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

KEY_SPACE = 1000003


def row_key(*cols: str, space: int = KEY_SPACE) -> Column:
    """A non-negative integer key from any columns (xxhash64 folded into [0, space))."""
    return F.pmod(F.xxhash64(*cols), F.lit(space))


def holdout_expr(key: str = "rk", test_frac: float = 0.3, stride: int = 5, buckets: int = 100) -> Column:
    """True for test rows: bucket (key div stride) mod buckets at or above the train share.
    The stride decorrelates the split from ``key mod k`` folds."""
    cut = int(round(buckets * (1 - test_frac)))
    return F.pmod(F.expr(f"`{key}` div {stride}"), F.lit(buckets)) >= cut


def holdout(df: DataFrame, key: str = "rk", test_frac: float = 0.3, out: str = "is_test") -> DataFrame:
    return df.withColumn(out, holdout_expr(key, test_frac))


def kfold(df: DataFrame, k: int = 5, key: str = "rk", out: str = "fold") -> DataFrame:
    """Fold = key mod k (the shuffled K-fold of the study, re-aimed as a hash split)."""
    return df.withColumn(out, F.pmod(F.col(key), F.lit(k)).cast("bigint"))


def inner_folds(df: DataFrame, k: int = 5, key: str = "rk", out: str = "inner_fold") -> DataFrame:
    """Folds inside a training set, taken from other key digits than the outer split."""
    return df.withColumn(out, F.pmod(F.expr(f"`{key}` div 500"), F.lit(k)).cast("bigint"))


def _cut(counts: DataFrame, strata: str, key: str) -> DataFrame:
    """Of a table of row counts ``_n`` per (stratum, key) with the stratum's ``_need`` (rows to take, smallest key first):
    per stratum the key where the running count reaches the need, and how many of its rows are still needed."""
    run = Window.partitionBy(strata).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("_cum", F.sum("_n").over(run)).withColumn("_prev", F.col("_cum") - F.col("_n"))
    return c.filter((F.col("_prev") < F.col("_need")) & (F.col("_cum") >= F.col("_need"))).select(
        strata, F.col(key).alias("_cut"), (F.col("_need") - F.col("_prev")).alias("_need"))


def _with(rows: DataFrame, per_stratum: DataFrame, strata: str) -> DataFrame:
    """Attach one row per stratum (classes: a few, by parameter); rows without a class are a stratum too."""
    p = per_stratum.withColumnRenamed(strata, "_stratum")
    return rows.join(F.broadcast(p), F.col(strata).eqNullSafe(F.col("_stratum")), "left").drop("_stratum")


def stratified_holdout(df: DataFrame, strata: str = "cls", key: str = "rk", test_frac: float = 0.3,
                       buckets: int = 1000, out: str = "is_test") -> DataFrame:
    """Exact stratified holdout: per stratum the ceil(test_frac * n) rows first in the order
    (bucket, key, remaining columns) go to test.

    The rows are staged and counted once per (stratum, bucket, key); the bucket, then the key inside it, where a
    class's quota ends are found on that table of counts by running sums over distinct values. The cuts, a row per
    class, are broadcast back: rows before a cut are test, rows after it train. Only rows that share the cut key are
    ranked, in a window partitioned by (stratum, key) — with keys drawn from a bounded key space that group is
    about n / key-space rows (a key holding a large share of all rows would make it one large, spillable sort task).
    """
    cols = list(df.columns)
    x = staged(df.withColumn("_b", F.pmod(F.expr(f"`{key}` div 7"), F.lit(buckets)).cast("bigint")))
    counts = staged(x.groupBy(strata, "_b", key).agg(F.count(F.lit(1)).alias("_n")))
    need = counts.groupBy(strata).agg(F.ceil(F.sum("_n") * F.lit(test_frac)).alias("_need"))
    by_bucket = _with(counts.groupBy(strata, "_b").agg(F.sum("_n").alias("_n")), need, strata)
    first = _cut(by_bucket, strata, "_b")
    inside = _with(counts, first, strata).filter(F.col("_b") == F.col("_cut")).drop("_b", "_cut")
    cuts = first.select(F.col(strata).alias("_s"), F.col("_cut").alias("_cut_b")).join(
        _cut(inside, strata, key), F.col("_s").eqNullSafe(F.col(strata))).drop("_s")
    x = _with(x, staged(cuts.withColumnRenamed("_cut", "_cut_key")), strata)
    b, k = F.col("_b"), F.col(key)
    at_cut = F.coalesce((b == F.col("_cut_b")) & (k == F.col("_cut_key")), F.lit(False))
    before = F.coalesce((b < F.col("_cut_b")) | ((b == F.col("_cut_b")) & (k < F.col("_cut_key"))), F.lit(False))
    decided = x.filter(~at_cut).withColumn(out, before)
    rest = [c for c in cols if c not in (strata, key)]
    rank = F.row_number().over(Window.partitionBy(strata, key).orderBy(*[F.col(f"`{c}`") for c in rest]))
    tied = x.filter(at_cut).withColumn(out, rank <= F.col("_need"))
    return decided.select(*cols, out).unionByName(tied.select(*cols, out))


def stratified_kfold(df: DataFrame, strata: str = "cls", k: int = 5, key: str = "rk", out: str = "fold",
                     ranges: int = 4096, space: int = KEY_SPACE) -> DataFrame:
    """K-fold whose folds share every class evenly: per class (a null class is one) the rows in order of key, then of
    the other columns, go to folds 0, 1, ..., k - 1 in turn, so sizes of a class differ by at most one.

    A row's rank is the number of rows of its class in earlier key ranges (a table of classes x ``ranges`` counts) plus
    its place within its own range, so no task sorts a whole class. Keys are in [0, space)."""
    width = -(-space // ranges)
    x = df.withColumn("_range", F.expr(f"`{key}` div {width}"))
    before = Window.partitionBy(strata).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = x.groupBy(strata, "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(strata).alias("_stratum"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    rest = [c for c in df.columns if c not in (strata, key)]
    place = F.row_number().over(Window.partitionBy(strata, "_range").orderBy(key, *[F.col(f"`{c}`") for c in rest])) - 1
    j = x.withColumn("_place", place).join(offset, F.col(strata).eqNullSafe(F.col("_stratum")) & F.col("_range").eqNullSafe(F.col("_r")))
    return j.withColumn(out, F.pmod(F.col("_off") + F.col("_place"), F.lit(k)).cast("bigint")).select(*df.columns, out)
