"""Per-row expressions (all built-in, whole-stage-codegen friendly Column code).

Spark runs with ANSI mode on, so plain ``/`` by zero raises; every ratio here is
either guarded by an epsilon (as the study does) or uses ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guard added to a denominator in the study's ratios, and the
# floor for the measured value in the guarded percentage error.
RATIO_EPS = 1e-5
APE_FLOOR = 1e-6


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log1p(c) -> Column:
    """log(1+x); NULL where x <= -1 (the row is then excluded by complete-case logic)."""
    return F.log1p(col(c))


def sqrt_abs(c) -> Column:
    return F.sqrt(F.abs(col(c)))


def square(c) -> Column:
    c = col(c)
    return c * c


def guarded_ratio(a, b, eps: float = RATIO_EPS) -> Column:
    """a / (b + eps); NULL instead of an error if b + eps is exactly zero."""
    return F.try_divide(col(a), col(b) + F.lit(eps))


def row_mean3(a, b, c) -> Column:
    return (col(a) + col(b) + col(c)) / 3


def row_std3(a, b, c) -> Column:
    """Sample standard deviation of three values (ddof=1)."""
    m = row_mean3(a, b, c)
    da, db, dc = col(a) - m, col(b) - m, col(c) - m
    return F.sqrt((da * da + db * db + dc * dc) / 2)


def row_median3(a, b, c) -> Column:
    """Exact median of three values without building an array."""
    a, b, c = col(a), col(b), col(c)
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def affine(c, scale, offset) -> Column:
    return col(c) * col(scale) + col(offset)


def ape(y, pred, floor: float = APE_FLOOR) -> Column:
    """Absolute percentage error as a fraction, denominator floored at ``floor``."""
    return F.abs(col(y) - col(pred)) / F.greatest(col(y), F.lit(floor))


def pct_improvement(base, x) -> Column:
    return F.try_divide((col(base) - col(x)) * 100, col(base))


def residual(y, pred) -> Column:
    return col(y) - col(pred)


def month_key(d) -> Column:
    return F.trunc(col(d), "MM")


def month_label(d) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def tex_escape(c) -> Column:
    return F.replace(col(c), F.lit("_"), F.lit("\\_"))


def short_label(c, n: int = 4) -> Column:
    return F.left(col(c), F.lit(n))


def agree_flag(ref, s2, s3, cuts=(50.0, 500.0, 1000.0)) -> Column:
    """1 when all three sensors sit below their cut (the study's reliability flag)."""
    return ((col(ref) < cuts[0]) & (col(s2) < cuts[1]) & (col(s3) < cuts[2])).cast("int")
