"""Cleaning and classification operators (complete cases, classes, flags, zones)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bands import CLASS_CUTS, CLASS_LABELS, class_ordinal, right_closed_class
from ..functions.scalar import agree_flag

VALUE_COLS = ["ref", "s2", "s3", "y"]


def complete_cases(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Keep rows where every listed column is present (NULL-free); pushed to the scan as IsNotNull."""
    cond = None
    for c in cols or VALUE_COLS:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return df.filter(cond)


def class_by_value(df: DataFrame, value: str = "y", cuts=CLASS_CUTS, labels=CLASS_LABELS,
                   out: str = "cls") -> DataFrame:
    """Row-level class from right-closed bins over the value; <= 0 -> NULL."""
    return (df.withColumn(out, right_closed_class(value, cuts, labels))
              .withColumn(f"{out}_ord", class_ordinal(out, labels)))


def site_means(df: DataFrame, site: str = "site", value: str = "y") -> DataFrame:
    """Mean of the value per site (partial aggregation before the shuffle)."""
    return df.groupBy(site).agg(F.avg(value).alias("site_mean"), F.count(F.lit(1)).alias("site_n"))


def class_by_site_mean(df: DataFrame, site: str = "site", value: str = "y", cuts=CLASS_CUTS,
                       labels=CLASS_LABELS, out: str = "cls") -> DataFrame:
    """Class of each row's site, from the site mean (mean <= c1 low, <= c2 mid, else high).

    The per-site table is one row per site (partial aggregation, one shuffle of
    per-site partials). The number of sites is data-dependent, so the table is
    attached by ``joins.attach``: broadcast when its checked row count is small,
    a shuffled join (AQE skew splitting) otherwise. A window over the site would
    shuffle every row instead.
    """
    from .joins import attach
    m = site_means(df, site, value).select(
        site, right_closed_class("site_mean", cuts, labels, null_at_or_below_zero=False).alias(out))
    return attach(df, m, site, "left").withColumn(f"{out}_ord", class_ordinal(out, labels))


def with_agree_flag(df: DataFrame, cuts=(50.0, 500.0, 1000.0), out: str = "all_agree") -> DataFrame:
    return df.withColumn(out, agree_flag("ref", "s2", "s3", cuts))


# The study's sensor cuts separating the reliable zone from the extreme zone.
ZONE_CUTS = (500.0, 1000.0)


def zone_expr(s2: str = "s2", s3: str = "s3", cuts=ZONE_CUTS):
    return F.when((F.col(s2) < cuts[0]) & (F.col(s3) < cuts[1]), F.lit("reliable")).otherwise(F.lit("extreme"))


def with_zone(df: DataFrame, cuts=ZONE_CUTS, out: str = "zone") -> DataFrame:
    """One pass: label each row reliable/extreme instead of splitting into two frames."""
    return df.withColumn(out, zone_expr("s2", "s3", cuts))
