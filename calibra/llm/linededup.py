"""Line dedup by site-relative frequency (DataFrame functions only).

Within a site, a line's frequency is the number of pages that contain it divided by the site's pages; pages of equal
text are one page of the site, so a text does not become boilerplate by its own copies. Lines above
``ratio`` (and on at least ``min_pages`` pages) are boilerplate and are dropped from every page of the site. The mean
number of distinct lines per page, divided by ``ratio``, bounds a site's boilerplate lines, so they fit one array
per site. White-space lines are never boilerplate. Lines are known by their MD5; counts are pre-aggregated before
they are shuffled by (site, line), so neither a hot site nor a hot line meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RATIO = 0.05
MIN_PAGES = 5
#: Boilerplate lines up to which the per-site arrays are broadcast (about 50 bytes each).
BROADCAST_LINES = 200_000


def site_key(c: Column) -> Column:
    """Null sites are one site of their own."""
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _worded(c: Column) -> Column:
    return c.rlike(r"[^\x20\x09-\x0D]")


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(__site, __lines): the MD5s of each site's boilerplate lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    site = docs.select(site_key(F.col(site_col)).alias("__site"), text.alias("__text"), F.unhex(F.md5(text)).alias("__page"))
    total = site.select("__site", "__page").distinct().groupBy("__site").agg(F.count(F.lit(1)).alias("__pages"))
    own = F.array_distinct(F.transform(F.filter(lines(F.col("__text")), _worded), F.md5))
    # a line of one page is counted once however often the page is copied: copies are gone before the counts meet
    per = (site.select("__site", "__page", F.explode(own).alias("__line")).distinct()
           .groupBy("__site", "__line").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_pages))
    return (per.join(total, "__site").where(F.col("__n") > ratio * F.col("__pages"))
            .groupBy("__site").agg(F.collect_list("__line").alias("__lines")))


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with the text's boilerplate lines removed, plus ``__n_lines`` and ``__n_dropped`` (long). A null text
    stays null with no lines; a text of boilerplate only becomes empty. Rows are never dropped."""
    found = stored(boilerplate(docs, site_col, text_col, ratio, min_pages))
    n = found.agg(F.coalesce(F.sum(F.size("__lines")), F.lit(0)).alias("n")).first()["n"]
    side = F.broadcast(found) if n <= BROADCAST_LINES else found  # beyond: a shuffled join that AQE splits
    d = docs.withColumn("__site", site_key(F.col(site_col))).join(side, "__site", "left")
    d = d.withColumn("__all", lines(F.col(text_col)))
    bad = F.col("__lines")
    d = d.withColumn("__left", F.when(bad.isNull(), F.col("__all")).otherwise(
        F.filter("__all", lambda x: ~F.array_contains(bad, F.md5(x)))))
    same = F.size("__left") == F.size("__all")
    cut = F.when(F.col(text_col).isNull() | same, F.col(text_col)).otherwise(F.array_join("__left", "\n"))
    none = F.col(text_col).isNull()
    return d.withColumns({
        "__n_lines": F.when(none, 0).otherwise(F.size("__all")).cast("long"),
        "__n_dropped": F.when(none, 0).otherwise(F.size("__all") - F.size("__left")).cast("long"),
        text_col: cut}).drop("__site", "__lines", "__all", "__left")
