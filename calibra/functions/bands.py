"""Threshold bands and class labels as when-chains (codegen'd, no UDF).

Spark's ``Bucketizer`` is left-closed; the study's bins are right-closed and its
metric bands use strict comparisons, so the chains are written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

# Class labels (low -> high) and the study's cuts on the measured value.
CLASS_LABELS = ("Mesotrophic", "Eutrophic", "Hypertrophic")
CLASS_CUTS = (25.0, 75.0)

# Metric band cuts used by the study's summaries (strict comparisons).
RMSE_BANDS = {"cv": (35.0, 40.0), "figure": (30.0, 50.0), "ensemble": (40.0, 100.0)}
R2_BANDS = {"cv": (0.6, 0.4), "ensemble": (0.8, 0.5)}
IMPORTANCE_BANDS = (10.0, 5.0)
BAND_LABELS = ("good", "fair", "poor")


def right_closed_class(v, cuts=CLASS_CUTS, labels=CLASS_LABELS, null_at_or_below_zero=True) -> Column:
    """(0,c1] -> labels[0], (c1,c2] -> labels[1], (c2,inf) -> labels[2].

    With ``null_at_or_below_zero`` values <= 0 get NULL, as right-closed binning
    starting at 0 does; without it (site-mean rule) everything <= c1 is the lowest class.
    """
    v = col(v)
    chain = F.when(v.isNull(), F.lit(None))
    if null_at_or_below_zero:
        chain = chain.when(v <= 0, F.lit(None))
    for cut, lab in zip(cuts, labels):
        chain = chain.when(v <= cut, F.lit(lab))
    return chain.otherwise(F.lit(labels[len(cuts)]))


def class_ordinal(c, labels=CLASS_LABELS) -> Column:
    """Ordinal code of a class label (0-based), NULL for NULL."""
    c = col(c)
    chain = F.when(c.isNull(), F.lit(None).cast("int"))
    for i, lab in enumerate(labels):
        chain = chain.when(c == lab, F.lit(i))
    return chain


def band(v, cuts, labels=BAND_LABELS, higher_is_better: bool = False) -> Column:
    """Strict-threshold band: lower-is-better uses ``v < cut``, higher uses ``v > cut``."""
    v = col(v)
    chain = F.when(v.isNull(), F.lit(None))
    for cut, lab in zip(cuts, labels):
        chain = chain.when((v > cut) if higher_is_better else (v < cut), F.lit(lab))
    return chain.otherwise(F.lit(labels[len(cuts)]))
