"""Attaching a per-group table (one row per site, fold, class...) back to the rows.

A per-group table's size is bounded by the number of groups, which for folds or classes is a
parameter but for sites is data-dependent. Only a caller that knows the row count gets a broadcast;
otherwise the join is planned as a shuffled one, and adaptive execution turns it into a
broadcast by the table's measured bytes or splits a hot key's partition. Nothing runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a per-group table that may be broadcast (a few dozen bytes per row).
MAX_BROADCAST_ROWS = 200_000


def attach(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS,
           known_rows: int | None = None) -> DataFrame:
    """Join a per-group table to the rows; ``known_rows`` up to ``max_rows`` makes it a broadcast."""
    side = F.broadcast(small) if known_rows is not None and known_rows <= max_rows else small
    return big.join(side, on, how)
