"""Rows read, missing, dropped and used (SURVEY "excluded and counted").

``Tally`` counts while the rows pass, through ``DataFrame.observe``: no extra pass, the numbers are there once the plan
has run. ``row_counts`` gives the same as a table, per group, for reports.

* missing: a required input is NULL or NaN;
* dropped: the inputs are there, but a derived feature is not (a logarithm out of its domain, a ratio without a value);
* used: the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def present(df: DataFrame, cols: list[str]) -> Column:
    """True where none of the columns is NULL (or NaN, for floating-point ones)."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & (~F.isnan(c) if c in floating else F.lit(True))
    return F.coalesce(ok, F.lit(False))


def _sums(there: Column, usable: Column) -> list[Column]:
    def n(c):
        return F.count(F.when(c, 1))

    return [F.count(F.lit(1)).alias("n_in"), n(~there).alias("n_missing"), n(there & ~usable).alias("n_dropped"),
            n(there & usable).alias("n_used")]


class Tally:
    """Counters of one plan: ``kept = tally.keep(df, inputs, features)`` filters to the usable rows and counts the others
    on the way; ``tally.get`` holds n_in, n_missing, n_dropped and n_used after the plan's first action."""

    def __init__(self, name: str = "rows"):
        self.observation = Observation(name)

    def keep(self, df: DataFrame, inputs: list[str], features: list[str] = ()) -> DataFrame:
        there, usable = present(df, inputs), present(df, list(features))
        return df.observe(self.observation, *_sums(there, usable)).filter(there & usable)

    @property
    def get(self) -> dict[str, int]:
        return self.observation.get


def row_counts(df: DataFrame, inputs: list[str], features: list[str] = (), by: list[str] = ()) -> DataFrame:
    """by..., n_in, n_missing, n_dropped, n_used."""
    return df.groupBy(*by).agg(*_sums(present(df, inputs), present(df, list(features))))
