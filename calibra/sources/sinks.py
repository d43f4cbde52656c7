"""Result sinks (S6-S8): every report is a DataFrame written by Spark's writers.

Results are small (models x classes x folds), but the writer is the same one used for
large tables: one folder per result, written by the executors, overwrite semantics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False,
                partition_by: list[str] | None = None) -> str:
    """Write a result table as Parquet (default) or CSV with a header. ``single_file`` coalesces a
    small report into one part file (only for tables bounded by models/classes, never raw rows)."""
    w = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(fmt)
    return path
