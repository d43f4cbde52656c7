"""Helpers shared by the corpus operators: shared-folder tables, batched Arrow maps, gapless ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rules (space, tab, newline, vertical tab, form feed, carriage return).
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for local-mode tests without the setting."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="calibra-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage and survives lost
    executors. Nothing is kept on an executor's own disk."""
    path = f"{shared_dir(df.sparkSession)}/calibra-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_az(c: Column) -> Column:
    """A-Z to a-z, every other character unchanged (``lower`` would fold all of Unicode)."""
    return F.translate(c, UPPER, LOWER)


def by_text(df: DataFrame, columns: list[str], fn: Callable[..., Iterator[tuple]], schema: str,
            rows: int = 256, most: int | None = None) -> DataFrame:
    """Map rows to rows through Arrow. ``fn(*column lists)`` gets at most ``rows`` rows as Python lists and
    yields output tuples, so a worker holds one small slice as objects whatever the batch size. With ``most`` a slice
    also ends where its strings pass that many bytes (a longer text is a slice of its own)."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for at, n in _slices(batch, rows, most):
                part = batch.slice(at, n)
                made = list(fn(*(part.column(i).to_pylist() for i in range(part.num_columns))))
                cols = list(zip(*made)) if made else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int, most: int | None) -> Iterator[tuple[int, int]]:
    sizes = np.zeros(batch.num_rows, np.int64)
    if most is not None:
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        upto = at + rows
        if most is not None:
            upto = min(upto, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        n = max(1, min(upto, batch.num_rows) - at)
        yield at, n
        at += n


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def gapless_rank(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int = 1024) -> DataFrame:
    """Add ``out`` = 0, 1, 2, ... within each group, without sorting a group in one task.

    Rows of a group are dealt by hash of ``order`` into ``buckets``; a row's rank is the number of
    rows in the group's earlier buckets (a small count table) plus its place within its own bucket. ``df`` is
    read twice: pass a stored table. ``group`` columns must not be null. Equal rows get distinct ranks.
    """
    x = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*group, "__bucket"]
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = (x.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (x.withColumn("__place", place).join(offset, keys)
            .withColumn(out, (F.col("__off") + F.col("__place")).cast("long"))
            .drop("__bucket", "__off", "__place"))
