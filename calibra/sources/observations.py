"""Observation sources: CSV and Parquet readers, lenient coercion, schema checks,
and the adapter that derives an observation table from the driver's tables.

Every reader returns the neutral observation layout

    site, obs_date, ref, s2, s3, y   (+ rk, an integer row key, where available)

so the rest of the engine is independent of the input's column names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names of the study's observation file and the neutral
# names they map to (date, site, reference sensor, two competing sensors, measurement).
STUDY_COLUMNS = {
    "fecha": "obs_date",
    "Embalse": "site",
    "C2RCC": "ref",
    "C2X": "s2",
    "C2XC": "s3",
    "Medicion": "y",
}
NUMERIC = ["ref", "s2", "s3", "y"]
REQUIRED = ["site", "ref", "s2", "s3", "y"]


def lenient_double(c: Column | str) -> Column:
    """Text -> DOUBLE the forgiving way: trim, accept a decimal comma, junk -> NULL,
    NaN -> NULL (Spark keeps NaN and NULL apart; the engine has one missing value)."""
    c = F.col(c) if isinstance(c, str) else c
    v = F.regexp_replace(F.trim(c.cast("string")), ",", ".").try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def coerce_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Coerce the listed columns (default: the four numeric ones that exist)."""
    cols = [c for c in (cols or NUMERIC) if c in df.columns]
    return df.withColumns({c: lenient_double(c) for c in cols})


def require_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    missing = [c for c in (cols or REQUIRED) if c not in df.columns]
    if missing:
        raise ValueError(f"observation table lacks required columns {missing}; has {df.columns}")
    return df


def _neutral_names(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    # header names may carry stray blanks; trim before mapping
    return df.select([F.col(f"`{c}`").alias(mapping.get(c.strip(), c.strip())) for c in df.columns])


def read_obs_csv(spark: SparkSession, path: str, mapping: dict[str, str] | None = None,
                 encoding: str = "ISO-8859-1", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Read an observation CSV. Every column is read as text (no schema inference
    pass over the data), names are trimmed and mapped, numerics coerced leniently."""
    raw = (spark.read.option("header", True).option("encoding", encoding)
           .option("inferSchema", False).option("mode", "PERMISSIVE").csv(path))
    df = _neutral_names(raw, mapping or STUDY_COLUMNS)
    df = coerce_numeric(df)
    if "obs_date" in df.columns:
        df = df.withColumn("obs_date", F.try_to_timestamp(F.trim("obs_date"), F.lit(date_format)).cast("date"))
    return require_columns(df)


def read_obs_parquet(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if mapping:
        df = df.select([F.col(c).alias(mapping.get(c, c)) for c in df.columns])
    return require_columns(df)


# Multipliers of the integer row key (not unique on its own columns,
# so three columns are mixed arithmetically; the same integers come out of any SQL engine).
ROW_KEY_MULT = (7919, 104729, 31)
ROW_KEY_MOD = 1000003


#: A table up to this size may be dealt anew; larger ones arrive as many splits.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition a small table on ``key``: stored as one file or row group, it would run every narrow
    step in one task. By the plan's size estimate, so larger tables are never shuffled for this."""
    small = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= SPREAD_BYTES
    return df.repartition(min_partitions or spark_parallelism(df), key) if small else df


def spark_parallelism(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def driver_obs(spark: SparkSession, sf_dir: str, with_missing: bool = False) -> DataFrame:
    """Observation view over the driver tables (lineitem joined to part).

    site = supplier, obs_date = ship date, ref = quantity, s2/s3 = two noisy
    price-derived sensors, y = a measurement correlated with ref and s2.
    ``with_missing`` blanks ``ref`` where tax is 0.08 to exercise cleaning.
    Only the needed columns reach the scan (column pruning); part is joined
    without a hint so AQE picks broadcast only when its runtime size allows.
    """
    li = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate"), "l_orderkey")
    pa = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice")
    j = li.join(pa, li.l_partkey == pa.p_partkey, "inner")
    q, p, t = F.col("l_quantity"), F.col("p_retailprice"), F.col("l_tax")
    m1, m2, m3 = ROW_KEY_MULT
    ref = F.when(t == 0.08, F.lit(None).cast("double")).otherwise(q) if with_missing else q
    return j.select(
        F.col("l_suppkey").alias("site"),
        F.col("l_shipdate").cast("date").alias("obs_date"),
        ref.alias("ref"),
        (q * p * (F.lit(1) + t) / 100).alias("s2"),
        (F.col("l_extendedprice") / 100).alias("s3"),
        (q * (F.lit(1) - F.col("l_discount")) + (p - 900) / 10).alias("y"),
        ((F.col("l_orderkey") * m1 + F.col("l_partkey") * m2 + F.col("l_linenumber") * m3)
         % ROW_KEY_MOD).alias("rk"),
    )
