"""Applying a fitted calibration to a stream.

The study has no streaming logic; what carries over is that every fitted artefact of
the engine is a small static table (rescale parameters, linear coefficients, class
cuts) and every per-row step is a projection. A stream of observations is therefore
scored with stream-static joins against those broadcast tables, and its running
error is a windowed aggregation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as FT
from ..operators import linear as L
from ..operators.metrics import metric_aggs, finish_metrics


def driver_obs_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """Observation view over lineitem read as a file stream, joined to the static part table."""
    li_schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    # the file source watches a folder; only the lineitem file(s) of it are picked up
    li = (spark.readStream.schema(li_schema).option("maxFilesPerTrigger", max_files)
          .option("pathGlobFilter", "lineitem*.parquet").parquet(sf_dir))
    pa = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice")
    q, p, t = F.col("l_quantity"), F.col("p_retailprice"), F.col("l_tax")
    return li.join(pa, li.l_partkey == pa.p_partkey).select(
        F.col("l_suppkey").alias("site"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        q.alias("ref"), (q * p * (F.lit(1) + t) / 100).alias("s2"), (F.col("l_extendedprice") / 100).alias("s3"),
        (q * (F.lit(1) - F.col("l_discount")) + (p - 900) / 10).alias("y"))


def score(stream: DataFrame, params: DataFrame, coefs: DataFrame, set_name: str = "optimized10") -> DataFrame:
    """Predictions for every arriving row: broadcast parameters and coefficients (one row per model)."""
    names = FT.names(set_name)
    x = stream.crossJoin(F.broadcast(params)) if set_name in FT.RESCALED_SETS else stream
    x = FT.project(x, FT.feature_set(set_name), keep=[c for c in ("site", "ts", "y") if c in stream.columns])
    x = x.crossJoin(F.broadcast(coefs))
    return x.select("site", "ts", "model", "y", L.linear_prediction(names).alias("pred"))


def windowed_errors(preds: DataFrame, window: str = "30 days") -> DataFrame:
    """Error bundle per model and event-time window."""
    agg = preds.groupBy(F.window("ts", window).alias("w"), "model").agg(*metric_aggs("y", "pred"))
    return finish_metrics(agg, ["w", "model"]).select(F.col("w.start").alias("window_start"), "*").drop("w")


def run_to_table(df: DataFrame, shared: str) -> DataFrame:
    """Drive an aggregating stream over everything available and return its final table.

    Complete mode: each micro-batch rewrites the whole table (windows x models, a small report) as Parquet in the
    shared folder, so trailing windows are included and late rows still count. The state keeps every window; a
    stream without end needs append mode with a watermark, which holds back the windows not yet closed.
    """
    root = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/table")

    q = (df.writeStream.foreachBatch(write).outputMode("complete").trigger(availableNow=True)
         .option("checkpointLocation", f"{root}/state").start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/table")
