"""Report runs (S6-S9): a named evaluation of one observation table, committed as a whole.

``run_report`` writes every table of the evaluation under ``<out>/<table>/run=<run>`` and, when all of them are there,
the run's row of ``<out>/manifest``. ``read_run`` opens the tables of a run that has its manifest row, so a run that
broke off is never read. Writing a run again replaces its own partitions only (dynamic partition overwrite) and
first takes its manifest row back, so a repetition after any failure ends in the same state.

    python -m calibra.plans.report observations.csv reports --run 2022-11 --evaluation full
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baselines as BL
from ..operators import classes as C
from ..operators import diagnostics as D
from ..operators import kstest as KS
from ..operators import metrics as M
from ..operators import ranking as RK
from ..operators import splits as SP
from ..operators import tally as T
from ..sources.staging import staged
from . import evaluation as EV
from .profile import STUDY, Profile

_MANIFEST = "table string, n_rows long, run string"


def _prepared(obs: DataFrame) -> DataFrame:
    return staged(C.complete_cases(obs).withColumn("rk", SP.row_key("site", "obs_date", "ref", "s2", "s3", "y")))


def sensors(obs: DataFrame, profile: Profile = STUDY) -> dict[str, DataFrame]:
    """Counted rows, sites per class, and the errors of the sensors alone, overall and per class."""
    rows = C.class_by_site_mean(_prepared(obs), cuts=profile.site_cuts)
    long = M.to_long(rows, {s: s for s in ("ref", "s2", "s3")}, ids=["cls", "y"])
    errors = M.metrics_rollup(long, ["model"], ["cls"])
    return {"counts": T.row_counts(obs, ["ref", "s2", "s3", "y"]),
            "class_counts": rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("site").alias("n_sites")),
            "sensor_errors": errors}


def full(obs: DataFrame, profile: Profile = STUDY) -> dict[str, DataFrame]:
    """``sensors`` and the linear models on the optimised features: K-fold and leave-one-site-out summaries, holdout
    ranking, residual diagnostics and the key figures."""
    rows = _prepared(obs)
    _, folds = EV.kfold_linear(rows, "optimized10", profile.k)
    from ..operators import loro as LO
    _, sites = LO.loro_linear(rows, "site")
    per_site = M.metric_bundle(sites, ["model", "site"])
    split = staged(SP.holdout(rows, "rk", profile.test_frac))
    _, preds = EV.holdout_linear(split, "optimized10")
    base = BL.predictions(split.filter("is_test"), BL.fit_closed_form(split.filter(~F.col("is_test"))), ["rk"])
    held = staged(M.metric_bundle(preds.select("model", "y", "pred").unionByName(base.select("model", "y", "pred")), ["model"]))
    residuals = preds.withColumn("r", F.col("y") - F.col("pred"))
    best = RK.best(held)
    ref = held.filter("model = 'ref'").select(F.col("rmse").alias("ref_rmse"))
    key = best.crossJoin(F.broadcast(ref)).select(
        "model", "rmse", "r2", "ref_rmse", (F.try_divide(F.col("ref_rmse") - F.col("rmse"), F.col("ref_rmse")) * 100).alias("improvement_pct"))
    return sensors(obs, profile) | {
        "kfold": EV.cv_summary(folds),
        "leave_one_site_out": per_site.groupBy("model").agg(
            F.count(F.lit(1)).alias("n_sites"), F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
            F.avg("mae").alias("mae_mean"), F.avg("r2").alias("r2_mean")),
        "holdout": RK.rank_by(held, "rmse"),
        "normality": D.jarque_bera(residuals, "r", ["model"]),
        "normality_ks": KS.one_sample(residuals.filter("model = 'elasticnet'"), "r"),
        "key_figures": key}


EVALUATIONS: dict[str, Callable[[DataFrame, Profile], dict[str, DataFrame]]] = {"sensors": sensors, "full": full}


def run_report(obs: DataFrame, out: str, run: str, evaluation: str = "sensors", profile: Profile = STUDY) -> dict[str, int]:
    """Write all tables of ``evaluation`` as run ``run`` and commit them; returns the rows of each table."""
    spark = obs.sparkSession
    _write(spark.createDataFrame([("", 0, run)], _MANIFEST).limit(1).withColumn("n_rows", F.lit(-1).cast("long")), f"{out}/manifest")
    sizes = {}
    for name, df in EVALUATIONS[evaluation](obs, profile).items():
        _write(df.withColumn("run", F.lit(run)), f"{out}/{name}")
        sizes[name] = spark.read.parquet(f"{out}/{name}").filter(F.col("run") == run).count()
    _write(spark.createDataFrame([(n, k, run) for n, k in sorted(sizes.items())], _MANIFEST), f"{out}/manifest")
    return sizes


def _write(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def read_run(spark: SparkSession, out: str, run: str) -> dict[str, DataFrame]:
    """The committed tables of a run; an error if it has none."""
    try:
        listed = [r.table for r in spark.read.parquet(f"{out}/manifest").filter((F.col("run") == run) & (F.col("n_rows") >= 0)).collect()]
    except AnalysisException:
        listed = []
    if not listed:
        raise LookupError(f"run {run!r} was not committed under {out}")
    return {t: spark.read.parquet(f"{out}/{t}").filter(F.col("run") == run).drop("run") for t in listed}


def main(argv: list[str] | None = None) -> None:
    from ..session import ENGINE_CONF
    from ..sources.observations import read_obs_csv, read_obs_parquet

    a = argparse.ArgumentParser(description="Evaluate an observation table and commit the report's tables.")
    a.add_argument("observations")
    a.add_argument("out")
    a.add_argument("--run", required=True)
    a.add_argument("--evaluation", choices=sorted(EVALUATIONS), default="sensors")
    args = a.parse_args(argv)
    builder = SparkSession.builder.appName("calibra-report")
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    read = read_obs_csv if args.observations.endswith(".csv") else read_obs_parquet
    for table, rows in run_report(read(spark, args.observations), args.out, args.run, args.evaluation).items():
        print(f"{table}\t{rows}")


if __name__ == "__main__":
    main()
