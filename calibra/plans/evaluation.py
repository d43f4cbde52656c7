"""Validation schemes wired from the operators: holdout, K-fold and leave-one-group-out.

Plan shape (the same for every scheme):
  1. split / fold column: a pure function of the row key (no shuffle);
  2. leak-free rescale parameters of every split from one pass of group moments;
  3. training statistics of every split in one aggregation over a fold-expanded
     view (each row is emitted once per split it trains: k-1 copies for K-fold,
     generated by ``explode`` — narrow, no join of rows);
  4. per-split solves (tiny, executor-side) -> coefficient table (splits x models rows);
  5. test predictions: each row meets its own split's parameters and coefficients via
     broadcast joins of those bounded tables;
  6. metrics per (model, split) in one aggregate, then the fold summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as FT
from ..operators import linear as L
from ..operators import loro as LO
from ..operators import metrics as M
from ..operators import rescale as RS
from ..operators import scaling as SC
from ..operators import splits as SP
from ..operators.joins import attach


def _with_params(df: DataFrame, params: DataFrame | None, on: str | None) -> DataFrame:
    if params is None:
        return df
    p = F.broadcast(params)
    return df.join(p, on) if on else df.crossJoin(p)


def features_frame(df: DataFrame, set_name: str, params: DataFrame | None = None, on: str | None = None,
                   keep: list[str] = (), set_kw: dict | None = None) -> DataFrame:
    """Project a named feature set (rescaled sets read the attached parameters); rows whose
    features are NULL (e.g. log of a rescaled value below -1) are dropped. The check reads the projected features: pushed
    below the projection, as a plain filter would be, it computes each of them once more, without shared parts."""
    feats = FT.feature_set(set_name, **(set_kw or {}))
    x = _with_params(df, params, on) if set_name in FT.RESCALED_SETS else df
    out = FT.project(x, feats, keep=list(keep))
    here = out.withColumn("_part", F.spark_partition_id()).filter("_part >= 0")  # holds filters above the projection
    return FT.complete_features(here, [n for n, _ in feats]).drop("_part")


def holdout_linear(df: DataFrame, set_name: str, specs=L.STUDY_LINEAR, is_test: str = "is_test",
                   ids: list[str] = ("rk",)) -> tuple[DataFrame, DataFrame]:
    """Fit on the training side, predict the test side. Returns (coefficients, long predictions)."""
    train = df.filter(~F.col(is_test))
    params = RS.rescale_params(train) if set_name in FT.RESCALED_SETS else None
    names = FT.names(set_name)
    fr = features_frame(df, set_name, params, keep=[*ids, "y", is_test])
    coefs = L.fit_linear(L.gram_stats(fr.filter(~F.col(is_test)), names), names, specs)
    preds = L.predict(fr.filter(F.col(is_test)), coefs, names, ids=list(ids))
    return coefs, preds


def other_folds(k: int, fold: str = "fold") -> F.Column:
    """The k-1 folds a row trains, as plain arithmetic (stays in generated code; no lambda)."""
    return F.array(*[F.pmod(F.col(fold) + i, F.lit(k)).cast("bigint") for i in range(1, k)])


def kfold_linear(df: DataFrame, set_name: str, k: int = 5, specs=L.STUDY_LINEAR, key: str = "rk",
                 ids: list[str] = ("rk",)) -> tuple[DataFrame, DataFrame]:
    """K-fold with every fold's rescale, scaler and model fitted on the other folds only.

    Returns (per-fold coefficients, long test predictions with ``fold``)."""
    f = SP.kfold(df, k, key)
    names = FT.names(set_name)
    params = None
    if set_name in FT.RESCALED_SETS:
        params = RS.leave_out_params(f, "fold").drop("n_train")
    if params is None:  # features do not depend on the fold: total minus fold, no copies
        fr = features_frame(f, set_name, None, keep=[*ids, "fold", "y"])
        coefs = L.fit_linear(L.leave_out_stats(fr, names, "fold"), names, specs, by=["fold"])
        return (coefs.withColumnRenamed("fold", "train_fold"),
                L.predict(fr, coefs, names, on=["fold"], ids=[*ids, "fold"]))
    if set_name == "optimized10":  # affine in the fold's parameters but for the median: total minus fold as well
        coefs, preds = LO.loro_linear(f, "fold", specs, ids=list(ids))
        return coefs.withColumnRenamed("fold", "train_fold"), preds
    # training view: one copy of each row per fold it trains (k - 1 copies), tagged train_fold
    tr = f.withColumn("train_fold", F.explode(other_folds(k)))
    tp = params.withColumnRenamed("fold", "train_fold") if params is not None else None
    trf = features_frame(tr, set_name, tp, on="train_fold", keep=["train_fold", "y"])
    coefs = L.fit_linear(L.gram_stats(trf, names, by=["train_fold"]), names, specs, by=["train_fold"])
    te = features_frame(f, set_name, params, on="fold", keep=[*ids, "fold", "y"])
    preds = L.predict(te, coefs.withColumnRenamed("train_fold", "fold"), names, on=["fold"], ids=[*ids, "fold"])
    return coefs, preds


def leave_out_linear(df: DataFrame, set_name: str, group: str = "site", specs=L.STUDY_LINEAR) -> tuple[DataFrame, DataFrame]:
    """Every group predicted by models fitted without it, for feature sets whose features do not depend on the
    training rows: one pass of group sums, total minus group, no copies and no pairs of rows and groups."""
    if set_name in FT.RESCALED_SETS:
        raise ValueError("rescaled sets depend on the held-out group; see operators.loro")
    names = FT.names(set_name)
    fr = features_frame(df, set_name, None, keep=[group, "y"])
    coefs = L.fit_linear(L.leave_out_stats(fr, names, group), names, specs, by=[group])
    j = attach(fr, coefs, group)
    return coefs, j.select(group, "model", "y", L.linear_prediction(names).alias("pred"))


def cv_summary(preds: DataFrame) -> DataFrame:
    per_fold = M.metric_bundle(preds, ["model", "fold"])
    return M.summarize_folds(per_fold, ["model"])


def standardized(df: DataFrame, names: list[str], is_test: str = "is_test", by: list[str] = ()) -> DataFrame:
    """Population-std z-scores fitted on the training side (for pyspark.ml learners)."""
    st = SC.fit_scaler(df.filter(~F.col(is_test)), names, by=list(by))
    return SC.apply_scaler(df, st, names, on=list(by) or None)
