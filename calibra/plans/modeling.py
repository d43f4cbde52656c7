"""Model comparisons that need iterative or tree learners, ensembles and sweeps.

All of them read one staged study (``study.Study``): features, folds and fitted models lie in the shared folder, base
predictions are columns of one stored table, and a model is fitted once however many queries use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features as FT
from ..operators import ensembles as EN
from ..operators import forest as FO
from ..operators import learners as LR
from ..operators import linear as L
from ..operators import metrics as M
from ..operators import ranking as RK
from ..operators import rescale as RS
from ..operators import splits as SP
from ..sources.staging import staged
from . import evaluation as EV
from . import study as ST

RIDGE = L.LinearSpec("ridge", "ridge", alpha=1.0)
ELASTICNET = L.LinearSpec("elasticnet", "elasticnet", alpha=0.1, l1_ratio=0.5)
# The study's forest on the extended features, its boosted counterpart, and the forest meta-learner.
EXTENDED_GBT = LR.LearnerSpec("boosted_extended", "gbt", {"maxIter": 200, "stepSize": 0.05, "maxDepth": 7})
META_FOREST = FO.ForestSpec("stacking_forest", trees=100, depth=15)
BASES = ST.BASES


def holdout_features(sp: DataFrame, set_name: str, keep=("rk", "y", "is_test")) -> DataFrame:
    params = RS.rescale_params(sp.filter(~F.col("is_test"))) if set_name in FT.RESCALED_SETS else None
    return EV.features_frame(sp, set_name, params, keep=list(keep))


def learner_holdout(sp: DataFrame, set_name: str, spec: LR.LearnerSpec, standardize: bool = False):
    names = FT.names(set_name)
    fr = staged(holdout_features(sp, set_name))
    if standardize:
        fr = EV.standardized(fr, names)
    model, pred = LR.fit_predict(fr.filter(~F.col("is_test")), fr.filter(F.col("is_test")), names, spec, ids=["rk"])
    return model, pred


def coef_importance(study: ST.Study, set_names=("orig16", "rescaled8", "rescaled16"), specs=(ELASTICNET, RIDGE)) -> DataFrame:
    """|coefficient| of standardised features as importance, per (approach, model) — M15. Each set's statistics are one
    stored row, read by the solver and for the standard deviations."""
    out = None
    for s in set_names:
        names = FT.names(s)
        stats = staged(L.gram_stats(study.frame(s).filter(~F.col("is_test")), names))
        coefs = L.fit_linear(stats, names, specs)
        sd = stats.select(*[F.sqrt(F.col(f"c_{i}_{i}")).alias(f"sd_{n}") for i, n in enumerate(names)])
        j = coefs.crossJoin(F.broadcast(sd))
        # coefficient on the standardised scale = raw coefficient * population std
        long = j.select(F.lit(s).alias("approach"), "model", F.explode(F.arrays_zip(
            F.array(*[F.lit(n) for n in names]).alias("feature"),
            F.array(*[(F.col(f"b_{n}") * F.col(f"sd_{n}")) for n in names]).alias("coefficient"))).alias("z"))
        long = long.select("approach", "model", "z.feature", "z.coefficient",
                           F.abs("z.coefficient").alias("importance"))
        out = long if out is None else out.unionByName(long)
    return RK.importance_table(out, ["approach", "model"])


def stacking(bases: DataFrame) -> DataFrame:
    """Meta least squares on the out-of-fold base predictions, applied to the test base predictions."""
    coefs = L.fit_linear(L.gram_stats(bases.filter(~F.col("is_test")), BASES), BASES, (L.LinearSpec("stacking", "ols"),))
    return L.predict(bases.filter("is_test"), coefs, BASES)


def stacking_forest(bases: DataFrame, spec: FO.ForestSpec = META_FOREST) -> DataFrame:
    """A forest as meta-learner on the out-of-fold base predictions."""
    trees = staged(FO.fit(bases.filter(~F.col("is_test")), BASES, spec))
    return FO.predict(bases.filter("is_test"), trees, BASES).select(F.lit(spec.name).alias("model"), "y", "pred")


def voting(bases: DataFrame) -> DataFrame:
    return EN.voting(bases.filter("is_test"), BASES).select(F.lit("voting").alias("model"), "y", "pred")


def weighted(bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    w = staged(EN.simplex_weights(bases.filter(~F.col("is_test")), BASES))
    return w, EN.weighted(bases.filter("is_test"), w, BASES).select(F.lit("weighted").alias("model"), "y", "pred")


def forest_predictions(study: ST.Study, set_name: str, spec: FO.ForestSpec, name: str | None = None) -> DataFrame:
    test = study.frame(set_name).filter("is_test").select("y", *FT.names(set_name))
    return FO.predict(test, study.forest(set_name, spec), FT.names(set_name)).select(
        F.lit(name or spec.name).alias("model"), "y", "pred")


def boosted_predictions(study: ST.Study, set_name: str, spec: LR.LearnerSpec) -> DataFrame:
    test = study.frame(set_name).filter("is_test")
    return study.boosted(set_name, spec).transform(test).select(F.lit(spec.name).alias("model"), "y", "pred")


def linear_predictions(study: ST.Study, set_name: str, specs) -> DataFrame:
    names, fr = FT.names(set_name), study.frame(set_name)
    coefs = L.fit_linear(L.gram_stats(fr.filter(~F.col("is_test")), names), names, specs)
    return L.predict(fr.filter("is_test"), coefs, names)


def approach_compare(study: ST.Study, set_names=("orig16", "rescaled8", "rescaled16"), forest=FO.STUDY_FOREST) -> DataFrame:
    """Feature-set x model comparison on one shared holdout: ElasticNet and Ridge through the Gram
    route, the forest tree by tree; one long result table (U2)."""
    study.fit_all([lambda s=s: study.forest(s, forest) for s in set_names])
    out = None
    for s in set_names:
        p = linear_predictions(study, s, (ELASTICNET, RIDGE)).unionByName(forest_predictions(study, s, forest))
        m = M.metric_bundle(p, ["model"]).select(F.lit(s).alias("approach"), "*")
        out = m if out is None else out.unionByName(m)
    return out


def ensemble_study(study: ST.Study, zone_cuts, ridges=(0.1, 1.0, 10.0)) -> DataFrame:
    """The ensemble study as one ranked table: sensors alone, the corrected one, models on the raw and on the extended
    features, both stackings, voting, weighted and zone-adaptive, by RMSE on the test rows."""
    jobs = [lambda: study.boosted("ext16", EXTENDED_GBT), lambda: study.forest("ext16", FO.STUDY_FOREST),
            lambda: study.base_predictions()]
    bases = study.fit_all(jobs)[2]
    raw = study.frame("raw3")
    train, test = raw.filter(~F.col("is_test")), raw.filter("is_test")
    specs = (*(L.LinearSpec(f"ridge_{a:g}", "ridge", alpha=a) for a in ridges),
             *(s for s in L.STUDY_LINEAR if s.kind != "ridge"))
    bias = train.agg(F.avg(F.col("y") - F.col("ref")).alias("bias"))
    sensors = M.to_long(test.crossJoin(F.broadcast(bias)), {
        "ref": "ref", "s2": "s2", "s3": "s3", "ref_corrected": F.col("ref") + F.col("bias")}, ["y"])
    held = bases.filter("is_test")
    coefs, zone_bias = EN.fit_adaptive(train, zone_cuts)
    adaptive = EN.predict_adaptive(test, coefs, zone_bias, zone_cuts)
    fr = EV.standardized(raw, FT.names("raw3"))
    _, huber = LR.fit_predict(fr.filter(~F.col("is_test")), fr.filter("is_test"), FT.names("raw3"), LR.STUDY_HUBER, newton=True)
    parts = {
        "baseline": [sensors],
        "raw": [linear_predictions(study, "raw3", specs), huber,
                M.to_long(held, {"random_forest": "p_rf", "boosted_trees": "p_xgb"}, ["y"])],
        "extended": [forest_predictions(study, "ext16", FO.STUDY_FOREST, "forest_extended"),
                     boosted_predictions(study, "ext16", EXTENDED_GBT)],
        "ensemble": [stacking(bases), stacking_forest(bases), voting(bases), weighted(bases)[1],
                     adaptive.select(F.lit("adaptive").alias("model"), "y", "pred")],
    }
    long = None
    for stage, preds in parts.items():
        for p in preds:
            p = p.select(F.lit(stage).alias("stage"), "model", "y", "pred")
            long = p if long is None else long.unionByName(p)
    return RK.rank_by(M.metric_bundle(long, ["stage", "model"]), "rmse")


def model_sweep(study: ST.Study, df: DataFrame, k: int = 5, set_name: str = "optimized10",
                forest: FO.ForestSpec = FO.STUDY_FOREST, boosted: LR.LearnerSpec = LR.STUDY_GBT,
                huber: LR.LearnerSpec = LR.STUDY_HUBER) -> DataFrame:
    """K-fold sweep of the study's model list: every fold is a study of its own (rescale, features and models of the
    other folds), the linear family goes through fold-keyed Gram statistics. Returns the fold summary (mean and
    population std of RMSE, MAE, R2) per model."""
    names = FT.names(set_name)
    rows = ST.once(study.spark, (*study.key, "rows", k), lambda: SP.kfold(df, k))  # read by every fold, twice
    folds = [ST.Study(study.spark, rows.withColumn("is_test", F.col("fold") == g), (*study.key, "fold", k, g), stored=True)
             for g in range(k)]
    (_, preds), *_ = study.fit_all([lambda: EV.kfold_linear(rows, set_name, k), *(lambda f=f: f.frame(set_name) for f in folds)])

    def huber_fold(f):
        fr = EV.standardized(f.frame(set_name), names)
        return LR.fit_predict(fr.filter(~F.col("is_test")), fr.filter("is_test"), names, huber, newton=True)[1]

    jobs = [lambda f=f: huber_fold(f) for f in folds] + [lambda f=f: f.forest(set_name, forest) for f in folds] + [
        lambda f=f: f.boosted(set_name, boosted) for f in folds]
    fitted = study.fit_all(jobs)
    for g, f in enumerate(folds):
        for p in (forest_predictions(f, set_name, forest), boosted_predictions(f, set_name, boosted), fitted[g]):
            preds = preds.unionByName(p.select(F.lit(g).cast("long").alias("fold"), "model", "y", "pred"),
                                      allowMissingColumns=True)
    return EV.cv_summary(preds)


def certificates(study: ST.Study, set_name: str = "optimized10", huber: LR.LearnerSpec = LR.STUDY_HUBER,
                 boosted: LR.LearnerSpec = LR.STUDY_GBT) -> DataFrame:
    """model, component, ok: the Huber fit's gradient is zero within the bound in every component, and no round of
    boosting raises the training loss."""
    names = FT.names(set_name)
    frame = study.frame(set_name)
    train = staged(EV.standardized(frame, names).filter(~F.col("is_test")).select(*names, "y"))
    model, _ = LR.fit_predict(train, train, names, huber)
    grad = LR.huber_certificate(model, train, names).select(F.lit(huber.name).alias("model"), "component", "ok")
    losses = LR.loss_by_round(study.boosted(set_name, boosted), frame.filter(~F.col("is_test")))
    falls = all(b <= a * (1 + 1e-12) for a, b in zip(losses, losses[1:]))
    return grad.unionByName(study.spark.createDataFrame([(boosted.name, f"loss of {len(losses)} rounds", falls)],
                                                        "model string, component string, ok boolean"))
