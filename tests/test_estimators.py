"""Pipeline stages: save and load, equal transforms, cross-validation by fold column against ``kfold_linear``."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from calibra.operators import classes as C
from calibra.operators import estimators as ES
from calibra.operators import linear as L
from calibra.operators import splits as SP
from calibra.plans import evaluation as EV
from calibra.sources.observations import driver_obs

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def obs(spark):
    return SP.kfold(C.complete_cases(driver_obs(spark, SF_SMALL)), 5).withColumn("fold", F.col("fold").cast("int")).cache()


def pipeline(spec, scaled=False):
    feats = ES.FeatureSet(setName="optimized10")
    stages = [ES.MomentMatch(), feats]
    if scaled:
        stages.append(ES.PopulationScaler(inputCols=feats.columns()))
    return Pipeline(stages=[*stages, ES.GramRegressor(inputCols=feats.columns(), kind=spec.kind, alpha=spec.alpha, l1Ratio=spec.l1_ratio)])


def test_saved_and_loaded_pipeline_predicts_the_same(spark, obs, tmp_path):
    for scaled in (False, True):
        fitted = pipeline(L.STUDY_LINEAR[1], scaled).fit(obs)
        fitted.write().overwrite().save(f"{tmp_path}/model")
        again = PipelineModel.load(f"{tmp_path}/model")
        a, b = (m.transform(obs).agg(F.sum("prediction"), F.count("prediction")).first() for m in (fitted, again))
        assert a[1] == b[1] == obs.count() and a[0] == pytest.approx(b[0], rel=1e-12)
    unfitted = pipeline(L.STUDY_LINEAR[1])
    unfitted.write().overwrite().save(f"{tmp_path}/pipeline")
    refit = Pipeline.load(f"{tmp_path}/pipeline").fit(obs)
    assert refit.stages[-1].getOrDefault("coefficients") == pytest.approx(
        pipeline(L.STUDY_LINEAR[1]).fit(obs).stages[-1].getOrDefault("coefficients"), rel=1e-9)


def test_scaling_does_not_change_the_predictions(obs):
    plain, scaled = (pipeline(L.STUDY_LINEAR[3], s).fit(obs).transform(obs).agg(F.sum(F.col("prediction") ** 2)).first()[0]
                     for s in (False, True))
    assert plain == pytest.approx(scaled, rel=1e-9)


@pytest.mark.parametrize("spec", [L.STUDY_LINEAR[1], L.STUDY_LINEAR[3]])
def test_cross_validator_by_fold_column_equals_kfold_linear(obs, spec):
    pipe = pipeline(spec)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), numFolds=5, foldCol="fold",
                        evaluator=RegressionEvaluator(labelCol="y", predictionCol="prediction", metricName="rmse"))
    got = cv.fit(obs).avgMetrics[0]
    _, preds = EV.kfold_linear(obs.drop("fold"), "optimized10", 5, specs=(spec,))
    assert got == pytest.approx(EV.cv_summary(preds).first().rmse_mean, rel=1e-9)


def test_nothing_to_learn_from(spark, obs):
    with pytest.raises(ValueError):
        ES.MomentMatch().fit(obs.limit(0))
    null = obs.limit(3).withColumn("f", F.lit(None).cast("double"))
    with pytest.raises(ValueError):
        ES.GramRegressor(inputCols=["f"], kind="ols").fit(null)
