"""The calibration steps as ``pyspark.ml`` stages (V5): fitted on training rows only, saved and loaded with a pipeline.

* ``MomentMatch`` learns the sensors' scale and offset against the reference;
* ``FeatureSet`` projects a named feature set from the rescaled columns;
* ``PopulationScaler`` learns means and population standard deviations;
* ``GramRegressor`` fits one of the study's linear models from sums of products.

``Pipeline(stages=[MomentMatch(), FeatureSet(setName="optimized10"), GramRegressor(...)])`` under
``CrossValidator(foldCol=...)`` refits every step on the other folds. What a stage has learnt are its params, so
the default reader and writer keep it. Rows with a missing feature get a NULL prediction and are not trained on.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from ..functions import features as FT
from . import linear as L
from . import rescale as RS
from . import scaling as SC


class _Sensors(Params):
    refCol = Param(Params._dummy(), "refCol", "trusted sensor", TypeConverters.toString)
    sensorCols = Param(Params._dummy(), "sensorCols", "sensors to rescale", TypeConverters.toListString)
    scales = Param(Params._dummy(), "scales", "learnt scale per sensor", TypeConverters.toListFloat)
    offsets = Param(Params._dummy(), "offsets", "learnt offset per sensor", TypeConverters.toListFloat)

    def _sensors(self):
        return self.getOrDefault(self.refCol), self.getOrDefault(self.sensorCols)


class MomentMatch(Estimator, _Sensors, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, refCol="ref", sensorCols=("s2", "s3")):
        super().__init__()
        self._set(refCol=refCol, sensorCols=list(sensorCols))

    def _fit(self, dataset):
        ref, sensors = self._sensors()
        r = RS.rescale_params(dataset, ref, sensors).first()
        if any(r[f"{s}_{k}"] is None for s in sensors for k in ("scale", "offset")):
            raise ValueError(f"no moments to match: {r.asDict()}")
        return MomentMatchModel()._set(refCol=ref, sensorCols=sensors, scales=[r[f"{s}_scale"] for s in sensors],
                                       offsets=[r[f"{s}_offset"] for s in sensors])


class MomentMatchModel(Model, _Sensors, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``<sensor>_scale``, ``<sensor>_offset`` and the rescaled ``<sensor>_r``."""

    def _transform(self, dataset):
        _, sensors = self._sensors()
        learnt = {f"{s}_{k}": F.lit(v) for k, vs in (("scale", self.getOrDefault(self.scales)),
                                                     ("offset", self.getOrDefault(self.offsets))) for s, v in zip(sensors, vs)}
        return dataset.withColumns(learnt).withColumns({f"{s}_r": FT.rescaled(s) for s in sensors})


class FeatureSet(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    setName = Param(Params._dummy(), "setName", "named feature set", TypeConverters.toString)
    prefix = Param(Params._dummy(), "prefix", "prefix of the feature columns", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, setName="optimized10", prefix="f_"):
        super().__init__()
        self._set(setName=setName, prefix=prefix)

    def columns(self) -> list[str]:
        return [self.getOrDefault(self.prefix) + n for n in FT.names(self.getOrDefault(self.setName))]

    def _transform(self, dataset):
        feats = FT.feature_set(self.getOrDefault(self.setName))
        return dataset.select("*", *[c.cast("double").alias(n) for n, (_, c) in zip(self.columns(), feats)])


class _Scaled(HasInputCols):
    means = Param(Params._dummy(), "means", "learnt means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "learnt population standard deviations, 1 for a constant", TypeConverters.toListFloat)


class PopulationScaler(Estimator, _Scaled, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=()):
        super().__init__()
        self._set(inputCols=list(inputCols))

    def _fit(self, dataset):
        cols = self.getInputCols()
        r = SC.fit_scaler(dataset, cols).first()
        return PopulationScalerModel()._set(inputCols=cols, means=[r[f"mu_{c}"] for c in cols],
                                            stds=[r[f"sd_{c}"] for c in cols])


class PopulationScalerModel(Model, _Scaled, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset):
        return dataset.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(
            self.getInputCols(), self.getOrDefault(self.means), self.getOrDefault(self.stds))})


class _Linear(HasInputCols, HasLabelCol, HasPredictionCol):
    kind = Param(Params._dummy(), "kind", "ols, ridge, lasso or elasticnet", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)
    l1Ratio = Param(Params._dummy(), "l1Ratio", "share of the absolute penalty", TypeConverters.toFloat)
    intercept = Param(Params._dummy(), "intercept", "learnt intercept", TypeConverters.toFloat)
    coefficients = Param(Params._dummy(), "coefficients", "learnt coefficients in raw units", TypeConverters.toListFloat)
    converged = Param(Params._dummy(), "converged", "whether the solver met its conditions", TypeConverters.toBoolean)


class GramRegressor(Estimator, _Linear, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=(), labelCol="y", predictionCol="prediction", kind="elasticnet", alpha=0.1, l1Ratio=0.5):
        super().__init__()
        self._set(inputCols=list(inputCols), labelCol=labelCol, predictionCol=predictionCol, kind=kind, alpha=float(alpha),
                  l1Ratio=float(l1Ratio))

    def _fit(self, dataset):
        cols, label = self.getInputCols(), self.getLabelCol()
        spec = L.LinearSpec("model", self.getOrDefault(self.kind), self.getOrDefault(self.alpha), self.getOrDefault(self.l1Ratio))
        rows = FT.complete_features(dataset.select(*cols, label), [*cols, label])
        r = L.fit_linear(L.gram_stats(rows, cols, label), cols, (spec,)).first()
        if r.intercept is None:
            raise ValueError("no complete training rows")
        return GramRegressorModel()._set(
            inputCols=cols, labelCol=label, predictionCol=self.getPredictionCol(), kind=spec.kind, alpha=spec.alpha,
            l1Ratio=spec.l1_ratio, intercept=r.intercept, coefficients=[r[f"b_{c}"] for c in cols],
            converged=r.converged)


class GramRegressorModel(Model, _Linear, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset):
        e = F.lit(self.getOrDefault(self.intercept))
        for c, b in zip(self.getInputCols(), self.getOrDefault(self.coefficients)):
            e = e + F.lit(b) * F.col(c)
        return dataset.withColumn(self.getPredictionCol(), e)
