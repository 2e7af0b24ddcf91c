"""The stacked ensemble as an estimator of ``pyspark.ml``: parameters, copies, pipelines, files."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel, RandomForestClassificationModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession

from .models import StackedEnsemble


class StackedClassifier(Estimator, HasInputCols, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Fits on rows with ``row_id``, the input columns and ``y``."""

    folds = Param(Params._dummy(), "folds", "folds of the base learners' scores", TypeConverters.toInt)
    trees = Param(Params._dummy(), "trees", "trees of the forest", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "rounds of boosting", TypeConverters.toInt)
    mlp = Param(Params._dummy(), "mlp", "a perceptron in place of the linear learner", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, folds: int = 5, seed: int = 42, trees: int = 150, rounds: int = 100, mlp: bool = False):
        super().__init__()
        self._setDefault(folds=5, seed=42, trees=150, rounds=100, mlp=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def setParams(self, **given) -> "StackedClassifier":
        return self._set(**given)

    def _fit(self, dataset: DataFrame) -> "StackedModel":
        value = lambda p: self.getOrDefault(p)
        fitted = StackedEnsemble(list(self.getInputCols()), value("folds"), value("seed"), value("trees"), value("rounds"), value("mlp")).fit(dataset)
        return self._copyValues(StackedModel(fitted), extra=None)


class StackedModel(Model, HasInputCols, HasSeed):
    """Adds ``score`` and ``pred``; ``save`` writes the learners and the settings to a folder of any store."""

    def __init__(self, fitted: StackedEnsemble):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.predict(dataset)

    def save(self, path: str) -> None:
        f = self.fitted
        for name, model in {**f.base, "meta": f.meta}.items():
            model.write().overwrite().save(f"{path}/{name}")
        kept = {"features": f.features, "folds": f.folds, "seed": f.seed, "trees": f.trees, "rounds": f.rounds, "mlp": f.mlp, "threshold": f.threshold, "scaler": f.scaler}
        SparkSession.active().createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> "StackedModel":
        kept = json.loads(SparkSession.active().read.text(f"{path}/settings").first()[0])
        f = StackedEnsemble(kept["features"], kept["folds"], kept["seed"], kept["trees"], kept["rounds"], kept["mlp"])
        f.threshold, f.scaler = kept["threshold"], {k: tuple(v) for k, v in kept["scaler"].items()}
        last = MultilayerPerceptronClassificationModel if f.mlp else LogisticRegressionModel
        kinds = {"rf": RandomForestClassificationModel, "gbt1": GBTClassificationModel, "gbt2": GBTClassificationModel, "mlp": last}
        f.base = {name: kind.load(f"{path}/{name}") for name, kind in kinds.items()}
        f.meta = LogisticRegressionModel.load(f"{path}/meta")
        return cls(f)._set(inputCols=f.features, seed=f.seed)
