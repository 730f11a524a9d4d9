"""Tabular experiments on Spark ML: fit on one part, score another, report risk metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import evaluate
from ..operators.shared import stage

_BASELINES = {"gbt": GBTClassifier, "forest": RandomForestClassifier, "logistic": LogisticRegression}


def baseline(kind: str = "gbt", *, weight_col: str | None = None, seed: int = 7, **params) -> Estimator:
    """A tree ensemble or logistic regression; weight_col weighs rows, as rare labels need."""
    if kind not in _BASELINES:
        raise ValueError(f"kind is one of {sorted(_BASELINES)}")
    est = _BASELINES[kind](featuresCol="__x", labelCol="label", **params)
    if kind != "logistic":
        est = est.setSeed(seed)
    return est.setWeightCol(weight_col) if weight_col else est


class TabularExperiment:
    """fit on training rows, score others by the probability of label 1, evaluate where both labels occur."""

    def __init__(self, estimator: Estimator, features: Sequence[str]) -> None:
        self.estimator, self.assembler = estimator, VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep")
        self.features, self.model = list(features), None

    def fit(self, train: DataFrame) -> TabularExperiment:
        self.model = self.estimator.fit(self.assembler.transform(train.withColumn("label", F.col("label").cast("double"))))
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("fit comes before score")
        out = self.model.transform(self.assembler.transform(rows))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")

    def evaluate(self, rows: DataFrame, *, tie: str, **budgets) -> DataFrame | None:
        scored = stage(self.score(rows).select(*dict.fromkeys(("label", "score", tie))), "scored")  # each metric reads it again
        if scored.select("label").distinct().limit(2).count() < 2:
            return None
        return evaluate(scored, tie=F.col(tie), **budgets)

    def importances(self) -> dict[str, float]:
        """What each feature adds to a tree model's decisions."""
        found = getattr(self.model, "featureImportances", None)
        if found is None:
            raise ValueError("only tree models have importances")
        return dict(zip(self.features, map(float, found.toArray())))
