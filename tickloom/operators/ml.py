"""Trained models on feature columns with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.dataset import class_weights, max_prediction, undersample


def fit_trend_classifier(df: DataFrame, features: Sequence[str], label: str = "label", hidden: Sequence[int] = (), balance: bool = True, seed: int = 7) -> PipelineModel:
    """A label model: logistic regression, or a perceptron with hidden layers; rows with a null feature are left out.

    With balance, all classes count alike: by weights, or for the perceptron, which knows no weights, by undersampling.
    """
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc")
    assemble = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep")
    scale = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True)
    rows = df.where(F.col(label).isNotNull()).dropna(subset=list(features))
    if balance:
        rows = undersample(rows, label, features, seed) if hidden else class_weights(rows, label)
    elif not hidden:
        rows = rows.withColumn("weight", F.lit(1.0))
    if hidden:
        classes = rows.select(label).distinct().count()
        layers = [len(features), *hidden, classes]
        model = MultilayerPerceptronClassifier(featuresCol="_features", labelCol="_label", layers=layers, seed=seed, maxIter=50)
    else:
        model = LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="weight", regParam=1e-4, maxIter=50)
    fitted = index.fit(rows)
    back = IndexToString(inputCol="prediction", outputCol="_best", labels=fitted.labels)
    return Pipeline(stages=[fitted, assemble, scale, model, back]).fit(rows)


def fit_bounds_regressor(df: DataFrame, features: Sequence[str], targets: Sequence[str] = ("center", "width"), seed: int = 7) -> dict[str, PipelineModel]:
    """One boosted-tree model for each of centre and width; rows with a null feature or target are left out of the fit."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    tree = lambda t: GBTRegressor(featuresCol="_features", labelCol=t, predictionCol=f"{t}pred", maxIter=10, maxDepth=4, seed=seed)
    rows = df.dropna(subset=list(features))
    return {t: Pipeline(stages=[assemble, tree(t)]).fit(rows.dropna(subset=[t])) for t in targets}


def _missing(features: Sequence[str]) -> Column:
    missing = F.lit(False)
    for c in features:
        missing = missing | F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`")
    return missing


def class_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with a score column for each label. The stage that knows the labels is used without its label column."""
    labels = model.stages[0].labels
    out = df
    for stage in model.stages[1:-1]:
        out = stage.transform(out)
    out = out.withColumn("_p", vector_to_array("probability"))
    return out.select(*df.columns, *[F.col("_p")[i].alias(x) for i, x in enumerate(labels)])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Class scores, best label and its score of every row; all null where a feature is missing."""
    labels = model.stages[0].labels
    missing = _missing(model.stages[1].getInputCols())
    found = max_prediction(class_scores(model, df.drop("label", "score").withColumn("_missing", missing)), labels)
    shown = [F.when(~F.col("_missing"), F.col(f"`{c}`")).alias(c) if c in (*labels, "score", "label") else F.col(f"`{c}`") for c in found.columns]
    return found.select(*[x for x, c in zip(shown, found.columns, strict=True) if c != "_missing"])


def predict_bounds(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """centerpred and widthpred of every row, the width not below 0; null where a feature is missing."""
    missing = _missing(next(iter(models.values())).stages[0].getInputCols())
    out = df.withColumn("_missing", missing)
    for m in models.values():
        out = m.transform(out).drop("_features")
    shown = {f"{t}pred": F.when(~F.col("_missing"), F.col(f"{t}pred")) for t in models}
    if "width" in models:
        shown["widthpred"] = F.when(~F.col("_missing"), F.greatest("widthpred", F.lit(0.0)))
    return out.withColumns(shown).drop("_missing")
