"""Tree ensembles with MLlib: one regressor per target on an assembled feature vector.
Training is distributed by MLlib (histogram aggregation per tree level); predictions are
appended as columns and evaluated with the metric aggregates."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import DEFAULT_SPEC, PanelSpec

# Model settings of the reference
GBM_PARAMS = {"maxIter": 50, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 10}
RF_PARAMS = {"numTrees": 200, "maxDepth": 10}


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="error").transform(df)


def fit_per_target(train: DataFrame, features: list[str], kind: str = "gbt", spec: PanelSpec = DEFAULT_SPEC,
                   validation_col: str | None = None, seed: int = 42) -> dict:
    data = assemble(train, features)
    models = {}
    for t in spec.targets:
        rows = data.where(F.col(t).isNotNull())
        if kind == "gbt":
            extra = {"validationIndicatorCol": validation_col, "validationTol": 0.01} if validation_col else {}
            est = GBTRegressor(featuresCol="_features", labelCol=t, predictionCol=f"predicted_{t}", seed=seed, **GBM_PARAMS, **extra)
        else:
            est = RandomForestRegressor(featuresCol="_features", labelCol=t, predictionCol=f"predicted_{t}", seed=seed, **RF_PARAMS)
        models[t] = est.fit(rows)
    return models


def predict(df: DataFrame, features: list[str], models: dict, model_name: str, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Wide predictions (keys, dataset, model, actual_t, predicted_t)."""
    x = assemble(df, features)
    for t, m in models.items():
        x = m.transform(x)
    cols = [F.col(spec.entity), F.col(spec.month), F.col(spec.split).alias("dataset"), F.lit(model_name).alias("model")]
    for t in spec.targets:
        cols += [F.col(t).cast("double").alias(f"actual_{t}"), F.col(f"predicted_{t}")]
    return x.select(*cols)


def importances(spark, models: dict, features: list[str], target: str, top: int = 20) -> DataFrame:
    imp = models[target].featureImportances.toArray()
    rows = sorted(((features[i], float(v)) for i, v in enumerate(imp)), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(rows)], "feature string, importance double, rank int")
