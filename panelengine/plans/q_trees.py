"""Tree models (#155-#157, #161): rows-only checks (MLlib fits)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting as BO
from ..operators import metrics as M
from ..operators import trees as TM
from . import training as TR
from .catalog import register
from .common import features


def _setup(spark, sf):
    feat = features(spark, sf)
    _, _, sel = TR.train(feat)
    return feat, sel


def _test_metrics(feat, sel, models, name):
    wide = TM.predict(feat, sel, models, name)
    return M.regression_metrics(M.to_long(wide), by=("model", "dataset", "target"))


@register("fit_gbm")
def q_fit_gbm(spark, sf):
    feat, sel = _setup(spark, sf)
    models = TM.fit_per_target(TR.fit_rows(feat), sel, "gbt")
    return _test_metrics(feat, sel, models, "gbm")


@register("fit_random_forest")
def q_fit_random_forest(spark, sf):
    feat, sel = _setup(spark, sf)
    models = TM.fit_per_target(TR.fit_rows(feat), sel, "rf")
    return _test_metrics(feat, sel, models, "random_forest")


BOOSTED = BO.Params(rounds=20, learning_rate=0.2, max_depth=3, max_leaves=8, bins=16, patience=5)


def _boosted(spark, sf, params=BOOSTED):
    """Second-order boosting on train rows, stopped by the validation rows."""
    feat, sel = _setup(spark, sf)
    key = F.col("entity_id") * 100000 + F.year("month") * 12 + F.month("month")
    return feat, BO.fit(TR.fit_rows(feat), sel, list(TR.DEFAULT_SPEC.targets), F.col("split") == "validation", key, params)


@register("fit_boosted_early_stop")
def q_fit_boosted_early_stop(spark, sf):
    """Regularised second-order boosting with early stopping by rounds."""
    feat, model = _boosted(spark, sf)
    wide = BO.predict(feat, model)
    cols = [F.col("entity_id"), F.col("month"), F.col("split").alias("dataset"), F.lit("boosted").alias("model")]
    for t in TR.DEFAULT_SPEC.targets:
        cols += [F.col(t).cast("double").alias(f"actual_{t}"), F.col(f"predicted_{t}")]
    return M.regression_metrics(M.to_long(wide.select(*cols)), by=("model", "dataset", "target"))


@register("boosted_rounds")
def q_boosted_rounds(spark, sf):
    """Validation loss before each round, and whether the round is kept."""
    _, model = _boosted(spark, sf)
    rows = [(t, k, float(v), k < len(model.trees[i])) for i, t in enumerate(model.targets) for k, v in enumerate(model.losses[i])]
    return spark.createDataFrame(rows, "target string, round int, validation_mse double, kept boolean")


@register("tree_importance")
def q_tree_importance(spark, sf):
    feat, sel = _setup(spark, sf)
    models = TM.fit_per_target(TR.fit_rows(feat), sel, "rf")
    return TM.importances(spark, models, sel, "revenue_month_1")
