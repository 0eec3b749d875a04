"""Exact explanations of linear predictions.

For a linear model the SHAP value of feature j is ``phi_j = beta_j (x_j - mu_j)`` with
``mu`` the background mean, and ``base + sum(phi) = prediction`` exactly.  Contributions
are built as an array of structs per row and sorted with ``array_sort`` inside the row, so
ranking the top drivers needs no shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import DEFAULT_SPEC, PanelSpec
from .linear import LinearModel
from .whatif import hashed_uniform


def _eight_digits(v: Column) -> Column:
    """Rounded to eight significant digits: contributions that differ in the last bits only tie,
    and the feature's name decides."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(v)) - 7)
    return F.when(v > 0, F.rint(v / unit) * unit).otherwise(F.lit(0.0))


def background_order(df: DataFrame, seed: int = 42, keys=("entity_id", "month")) -> Column:
    """Hash that orders rows for the background, whatever the partitioning; a date counts as the
    number of its month, other keys are whole numbers."""
    number = lambda k: F.year(k) * 12 + F.month(k) if isinstance(df.schema[k].dataType, (T.DateType, T.TimestampType)) else F.col(k).cast("long")
    return hashed_uniform(*[number(k) for k in keys], F.lit(seed))


def background_mean(df: DataFrame, features: list[str], n: int = 100, seed: int = 42, keys=("entity_id", "month")) -> np.ndarray:
    """Mean of at most ``n`` rows picked by a seeded hash order (deterministic whatever
    the partitioning; a top-n per task, then a merge of n-row lists)."""
    sample = background_sample(df, n, seed, keys)
    row = sample.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return np.array([row[f"m{i}"] for i in range(len(features))], dtype=float)


def background_sample(df: DataFrame, n: int = 100, seed: int = 42, keys=("entity_id", "month")) -> DataFrame:
    return df.orderBy(background_order(df, seed, keys), *keys).limit(n)


def explanations(
    df: DataFrame, model: LinearModel, bg_mean: np.ndarray | None, top: int = 5, spec: PanelSpec = DEFAULT_SPEC
) -> DataFrame:
    """Long table (entity, month, target, rank, feature, phi, base, prediction); ``bg_mean``
    None gives the coefficient fallback x * beta with the intercept as base (#183). One scan:
    a row carries an array over the targets, each with its contributions sorted by size."""
    centred = []
    for j, c in enumerate(model.features):
        x = F.col(f"`{c}`").cast("double")
        centred.append(x if bg_mean is None else x - F.lit(float(bg_mean[j])))
    x = F.array(*centred)
    names = F.array(*[F.lit(c) for c in model.features])
    targets = []
    for t, name in enumerate(model.targets):
        base = float(model.intercept[t]) + (0.0 if bg_mean is None else float(bg_mean @ model.coef[:, t]))
        targets.append(F.struct(F.lit(name).alias("target"), F.lit(base).alias("base"), F.array(*[F.lit(float(b)) for b in model.coef[:, t]]).alias("coefs")))
    each = df.select(spec.entity, spec.month, x.alias("_x")).select(spec.entity, spec.month, "_x", F.explode(F.array(*targets)).alias("_t"))
    phi = F.zip_with(F.zip_with("_x", "_t.coefs", lambda a, b: a * b), names, lambda v, n: F.struct((-_eight_digits(F.abs(v))).alias("size"), n.alias("feature"), v.alias("phi")))
    each = each.select(spec.entity, spec.month, "_t", phi.alias("_phi"))
    total = F.aggregate("_phi", F.lit(0.0), lambda acc, s: acc + s["phi"])
    ranked = F.slice(F.array_sort("_phi"), 1, top)
    out = each.select(spec.entity, spec.month, F.col("_t.target").alias("target"), F.col("_t.base").alias("base_value"), (F.col("_t.base") + total).alias("prediction"), F.posexplode(ranked).alias("pos", "c"))
    return out.select(spec.entity, spec.month, "target", (F.col("pos") + 1).alias("rank"), F.col("c.feature").alias("feature"), F.col("c.phi").alias("phi"), "base_value", "prediction")


def shap_totals(df: DataFrame, model: LinearModel, bg_mean: np.ndarray, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Total |phi| per feature over all rows and targets (#182): one aggregate pass."""
    aggs = []
    for j, c in enumerate(model.features):
        x = F.col(c).cast("double") - F.lit(float(bg_mean[j]))
        s = sum((F.abs(F.lit(float(model.coef[j, t])) * x) for t in range(len(model.targets))), F.lit(0.0))
        aggs.append(F.sum(s).alias(f"s{j}"))
    one = df.agg(*aggs)
    body = ", ".join(f"'{c}', s{j}" for j, c in enumerate(model.features))
    return one.selectExpr(f"stack({len(model.features)}, {body}) AS (feature, total_abs_shap)")


def global_importance(coefs: DataFrame) -> DataFrame:
    """|scaled coef| rank and sign per target, from the coefficient table (#184)."""
    w = Window.partitionBy("target").orderBy(F.abs("scaled_coef").desc(), "feature")
    return coefs.select(
        "target", "feature", F.abs("scaled_coef").alias("importance"),
        F.when(F.col("scaled_coef") >= 0, "positive").otherwise("negative").alias("direction"),
        F.row_number().over(w).alias("rank"),
    )
