"""Augmentation of training rows (#230-#235): rows-only checks (hash-seeded randomness)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment as AU
from ..operators import features as FE
from .catalog import register
from .common import features


def _train(spark, sf):
    feat = features(spark, sf)
    cols = FE.feature_columns(feat) + list(FE.DEFAULT_SPEC.targets)
    train = feat.where(F.col("split") == "train").select("entity_id", "month", *cols)
    return train, cols


def _indexed(spark, sf):
    train, cols = _train(spark, sf)
    idx, n = AU.dense_index(train, ["entity_id", "month"])
    return idx, n, cols


@register("augment_bootstrap")
def q_augment_bootstrap(spark, sf):
    idx, n, cols = _indexed(spark, sf)
    return AU.bootstrap(idx, n, n // 6, cols)


@register("augment_noise")
def q_augment_noise(spark, sf):
    idx, n, cols = _indexed(spark, sf)
    return AU.add_noise(AU.bootstrap(idx, n, n // 6, cols), cols)


@register("augment_interpolate")
def q_augment_interpolate(spark, sf):
    idx, n, cols = _indexed(spark, sf)
    return AU.interpolate(idx, n, n // 6, cols)


@register("augment_mixup")
def q_augment_mixup(spark, sf):
    idx, n, cols = _indexed(spark, sf)
    return AU.mixup(idx, n, n // 6, cols)


@register("augment_union")
def q_augment_union(spark, sf):
    train, cols = _train(spark, sf)
    return AU.augment(train, cols)


@register("augment_validate")
def q_augment_validate(spark, sf):
    train, cols = _train(spark, sf)
    aug = AU.augment(train, cols)
    return AU.validate_augmentation(train, aug, [c for c in cols if c not in FE.DEFAULT_SPEC.targets])
