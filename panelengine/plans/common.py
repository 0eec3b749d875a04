"""Shared plan pieces for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.features import engineer_features, nan_to_null
from ..session import ensure_checkpoint_dir
from ..sources.tpch import build_panel


def panel(spark: SparkSession, sf_dir: str, level: str = "nation", **options) -> DataFrame:
    return build_panel(spark, sf_dir, level, **options)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the cluster's ``spark.checkpoint.dir``: downstream jobs
    read the written rows instead of re-planning (and re-running) the whole lineage, and
    survive executor loss.  Never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def features(spark: SparkSession, sf_dir: str, drop: bool = True, split: bool = True, level: str = "nation") -> DataFrame:
    """Engineered panel, materialized once per job (the feature plan is ~80 window and
    scalar expressions deep; every model/evaluation job reads it several times)."""
    return materialize(engineer_features(panel(spark, sf_dir, level), drop=drop, split=split))


def feature_frame(spark: SparkSession, sf_dir: str, drop: bool = True, split: bool = True, level: str = "nation") -> DataFrame:
    """The engineered panel as a plan, for queries that read it once: columns that they do not
    use are pruned down to the panel."""
    return engineer_features(panel(spark, sf_dir, level), drop=drop, split=split)


def raw(spark: SparkSession, sf_dir: str, level: str = "nation") -> DataFrame:
    return nan_to_null(panel(spark, sf_dir, level))
