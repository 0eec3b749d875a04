"""Model registry as tables: per version a coefficient table (parquet) and a metadata
record (JSON), under the shared checkpoint folder.  Listing versions is a read of the
metadata files with the version parsed from the path, sorted by semantic version."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def registry_root(spark: SparkSession, name: str = "registry") -> str:
    return os.path.join(ensure_checkpoint_dir(spark), name)


def save_model(spark: SparkSession, root: str, model, version: str, extra: dict | None = None) -> None:
    model.coefficient_table(spark, version).write.mode("overwrite").parquet(os.path.join(root, f"coefficients_v{version}"))
    meta = {"model_type": model.kind, "n_features": len(model.features), "targets": ",".join(model.targets),
            "features": ",".join(model.features), **{k: str(v) for k, v in (model.params | (extra or {})).items()}}
    spark.createDataFrame([tuple(meta.values())], ", ".join(f"`{k}` string" if not isinstance(v, int) else f"`{k}` long" for k, v in meta.items())) \
        .coalesce(1).write.mode("overwrite").json(os.path.join(root, f"metadata_v{version}"))


def scan_model_registry(spark: SparkSession, root: str) -> DataFrame:
    meta = spark.read.json(os.path.join(root, "metadata_v*"))
    version = F.regexp_extract(F.input_file_name(), r"metadata_v([0-9.]+)", 1)
    parts = F.split(version, r"\.")
    return meta.select(
        version.alias("version"), "model_type", "n_features", "targets",
        parts.getItem(0).cast("int").alias("_maj"), parts.getItem(1).cast("int").alias("_min"), parts.getItem(2).cast("int").alias("_pat"),
    ).orderBy(F.desc("_maj"), F.desc("_min"), F.desc("_pat")).drop("_maj", "_min", "_pat")


def load_coefficients(spark: SparkSession, root: str, version: str) -> DataFrame | None:
    path = os.path.join(root, f"coefficients_v{version}")
    try:
        return spark.read.parquet(path)
    except Exception:  # absent version -> None, as the reference returns None
        return None
