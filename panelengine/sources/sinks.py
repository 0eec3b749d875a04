"""Sinks: partitioned parquet tables under the cluster's shared checkpoint folder, read
back as the next job's source (a written table also cuts lineage)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def table_path(df: DataFrame, name: str) -> str:
    base = ensure_checkpoint_dir(df.sparkSession)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def write_table(df: DataFrame, name: str, partition_by: list[str] | tuple = ()) -> str:
    path = table_path(df, name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def roundtrip(df: DataFrame, name: str, partition_by: list[str] | tuple = ()) -> DataFrame:
    """Write, then read back (partition columns return as regular columns)."""
    path = write_table(df, name, partition_by)
    return df.sparkSession.read.parquet(path)
