"""Sinks and nested formatting (#7, #10, #24)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.nested import round_nested
from ..operators import products as P
from ..sources.sinks import roundtrip
from .catalog import register
from .common import features, raw
from .oracle_features import ENGINEERED_COLUMNS, select_cols, with_features
from .q_whatif import _PL, _corr_long_sql
from .oracle_panel import with_panel


@register("sink_engineered", with_features(f"SELECT {select_cols(ENGINEERED_COLUMNS + ['split'])} FROM feat"))
def q_sink_engineered(spark, sf):
    """Engineered panel written as parquet partitioned by split, read back."""
    return roundtrip(features(spark, sf), "engineered", ["split"])


@register("product_artifacts_roundtrip", _corr_long_sql(with_panel, "panel", _PL, "lever"))
def q_product_artifacts_roundtrip(spark, sf):
    """Product x lever correlation artifact saved and reloaded (long table)."""
    return roundtrip(P.corr_product_lever(raw(spark, sf)), "product_lever_corr")


@register("round_nested")
def q_round_nested(spark, sf):
    """Per entity: its last three months as an array of structs plus a map of means, every
    double rounded to 2 decimals through the schema walk."""
    p = raw(spark, sf)
    w = Window.partitionBy("entity_id").orderBy(F.col("month").desc())
    last3 = p.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 3)
    nested = last3.groupBy("entity_id").agg(
        F.sort_array(F.collect_list(F.struct("month", "total_revenue", "retention_rate", "avg_ticket_price"))).alias("months"),
        F.create_map(F.lit("avg_revenue"), F.avg("total_revenue"), F.lit("avg_ticket"), F.avg("avg_ticket_price")).alias("means"),
    )
    return round_nested(nested)
