"""Per-entity history summaries (the history service of the reference, for all entities
in one job).

One window ranks each entity's months newest-first; a groupBy on the same key then folds
the last ``n`` rows.  The window's shuffle already clusters rows by entity, so the
aggregate adds no second exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dbl, round2
from ..spec import DEFAULT_SPEC, LEVER_NAMES, PanelSpec


def _newest_first(spec: PanelSpec):
    return Window.partitionBy(spec.entity).orderBy(F.col(spec.month).desc())


def with_recency(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, name: str = "recency") -> DataFrame:
    """1 = latest month of the entity."""
    return df.withColumn(name, F.row_number().over(_newest_first(spec)))


def last_n_per_entity(df: DataFrame, n: int = 12, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    return with_recency(df, spec).where(F.col("recency") <= n).drop("recency")


def latest_value(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    return df.groupBy(spec.entity).agg(
        F.max_by(spec.revenue, spec.month).alias("latest_revenue"),
        F.max_by(spec.members, spec.month).alias("latest_members"),
    )


def _ewm_newest_first(value: str, recency: str = "recency", decay: float = 0.5):
    w = F.pow(dbl(decay), F.col(recency) - 1)
    return F.sum(w * F.col(value)) / F.sum(w)


def tail3_stats(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, history: int = 12) -> DataFrame:
    """Last-3-row means / std and the EWM (span 3) of the last ``history`` rows at the
    latest row: the rolling inputs of a request's feature row."""
    h = last_n_per_entity_ranked(df, history, spec)
    in3 = F.col("recency") <= 3
    return h.groupBy(spec.entity).agg(
        F.avg(F.when(in3, F.col(spec.retention))).alias("tail3_avg_retention"),
        F.avg(F.when(in3, F.col(spec.revenue))).alias("tail3_avg_revenue"),
        F.avg(F.when(in3, F.col("class_attendance_rate"))).alias("tail3_avg_attendance"),
        round2(F.stddev_samp(F.when(in3, F.col(spec.revenue)))).alias("tail3_std_revenue"),
        round2(_ewm_newest_first(spec.revenue)).alias("ewm_revenue"),
    )


def last_n_per_entity_ranked(df: DataFrame, n: int, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    return with_recency(df, spec).where(F.col("recency") <= n)


def entity_summary(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, n: int = 12) -> DataFrame:
    """Months, means and latest values over the last ``n`` months, for every entity (#81, #83)."""
    h = last_n_per_entity_ranked(df, n, spec)
    return h.groupBy(spec.entity).agg(
        F.count(F.lit(1)).alias("months_of_data"),
        F.avg(spec.revenue).alias("avg_revenue"),
        F.avg(spec.members).alias("avg_members"),
        F.avg(spec.retention).alias("avg_retention"),
        F.max_by(spec.revenue, spec.month).alias("latest_revenue"),
        F.max_by(spec.members, spec.month).alias("latest_members"),
    )


def history_context(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, n: int = 12) -> DataFrame:
    """Everything a request needs from its entity's last ``n`` months, one row per entity:
    latest values, last-3 statistics, EWM, latest calendar month, lever means (#37) and the
    6-month lever trends (#70)."""
    h = last_n_per_entity_ranked(df, n, spec)
    in3 = F.col("recency") <= 3
    in6 = F.col("recency") <= 6
    present = set(df.columns)
    lever_means = [
        F.avg(F.col(lv)).alias(f"hist_{lv}") for lv in LEVER_NAMES if lv in present
    ]
    trends = []
    for lv in LEVER_NAMES:
        if lv in present:
            last = F.max_by(F.when(in6, F.col(lv)), F.when(in6, -F.col("recency")))
            first = F.max_by(F.when(in6, F.col(lv)), F.when(in6, F.col("recency")))
            cnt = F.count_if(in6)  # rows, also those without a value; a missing end leaves no trend
            trends.append(F.try_divide((last - first).cast("double"), cnt.cast("double")).alias(f"trend_{lv}"))
    return h.groupBy(spec.entity).agg(
        F.count(F.lit(1)).alias("n_hist"),
        F.max_by(spec.revenue, spec.month).alias("last_revenue"),
        F.max_by(spec.members, spec.month).alias("last_members"),
        F.max(spec.month).alias("last_month"),
        F.avg(F.when(in3, F.col(spec.retention))).alias("tail3_avg_retention"),
        F.avg(F.when(in3, F.col(spec.revenue))).alias("tail3_avg_revenue"),
        F.avg(F.when(in3, F.col("class_attendance_rate"))).alias("tail3_avg_attendance"),
        F.stddev_samp(F.when(in3, F.col(spec.revenue))).alias("tail3_std_revenue"),
        _ewm_newest_first(spec.revenue).alias("ewm_revenue"),
        F.avg(spec.revenue).alias("mean_revenue"),
        *lever_means,
        *trends,
    )
