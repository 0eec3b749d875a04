"""Leakage-safe time-series features on an entity-month panel.

Every window shares ``W = partitionBy(entity).orderBy(month)``, so the whole feature plan
costs one shuffle on the entity key and one sort; Catalyst stacks the Window operators on
the same partitioning.  Lags/leads are by row (previous / next observed month), as in the
reference.  All engineered values are rounded to 2 decimals the numpy way (half-even on
x*100).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dbl, flag, month_cos, month_sin, round2, safe_div
from ..spec import DEFAULT_SPEC, PanelSpec


def entity_window(spec: PanelSpec = DEFAULT_SPEC):
    return Window.partitionBy(spec.entity).orderBy(spec.month)


# --- entity-level (#18, #47) ------------------------------------------------

def studio_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    w = entity_window(spec)
    df = df.withColumn("studio_age", F.dense_rank().over(w))
    cols = set(df.columns)
    if "studio_location" in cols:
        df = df.withColumn("location_urban", flag(F.col("studio_location") == "urban"))
    if "studio_size_tier" in cols:
        for t in ("small", "medium", "large"):
            df = df.withColumn(f"size_{t}", flag(F.col("studio_size_tier") == t))
    if "studio_price_tier" in cols:
        for t in ("low", "medium", "high"):
            df = df.withColumn(f"price_{t}", flag(F.col("studio_price_tier") == t))
    return df


# --- derived business ratios (#25-#30) ------------------------------------------

def derived_features(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        round2(safe_div("total_revenue", "total_members")).alias("revenue_per_member"),
        round2(1 - F.col("retention_rate")).alias("churn_rate"),
        round2(safe_div("total_class_attendance", F.col("total_classes_held") * 20)).alias("class_utilization"),
        round2(safe_div("staff_count", "total_members")).alias("staff_per_member"),
        round2(F.col("avg_ticket_price") * F.col("retention_rate") * 12).alias("estimated_ltv"),
        round2(safe_div("membership_revenue", "total_revenue")).alias("membership_revenue_pct"),
        round2(safe_div("class_pack_revenue", "total_revenue")).alias("class_pack_revenue_pct"),
    )


# --- lags and growth (#48, #49) -----------------------------------------------------

def lagged_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    w = entity_window(spec)
    df = df.withColumn("prev_month_revenue", round2(F.lag(spec.revenue, 1).over(w))).withColumn(
        "prev_month_members", F.lag(spec.members, 1).over(w)
    )
    return df.withColumn(
        "mom_revenue_growth",
        round2(safe_div(F.col(spec.revenue) - F.col("prev_month_revenue"), "prev_month_revenue")),
    ).withColumn(
        "mom_member_growth",
        round2(safe_div(F.col(spec.members) - F.col("prev_month_members"), "prev_month_members")),
    )


# --- rolling statistics (#50-#52) ----------------------------------------------

def ewm_previous(c: str, spec: PanelSpec = DEFAULT_SPEC, span: float = 3.0, include_current: bool = False) -> Column:
    """pandas ``x.shift(1).ewm(span).mean()`` (adjust=True): sum(a^i x) / sum(a^i) over all
    preceding rows, newest first, a = 1 - 2/(span+1).  The list folded for a row holds the
    entity's months before it, so its size is bounded by the calendar, not by the data."""
    decay = 1.0 - 2.0 / (span + 1.0)
    hi = 0 if include_current else -1
    frame = entity_window(spec).rowsBetween(Window.unboundedPreceding, hi)
    values = F.collect_list(F.col(c).cast("double")).over(frame)
    init = F.struct(dbl(0.0).alias("num"), dbl(0.0).alias("den"))
    folded = F.aggregate(
        values,
        init,
        lambda acc, x: F.struct(
            (acc["num"] * decay + x).alias("num"), (acc["den"] * decay + 1.0).alias("den")
        ),
    )
    return F.when(F.size(values) > 0, folded["num"] / folded["den"])


def rolling_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, min_periods: int = 1) -> DataFrame:
    """3-row rolling mean/std of the *preceding* rows (current row excluded).

    ``min_periods=1`` is the multi-entity behaviour; 3 reproduces the single-series one."""
    frame = entity_window(spec).rowsBetween(-3, -1)

    def mean3(c):
        m = F.avg(c).over(frame)
        if min_periods > 1:
            m = F.when(F.count(c).over(frame) >= min_periods, m)
        return round2(m)

    std = F.stddev_samp(spec.revenue).over(frame)
    if min_periods > 1:
        std = F.when(F.count(spec.revenue).over(frame) >= min_periods, std)
    return df.select(
        "*",
        mean3(spec.retention).alias("3m_avg_retention"),
        mean3(spec.revenue).alias("3m_avg_revenue"),
        mean3("class_attendance_rate").alias("3m_avg_attendance"),
        round2(std).alias("3m_std_revenue"),
        round2(ewm_previous(spec.revenue, spec)).alias("revenue_momentum"),
    )


# --- interactions (#31, #19) --------------------------------------------------------

def interaction_features(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    if "staff_utilization_rate" in cols:
        staff = F.col("staff_utilization_rate") * F.col("total_members")
    elif "staff_count" in cols:
        staff = F.col("staff_count") * F.col("total_members")
    else:
        staff = F.lit(0)
    return df.select(
        "*",
        round2(F.col("retention_rate") * F.col("avg_ticket_price")).alias("retention_x_ticket"),
        round2(F.col("class_attendance_rate") * F.col("total_classes_held")).alias("attendance_x_classes"),
        round2(F.col("upsell_rate") * F.col("total_members")).alias("upsell_x_members"),
        round2(staff).alias("staff_util_x_members"),
    )


# --- calendar (#32-#34) ---------------------------------------------------------------

def cyclical_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    if "month_index" not in df.columns:
        df = df.withColumn("month_index", F.month(spec.month))
    m = F.col("month_index")
    return df.select(
        "*",
        month_sin(m).alias("month_sin"),
        month_cos(m).alias("month_cos"),
        flag(m == 1).alias("is_january"),
        flag(m.isin(6, 7, 8)).alias("is_summer"),
        flag(m == 9).alias("is_fall"),
    )


# --- targets (#53) -------------------------------------------------------------------------

def target_variables(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    w = entity_window(spec)
    t = spec.targets
    return df.select(
        "*",
        F.lead(spec.revenue, 1).over(w).alias(t[0]),
        F.lead(spec.revenue, 2).over(w).alias(t[1]),
        F.lead(spec.revenue, 3).over(w).alias(t[2]),
        F.lead(spec.members, 3).over(w).alias(t[3]),
        F.lead(spec.retention, 3).over(w).alias(t[4]),
    )


# --- row filters (#16, #17) --------------------------------------------------------------

def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every floating column (pandas has only NaN; Spark aggregates treat
    NaN as a value)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_tail_targets(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, horizon: int = 3) -> DataFrame:
    """Rows that still have ``horizon`` future rows (the single-series generator's df[:-3])."""
    w = entity_window(spec)
    return df.withColumn("_ahead", F.lead(spec.revenue, horizon).over(w)).where(F.col("_ahead").isNotNull()).drop("_ahead")


# --- splits (#54, #55) --------------------------------------------------------------------

def temporal_split_entity(
    df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, train: float = 0.75, validation_end: float = 0.90
) -> DataFrame:
    """Per entity, in month order: first int(.75 n) rows train, up to int(.90 n) validation,
    rest test."""
    w = entity_window(spec)
    n = F.count(F.lit(1)).over(Window.partitionBy(spec.entity)).cast("double")
    rn = (F.row_number().over(w) - 1).cast("double")
    label = (
        F.when(rn < F.floor(n * dbl(train)), F.lit("train"))
        .when(rn < F.floor(n * dbl(validation_end)), F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return df.withColumn(spec.split, label)


def temporal_split_global(
    df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, train: float = 0.8, validation: float = 0.1
) -> DataFrame:
    """One cut over the calendar: the distinct months are ranked (a table of months, small
    by construction) and every entity's row takes the split of its month."""
    months = df.select(spec.month).distinct()
    w = Window.orderBy(spec.month)
    n = F.count(F.lit(1)).over(Window.partitionBy()).cast("double")
    rn = (F.row_number().over(w) - 1).cast("double")
    label = (
        F.when(rn < F.floor(n * dbl(train)), F.lit("train"))
        .when(rn < F.floor(n * dbl(train + validation)), F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    months = months.select(spec.month, label.alias(spec.split))
    return df.join(F.broadcast(months), spec.month)


# --- composition (#3.1 feature pipeline) ----------------------------------------------------

def engineer_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, drop: bool = True, split: bool = True) -> DataFrame:
    df = nan_to_null(df)
    df = studio_features(df, spec)
    df = derived_features(df)
    df = lagged_features(df, spec)
    df = rolling_features(df, spec)
    df = interaction_features(df)
    df = cyclical_features(df, spec)
    df = target_variables(df, spec)
    if drop:
        df = drop_incomplete(df)
    if split:
        df = temporal_split_entity(df, spec)
    return df


def feature_columns(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, numeric_only: bool = True) -> list[str]:
    """All columns except keys, labels and targets (#14), numeric only (#15).  Resolved from
    the schema at plan time; no job."""
    excluded = set(spec.non_features) | set(spec.targets)
    out = []
    for f in df.schema.fields:
        if f.name in excluded:
            continue
        if numeric_only and f.dataType.typeName() not in ("integer", "long", "double", "float", "short", "decimal"):
            continue
        out.append(f.name)
    return out
