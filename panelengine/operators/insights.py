"""From model features back to levers, and from lists of recommendations to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import LEVERS
from .linear import LinearModel

# Model targets that speak for an output lever
REVENUE = ("revenue_month_1", "revenue_month_2", "revenue_month_3")
LEVER_TARGETS = {
    "total_revenue": REVENUE,
    "total_members": ("member_count_month_3", *REVENUE),
    "retention_rate": ("retention_rate_month_3", "member_count_month_3"),
    "avg_ticket_price": REVENUE,
    "class_attendance_rate": REVENUE,
    "new_members": ("member_count_month_3", "revenue_month_1"),
    "staff_utilization_rate": REVENUE,
    "upsell_rate": REVENUE,
    "total_classes_held": REVENUE,
}


def feature_to_lever(feature: Column) -> Column:
    """The lever a feature stands for: itself, else the first whose name it holds, else the first
    that shares a word of more than three letters, else the feature's own name."""
    holds = [F.when(feature.contains(lv), F.lit(lv)) for lv in LEVERS]
    shares = []
    for lv in LEVERS:
        words = [w for w in lv.split("_") if len(w) > 3]
        any_word = F.lit(False)
        for w in words:
            any_word = any_word | feature.contains(w)
        shares.append(F.when(any_word, F.lit(lv)))
    return F.coalesce(*[F.when(feature == lv, F.lit(lv)) for lv in LEVERS], *holds, *shares, feature)


def relates_to_inputs(feature: Column, levers: str = "levers") -> Column:
    """Whether a feature's name holds that of a lever the request gives, also when both are
    written without underscores."""
    plain = F.regexp_replace(F.lower(feature), "_", "")
    out = F.lit(False)
    for lv in LEVERS:
        hit = feature.contains(lv) | plain.contains(lv.replace("_", ""))
        out = out | (F.col(f"{levers}.{lv}").isNotNull() & hit)
    return out


def contributions(df: DataFrame, model: LinearModel, keys: list[str]) -> DataFrame:
    """Rows (keys, target, feature, contribution): coefficient times value, features of
    coefficient 0 left out."""
    items = []
    for t, name in enumerate(model.targets):
        for j, c in enumerate(model.features):
            if model.coef[j, t]:
                items.append(F.struct(F.lit(name).alias("target"), F.lit(c).alias("feature"), (F.lit(float(model.coef[j, t])) * F.col(c).cast("double")).alias("contribution")))
    return df.select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.*")


def top_drivers(rows: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    w = Window.partitionBy(*keys, "target").orderBy(F.desc(F.round(F.abs("contribution"), 6)), "feature")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def dedup_drivers(rows: DataFrame, keys: list[str], order: list, n: int = 5) -> DataFrame:
    """The first row per (keys, lever, feature) in ``order``, then the first ``n`` per keys."""
    first = Window.partitionBy(*keys, "input_lever", "feature").orderBy(*order)
    out = rows.withColumn("_first", F.row_number().over(first)).where(F.col("_first") == 1).drop("_first")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def lever_insights(drivers: DataFrame) -> DataFrame:
    """Per request and output lever, its at most five distinct drivers. ``drivers`` has
    request_id, levers, target, feature, contribution and rank; targets are taken in the order
    of LEVER_TARGETS."""
    pairs = [F.struct(F.lit(lv).alias("output_lever"), F.lit(t).alias("target"), F.lit(i).alias("target_no")) for lv, ts in LEVER_TARGETS.items() for i, t in enumerate(ts)]
    related = drivers.where(relates_to_inputs(F.col("feature"))).withColumn("input_lever", feature_to_lever(F.col("feature")))
    x = related.withColumn("p", F.explode(F.filter(F.array(*pairs), lambda p: p["target"] == F.col("target"))))
    x = x.select("request_id", F.col("p.output_lever").alias("output_lever"), F.col("p.target_no").alias("target_no"), "target", "rank", "input_lever", "feature", "contribution")
    return dedup_drivers(x, ["request_id", "output_lever"], ["target_no", "rank"])


def consolidate_recommendations(promoted: DataFrame, top: int = 5) -> DataFrame:
    """``promoted`` (metric, product, corr) over several metrics: how many promote a product, the
    mean correlation and the metrics; the first ``top`` by count, then mean."""
    g = promoted.groupBy("product").agg(
        F.count(F.lit(1)).alias("n_metrics"), F.avg("corr").alias("mean_corr"), F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metrics")
    )
    w = Window.orderBy(F.desc("n_metrics"), F.desc(F.round("mean_corr", 6)), "product")  # one row per product of the catalogue
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def metric_estimates(per_target: DataFrame) -> DataFrame:
    """One row of baseline metrics from test metrics (target, rmse, mae, r2, mape in %): the
    accuracies are estimates from the mean positive MAPE of the revenue targets and R2."""
    revenue = F.col("target").isin(*REVENUE) & (F.col("mape") > 0)
    one = per_target.agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"), F.avg(F.when(revenue, F.col("mape"))).alias("m"))
    m = F.coalesce(F.when(F.col("m") > 1, F.col("m") / 100.0).otherwise(F.col("m")), F.lit(0.08))
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    return one.select(
        "rmse", "mae", "r2", m.alias("mape"), clamp(1 - m * 5, 0.5, 0.95).alias("accuracy_within_5pct"), clamp(1 - m * 3, 0.7, 0.98).alias("accuracy_within_10pct"),
        clamp(F.col("r2"), 0.5, 0.98).alias("forecast_accuracy"), clamp(F.col("r2") * 1.05, 0.7, 0.99).alias("directional_accuracy"),
    )
