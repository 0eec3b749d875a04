"""Forecast evaluation: baselines, regression / business metrics, ensembles.

Predictions travel in two shapes:

* wide  - keys, ``dataset``, ``model``, ``actual_<t>``, ``predicted_<t>`` for the 5 targets
* long  - keys, ``dataset``, ``model``, ``target``, ``actual``, ``predicted``

Every metric is a grouped aggregate on one of them (map-side partial aggregation; the
group count is models x datasets x targets, tiny), so evaluating a billion predictions
costs one pass.  Sequence metrics (direction, trend) use an entity-partitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dbl, round2
from ..spec import DEFAULT_SPEC, REVENUE_TARGETS, TARGETS, PanelSpec
from .quality import stack
from .ranks import numbered, quantiles

KEYS = ("entity_id", "month")


# --- baselines (#168-#170) ------------------------------------------------------------


def _wide(df: DataFrame, model: str, preds: dict[str, Column], spec: PanelSpec) -> DataFrame:
    cols = [F.col(spec.entity), F.col(spec.month), F.col(spec.split).alias("dataset"), F.lit(model).alias("model")]
    for t in spec.targets:
        cols += [F.col(t).cast("double").alias(f"actual_{t}"), preds[t].cast("double").alias(f"predicted_{t}")]
    return df.select(*cols)


def baseline_last_value(feat: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Persistence: the current value predicts every horizon."""
    p = {t: F.col(spec.revenue) for t in REVENUE_TARGETS}
    p[spec.targets[3]] = F.col(spec.members)
    p[spec.targets[4]] = F.col(spec.retention)
    return _wide(feat, "baseline_last_value", p, spec)


def baseline_mean(feat: DataFrame, spec: PanelSpec = DEFAULT_SPEC, train_splits=("train",)) -> DataFrame:
    """Training mean of each target (one-row aggregate, broadcast)."""
    means = feat.where(F.col(spec.split).isin(*train_splits)).agg(
        *[F.avg(t).alias(f"_mean_{t}") for t in spec.targets]
    )
    j = feat.crossJoin(F.broadcast(means))
    return _wide(j, "baseline_mean", {t: F.col(f"_mean_{t}") for t in spec.targets}, spec)


def baseline_linear_trend(feat: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """current + (current - previous) * h; retention constant."""
    rev_trend = F.col(spec.revenue) - F.col("prev_month_revenue")
    p = {t: F.col(spec.revenue) + rev_trend * (i + 1) for i, t in enumerate(REVENUE_TARGETS)}
    p[spec.targets[3]] = F.col(spec.members) + (F.col(spec.members) - F.col("prev_month_members")) * 3
    p[spec.targets[4]] = F.col(spec.retention)
    return _wide(feat, "baseline_linear_trend", p, spec)


def all_baselines(feat: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    return baseline_last_value(feat, spec).unionByName(baseline_mean(feat, spec)).unionByName(
        baseline_linear_trend(feat, spec)
    )


# --- shapes ----------------------------------------------------------------------------


def to_long(wide: DataFrame, targets=TARGETS) -> DataFrame:
    keep = [c for c in wide.columns if not c.startswith(("actual_", "predicted_"))]
    body = ", ".join(f"'{t}', `actual_{t}`, `predicted_{t}`" for t in targets)
    return wide.selectExpr(*[f"`{c}`" for c in keep], f"stack({len(targets)}, {body}) AS (target, actual, predicted)")


def audit_predictions(wide: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Audit rows (#8): actual / predicted / residual / abs / pct error per target plus a
    per-dataset ``sample_index`` in (entity, month) order."""
    cols = [spec.entity, spec.month, "dataset", "model"]
    for t in spec.targets:
        a, p = F.col(f"actual_{t}"), F.col(f"predicted_{t}")
        cols += [
            a.alias(f"actual_{t}"), p.alias(f"predicted_{t}"), (a - p).alias(f"residual_{t}"),
            F.abs(a - p).alias(f"abs_error_{t}"), (F.abs(F.try_divide(a - p, a)) * 100).alias(f"pct_error_{t}"),
        ]
    return numbered(wide.select(*cols), ["model", "dataset"], [spec.entity, spec.month], "sample_index")


# --- regression metrics (#97-#100) ------------------------------------------------------


def _valid(long: DataFrame) -> DataFrame:
    return long.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())


def regression_metrics(long: DataFrame, by=("model", "dataset", "target"), mape_eps: float = 1e-10) -> DataFrame:
    e = F.col("actual") - F.col("predicted")
    sse = F.sum(e * e)
    sst = F.var_pop("actual") * F.count(F.lit(1))
    denom = F.col("actual") + dbl(mape_eps) if mape_eps else F.col("actual")
    return _valid(long).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        round2(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
        round2(F.avg(F.abs(e)), 2).alias("mae"),
        round2(1 - F.try_divide(sse, sst), 4).alias("r2"),
        round2(F.avg(F.abs(F.try_divide(e, denom))) * 100, 2).alias("mape"),
    )


def error_bias(long: DataFrame, by=("model", "dataset", "target")) -> DataFrame:
    err = F.col("predicted") - F.col("actual")
    return _valid(long).groupBy(*by).agg(
        round2(F.avg(err), 2).alias("mean_error"), round2(F.stddev_pop(err), 2).alias("std_error")
    )


def step_direction_accuracy(long: DataFrame, by=("model", "dataset", "target"), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """sign(y_t - y_{t-1}) == sign(p_t - p_{t-1}) over each entity's successive rows."""
    w = Window.partitionBy(*by, spec.entity).orderBy(spec.month)
    d = long.where(F.col("target").isin(*REVENUE_TARGETS)).select(
        *by,
        F.signum(F.col("actual") - F.lag("actual").over(w)).alias("sa"),
        F.signum(F.col("predicted") - F.lag("predicted").over(w)).alias("sp"),
    )
    return d.where(F.col("sa").isNotNull() & F.col("sp").isNotNull()).groupBy(*by).agg(
        round2(F.avg((F.col("sa") == F.col("sp")).cast("double")) * 100, 2).alias("directional_accuracy")
    )


# --- business metrics (#101-#103) ----------------------------------------------------------


def _pct(t: str) -> Column:
    return F.abs(F.try_divide(F.col(f"predicted_{t}") - F.col(f"actual_{t}"), F.col(f"actual_{t}"))) * 100


def business_metrics(wide: DataFrame, by=("model", "dataset"), spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    r = list(REVENUE_TARGETS)
    pct = [_pct(t) for t in r]
    n3 = 3.0
    within = lambda lim: sum((p <= lim).cast("double") for p in pct) / n3
    large = sum((p > 15.0).cast("double") for p in pct) / n3
    impact = sum(p * F.when(p > 10, 2.0).otherwise(1.0) for p in pct) / n3
    sum_a = sum(F.col(f"actual_{t}") for t in r)
    sum_p = sum(F.col(f"predicted_{t}") for t in r)
    cum = F.abs(F.try_divide(sum_p - sum_a, sum_a))
    dirs = [
        (F.signum(F.col(f"actual_{r[i + 1]}") - F.col(f"actual_{r[i]}"))
         == F.signum(F.col(f"predicted_{r[i + 1]}") - F.col(f"predicted_{r[i]}"))).cast("double")
        for i in range(2)
    ]
    w = Window.partitionBy(*by, spec.entity).orderBy(spec.month)
    trend = (
        F.signum(F.col(f"actual_{r[0]}") - F.lag(f"actual_{r[0]}").over(w))
        == F.signum(F.col(f"predicted_{r[0]}") - F.lag(f"predicted_{r[0]}").over(w))
    ).cast("double")
    mem, ret = spec.targets[3], spec.targets[4]
    rows = wide.select(
        *by,
        within(5.0).alias("w5"), within(10.0).alias("w10"), cum.alias("cum"), ((dirs[0] + dirs[1]) / 2).alias("dir"),
        impact.alias("impact"), *[p.alias(f"mape{i + 1}") for i, p in enumerate(pct)],
        _pct(mem).alias("mem"), F.abs(F.col(f"predicted_{ret}") - F.col(f"actual_{ret}")).alias("ret"),
        trend.alias("trend"), large.alias("large"),
    )
    one = rows.groupBy(*by).agg(
        round2(F.avg("w5") * 100, 2).alias("within_5_percent"),
        round2(F.avg("w10") * 100, 2).alias("within_10_percent"),
        round2((1 - F.avg("cum")) * 100, 2).alias("forecast_accuracy"),
        round2(F.avg("dir") * 100, 2).alias("directional_accuracy"),
        round2(100 - F.avg("impact"), 2).alias("business_impact_score"),
        round2(F.avg("mape1"), 2).alias("mape_month_1"),
        round2(F.avg("mape2"), 2).alias("mape_month_2"),
        round2(F.avg("mape3"), 2).alias("mape_month_3"),
        round2(F.avg("mem"), 2).alias("member_prediction_mape"),
        round2(F.avg("ret"), 4).alias("retention_prediction_mae"),
        round2(F.avg("trend") * 100, 2).alias("revenue_trend_consistency"),
        round2(F.avg("large") * 100, 2).alias("large_error_rate"),
    )
    names = [
        "within_5_percent", "within_10_percent", "forecast_accuracy", "directional_accuracy",
        "business_impact_score", "mape_month_1", "mape_month_2", "mape_month_3", "member_prediction_mape",
        "retention_prediction_mae", "revenue_trend_consistency", "large_error_rate",
    ]
    body = ", ".join(f"'{n}', `{n}`" for n in names)
    return one.selectExpr(*by, f"stack({len(names)}, {body}) AS (metric, value)")


def horizon_breakdown(wide: DataFrame, by=("model", "dataset")) -> DataFrame:
    body = ", ".join(f"'Month_{i + 1}', `actual_{t}`, `predicted_{t}`" for i, t in enumerate(REVENUE_TARGETS))
    long = wide.selectExpr(*by, f"stack(3, {body}) AS (horizon, actual, predicted)")
    long = long.select(
        *by, "horizon", F.abs(F.col("predicted") - F.col("actual")).alias("ae"),
        (F.abs(F.try_divide(F.col("predicted") - F.col("actual"), F.col("actual"))) * 100).alias("pe"),
        ((F.col("predicted") - F.col("actual")) ** 2).alias("se"),
    )
    keys = [*by, "horizon"]
    cells = F.explode(F.array(F.struct(F.lit("ae").alias("m"), F.col("ae").alias("v")), F.struct(F.lit("pe").alias("m"), F.col("pe").alias("v")))).alias("x")
    medians = quantiles(long.select(*keys, cells).select(*keys, "x.m", "x.v"), [*keys, "m"], "v", [0.5])
    medians = medians.groupBy(*keys).agg(
        round2(F.max(F.when(F.col("m") == "ae", F.col("q0"))), 2).alias("median_abs_error"),
        round2(F.max(F.when(F.col("m") == "pe", F.col("q0"))), 2).alias("median_pct_error"),
    )
    out = long.groupBy(*keys).agg(
        round2(F.avg("ae"), 2).alias("mean_abs_error"),
        round2(F.max("ae"), 2).alias("max_abs_error"),
        round2(F.avg("pe"), 2).alias("mean_pct_error"),
        round2(F.avg((F.col("pe") <= 5.0).cast("double")) * 100, 2).alias("within_5pct"),
        round2(F.avg((F.col("pe") <= 10.0).cast("double")) * 100, 2).alias("within_10pct"),
        round2(F.sqrt(F.avg("se")), 2).alias("rmse"),
    )
    return out.join(medians, keys)


def quarterly_metrics(wide: DataFrame, by=("model", "dataset")) -> DataFrame:
    qa = sum(F.col(f"actual_{t}") for t in REVENUE_TARGETS)
    qp = sum(F.col(f"predicted_{t}") for t in REVENUE_TARGETS)
    pe = F.abs(F.try_divide(qp - qa, qa)) * 100
    x = wide.select(*by, pe.alias("pe"), F.abs(qp - qa).alias("ae"))
    return x.groupBy(*by).agg(
        round2(F.avg("pe"), 2).alias("quarterly_mape"),
        round2(F.sum("ae"), 2).alias("total_quarterly_error"),
        round2(F.avg((F.col("pe") <= 5.0).cast("double")) * 100, 2).alias("quarterly_within_5pct"),
        round2(F.avg((F.col("pe") <= 10.0).cast("double")) * 100, 2).alias("quarterly_within_10pct"),
    )


# --- residuals (#104, #105) ---------------------------------------------------------------


def residual_analysis(long: DataFrame, by=("model", "dataset", "target")) -> DataFrame:
    r = _valid(long).select(
        *by, (F.col("actual") - F.col("predicted")).alias("res"),
        (F.abs(F.try_divide(F.col("actual") - F.col("predicted"), F.col("actual"))) * 100).alias("pct"),
    )
    stats = r.groupBy(*by).agg(F.stddev_samp("res").alias("_sd"))
    j = r.join(F.broadcast(stats), list(by))  # one row per group: models x datasets x targets
    return j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        round2(F.avg("res"), 2).alias("mean_residual"),
        round2(F.stddev_samp("res"), 2).alias("std_residual"),
        round2(F.max(F.abs("res")), 2).alias("max_abs_error"),
        round2(F.avg("pct"), 2).alias("mean_pct_error"),
        round2(F.max("pct"), 2).alias("max_pct_error"),
        F.count_if(F.abs("res") > 2 * F.col("_sd")).alias("outliers_2std"),
    )


def residual_histogram(long: DataFrame, bins: int = 20, by=("model", "dataset", "target")) -> DataFrame:
    """numpy.histogram over [min, max] with ``bins`` equal bins; max falls in the last bin."""
    # residuals rounded to 4 dp first: bin edges must not depend on the last bits of a sum
    r = _valid(long).select(*by, round2(F.col("actual") - F.col("predicted"), 4).alias("res"))
    rng = r.groupBy(*by).agg(F.min("res").alias("lo"), F.max("res").alias("hi"))
    j = r.join(F.broadcast(rng), list(by))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col("res") - F.col("lo")) / width) + 1, F.lit(bins))
    ).cast("int")
    return j.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


# --- ensembles (#106, #107, #158-#160) ------------------------------------------------------


def ensemble_weights(long: DataFrame, dataset: str = "validation") -> DataFrame:
    """Inverse validation RMSE over all targets, normalised to sum 1."""
    e = F.col("predicted") - F.col("actual")
    r = _valid(long).where(F.col("dataset") == dataset).groupBy("model").agg(F.sqrt(F.avg(e * e)).alias("val_rmse"))
    inv = 1.0 / F.col("val_rmse")
    return r.select("model", round2("val_rmse", 2).alias("val_rmse"), round2(inv / F.sum(inv).over(Window.partitionBy()), 6).alias("weight"))


def ensemble_predict(long: DataFrame, weights: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    j = long.join(F.broadcast(weights.select("model", "weight")), "model")  # one row per model
    return j.groupBy(spec.entity, spec.month, "dataset", "target").agg(
        F.first("actual").alias("actual"), F.sum(F.col("weight") * F.col("predicted")).alias("predicted")
    ).withColumn("model", F.lit("ensemble"))


def ensemble_interval(long: DataFrame, z: float = 1.96, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """mean +- z * population std across member models, per row and target."""
    g = long.groupBy(spec.entity, spec.month, "dataset", "target").agg(
        F.first("actual").alias("actual"), F.avg("predicted").alias("pred_mean"), F.stddev_pop("predicted").alias("pred_std")
    )
    return g.select(
        "*", (F.col("pred_mean") - z * F.col("pred_std")).alias("lower"), (F.col("pred_mean") + z * F.col("pred_std")).alias("upper")
    )


def interval_coverage(intervals: DataFrame, by=("dataset",)) -> DataFrame:
    inside = F.col("actual").between(F.col("lower"), F.col("upper")).cast("double")
    return intervals.where(F.col("actual").isNotNull()).groupBy(*by).agg(round2(F.avg(inside) * 100, 2).alias("coverage_pct"))


def per_model_metrics(long: DataFrame, dataset: str = "test") -> DataFrame:
    """RMSE / MAE / R2 of each model over all targets flattened together (#159, #98)."""
    return regression_metrics(long.where(F.col("dataset") == dataset), by=("model",)).drop("mape")


def argbest_model(metrics: DataFrame, by_r2: bool = True) -> DataFrame:
    if by_r2:
        return metrics.agg(F.max_by("model", "r2").alias("best_model"), F.max("r2").alias("best_r2"))
    return metrics.agg(F.min_by("model", "rmse").alias("best_model"), F.min("rmse").alias("best_rmse"))
