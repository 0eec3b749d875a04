"""Baselines and evaluation metrics (#8, #9, #67, #97-#107, #143, #158-#160, #168-#170)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..spec import REVENUE_TARGETS, TARGETS
from ..sources.sinks import roundtrip
from .catalog import register
from .common import features
from .oracle_features import with_features
from .oracle_panel import r2

MODELS = ("baseline_last_value", "baseline_mean", "baseline_linear_trend")


def _wide_select(model: str, preds: dict[str, str]) -> str:
    cols = ", ".join(f"CAST({t} AS DOUBLE) AS actual_{t}, CAST({preds[t]} AS DOUBLE) AS predicted_{t}" for t in TARGETS)
    return f"SELECT entity_id, month, split AS dataset, '{model}' AS model, {cols} FROM feat"


def _baseline_ctes() -> str:
    last = {t: "total_revenue" for t in REVENUE_TARGETS}
    last.update({TARGETS[3]: "total_members", TARGETS[4]: "retention_rate"})
    mean = {t: f"(SELECT m_{t} FROM tm)" for t in TARGETS}
    trend = {t: f"total_revenue + (total_revenue - prev_month_revenue) * {i + 1}" for i, t in enumerate(REVENUE_TARGETS)}
    trend[TARGETS[3]] = "total_members + (total_members - prev_month_members) * 3"
    trend[TARGETS[4]] = "retention_rate"
    tm = ", ".join(f"avg({t}) AS m_{t}" for t in TARGETS)
    long = "\nUNION ALL ".join(
        f"SELECT entity_id, month, dataset, model, '{t}' AS target, actual_{t} AS actual, predicted_{t} AS predicted FROM pw"
        for t in TARGETS
    )
    return f"""tm AS (SELECT {tm} FROM feat WHERE split = 'train'),
pw_last AS ({_wide_select('baseline_last_value', last)}),
pw_mean AS ({_wide_select('baseline_mean', mean)}),
pw_trend AS ({_wide_select('baseline_linear_trend', trend)}),
pw AS (SELECT * FROM pw_last UNION ALL SELECT * FROM pw_mean UNION ALL SELECT * FROM pw_trend),
pl AS ({long}),
plv AS (SELECT * FROM pl WHERE actual IS NOT NULL AND predicted IS NOT NULL)"""


def msql(body: str, extra: str = "") -> str:
    ctes = _baseline_ctes() + (",\n" + extra.strip() if extra else "")
    return with_features(body, extra_ctes=ctes)


def _baselines(spark, sf):
    return M.all_baselines(features(spark, sf))


def _long(spark, sf):
    return M.to_long(_baselines(spark, sf))


# ---------------------------------------------------------------- baselines


@register("baseline_last_value", msql("SELECT * FROM pw_last"))
def q_baseline_last_value(spark, sf):
    return M.baseline_last_value(features(spark, sf))


@register("baseline_mean", msql("SELECT * FROM pw_mean"))
def q_baseline_mean(spark, sf):
    return M.baseline_mean(features(spark, sf))


@register("baseline_linear_trend", msql("SELECT * FROM pw_trend"))
def q_baseline_linear_trend(spark, sf):
    return M.baseline_linear_trend(features(spark, sf))


def _audit_sql():
    cols = ", ".join(
        f"actual_{t}, predicted_{t}, actual_{t} - predicted_{t} AS residual_{t}, abs(actual_{t} - predicted_{t}) AS abs_error_{t}, "
        f"abs((actual_{t} - predicted_{t}) / NULLIF(actual_{t}, 0)) * 100 AS pct_error_{t}"
        for t in TARGETS
    )
    return msql(
        f"SELECT entity_id, month, dataset, model, {cols}, "
        "row_number() OVER (PARTITION BY model, dataset ORDER BY entity_id, month) - 1 AS sample_index FROM pw_last"
    )


@register("sink_audit_predictions", _audit_sql())
def q_sink_audit_predictions(spark, sf):
    return roundtrip(M.audit_predictions(M.baseline_last_value(features(spark, sf))), "audit", ["dataset"])


# ---------------------------------------------------------------- regression metrics

_E = "(actual - predicted)"


def _reg_sql(by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, {r2(f'sqrt(avg({_E} * {_E}))', 2)} AS rmse, {r2(f'avg(abs({_E}))', 2)} AS mae,
       {r2(f'1 - sum({_E} * {_E}) / NULLIF(var_pop(actual) * count(*), 0)', 4)} AS r2,
       {r2(f'avg(abs({_E} / NULLIF(actual + 1e-10, 0))) * 100', 2)} AS mape
FROM plv GROUP BY {by}"""


@register("regression_metrics", msql(_reg_sql("model, dataset, target")))
def q_regression_metrics(spark, sf):
    return M.regression_metrics(_long(spark, sf))


@register("overall_metrics", msql(_reg_sql("model, dataset")))
def q_overall_metrics(spark, sf):
    return M.regression_metrics(_long(spark, sf), by=("model", "dataset"))


_ERR = "(predicted - actual)"


@register(
    "error_bias",
    msql(f"SELECT model, dataset, target, {r2(f'avg({_ERR})', 2)} AS mean_error, {r2(f'stddev_pop({_ERR})', 2)} AS std_error FROM plv GROUP BY ALL"),
)
def q_error_bias(spark, sf):
    return M.error_bias(_long(spark, sf))


_DIR = f"""SELECT model, dataset, target, {r2('avg(CAST(sa = sp AS DOUBLE)) * 100', 2)} AS directional_accuracy FROM (
  SELECT model, dataset, target,
         sign(actual - lag(actual) OVER w) AS sa, sign(predicted - lag(predicted) OVER w) AS sp
  FROM pl WHERE target IN ({', '.join(f"'{t}'" for t in REVENUE_TARGETS)})
  WINDOW w AS (PARTITION BY model, dataset, target, entity_id ORDER BY month))
WHERE sa IS NOT NULL AND sp IS NOT NULL GROUP BY ALL"""


@register("step_direction_accuracy", msql(_DIR))
def q_step_direction_accuracy(spark, sf):
    return M.step_direction_accuracy(_long(spark, sf))


@register(
    "metrics_by_dataset",
    msql(
        f"""SELECT r.*, b.mean_error, b.std_error, d.directional_accuracy
            FROM ({_reg_sql('model, dataset, target')}) r
            JOIN (SELECT model, dataset, target, {r2(f'avg({_ERR})', 2)} AS mean_error, {r2(f'stddev_pop({_ERR})', 2)} AS std_error FROM plv GROUP BY ALL) b
              USING (model, dataset, target)
            LEFT JOIN ({_DIR}) d USING (model, dataset, target)
            WHERE model = 'baseline_last_value'"""
    ),
)
def q_metrics_by_dataset(spark, sf):
    long = M.to_long(M.baseline_last_value(features(spark, sf)))
    keys = ["model", "dataset", "target"]
    return (
        M.regression_metrics(long)
        .join(M.error_bias(long), keys)
        .join(M.step_direction_accuracy(long), keys, "left")
    )


# ---------------------------------------------------------------- business metrics


def _pct(t):
    return f"(abs((predicted_{t} - actual_{t}) / NULLIF(actual_{t}, 0)) * 100)"


def _business_sql():
    r = list(REVENUE_TARGETS)
    p = [_pct(t) for t in r]
    within = lambda lim: "(" + " + ".join(f"CAST({x} <= {lim} AS DOUBLE)" for x in p) + ") / 3.0"
    large = "(" + " + ".join(f"CAST({x} > 15.0 AS DOUBLE)" for x in p) + ") / 3.0"
    impact = "(" + " + ".join(f"{x} * CASE WHEN {x} > 10 THEN 2.0 ELSE 1.0 END" for x in p) + ") / 3.0"
    sa = " + ".join(f"actual_{t}" for t in r)
    sp = " + ".join(f"predicted_{t}" for t in r)
    dirs = " + ".join(
        f"CAST(sign(actual_{r[i + 1]} - actual_{r[i]}) = sign(predicted_{r[i + 1]} - predicted_{r[i]}) AS DOUBLE)" for i in range(2)
    )
    m, rt = TARGETS[3], TARGETS[4]
    rows = f"""SELECT model, dataset, {within(5.0)} AS w5, {within(10.0)} AS w10,
       abs(({sp}) - ({sa})) / NULLIF({sa}, 0) AS cum, ({dirs}) / 2 AS dir, {impact} AS impact,
       {p[0]} AS mape1, {p[1]} AS mape2, {p[2]} AS mape3, {_pct(m)} AS mem, abs(predicted_{rt} - actual_{rt}) AS ret,
       CAST(sign(actual_{r[0]} - lag(actual_{r[0]}) OVER w) = sign(predicted_{r[0]} - lag(predicted_{r[0]}) OVER w) AS DOUBLE) AS trend,
       {large} AS large
FROM pw WINDOW w AS (PARTITION BY model, dataset, entity_id ORDER BY month)"""
    aggs = {
        "within_5_percent": r2("avg(w5) * 100", 2), "within_10_percent": r2("avg(w10) * 100", 2),
        "forecast_accuracy": r2("(1 - avg(cum)) * 100", 2), "directional_accuracy": r2("avg(dir) * 100", 2),
        "business_impact_score": r2("100 - avg(impact)", 2), "mape_month_1": r2("avg(mape1)", 2),
        "mape_month_2": r2("avg(mape2)", 2), "mape_month_3": r2("avg(mape3)", 2),
        "member_prediction_mape": r2("avg(mem)", 2), "retention_prediction_mae": r2("avg(ret)", 4),
        "revenue_trend_consistency": r2("avg(trend) * 100", 2), "large_error_rate": r2("avg(large) * 100", 2),
    }
    one = "SELECT model, dataset, " + ", ".join(f"{v} AS {k}" for k, v in aggs.items()) + " FROM r GROUP BY model, dataset"
    body = "\nUNION ALL ".join(f"SELECT model, dataset, '{k}' AS metric, {k} AS value FROM one" for k in aggs)
    return body, f"r AS ({rows}),\none AS ({one})"


@register("business_metrics", msql(*_business_sql()))
def q_business_metrics(spark, sf):
    return M.business_metrics(_baselines(spark, sf))


def _horizon_sql():
    parts = "\nUNION ALL ".join(
        f"SELECT model, dataset, 'Month_{i + 1}' AS horizon, abs(predicted_{t} - actual_{t}) AS ae, {_pct(t)} AS pe, "
        f"(predicted_{t} - actual_{t}) * (predicted_{t} - actual_{t}) AS se FROM pw"
        for i, t in enumerate(REVENUE_TARGETS)
    )
    body = f"""SELECT model, dataset, horizon, {r2('avg(ae)', 2)} AS mean_abs_error, {r2('quantile_cont(ae, 0.5)', 2)} AS median_abs_error,
       {r2('max(ae)', 2)} AS max_abs_error, {r2('avg(pe)', 2)} AS mean_pct_error, {r2('quantile_cont(pe, 0.5)', 2)} AS median_pct_error,
       {r2('avg(CAST(pe <= 5.0 AS DOUBLE)) * 100', 2)} AS within_5pct, {r2('avg(CAST(pe <= 10.0 AS DOUBLE)) * 100', 2)} AS within_10pct,
       {r2('sqrt(avg(se))', 2)} AS rmse
FROM h GROUP BY ALL"""
    return body, f"h AS ({parts})"


@register("horizon_breakdown", msql(*_horizon_sql()))
def q_horizon_breakdown(spark, sf):
    return M.horizon_breakdown(_baselines(spark, sf))


def _quarterly_sql():
    qa = " + ".join(f"actual_{t}" for t in REVENUE_TARGETS)
    qp = " + ".join(f"predicted_{t}" for t in REVENUE_TARGETS)
    body = f"""SELECT model, dataset, {r2('avg(pe)', 2)} AS quarterly_mape, {r2('sum(ae)', 2)} AS total_quarterly_error,
       {r2('avg(CAST(pe <= 5.0 AS DOUBLE)) * 100', 2)} AS quarterly_within_5pct,
       {r2('avg(CAST(pe <= 10.0 AS DOUBLE)) * 100', 2)} AS quarterly_within_10pct
FROM (SELECT model, dataset, abs(({qp}) - ({qa})) / NULLIF({qa}, 0) * 100 AS pe, abs(({qp}) - ({qa})) AS ae FROM pw)
GROUP BY ALL"""
    return body


@register("quarterly_metrics", msql(_quarterly_sql()))
def q_quarterly_metrics(spark, sf):
    return M.quarterly_metrics(_baselines(spark, sf))


# ---------------------------------------------------------------- residuals


@register(
    "residual_analysis",
    msql(
        f"""SELECT model, dataset, target, count(*) AS n, {r2('avg(res)', 2)} AS mean_residual, {r2('stddev_samp(res)', 2)} AS std_residual,
                   {r2('max(abs(res))', 2)} AS max_abs_error, {r2('avg(pct)', 2)} AS mean_pct_error, {r2('max(pct)', 2)} AS max_pct_error,
                   count(*) FILTER (WHERE abs(res) > 2 * sd) AS outliers_2std
            FROM (SELECT model, dataset, target, actual - predicted AS res,
                         abs((actual - predicted) / NULLIF(actual, 0)) * 100 AS pct,
                         stddev_samp(actual - predicted) OVER (PARTITION BY model, dataset, target) AS sd FROM plv)
            GROUP BY ALL"""
    ),
)
def q_residual_analysis(spark, sf):
    return M.residual_analysis(_long(spark, sf))


@register(
    "residual_histogram",
    msql(
        """SELECT model, dataset, target, CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((res - lo) / ((hi - lo) / 20)) + 1, 20) END AS INTEGER) AS bin,
                  count(*) AS count
           FROM (SELECT model, dataset, target, res, min(res) OVER (PARTITION BY model, dataset, target) AS lo,
                        max(res) OVER (PARTITION BY model, dataset, target) AS hi
                 FROM (SELECT model, dataset, target, round_even((actual - predicted) * 10000, 0) / 10000 AS res FROM plv))
           GROUP BY ALL"""
    ),
)
def q_residual_histogram(spark, sf):
    return M.residual_histogram(_long(spark, sf))


# ---------------------------------------------------------------- ensembles over the baselines

_WEIGHTS = f"""wt AS (
  SELECT model, sqrt(avg((predicted - actual) * (predicted - actual))) AS val_rmse FROM plv WHERE dataset = 'validation' GROUP BY model),
wts AS (SELECT model, val_rmse, (1.0 / val_rmse) / sum(1.0 / val_rmse) OVER () AS weight FROM wt)"""


@register("ensemble_weights", msql(f"SELECT model, {r2('val_rmse', 2)} AS val_rmse, {r2('weight', 6)} AS weight FROM wts", extra=_WEIGHTS))
def q_ensemble_weights(spark, sf):
    return M.ensemble_weights(_long(spark, sf))


def _ens_weights_df(long):
    # full-precision weights for prediction
    e = F.col("predicted") - F.col("actual")
    r = long.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull() & (F.col("dataset") == "validation"))
    r = r.groupBy("model").agg(F.sqrt(F.avg(e * e)).alias("val_rmse"))
    from pyspark.sql import Window

    return r.select("model", ((1.0 / F.col("val_rmse")) / F.sum(1.0 / F.col("val_rmse")).over(Window.partitionBy())).alias("weight"))


@register(
    "ensemble_predict",
    msql(
        f"""SELECT entity_id, month, dataset, target, any_value(actual) AS actual, {r2('sum(weight * predicted)', 2)} AS predicted, 'ensemble' AS model
            FROM pl JOIN wts USING (model) GROUP BY entity_id, month, dataset, target""",
        extra=_WEIGHTS,
    ),
)
def q_ensemble_predict(spark, sf):
    long = _long(spark, sf)
    out = M.ensemble_predict(long, _ens_weights_df(long))
    return out.withColumn("predicted", F.rint(F.col("predicted") * 100) / 100)


_INTERVAL = """iv AS (
  SELECT entity_id, month, dataset, target, any_value(actual) AS actual, avg(predicted) AS pred_mean, stddev_pop(predicted) AS pred_std
  FROM pl GROUP BY entity_id, month, dataset, target)"""


@register(
    "ensemble_interval",
    msql(
        f"""SELECT entity_id, month, dataset, target, actual, {r2('pred_mean', 2)} AS pred_mean, {r2('pred_std', 2)} AS pred_std,
                   {r2('pred_mean - 1.96 * pred_std', 2)} AS lower, {r2('pred_mean + 1.96 * pred_std', 2)} AS upper FROM iv""",
        extra=_INTERVAL,
    ),
)
def q_ensemble_interval(spark, sf):
    iv = M.ensemble_interval(_long(spark, sf))
    rnd = lambda c: (F.rint(F.col(c) * 100) / 100).alias(c)
    return iv.select("entity_id", "month", "dataset", "target", "actual", rnd("pred_mean"), rnd("pred_std"), rnd("lower"), rnd("upper"))


@register(
    "interval_coverage",
    msql(
        f"""SELECT dataset, {r2('avg(CAST(actual BETWEEN pred_mean - 1.96 * pred_std AND pred_mean + 1.96 * pred_std AS DOUBLE)) * 100', 2)} AS coverage_pct
            FROM iv WHERE actual IS NOT NULL GROUP BY dataset""",
        extra=_INTERVAL,
    ),
)
def q_interval_coverage(spark, sf):
    return M.interval_coverage(M.ensemble_interval(_long(spark, sf)))


_PER_MODEL = f"""pm AS (
  SELECT model, count(*) AS n, {r2(f'sqrt(avg({_E} * {_E}))', 2)} AS rmse, {r2(f'avg(abs({_E}))', 2)} AS mae,
         {r2(f'1 - sum({_E} * {_E}) / NULLIF(var_pop(actual) * count(*), 0)', 4)} AS r2
  FROM plv WHERE dataset = 'test' GROUP BY model)"""


@register("per_model_metrics", msql("SELECT * FROM pm", extra=_PER_MODEL))
def q_per_model_metrics(spark, sf):
    return M.per_model_metrics(_long(spark, sf))


@register("argbest_model", msql("SELECT max_by(model, r2) AS best_model, max(r2) AS best_r2 FROM pm", extra=_PER_MODEL))
def q_argbest_model(spark, sf):
    return M.argbest_model(M.per_model_metrics(_long(spark, sf)))


_SINK_METRICS = (
    "within_5_percent", "within_10_percent", "forecast_accuracy", "directional_accuracy", "business_impact_score", "mape_month_1", "mape_month_2", "mape_month_3",
    "member_prediction_mape", "retention_prediction_mae", "revenue_trend_consistency", "large_error_rate",
)
_SINK_QUARTERLY = ("quarterly_mape", "total_quarterly_error", "quarterly_within_5pct", "quarterly_within_10pct")
_SINK_HORIZON = ("mean_abs_error", "median_abs_error", "max_abs_error", "mean_pct_error", "median_pct_error", "within_5pct", "within_10pct", "rmse")


def _sink_sql() -> str:
    only = "model = 'baseline_last_value' AND dataset = 'test'"
    cols = [f"(SELECT {m} FROM one WHERE {only}) AS {m}" for m in _SINK_METRICS]
    cols += [f"(SELECT {m} FROM qu WHERE {only}) AS {m}" for m in _SINK_QUARTERLY]
    cols += [f"(SELECT {m} FROM ho WHERE {only} AND horizon = 'Month_{i}') AS Month_{i}_{m}" for i in (1, 2, 3) for m in _SINK_HORIZON]
    horizon, cells = _horizon_sql()
    extra = _business_sql()[1] + f",\nqu AS ({_quarterly_sql()}),\n{cells},\nho AS ({horizon})"
    return msql("SELECT " + ", ".join(cols), extra=extra)


@register("sink_metrics", _sink_sql())
def q_sink_metrics(spark, sf):
    """All metrics of the test rows as one wide row, written and read back."""
    w = M.baseline_last_value(features(spark, sf))
    test = F.col("dataset") == "test"
    bm = M.business_metrics(w).where(test).groupBy().pivot("metric", list(_SINK_METRICS)).agg(F.max("value"))
    qu = M.quarterly_metrics(w).where(test).select(*_SINK_QUARTERLY)
    ho = M.horizon_breakdown(w).where(test).agg(
        *[F.max(F.when(F.col("horizon") == f"Month_{i}", F.col(m))).alias(f"Month_{i}_{m}") for i in (1, 2, 3) for m in _SINK_HORIZON]
    )
    return roundtrip(bm.crossJoin(qu).crossJoin(ho), "metrics")  # one row each


@register(
    "average_report_metrics",
    msql(
        f"""SELECT r.model, {r2('avg(r.rmse)', 2)} AS avg_rmse, {r2('avg(r.mape)', 2)} AS avg_mape, {r2('avg(r.r2)', 4)} AS avg_r2,
                   any_value(b.value) AS within_10_percent,
                   avg(r.mape) < 10 AND any_value(b.value) > 70 AS approved
            FROM ({_reg_sql('model, dataset, target')}) r
            JOIN (SELECT model, dataset, value FROM one_long WHERE metric = 'within_10_percent') b USING (model, dataset)
            WHERE r.dataset = 'test' GROUP BY r.model""",
        extra=_business_sql()[1] + ",\none_long AS (" + _business_sql()[0] + ")",
    ),
)
def q_average_report_metrics(spark, sf):
    """Mean RMSE / MAPE / R2 over the targets on the test split and the approval rule
    (MAPE < 10 and within-10 % > 70)."""
    w = _baselines(spark, sf)
    reg = M.regression_metrics(M.to_long(w)).where(F.col("dataset") == "test")
    bm = M.business_metrics(w).where((F.col("dataset") == "test") & (F.col("metric") == "within_10_percent"))
    g = reg.groupBy("model").agg(F.avg("rmse").alias("_rmse"), F.avg("mape").alias("_mape"), F.avg("r2").alias("_r2"))
    j = g.join(bm.select("model", F.col("value").alias("within_10_percent")), "model")
    rnd = lambda c, d: (F.rint(F.col(c) * 10**d) / 10**d)
    return j.select(
        "model", rnd("_rmse", 2).alias("avg_rmse"), rnd("_mape", 2).alias("avg_mape"), rnd("_r2", 4).alias("avg_r2"),
        "within_10_percent", ((F.col("_mape") < 10) & (F.col("within_10_percent") > 70)).alias("approved"),
    )
