"""Model-driven request queries: forecasts, sensitivity, inverse search, plans, partial
prediction (#132, #180, #186-#217).

All score with the fixed model of ``fixed_model``, so SQL can follow them; the panel is built
once per query. The operators take any linear model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import confidence_level, dbl, round2
from ..operators import search as S
from ..operators import whatif as WI
from ..spec import LEVERS
from . import oracle_whatif as O
from .catalog import register
from .common import materialize, raw
from .fixed_model import LEVER_MODELS, MODEL
from .oracle_panel import r2
from .oracle_search import search
from .oracle_whatif import FALLBACK_MONTH, wsql

CONTEXT = [
    "n_hist", "last_revenue", "last_members", "last_month", "tail3_avg_retention", "tail3_avg_revenue", "tail3_avg_attendance", "tail3_std_revenue",
    "ewm_revenue",
]


def filled(spark, sf) -> DataFrame:
    """Requests with history and clipped levers, from one build of the panel."""
    p = materialize(raw(spark, sf))
    return WI.clip_levers(WI.fill_missing_levers(WI.with_history(WI.request_table(p), p)))


def _with_features(df: DataFrame, levers: str) -> DataFrame:
    """Feature columns of ``levers`` beside the request's own columns."""
    return WI.request_features(df, levers=levers, month_without_history=FALLBACK_MONTH)


def predictions(df: DataFrame, levers: str, keep: list[str]) -> DataFrame:
    f = _with_features(df.select(*dict.fromkeys([*keep, *CONTEXT, levers])), levers)
    return f.select(*keep, *MODEL.predict_columns(available=set(f.columns)))


def scored(spark, sf) -> DataFrame:
    q = filled(spark, sf)
    keep = ["request_id", "entity_id", "kind", "projection_months", "constraints", "clipped", "filled", *CONTEXT]
    return predictions(q, "clipped", keep)


def _revenue3(df: DataFrame) -> Column:
    return F.col("predicted_revenue_month_1") + F.col("predicted_revenue_month_2") + F.col("predicted_revenue_month_3")


def three_months(df: DataFrame, levers: str) -> DataFrame:
    """``df`` with ``revenue``: predicted over three months for the struct ``levers``."""
    keep = [c for c in df.columns if c != "revenue"]
    p = predictions(df, levers, keep)
    return p.select(*keep, _revenue3(p).alias("revenue"))


# --------------------------------------------------------------------------- forecasts


@register("forecast_monthly", wsql(f"SELECT request_id, month_ahead, {r2('revenue')} AS revenue, member_count, {r2('retention_rate', 6)} AS retention_rate, {r2('confidence_score', 4)} AS confidence_score FROM fc", O.FORECAST))
def q_forecast_monthly(spark, sf):
    m = WI.forecast_monthly(scored(spark, sf))
    return m.select("request_id", "month_ahead", round2("revenue").alias("revenue"), "member_count", round2("retention_rate", 6).alias("retention_rate"), round2("confidence_score", 4).alias("confidence_score"))


@register("forecast_extrapolate", wsql(f"SELECT request_id, month_ahead, {r2('revenue')} AS revenue, member_count FROM fc WHERE month_ahead > 3", O.FORECAST))
def q_forecast_extrapolate(spark, sf):
    m = WI.forecast_monthly(scored(spark, sf)).where(F.col("month_ahead") > 3)
    return m.select("request_id", "month_ahead", round2("revenue").alias("revenue"), "member_count")


@register(
    "forecast_totals",
    wsql(f"SELECT request_id, {r2('sum(revenue)')} AS total_projected_revenue, {r2('avg(confidence_score)', 4)} AS average_confidence, count(*) AS months FROM fc GROUP BY request_id", O.FORECAST),
)
def q_forecast_totals(spark, sf):
    t = WI.forecast_totals(WI.forecast_monthly(scored(spark, sf)))
    return t.select("request_id", round2("total_projected_revenue").alias("total_projected_revenue"), round2("average_confidence", 4).alias("average_confidence"), "months")


@register(
    "horizon_revenue",
    wsql(
        f"SELECT request_id, projection_months, {r2('CASE WHEN projection_months >= 3 THEN r1 + r2 + r3 WHEN projection_months = 2 THEN r1 + r2 ELSE r1 END + CASE WHEN projection_months > 3 THEN (r1 + r2 + r3) / 3 * (projection_months - 3) ELSE 0 END')} AS horizon_revenue "
        "FROM sc WHERE projection_months BETWEEN 1 AND 12",
        O.SCORED,
    ),
)
def q_horizon_revenue(spark, sf):
    """Revenue over the target months: the first <=3 summed, beyond 3 + average * (n - 3)."""
    s = scored(spark, sf).where(F.col("projection_months").between(1, 12))
    r = [F.col(f"predicted_revenue_month_{i}") for i in (1, 2, 3)]
    n = F.col("projection_months")
    first = F.when(n >= 3, r[0] + r[1] + r[2]).when(n == 2, r[0] + r[1]).otherwise(r[0])
    more = F.when(n > 3, (r[0] + r[1] + r[2]) / 3 * (n - 3)).otherwise(F.lit(0.0))
    return s.select("request_id", "projection_months", round2(first + more).alias("horizon_revenue"))


@register(
    "forward_metrics",
    wsql(
        f"""SELECT request_id, {r2('avg(confidence_score)', 3)} AS prediction_confidence, {r2('avg(month_ahead)', 1)} AS prediction_horizon_months,
  CASE WHEN avg(confidence_score) / (1 + 0.15 * (avg(month_ahead) - 1)) >= 0.8 THEN 'High' WHEN avg(confidence_score) / (1 + 0.15 * (avg(month_ahead) - 1)) >= 0.6 THEN 'Medium' ELSE 'Low' END AS confidence_level,
  CASE WHEN avg(confidence_score) >= 0.8 THEN 'high' WHEN avg(confidence_score) >= 0.6 THEN 'moderate' ELSE 'lower' END AS confidence_factor,
  CASE WHEN avg(month_ahead) <= 1.5 THEN 'short' WHEN avg(month_ahead) <= 2.5 THEN 'medium' ELSE 'longer' END AS horizon_factor,
  {r2('2500.0 / NULLIF(mean_revenue, 0) * 100')} AS rmse_pct, {r2('1800.0 / NULLIF(mean_revenue, 0) * 100')} AS mae_pct
FROM fc JOIN (SELECT request_id, mean_revenue FROM rf) USING (request_id) GROUP BY request_id, mean_revenue""",
        O.FORECAST,
    ),
)
def q_forward_metrics(spark, sf):
    """Response metrics of a forecast: the model's baseline errors as they are (in % of the
    entity's mean revenue), and the confidence by itself."""
    q = filled(spark, sf)
    keep = ["request_id", "projection_months", "clipped", "mean_revenue"]
    s = predictions(q, "clipped", keep)
    m = WI.forecast_monthly(s).join(s.select("request_id", "mean_revenue"), "request_id")
    g = m.groupBy("request_id", "mean_revenue").agg(F.avg("confidence_score").alias("c"), F.avg("month_ahead").alias("h"))
    return g.select(
        "request_id", round2("c", 3).alias("prediction_confidence"), round2("h", 1).alias("prediction_horizon_months"),
        confidence_level(F.col("c"), F.col("h")).alias("confidence_level"),
        F.when(F.col("c") >= 0.8, "high").when(F.col("c") >= 0.6, "moderate").otherwise("lower").alias("confidence_factor"),
        F.when(F.col("h") <= 1.5, "short").when(F.col("h") <= 2.5, "medium").otherwise("longer").alias("horizon_factor"),
        *_error_pct(),
    )


#: baseline errors of a model without test results (fixed values)
BASELINE_RMSE, BASELINE_MAE = 2500.0, 1800.0


def _error_pct() -> list[Column]:
    return [round2(F.try_divide(dbl(x), F.col("mean_revenue")) * 100).alias(n) for x, n in ((BASELINE_RMSE, "rmse_pct"), (BASELINE_MAE, "mae_pct"))]


# --------------------------------------------------------------------------- sensitivity


def _varied(spark, sf, changes) -> DataFrame:
    s = scored(spark, sf).withColumnRenamed("predicted_revenue_month_1", "base_revenue")
    v = WI.lever_variations(s.select("request_id", "base_revenue", "clipped", *CONTEXT), changes)
    p = predictions(v, "varied", ["request_id", "lever", "change_pct", "old_value", "new_value", "base_revenue", "varied"])
    return p.withColumnRenamed("predicted_revenue_month_1", "varied_revenue")


@register(
    "candidates_cross_join",
    wsql("SELECT request_id, lever, change_pct, " + ", ".join(f"{r2(f'v_{lv}', 6)} AS {lv}" for lv in O.LV) + " FROM vb", O.variations((-20, -10, 10, 20))),
)
def q_candidates_cross_join(spark, sf):
    v = WI.lever_variations(filled(spark, sf).select("request_id", "clipped"))
    return v.select("request_id", "lever", "change_pct", *[round2(f"varied.{lv}", 6).alias(lv) for lv in LEVERS])


@register(
    "lever_sensitivity_grid",
    wsql(
        f"""SELECT request_id, lever, {r2('s', 4)} AS average_sensitivity, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(s, 6) DESC, lever) AS INTEGER) AS rank FROM (
  SELECT request_id, lever, coalesce(avg(CASE WHEN moved <> 0 THEN abs((varied_revenue - r1) / moved) END), 0) AS s
  FROM (SELECT *, CASE WHEN old_value > 0 THEN (new_value - old_value) / old_value * 100 ELSE 0 END AS moved FROM vc) GROUP BY request_id, lever)""",
        O.variations((-20, -10, 10, 20)),
    ),
)
def q_lever_sensitivity_grid(spark, sf):
    g = WI.average_sensitivity(_varied(spark, sf, (-20, -10, 10, 20)))
    return g.select("request_id", "lever", round2("average_sensitivity", 4).alias("average_sensitivity"), "rank")


_EFFORT = {
    "avg_ticket_price": "low", "upsell_rate": "low", "class_attendance_rate": "medium", "staff_utilization_rate": "medium", "total_classes_held": "medium",
    "total_members": "high", "retention_rate": "high", "new_members": "high",
}


@register(
    "quick_wins",
    wsql(
        f"""SELECT request_id, lever, {r2('gain', 4)} AS revenue_gain, {r2('gain / NULLIF(abs(new_value - old_value), 0)', 4)} AS roi_per_unit, {O.case('lever', _EFFORT, lambda v: f"'{v}'")} AS effort, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(gain, 6) DESC, lever) AS rank FROM (SELECT *, varied_revenue - r1 AS gain FROM vc) WHERE gain > 0) WHERE rank <= 5""",
        O.variations((10,)),
    ),
)
def q_quick_wins(spark, sf):
    d = _varied(spark, sf, (10,)).withColumn("gain", F.col("varied_revenue") - F.col("base_revenue")).where(F.col("gain") > 0)
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("gain", 6)), "lever")
    effort = F.create_map(*[x for lv, e in WI.LEVER_EFFORT.items() for x in (F.lit(lv), F.lit(e))])
    d = d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 5)
    roi = F.try_divide(F.col("gain"), F.abs(F.col("new_value") - F.col("old_value")))
    return d.select("request_id", "lever", round2("gain", 4).alias("revenue_gain"), round2(roi, 4).alias("roi_per_unit"), effort[F.col("lever")].alias("effort"), "rank")


# --------------------------------------------------------------------------- inverse search

TARGET_FACTOR = 1.1
KEYS = ["request_id", "scenario"]
#: scenario name -> allowed increases of retention, ticket and new members (None: no limits)
SCENARIOS = {"free": None, "gentle": (0.02, 5.0, 3.0), "bold": (0.1, 50.0, 30.0)}
#: scenarios that weigh retention, growth and cost beside the revenue
MULTI_SCENARIOS = ("bold",)


def revenue_of_levers(lever) -> Column:
    """Predicted revenue of three months for a function from a lever's name to its column."""
    return MODEL.total_from(WI.request_feature_columns(lever, FALLBACK_MONTH, set(MODEL.features)), [f"revenue_month_{i}" for i in (1, 2, 3)])


def _search_base(spark, sf, scenarios: dict | None) -> DataFrame:
    s = scored(spark, sf)
    base = s.select("request_id", "clipped", "constraints", *CONTEXT, (_revenue3(s) * dbl(TARGET_FACTOR)).alias("target_revenue"), _revenue3(s).alias("current_revenue"))
    if scenarios is None:
        base = base.withColumn("scenario", F.lit("request"))
    else:
        names = ("max_retention_increase", "max_ticket_increase", "max_new_members_increase")
        none = F.lit(None).cast("struct<" + ",".join(f"{n}:double" for n in names) + ">")
        rows = [F.struct(F.lit(k).alias("scenario"), (none if v is None else F.struct(*[dbl(x).alias(n) for x, n in zip(v, names)])).alias("constraints")) for k, v in scenarios.items()]
        base = base.drop("constraints").withColumn("x", F.explode(F.array(*rows))).select("*", "x.*").drop("x")
    return WI.optimization_bounds(base).drop("constraints")


def inverse(spark, sf, scenarios: dict | None = None, multi: Column | None = None) -> DataFrame:
    """The search for 1.1 times the current three months' revenue, per request (with the
    request's own constraints) or per request and scenario; ``multi`` says which rows have
    several objectives."""
    found = S.best_levers(_search_base(spark, sf, scenarios), revenue_of_levers, "request_id", multi=multi)
    return materialize(found.withColumn("recommended", WI.rounded_levers("optimized")))


def _sensitivity(inv: DataFrame) -> DataFrame:
    p = WI.probe_levers(inv.withColumnRenamed("revenue", "best_revenue")).withColumn("scored_probe", WI.rounded_levers("probe"))
    p = three_months(p.drop("bounds", "optimized", "recommended", "probe"), "scored_probe")
    return p.select(*KEYS, "lever", ((F.col("revenue") - F.col("best_revenue")) / F.col("best_revenue") * 100).alias("sensitivity"))


def _changes(inv: DataFrame) -> DataFrame:
    return WI.lever_changes(inv, KEYS).join(_sensitivity(inv), [*KEYS, "lever"])


def _confidence(inv: DataFrame) -> DataFrame:
    un = _spread(inv)
    f = WI.feasibility(inv.withColumn("request_id", F.struct(*KEYS)), "clipped", "recommended").select("request_id.*", "overall_score", "overall_difficulty")
    x = inv.join(un.select(*KEYS, "cv"), KEYS).join(f, KEYS)
    ok = F.abs(F.col("revenue") - F.col("target_revenue")) <= 0.01 * F.col("target_revenue")
    rate = F.when(F.col("target_revenue") > 0, F.col("revenue") / F.col("target_revenue")).otherwise(0.0)
    conf = WI.optimization_confidence(ok, F.col("revenue"), F.col("target_revenue"), F.col("overall_score"), F.col("cv"))
    return x.select("*", ok.alias("success"), F.least(rate, dbl(1.0)).alias("achievement_rate"), conf.alias("confidence_score"))


def _spread(inv: DataFrame) -> DataFrame:
    p = WI.perturbed_levers(inv).withColumn("scored_draw", WI.rounded_levers("perturbed"))
    p = three_months(p.select(*KEYS, *CONTEXT, "scored_draw", "draw"), "scored_draw")
    return WI.uncertainty(p, KEYS)


@register(
    "optimization_bounds",
    wsql("\nUNION ALL ".join(f"SELECT request_id, '{lv}' AS lever, {r2(f'lo_{lv}', 6)} AS lo, {r2(f'hi_{lv}', 6)} AS hi FROM base" for lv in O.LV), f"{O.SCORED},\n{O._target(False)}"),
)
def q_optimization_bounds(spark, sf):
    b = WI.optimization_bounds(filled(spark, sf).select("request_id", "clipped", "constraints"))
    rows = F.array(*[F.struct(F.lit(lv).alias("lever"), round2(f"bounds.{lv}.lo", 6).alias("lo"), round2(f"bounds.{lv}.hi", 6).alias("hi")) for lv in LEVERS])
    return b.select("request_id", F.explode(rows).alias("x")).select("request_id", "x.*")


_FOUND = ", ".join(f"{r2(f'y_{lv}', 4)} AS {lv}" for lv in O.LV)


def _found(x: DataFrame) -> list[Column]:
    return [round2("target_revenue").alias("target_revenue"), round2("revenue").alias("predicted_revenue"), *[round2(f"recommended.{lv}", 4).alias(lv) for lv in LEVERS]]


@register("inverse_line_search", wsql(f"SELECT request_id, {r2('f', 5)} AS f, {r2('target_revenue')} AS target_revenue, {r2('revenue')} AS predicted_revenue, {_FOUND} FROM inv", O.line_search()))
def q_inverse_line_search(spark, sf):
    """All levers together along one line, by one factor."""
    x = WI.line_search(_search_base(spark, sf, None), three_months, KEYS).withColumn("recommended", WI.rounded_levers("optimized"))
    return x.select("request_id", round2("f", 5).alias("f"), *_found(x))


@register("inverse_search", wsql(f"SELECT request_id, method, {r2('target_revenue')} AS target_revenue, {r2('revenue')} AS predicted_revenue, {_FOUND} FROM inv", search()))
def q_inverse_search(spark, sf):
    """Every lever on its own: the best of all methods."""
    x = inverse(spark, sf)
    return x.select("request_id", "method", *_found(x))


@register(
    "inverse_search_multi",
    wsql(f"SELECT request_id, method, {r2('objective', 6)} AS objective, {r2('target_revenue')} AS target_revenue, {r2('revenue')} AS predicted_revenue, {_FOUND} FROM inv", search(multi="true")),
)
def q_inverse_search_multi(spark, sf):
    """The search driven by revenue, retention, growth and cost together."""
    x = inverse(spark, sf, multi=F.lit(True))
    return x.select("request_id", "method", round2("objective", 6).alias("objective"), *_found(x))


@register("objective_single", wsql(f"SELECT request_id, {r2('objective', 2)} AS objective FROM inv", search()))
def q_objective_single(spark, sf):
    return inverse(spark, sf).select("request_id", round2("objective", 2).alias("objective"))


@register("objective_multi", wsql(f"SELECT request_id, {r2(O.multi_objective(), 6)} AS objective FROM inv", search()))
def q_objective_multi(spark, sf):
    x = inverse(spark, sf)
    return x.select("request_id", round2(WI.objective_multi(F.col("revenue"), F.col("target_revenue"), "clipped", "optimized"), 6).alias("objective"))


@register(
    "achievement",
    wsql("SELECT request_id, least(revenue / target_revenue, 1) >= 0.999999 OR round_even(least(revenue / target_revenue, 1) * 1e6, 0) / 1e6 >= 1 AS reached, "
         f"{r2('least(revenue / target_revenue, 1)', 6)} AS achievement, abs(revenue - target_revenue) <= 0.01 * target_revenue AS success FROM inv", search()),
)
def q_achievement(spark, sf):
    x = inverse(spark, sf)
    ach = F.least(F.col("revenue") / F.col("target_revenue"), dbl(1.0))
    return x.select(
        "request_id", ((ach >= 0.999999) | (round2(ach, 6) >= 1)).alias("reached"), round2(ach, 6).alias("achievement"),
        (F.abs(F.col("revenue") - F.col("target_revenue")) <= 0.01 * F.col("target_revenue")).alias("success"),
    )


@register("local_sensitivity", wsql(f"SELECT request_id, lever, {r2('sensitivity', 6)} AS sensitivity FROM pr", f"{search()},\n{O.probes()}"))
def q_local_sensitivity(spark, sf):
    return _sensitivity(inverse(spark, sf)).select("request_id", "lever", round2("sensitivity", 6).alias("sensitivity"))


@register(
    "lever_changes",
    wsql(
        f"SELECT request_id, lever, {r2('current', 4)} AS current, {r2('proposed', 4)} AS proposed, {r2('change', 4)} AS change, {r2('change_pct', 4)} AS change_pct, difficulty, "
        f"CAST(feasibility_score AS DOUBLE) AS feasibility_score, priority, {r2('sensitivity', 6)} AS sensitivity FROM ch",
        f"{search()},\n{O.probes()},\n{O.changes()}",
    ),
)
def q_lever_changes(spark, sf):
    c = _changes(inverse(spark, sf))
    return c.select(
        "request_id", "lever", *[round2(x, 4).alias(x) for x in ("current", "proposed", "change", "change_pct")], "difficulty",
        F.col("feasibility_score").cast("double").alias("feasibility_score"), "priority", round2("sensitivity", 6).alias("sensitivity"),
    )


@register(
    "sort_changes",
    wsql("SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY priority, lever_no) AS INTEGER) AS place, lever, priority FROM ch", f"{search()},\n{O.probes()},\n{O.changes()}"),
)
def q_sort_changes(spark, sf):
    order = F.create_map(*[x for i, lv in enumerate(LEVERS) for x in (F.lit(lv), F.lit(i))])[F.col("lever")]
    w = Window.partitionBy("request_id").orderBy("priority", order)
    return WI.lever_changes(inverse(spark, sf), KEYS).select("request_id", F.row_number().over(w).alias("place"), "lever", "priority")


@register(
    "action_plan",
    wsql(
        f"""SELECT request_id, CAST(step AS INTEGER) AS step, lever, {r2('change_pct', 4)} AS change_pct, difficulty,
  {r2('(revenue - r1 - r2 - r3) * CASE WHEN total > 0 THEN abs(sensitivity) / total ELSE 1.0 / n END')} AS expected_impact,
  CAST(floor({O.case('lever', O.WEEKS)} * CASE difficulty WHEN 'hard' THEN 1.5 WHEN 'very_hard' THEN 2.0 ELSE 1.0 END) AS INTEGER) AS timeline_weeks
FROM (SELECT *, sum(abs(sensitivity)) OVER (PARTITION BY request_id) AS total, count(*) OVER (PARTITION BY request_id) AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY priority, lever_no) AS step FROM ch) WHERE step <= 6)
JOIN (SELECT request_id, revenue, r1, r2, r3 FROM inv) USING (request_id)""",
        f"{search()},\n{O.probes()},\n{O.changes()}",
    ),
)
def q_action_plan(spark, sf):
    inv = inverse(spark, sf)
    c = _changes(inv).join(inv.select(*KEYS, (F.col("revenue") - F.col("current_revenue")).alias("impact")), KEYS)
    p = WI.action_plan(c, "impact")
    return p.select("request_id", "step", "lever", round2("change_pct", 4).alias("change_pct"), "difficulty", round2("expected_impact").alias("expected_impact"), "timeline_weeks")


@register("baseline_trajectory", wsql(f"SELECT request_id, {r2('CASE WHEN projection_months >= 3 THEN r1 + r2 + r3 WHEN projection_months = 2 THEN r1 + r2 ELSE r1 END')} AS current_trajectory FROM sc WHERE projection_months BETWEEN 1 AND 12", O.SCORED))
def q_baseline_trajectory(spark, sf):
    """Revenue of at most the first three months with the levers as they are."""
    s = scored(spark, sf).where(F.col("projection_months").between(1, 12))
    n, r = F.col("projection_months"), [F.col(f"predicted_revenue_month_{i}") for i in (1, 2, 3)]
    return s.select("request_id", round2(F.when(n >= 3, r[0] + r[1] + r[2]).when(n == 2, r[0] + r[1]).otherwise(r[0])).alias("current_trajectory"))


_SPREAD = ("mean_revenue", "std_revenue", "revenue_low", "revenue_high")


@register(
    "uncertainty",
    wsql("SELECT request_id, " + ", ".join(f"{r2(c, 3)} AS {c}" for c in _SPREAD) + f", {r2('cv', 6)} AS cv FROM un", f"{search()},\n{O.perturbations()}"),
)
def q_uncertainty(spark, sf):
    return _spread(inverse(spark, sf)).select("request_id", *[round2(c, 3).alias(c) for c in _SPREAD], round2("cv", 6).alias("cv"))


@register(
    "optimization_confidence",
    wsql(f"SELECT request_id, success, {r2('achievement_rate', 6)} AS achievement_rate, {r2('confidence_score', 6)} AS confidence_score FROM co", f"{search()},\n{O.perturbations()},\n{O.confidence()}"),
)
def q_optimization_confidence(spark, sf):
    c = _confidence(inverse(spark, sf))
    return c.select("request_id", "success", round2("achievement_rate", 6).alias("achievement_rate"), round2("confidence_score", 6).alias("confidence_score"))


_OVERALL = "achievement_rate * 0.4e0 + confidence_score * 0.3e0 + feasibility_score * 0.3e0"


@register(
    "compare_optimization_scenarios",
    wsql(
        f"SELECT request_id, scenario, {r2('revenue')} AS predicted_revenue, {r2(_OVERALL, 6)} AS overall_score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round({_OVERALL}, 6) DESC, scenario) AS INTEGER) AS rank FROM co",
        f"{search(scenarios=True, multi=O.MULTI)},\n{O.perturbations()},\n{O.confidence()}",
    ),
)
def q_compare_optimization_scenarios(spark, sf):
    c = _confidence(inverse(spark, sf, SCENARIOS, F.col("scenario").isin(*MULTI_SCENARIOS)))
    score = F.col("achievement_rate") * 0.4 + F.col("confidence_score") * 0.3 + F.col("overall_score") * 0.3
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("score", 6)), "scenario")
    return c.withColumn("score", score).select("request_id", "scenario", round2("revenue").alias("predicted_revenue"), round2("score", 6).alias("overall_score"), F.row_number().over(w).alias("rank"))


@register(
    "inverse_metrics",
    wsql(
        f"""SELECT request_id, {r2('confidence_score', 3)} AS optimization_confidence, {r2('achievement_rate', 3)} AS target_achievement_rate,
  CASE WHEN achievement_rate >= 0.95 AND confidence_score >= 0.8 THEN 'High' WHEN achievement_rate >= 0.8 AND confidence_score >= 0.6 THEN 'Medium' ELSE 'Low' END AS confidence_level,
  {r2('coalesce(avg_change, 0)')} AS avg_lever_change_pct, coalesce(n, 0) AS n_lever_changes,
  CASE WHEN coalesce(avg_change, 0) <= 15 THEN 'minor' WHEN avg_change <= 30 THEN 'moderate' ELSE 'significant' END AS change_factor,
  {r2('2500.0 / NULLIF(mean_revenue, 0) * 100')} AS rmse_pct, {r2('1800.0 / NULLIF(mean_revenue, 0) * 100')} AS mae_pct
FROM co LEFT JOIN (SELECT request_id, avg(abs(change_pct)) AS avg_change, count(*) AS n FROM ch GROUP BY request_id) USING (request_id)""",
        f"{search()},\n{O.probes()},\n{O.changes()},\n{O.perturbations()},\n{O.confidence()}",
    ),
)
def q_inverse_metrics(spark, sf):
    q = filled(spark, sf).select("request_id", "mean_revenue")
    inv = inverse(spark, sf)
    ch = WI.lever_changes(inv, KEYS).groupBy("request_id").agg(F.avg(F.abs("change_pct")).alias("a"), F.count(F.lit(1)).alias("n"))
    c = _confidence(inv).join(ch, "request_id", "left").join(q, "request_id")
    a, rate, conf = F.coalesce("a", dbl(0.0)), F.col("achievement_rate"), F.col("confidence_score")
    return c.select(
        "request_id", round2(conf, 3).alias("optimization_confidence"), round2(rate, 3).alias("target_achievement_rate"),
        F.when((rate >= 0.95) & (conf >= 0.8), "High").when((rate >= 0.8) & (conf >= 0.6), "Medium").otherwise("Low").alias("confidence_level"),
        round2(a).alias("avg_lever_change_pct"), F.coalesce("n", F.lit(0)).alias("n_lever_changes"),
        F.when(a <= 15, "minor").when(a <= 30, "moderate").otherwise("significant").alias("change_factor"), *_error_pct(),
    )


# --------------------------------------------------------------------------- scenarios of lever sets

#: named lever sets compared per request: (name, lever -> factor); "current" keeps the levers
LEVER_SETS = (
    ("current", {}),
    ("all_plus_10", {lv: 1.10 for lv in LEVERS}),
    ("all_minus_10", {lv: 0.90 for lv in LEVERS}),
    ("price_plus_20", {"avg_ticket_price": 1.20}),
    ("retention_plus_5", {"retention_rate": 1.05}),
)


def _sets_sql() -> str:
    parts = []
    for name, factors in LEVER_SETS:
        cols = []
        for lv in O.LV:
            x = O.clip(f"c_{lv} * {O.d(factors.get(lv, 1.0))}", lv)
            cols.append((f"round_even({x}, 0)" if O.B[lv][3] else x) + f" AS v_{lv}")
        parts.append(f"SELECT rf.*, '{name}' AS scenario, {', '.join(cols)} FROM rf")
    return "vs AS (" + "\nUNION ALL ".join(parts) + f"),\nss AS (SELECT request_id, scenario, {O.predicted('r1', 'v_')} AS r1, {O.predicted('m3', 'v_')} AS m3 FROM vs)"


def _set_scores(spark, sf) -> DataFrame:
    arr = []
    for name, factors in LEVER_SETS:
        fields = []
        for lv, (lo, hi, _, is_int) in LEVERS.items():
            v = F.least(F.greatest(F.col(f"clipped.{lv}") * dbl(factors.get(lv, 1.0)), dbl(lo)), dbl(hi))
            fields.append((F.rint(v) if is_int else v).alias(lv))
        arr.append(F.struct(F.lit(name).alias("scenario"), F.struct(*fields).alias("varied")))
    x = filled(spark, sf).select("request_id", "clipped", *CONTEXT).withColumn("x", F.explode(F.array(*arr))).select("*", "x.*").drop("x")
    p = predictions(x, "varied", ["request_id", "scenario"])
    return p.select("request_id", "scenario", F.col("predicted_revenue_month_1").alias("revenue_month_1"), F.col("predicted_member_count_month_3").alias("member_count_month_3"))


@register(
    "compare_lever_scenarios",
    wsql(f"SELECT request_id, scenario, {r2('r1', 4)} AS revenue_month_1, {r2('m3', 4)} AS member_count_month_3, CAST(row_number() OVER (PARTITION BY request_id ORDER BY round(r1, 6) DESC, scenario) AS INTEGER) AS rank FROM ss", _sets_sql()),
)
def q_compare_lever_scenarios(spark, sf):
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("revenue_month_1", 6)), "scenario")
    sc = _set_scores(spark, sf).withColumn("rank", F.row_number().over(w))
    return sc.select("request_id", "scenario", round2("revenue_month_1", 4).alias("revenue_month_1"), round2("member_count_month_3", 4).alias("member_count_month_3"), "rank")


@register(
    "scenario_ranges",
    wsql(
        f"""SELECT request_id, {r2('min(r1)', 4)} AS min_revenue, {r2('max(r1)', 4)} AS max_revenue, {r2('max(r1) - min(r1)', 4)} AS revenue_spread, {r2('min(m3)', 4)} AS min_members,
  {r2('max(m3)', 4)} AS max_members, arg_min(scenario, rank) AS best_scenario FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(r1, 6) DESC, scenario) AS rank FROM ss) GROUP BY request_id""",
        _sets_sql(),
    ),
)
def q_scenario_ranges(spark, sf):
    w = Window.partitionBy("request_id").orderBy(F.desc(F.round("revenue_month_1", 6)), "scenario")
    sc = _set_scores(spark, sf).withColumn("rank", F.row_number().over(w))
    r, m = F.col("revenue_month_1"), F.col("member_count_month_3")
    return sc.groupBy("request_id").agg(
        round2(F.min(r), 4).alias("min_revenue"), round2(F.max(r), 4).alias("max_revenue"), round2(F.max(r) - F.min(r), 4).alias("revenue_spread"),
        round2(F.min(m), 4).alias("min_members"), round2(F.max(m), 4).alias("max_members"), F.min_by("scenario", "rank").alias("best_scenario"),
    )


# --------------------------------------------------------------------------- partial prediction

OUTPUTS = list(LEVER_MODELS)


def _states(spark, sf) -> DataFrame:
    entries = [x for lv, (b0, coefs) in LEVER_MODELS.items() for x in (F.lit(lv), F.struct(dbl(b0).alias("intercept"), F.array(*[dbl(coefs.get(o, 0.0)) for o in LEVERS]).alias("coefs")))]
    s = scored(spark, sf)
    # the fixed lever models hold for entities with history; others keep their values
    none = F.lit(None).cast("map<string,struct<intercept:double,coefs:array<double>>>")
    return WI.month_states(s.withColumn("lever_models", F.when(F.col("n_hist").isNotNull(), F.create_map(*entries)).otherwise(none)))


@register("month_state", wsql(f"SELECT request_id, month_ahead, {r2('state_revenue')} AS total_revenue, {r2('state_members', 4)} AS total_members, {r2('state_retention', 6)} AS retention_rate FROM ms", O.STATES))
def q_month_state(spark, sf):
    s = _states(spark, sf)
    return s.select("request_id", "month_ahead", round2("state_revenue").alias("total_revenue"), round2("state_members", 4).alias("total_members"), round2("state_retention", 6).alias("retention_rate"))


_SEQ = f"{O.STATES},\n{O.sequential()}"


@register("predict_levers_sequential", wsql(f"SELECT request_id, month_ahead, lever, {r2('predicted_value', 6)} AS predicted_value, {r2('confidence', 4)} AS confidence FROM sq", _SEQ))
def q_predict_levers_sequential(spark, sf):
    m = WI.predict_levers_sequentially(_states(spark, sf), OUTPUTS)
    return m.select("request_id", "month_ahead", "lever", round2("predicted_value", 6).alias("predicted_value"), round2("confidence", 4).alias("confidence"))


_ALL_MONTHLY = (
    f"al AS (SELECT request_id, lever, predicted_value, confidence FROM sq UNION ALL SELECT request_id, 'total_revenue', state_revenue, greatest({O.d(0.5)}, {O.d(0.85)} - (month_ahead - 1) * {O.d(0.05)}) FROM ms "
    f"UNION ALL SELECT request_id, 'total_members', state_members, greatest({O.d(0.5)}, {O.d(0.85)} - (month_ahead - 1) * {O.d(0.05)}) FROM ms)"
)


def _all_monthly(spark, sf) -> DataFrame:
    """The sequential predictions with the main model's revenue and members as output levers."""
    s = _states(spark, sf)
    conf = F.greatest(dbl(0.5), 0.85 - (F.col("month_ahead") - 1) * 0.05).cast("double").alias("confidence")
    out = WI.predict_levers_sequentially(s, OUTPUTS)
    for lever, column in (("total_revenue", "state_revenue"), ("total_members", "state_members")):
        out = out.unionByName(s.select("request_id", "month_ahead", F.lit(lever).alias("lever"), F.col(column).cast("double").alias("predicted_value"), conf))
    return out


@register(
    "partial_summary",
    wsql(
        f"SELECT request_id, lever, {r2('CASE WHEN lever = ' + chr(39) + 'total_revenue' + chr(39) + ' THEN sum(predicted_value) ELSE avg(predicted_value) END', 4)} AS predicted_value, {r2('avg(confidence)', 4)} AS confidence, "
        f"{r2('min(predicted_value)', 4)} AS low, {r2('max(predicted_value)', 4)} AS high, count(*) AS months FROM al GROUP BY request_id, lever",
        f"{_SEQ},\n{_ALL_MONTHLY}",
    ),
)
def q_partial_summary(spark, sf):
    p = WI.partial_summary(_all_monthly(spark, sf))
    return p.select("request_id", "lever", *[round2(c, 4).alias(c) for c in ("predicted_value", "confidence", "low", "high")], "months")


@register(
    "partial_metrics",
    wsql(
        f"""SELECT request_id, {r2('c', 3)} AS prediction_confidence, CASE WHEN c / (1 + 0.15 * 0.5) >= 0.8 THEN 'High' WHEN c / (1 + 0.15 * 0.5) >= 0.6 THEN 'Medium' ELSE 'Low' END AS confidence_level,
  known AS n_known_levers, predicted AS n_predicted_levers, {r2('known / (known + predicted)')} AS known_lever_ratio, {r2('2500.0 / NULLIF(mean_revenue, 0) * 100')} AS rmse_pct, {r2('1800.0 / NULLIF(mean_revenue, 0) * 100')} AS mae_pct
FROM (SELECT request_id, avg(c) AS c, count(*) AS predicted FROM (SELECT request_id, lever, avg(confidence) AS c FROM al GROUP BY ALL) GROUP BY request_id)
JOIN (SELECT request_id, mean_revenue, CAST({' + '.join(f'CAST(in_{lv} IS NOT NULL AS INTEGER)' for lv in O.LV)} AS BIGINT) AS known FROM rf) USING (request_id)""",
        f"{_SEQ},\n{_ALL_MONTHLY}",
    ),
)
def q_partial_metrics(spark, sf):
    known = sum((F.when(F.col(f"levers.{lv}").isNotNull(), 1).otherwise(0) for lv in LEVERS), F.lit(0)).cast("bigint")
    q = filled(spark, sf).select("request_id", "mean_revenue", known.alias("known"))
    per = WI.partial_summary(_all_monthly(spark, sf)).groupBy("request_id").agg(F.avg("confidence").alias("c"), F.count(F.lit(1)).alias("predicted"))
    x = per.join(q, "request_id")
    return x.select(
        "request_id", round2("c", 3).alias("prediction_confidence"), confidence_level(F.col("c"), 1.5).alias("confidence_level"), F.col("known").alias("n_known_levers"),
        F.col("predicted").alias("n_predicted_levers"), round2(F.col("known") / (F.col("known") + F.col("predicted"))).alias("known_lever_ratio"), *_error_pct(),
    )


@register("lever_evolution", wsql(f"SELECT request_id, lever, month_ahead, {r2('predicted_value', 4)} AS predicted_value, {r2('confidence', 4)} AS confidence FROM ev", O.evolution()))
def q_lever_evolution(spark, sf):
    e = WI.lever_evolution(filled(spark, sf))
    return e.select("request_id", "lever", "month_ahead", round2("predicted_value", 4).alias("predicted_value"), round2("confidence", 4).alias("confidence"))
