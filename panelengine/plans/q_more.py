"""Joins, unions, rankings, insights and nested metrics (#6, #45, #46, #69, #70, #109, #127,
#129-#131, #134-#137, #139, #217, #219)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import round2
from ..operators import augment as AU
from ..operators import features as FE
from ..operators import history as H
from ..operators import insights as I
from ..operators import metrics as M
from ..operators import products as P
from ..operators import whatif as WI
from ..sources.sinks import table_path
from ..spec import PRODUCT_LEVERS, PRODUCT_NAMES, REVENUE_TARGETS, TARGETS, product_revenue_column
from . import oracle_whatif as O
from .catalog import register
from .common import feature_frame, features, materialize, panel, raw
from .fixed_model import MODEL
from .oracle_features import FEATURE_COLUMNS, PANEL_COLUMNS, q, with_features
from .oracle_panel import r2, with_panel
from .oracle_whatif import FALLBACK_MONTH, wsql
from .q_metrics import msql
from .q_quality import corr_sql

# --------------------------------------------------------------------------- rankings, trends, sets

_PRODUCT_SUMS = "\nUNION ALL ".join(f"SELECT entity_id, '{p}' AS product, sum({product_revenue_column(p)}) AS score FROM panel GROUP BY entity_id" for p in PRODUCT_NAMES)

@register("rank_by_score", with_panel(f"SELECT entity_id, product, {r2('score')} AS score, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY round(score, 2) DESC, product) AS INTEGER) AS rank FROM ({_PRODUCT_SUMS})"))
def q_rank_by_score(spark, sf):
    """Products of every entity by revenue, 1 the highest."""
    body = ", ".join(f"'{p}', CAST(`{product_revenue_column(p)}` AS DOUBLE)" for p in PRODUCT_NAMES)
    long = panel(spark, sf).select("entity_id", F.expr(f"stack({len(PRODUCT_NAMES)}, {body}) AS (product, revenue)"))
    g = long.groupBy("entity_id", "product").agg(F.sum("revenue").alias("score"))
    w = Window.partitionBy("entity_id").orderBy(F.desc(F.round("score", 2)), "product")
    return g.select("entity_id", "product", round2("score").alias("score"), F.row_number().over(w).alias("rank"))

@register("recent_trend_6", with_panel("SELECT entity_id, " + ", ".join(f"{r2(f'trend_{lv}', 4)} AS {lv}" for lv in O.PRESENT) + " FROM hc", extra_ctes=O.HISTORY))
def q_recent_trend_6(spark, sf):
    h = H.history_context(raw(spark, sf))
    return h.select("entity_id", *[round2(f"trend_{lv}", 4).alias(lv) for lv in O.PRESENT])

@register("distinct_values", with_panel("SELECT 'month' AS kind, strftime(month, '%Y-%m-%d') AS value, CAST(row_number() OVER (ORDER BY month) AS INTEGER) AS place FROM (SELECT DISTINCT month FROM panel)\n"
                                        "UNION ALL SELECT 'entity', CAST(entity_id AS VARCHAR), CAST(row_number() OVER (ORDER BY entity_id) AS INTEGER) FROM (SELECT DISTINCT entity_id FROM panel)"))
def q_distinct_values(spark, sf):
    p = materialize(panel(spark, sf).select("entity_id", "month"))
    m = p.select("month").distinct()  # as many rows as the calendar has months
    e = p.select("entity_id").distinct()
    from ..operators.ranks import numbered

    months = numbered(m, [], ["month"], "n").select(F.lit("month").alias("kind"), F.date_format("month", "yyyy-MM-dd").alias("value"), (F.col("n") + 1).cast("int").alias("place"))
    return months.unionByName(numbered(e, [], ["entity_id"], "n").select(F.lit("entity").alias("kind"), F.col("entity_id").cast("string").alias("value"), (F.col("n") + 1).cast("int").alias("place")))

# --------------------------------------------------------------------------- joins and unions

_DIMENSIONS = ("studio_location", "studio_size_tier", "studio_price_tier")

@register("join_dimension_tiers", with_panel("SELECT entity_id, month, total_revenue, studio_location, studio_size_tier, studio_price_tier FROM panel"))
def q_join_dimension_tiers(spark, sf):
    """Monthly facts joined with the entities' attributes (one row per entity; the planner
    broadcasts them where they are small)."""
    p = materialize(panel(spark, sf).select("entity_id", "month", "total_revenue", *_DIMENSIONS))
    return p.select("entity_id", "month", "total_revenue").join(p.select("entity_id", *_DIMENSIONS).distinct(), "entity_id")

@register("union_entities", with_panel("SELECT entity_id, month, total_revenue, total_members FROM panel"))
def q_union_entities(spark, sf):
    """Panels of the urban and of the other entities stacked."""
    p = materialize(panel(spark, sf).select("entity_id", "month", "total_revenue", "total_members", "studio_location"))
    urban = F.col("studio_location") == "urban"
    return p.where(urban).unionByName(p.where(~F.coalesce(urban, F.lit(False)))).drop("studio_location")

@register("union_train_val", with_features("SELECT entity_id, month, split, total_revenue FROM feat WHERE split <> 'test'"))
def q_union_train_val(spark, sf):
    f = materialize(feature_frame(spark, sf).select("entity_id", "month", "split", "total_revenue"))
    return f.where("split = 'train'").unionByName(f.where("split = 'validation'"))

@register("union_augmented", with_features(
    "SELECT split, method, count(*) AS n FROM (SELECT split, 'original' AS method FROM feat UNION ALL SELECT 'train', m FROM (SELECT unnest(range(0, (CAST(floor((SELECT count(*) FROM feat WHERE split = 'train') * 1.5) AS BIGINT) "
    "- (SELECT count(*) FROM feat WHERE split = 'train')) // 3)) AS i), (SELECT unnest(['noise', 'bootstrap', 'interpolate']) AS m)) GROUP BY ALL"))
def q_union_augmented(spark, sf):
    """Rows per split and method of: augmented training rows, validation and test."""
    feat = features(spark, sf)
    cols = FE.feature_columns(feat) + list(TARGETS)
    augmented = AU.augment(feat.where("split = 'train'").select("entity_id", "month", *cols), cols).select("method", *cols, "split")
    rest = feat.where("split <> 'train'").select(F.lit("original").alias("method"), *cols, "split")
    return augmented.unionByName(rest).groupBy("split", "method").agg(F.count(F.lit(1)).alias("n"))

@register("actual_vs_predicted", with_features("SELECT entity_id, month, split, " + ", ".join(f"CAST({t} AS DOUBLE) AS actual_{t}" for t in REVENUE_TARGETS) + ", total_revenue AS predicted FROM feat"))
def q_actual_vs_predicted(spark, sf):
    """Predictions and actuals as two tables, aligned on (entity, month)."""
    f = features(spark, sf)
    actual = f.select("entity_id", "month", "split", *[F.col(t).cast("double").alias(f"actual_{t}") for t in REVENUE_TARGETS])
    return actual.join(f.select("entity_id", "month", F.col("total_revenue").alias("predicted")), ["entity_id", "month"])

def _panel_prediction(t: str) -> str:
    start, coefs = O.MODEL[t]
    return "(" + O.d(start) + "".join(f" + {O.d(b)} * CAST({c} AS DOUBLE)" for c, b in zip(O.MODEL_FEATURES, coefs) if b) + ")"

_TARGET_KEYS = dict(zip(TARGETS, O.MODEL))

@register("scores_join_coefficients", with_features("\nUNION ALL ".join(f"SELECT entity_id, month, '{t}' AS target, {r2(_panel_prediction(k), 4)} AS prediction FROM feat" for t, k in _TARGET_KEYS.items())))
def q_scores_join_coefficients(spark, sf):
    """Long features joined with the coefficient table, summed per target."""
    f = feature_frame(spark, sf)
    body = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in MODEL.features)
    long = f.select("entity_id", "month", F.expr(f"stack({len(MODEL.features)}, {body}) AS (feature, value)"))
    coefs = MODEL.coefficient_table(spark).select("target", "feature", "coef", "intercept")
    g = long.join(F.broadcast(coefs), "feature").groupBy("entity_id", "month", "target").agg(F.sum(F.col("value") * F.col("coef")).alias("s"), F.first("intercept").alias("b"))
    return g.select("entity_id", "month", "target", round2(F.col("s") + F.col("b"), 4).alias("prediction"))

def _score_columns(prefix: str) -> str:
    return ", ".join(f"{r2(_panel_prediction(k), 4)} AS {prefix}{t}" for t, k in _TARGET_KEYS.items())

@register("score_fixed_linear", with_features(f"SELECT entity_id, month, split, {_score_columns('predicted_')} FROM feat"))
def q_score_fixed_linear(spark, sf):
    f = feature_frame(spark, sf)
    cols = [round2(c, 4).alias(f"predicted_{t}") for t, c in zip(TARGETS, MODEL.predict_columns())]
    return f.select("entity_id", "month", "split", *cols)

@register("shap_fixed_linear", with_features(
    "SELECT entity_id, month, target, feature, " + r2("phi", 4) + " AS phi FROM (" + "\nUNION ALL ".join(
        f"SELECT entity_id, month, '{t}' AS target, '{c}' AS feature, {O.d(b)} * (CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM feat WHERE split <> 'test')) AS phi FROM feat WHERE split = 'test'"
        for t, k in _TARGET_KEYS.items() for c, b in zip(O.MODEL_FEATURES, O.MODEL[k][1]) if b) + ")"))
def q_shap_fixed_linear(spark, sf):
    """Exact linear SHAP values of the test rows: coefficient x (value - background mean), the
    background being all training and validation rows."""
    f = features(spark, sf)
    means = f.where("split <> 'test'").agg(*[F.avg(c).alias(f"m_{c}") for c in MODEL.features])
    x = f.where("split = 'test'").crossJoin(F.broadcast(means))  # one row of means
    x = x.select("entity_id", "month", *[(F.col(c).cast("double") - F.col(f"m_{c}")).alias(c) for c in MODEL.features])
    out = I.contributions(x, MODEL, ["entity_id", "month"])
    return out.select("entity_id", "month", "target", "feature", round2("contribution", 4).alias("phi"))

# --------------------------------------------------------------------------- features and levers

_MAPPED = [c for c in (*PANEL_COLUMNS, *FEATURE_COLUMNS) if c not in ("entity_id", "month", "studio_location", "studio_size_tier", "studio_price_tier")]

def _lever_of_sql(x: str) -> str:
    tests = [f"WHEN {x} = '{lv}' THEN '{lv}'" for lv in O.LV] + [f"WHEN contains({x}, '{lv}') THEN '{lv}'" for lv in O.LV]
    for lv in O.LV:
        words = " OR ".join(f"contains({x}, '{w}')" for w in lv.split("_") if len(w) > 3)
        tests.append(f"WHEN {words} THEN '{lv}'")
    return "CASE " + " ".join(tests) + f" ELSE {x} END"

@register("feature_to_lever", with_features(
    f"SELECT feature, {_lever_of_sql('feature')} AS lever, n FROM (" + "\nUNION ALL ".join(f"SELECT '{c}' AS feature, count({q(c)}) AS n FROM feat" for c in _MAPPED) + ")"))
def q_feature_to_lever(spark, sf):
    """The lever behind every feature column of the panel, with the rows that have a value."""
    f = feature_frame(spark, sf)
    cols = FE.feature_columns(f)
    one = f.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)])
    body = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    return one.selectExpr(f"stack({len(cols)}, {body}) AS (feature, n)").select("feature", I.feature_to_lever(F.col("feature")).alias("lever"), "n")

def _request_contributions(spark, sf):
    p = materialize(raw(spark, sf))
    df = WI.clip_levers(WI.fill_missing_levers(WI.with_history(WI.request_table(p), p)))
    given = df.select("request_id", F.col("levers").alias("given"))
    f = WI.request_features(df.drop("levers"), month_without_history=FALLBACK_MONTH)
    return I.top_drivers(I.contributions(f, MODEL, ["request_id"]), ["request_id"]).join(given.withColumnRenamed("given", "levers"), "request_id")

def _drivers_sql() -> str:
    f = O.feature_sql("c_")
    rows = "\nUNION ALL ".join(
        f"SELECT request_id, '{t}' AS target, '{c}' AS feature, {O.d(b)} * CAST({f[c]} AS DOUBLE) AS contribution FROM rf"
        for t, k in _TARGET_KEYS.items() for c, b in zip(O.MODEL_FEATURES, O.MODEL[k][1]) if b
    )
    relates = " OR ".join(f"(in_{lv} IS NOT NULL AND (contains(feature, '{lv}') OR contains(replace(lower(feature), '_', ''), '{lv.replace('_', '')}')))" for lv in O.LV)
    pairs = ", ".join(f"('{lv}', '{t}', {i})" for lv, ts in _LEVER_TARGETS.items() for i, t in enumerate(ts))
    return f"""d0 AS ({rows}),
d1 AS (SELECT *, row_number() OVER (PARTITION BY request_id, target ORDER BY round(abs(contribution), 6) DESC, feature) AS rank FROM d0),
d2 AS (SELECT d1.*, {_lever_of_sql('feature')} AS input_lever FROM d1 JOIN rf USING (request_id) WHERE rank <= 5 AND ({relates})),
d3 AS (SELECT d2.*, output_lever, target_no FROM d2 JOIN (VALUES {pairs}) v(output_lever, target, target_no) USING (target)),
d4 AS (SELECT * FROM d3 QUALIFY row_number() OVER (PARTITION BY request_id, output_lever, input_lever, feature ORDER BY target_no, rank) = 1),
d5 AS (SELECT *, row_number() OVER (PARTITION BY request_id, output_lever ORDER BY target_no, rank) AS place FROM d4)"""

_R = ("revenue_month_1", "revenue_month_2", "revenue_month_3")
_LEVER_TARGETS = {
    "total_revenue": _R, "total_members": ("member_count_month_3", *_R), "retention_rate": ("retention_rate_month_3", "member_count_month_3"), "avg_ticket_price": _R,
    "class_attendance_rate": _R, "new_members": ("member_count_month_3", "revenue_month_1"), "staff_utilization_rate": _R, "upsell_rate": _R, "total_classes_held": _R,
}

@register("lever_insights", wsql(f"SELECT request_id, output_lever, CAST(place AS INTEGER) AS place, input_lever, feature, target, {r2('contribution', 4)} AS contribution FROM d5 WHERE place <= 5", _drivers_sql()))
def q_lever_insights(spark, sf):
    x = I.lever_insights(_request_contributions(spark, sf))
    return x.select("request_id", "output_lever", "place", "input_lever", "feature", "target", round2("contribution", 4).alias("contribution"))

@register("dedup_drivers", wsql("SELECT request_id, output_lever, count(*) AS n_drivers FROM d5 WHERE place <= 5 GROUP BY ALL", _drivers_sql()))
def q_dedup_drivers(spark, sf):
    return I.lever_insights(_request_contributions(spark, sf)).groupBy("request_id", "output_lever").agg(F.count(F.lit(1)).alias("n_drivers"))

# --------------------------------------------------------------------------- products

_METRICS = ("revenue_month_1", "revenue_month_2", "revenue_month_3", "total_revenue")

def _promoted_sql() -> str:
    pairs = [(p, m) for p in PRODUCT_NAMES for m in _METRICS]
    one = ", ".join(f"{r2(corr_sql(product_revenue_column(p), m), 4)} AS c{i}" for i, (p, m) in enumerate(pairs))
    means = ", ".join(f"{r2(f'avg({product_revenue_column(p)})')} AS a{i}" for i, p in enumerate(PRODUCT_NAMES))
    rows = "\nUNION ALL ".join(f"SELECT '{p}' AS product, '{m}' AS metric, c{i} AS corr, a{PRODUCT_NAMES.index(p)} AS mean FROM one" for i, (p, m) in enumerate(pairs))
    return f"one AS (SELECT {one}, {means} FROM feat),\npr AS (SELECT * FROM ({rows}) WHERE corr >= 0.0 QUALIFY row_number() OVER (PARTITION BY metric ORDER BY corr * mean DESC, product) <= 5)"

@register("consolidate_recommendations", with_features(
    f"""SELECT product, n_metrics, {r2('mean_corr', 4)} AS mean_corr, metrics, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY n_metrics DESC, round(mean_corr, 6) DESC, product) AS rank FROM (
    SELECT product, count(*) AS n_metrics, avg(corr) AS mean_corr, string_agg(metric, ',' ORDER BY metric) AS metrics FROM pr GROUP BY product)) WHERE rank <= 5""",
    extra_ctes=_promoted_sql()))
def q_consolidate_recommendations(spark, sf):
    f = features(spark, sf)
    corr, stats = P.corr_product_revenue(f), P.product_stats(f)
    j = corr.where(F.col("corr") >= 0.0).join(stats.select("product", "mean"), "product")
    w = Window.partitionBy("metric").orderBy(F.desc(F.col("corr") * F.col("mean")), "product")
    top = j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 5)
    return I.consolidate_recommendations(top).select("product", "n_metrics", round2("mean_corr", 4).alias("mean_corr"), "metrics", "rank")

def _strength_sql() -> str:
    pairs = [(p, x) for p in PRODUCT_NAMES for x in PRODUCT_LEVERS]
    aggs = ", ".join(f"{r2(corr_sql(product_revenue_column(p), x), 4)} AS c{i}" for i, (p, x) in enumerate(pairs))
    rows = "\nUNION ALL ".join(f"SELECT '{p}' AS product, '{x}' AS lever, c{i} AS corr FROM one" for i, (p, x) in enumerate(pairs))
    goals = {"retention_rate": 0.75, "class_attendance_rate": 0.70, "upsell_rate": 0.20, "avg_ticket_price": 150.0}
    strengths = "\nUNION ALL ".join(
        f"SELECT request_id, '{lv}' AS lever, CASE WHEN c_{lv} / {O.d(g)} >= 1.05 THEN 'strong' WHEN c_{lv} / {O.d(g)} >= 0.95 THEN 'moderate' ELSE 'weak' END AS strength FROM rf" for lv, g in goals.items()
    )
    return (
        f"one AS (SELECT {aggs} FROM panel),\ntp AS (SELECT * FROM ({rows}) WHERE corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product ORDER BY abs(corr) DESC, lever) <= 2),\n"
        f"st AS ({strengths})"
    )

@register("product_lever_strength", wsql("SELECT request_id, product, lever, corr, strength FROM tp JOIN st USING (lever)", _strength_sql()))
def q_product_lever_strength(spark, sf):
    """Every product's two most correlated levers, with the request's strength on them."""
    p = materialize(raw(spark, sf))
    corr = P.corr_product_lever(p).where(F.col("corr").isNotNull())
    w = Window.partitionBy("product").orderBy(F.desc(F.abs("corr")), "lever")
    top = corr.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2).drop("r")
    req = WI.clip_levers(WI.fill_missing_levers(WI.with_history(WI.request_table(p), p)))
    return WI.lever_strength(req).select("request_id", "lever", "strength").join(top, "lever").select("request_id", "product", "lever", "corr", "strength")

# --------------------------------------------------------------------------- metrics from files

_TESTS = (
    "tm2 AS (SELECT target, sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse, avg(abs(actual - predicted)) AS mae, "
    "1 - sum((actual - predicted) * (actual - predicted)) / NULLIF(var_pop(actual) * count(*), 0) AS r2, avg(abs((actual - predicted) / NULLIF(actual + 1e-10, 0))) * 100 AS mape "
    "FROM plv WHERE dataset = 'test' AND model = 'baseline_last_value' GROUP BY target)"
)

def _test_metrics(spark, sf):
    m = M.regression_metrics(M.to_long(M.baseline_last_value(features(spark, sf))))
    return m.where("dataset = 'test'").select("target", "rmse", "mae", "r2", "mape")

_EST = ("rmse", "mae", "r2", "mape", "accuracy_within_5pct", "accuracy_within_10pct", "forecast_accuracy", "directional_accuracy")
#: the per-target metrics are rounded before they are averaged, as in the report they come from
_REPORT = f"tr AS (SELECT target, {r2('rmse')} AS rmse, {r2('mae')} AS mae, {r2('r2', 4)} AS r2, {r2('mape')} AS mape FROM tm2)"
_EST_SQL = (
    "es AS (SELECT avg(rmse) AS rmse, avg(mae) AS mae, avg(r2) AS r2, avg(CASE WHEN target LIKE 'revenue%' AND mape > 0 THEN mape END) AS m FROM tr),\n"
    "e2 AS (SELECT rmse, mae, r2, coalesce(CASE WHEN m > 1 THEN m / 100 ELSE m END, 0.08) AS mape FROM es),\n"
    "e3 AS (SELECT *, greatest(0.5, least(0.95, 1 - mape * 5)) AS accuracy_within_5pct, greatest(0.7, least(0.98, 1 - mape * 3)) AS accuracy_within_10pct, "
    "greatest(0.5, least(0.98, r2)) AS forecast_accuracy, greatest(0.7, least(0.99, r2 * 1.05)) AS directional_accuracy FROM e2)"
)

@register("metric_estimates", msql("SELECT " + ", ".join(f"{r2(c, 4)} AS {c}" for c in _EST) + " FROM e3", f"{_TESTS},\n{_REPORT},\n{_EST_SQL}"))
def q_metric_estimates(spark, sf):
    return I.metric_estimates(_test_metrics(spark, sf)).select(*[round2(c, 4).alias(c) for c in _EST])

@register("scan_nested_metrics", msql(
    f"SELECT 'baseline_last_value' AS best_model, {r2('avg(rmse)', 4)} AS overall_rmse, {r2('avg(mae)', 4)} AS overall_mae, {r2('avg(r2)', 4)} AS overall_r2, "
    + ", ".join(f"max(CASE WHEN target = '{t}' THEN mape END) AS mape_{i + 1}" for i, t in enumerate(REVENUE_TARGETS)) + " FROM tr", f"{_TESTS},\n{_REPORT}"))
def q_scan_nested_metrics(spark, sf):
    """A nested results file, as training writes it, and the overall and revenue metrics of its
    best model read back from it."""
    m = _test_metrics(spark, sf)
    cell = F.struct("rmse", "mae", "r2", "mape")
    doc = m.agg(
        F.lit("baseline_last_value").alias("best_model"),
        F.struct(F.avg("rmse").alias("overall_rmse"), F.avg("mae").alias("overall_mae"), F.avg("r2").alias("overall_r2"), F.map_from_entries(F.collect_list(F.struct("target", cell))).alias("metrics_by_target")).alias("test"),
    )
    path = table_path(m, "results-json")
    doc.withColumn("results", F.create_map("best_model", "test")).select("best_model", "results").write.json(path)
    inner = "struct<overall_rmse:double,overall_mae:double,overall_r2:double,metrics_by_target:map<string,struct<rmse:double,mae:double,r2:double,mape:double>>>"
    back = spark.read.schema(f"best_model string, results map<string,{inner}>").json(path).withColumn("best", F.col("results")[F.col("best_model")])
    mapes = [F.col("best.metrics_by_target")[t]["mape"].alias(f"mape_{i + 1}") for i, t in enumerate(REVENUE_TARGETS)]
    return back.select("best_model", *[round2(f"best.{c}", 4).alias(c) for c in ("overall_rmse", "overall_mae", "overall_r2")], *mapes)

@register("parse_r2_from_text", msql(
    f"SELECT count(*) AS n, {r2('avg(r)', 4)} AS mean_r2 FROM (SELECT round_even(1 - sum((actual - predicted) * (actual - predicted)) / NULLIF(var_pop(actual) * count(*), 0), 4) AS r FROM plv GROUP BY model, dataset, target) WHERE r >= 0 AND r < 1"))
def q_parse_r2_from_text(spark, sf):
    """A text report with a line per model, split and target, and the mean of the R2 it names
    (those that read 0.something)."""
    m = M.regression_metrics(M.to_long(M.all_baselines(features(spark, sf))))
    path = table_path(m, "report-text")
    m.select(F.format_string("%s / %s / %s: R² = %.4f", "model", "dataset", "target", F.col("r2") + 0.0).alias("value")).write.text(path)
    found = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"R² = (0\.\d+)"), F.lit(1))).alias("r"))
    return found.agg(F.count(F.lit(1)).alias("n"), round2(F.avg(F.col("r").cast("double")), 4).alias("mean_r2"))
