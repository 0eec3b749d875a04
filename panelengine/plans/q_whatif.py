"""Batch request operators (#20, #35-#44, #126, #186-#215) and product analytics
(#84-#88, #140, #218)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import confidence_level, horizon_degradation, pct_change, round2
from ..operators import products as P
from ..operators import whatif as WI
from ..operators.features import engineer_features
from ..spec import LEVER_STRENGTH_TARGETS, PRODUCT_CATEGORY, PRODUCT_LEVERS, PRODUCT_NAMES, product_revenue_column
from .catalog import register
from .common import features, materialize, raw
from .oracle_features import with_features
from .oracle_panel import r2, with_panel
from .oracle_whatif import FALLBACK_MONTH, LV, PRESENT, THRESHOLDS, WHOLE, B, feature_sql, wsql
from .q_quality import corr_sql



def _req(spark, sf):
    p = raw(spark, sf)
    return p, WI.request_table(p)


def _filled(spark, sf):
    p, req = _req(spark, sf)
    return WI.clip_levers(WI.fill_missing_levers(WI.with_history(req, p)))


# --------------------------------------------------------------------------- requests


@register(
    "validate_levers",
    wsql(
        "SELECT request_id, concat_ws(',', " + ", ".join(
            f"CASE WHEN in_{lv} IS NOT NULL AND (in_{lv} < {B[lv][0]} OR in_{lv} > {B[lv][1]}) THEN '{lv}' END" for lv in LV
        ) + ", CASE WHEN projection_months < 1 OR projection_months > 12 THEN 'projection_months' END) AS violations, "
        "NOT (" + " OR ".join(f"coalesce(in_{lv} < {B[lv][0]} OR in_{lv} > {B[lv][1]}, false)" for lv in LV)
        + " OR projection_months < 1 OR projection_months > 12) AS valid FROM req"
    ),
)
def q_validate_levers(spark, sf):
    _, req = _req(spark, sf)
    v = WI.validate_levers(req)
    return v.select("request_id", F.concat_ws(",", "violations").alias("violations"), "valid")


@register("fill_missing_levers", wsql("SELECT request_id, " + ", ".join(f"f_{lv} AS {lv}" for lv in LV) + " FROM rf"))
def q_fill_missing_levers(spark, sf):
    return _filled(spark, sf).select("request_id", "filled.*")


@register("clip_to_bounds", wsql("SELECT request_id, " + ", ".join(f"c_{lv} AS {lv}" for lv in LV) + " FROM rf"))
def q_clip_to_bounds(spark, sf):
    return _filled(spark, sf).select("request_id", "clipped.*")


_INTS = [lv for lv in LV if B[lv][3]]


@register("int_levers", wsql("SELECT request_id, " + ", ".join(f"CAST(c_{lv} AS BIGINT) AS {lv}" for lv in _INTS) + " FROM rf"))
def q_int_levers(spark, sf):
    return _filled(spark, sf).select("request_id", *[F.col(f"clipped.{lv}").cast("bigint").alias(lv) for lv in _INTS])


_HCOLS = ["n_hist", "last_revenue", "last_members", "last_month", "tail3_avg_retention", "tail3_avg_revenue", "tail3_avg_attendance", "mean_revenue"]


@register(
    "requests_join_history",
    wsql("SELECT request_id, " + ", ".join(f"{r2(c, 4)} AS {c}" if c not in ("n_hist", "last_month", "last_members") else c for c in _HCOLS)
         + f", {r2('tail3_std_revenue', 2)} AS tail3_std_revenue, {r2('ewm_revenue', 2)} AS ewm_revenue FROM rf"),
)
def q_requests_join_history(spark, sf):
    f = _filled(spark, sf)
    return f.select(
        "request_id", *[round2(c, 4).alias(c) if c not in ("n_hist", "last_month", "last_members") else F.col(c) for c in _HCOLS],
        round2("tail3_std_revenue", 2).alias("tail3_std_revenue"), round2("ewm_revenue", 2).alias("ewm_revenue"),
    )


def _request_feature_sql(history: bool) -> str:
    cols = ", ".join(f'{v} AS "{k}"' if k in WHOLE else f'{r2(v, 4)} AS "{k}"' for k, v in feature_sql("c_", history).items())
    return wsql(f"SELECT request_id, {cols} FROM rf")


def _request_features(f):
    f = WI.request_features(f, month_without_history=FALLBACK_MONTH)
    return f.select("request_id", *[F.col(c).cast("bigint").alias(c) if c in WHOLE else round2(F.col(c), 4).alias(c) for c in feature_sql()])


@register("request_features", _request_feature_sql(True))
def q_request_features(spark, sf):
    return _request_features(_filled(spark, sf))


@register("request_features_no_history", _request_feature_sql(False))
def q_request_features_no_history(spark, sf):
    # the entity's history is dropped: every lag / rolling input falls back to the request itself
    return _request_features(_filled(spark, sf).withColumn("n_hist", F.lit(None).cast("long")))


@register(
    "lever_strength",
    wsql("\nUNION ALL ".join(
        f"SELECT request_id, '{lv}' AS lever, c_{lv} AS current, CAST({float(t)} AS DOUBLE) AS target, {r2(f'c_{lv} / {float(t)}', 6)} AS performance, "
        f"CASE WHEN c_{lv} / {float(t)} >= 1.05 THEN 'strong' WHEN c_{lv} / {float(t)} >= 0.95 THEN 'moderate' ELSE 'weak' END AS strength FROM rf"
        for lv, t in LEVER_STRENGTH_TARGETS.items())),
)
def q_lever_strength(spark, sf):
    s = WI.lever_strength(_filled(spark, sf))
    return s.withColumn("performance", round2("performance", 6))


def _feas_sql():
    parts = []
    for lv, (e, mo, h) in THRESHOLDS.items():
        lo, hi, _, is_int = B[lv]
        new = f"least(greatest(c_{lv} * 1.1, {float(lo)}), {float(hi)})"
        if is_int:
            new = f"round_even({new}, 0)"
        ch = f"abs({new} - c_{lv})"
        parts.append(f"CASE WHEN {ch} <= {e} THEN 1.0 WHEN {ch} <= {mo} THEN 0.7 WHEN {ch} <= {h} THEN 0.4 ELSE 0.2 END")
    score = "((" + " + ".join(parts) + f") / {len(parts)})"
    return wsql(
        f"SELECT request_id, {r2(score, 6)} AS overall_score, CASE WHEN {score} >= 0.8 THEN 'easy' WHEN {score} >= 0.6 THEN 'moderate' "
        f"WHEN {score} >= 0.4 THEN 'hard' ELSE 'very_hard' END AS overall_difficulty FROM rf"
    )


@register("feasibility", _feas_sql())
def q_feasibility(spark, sf):
    f = _filled(spark, sf).withColumn("proposed", WI.scaled_levers("clipped", 1.1))
    return WI.feasibility(f, "clipped", "proposed").select("request_id", round2("overall_score", 6).alias("overall_score"), "overall_difficulty")


@register(
    "lever_quality",
    wsql(
        "SELECT request_id, CASE WHEN n = 0 THEN 0.75 ELSE 0.7 + 0.3 * (0.3 * least(1.0, n / 15.0) + 0.7 * (ok / n)) END AS lever_quality FROM ("
        "SELECT request_id, " + " + ".join(f"CAST(in_{lv} IS NOT NULL AS INTEGER)" for lv in LV) + " AS n, "
        + " + ".join(f"CAST(coalesce(in_{lv} >= 0 AND in_{lv} <= 1000, false) AS INTEGER)" for lv in LV) + " AS ok FROM req)"
    ),
)
def q_lever_quality(spark, sf):
    _, req = _req(spark, sf)
    return req.select("request_id", WI.lever_quality("levers").alias("lever_quality"))


@register(
    "horizon_degradation",
    wsql(
        "SELECT request_id, h, CASE WHEN h <= 1 THEN 1.0 WHEN h <= 2 THEN 1.0 + (h - 1) * 0.15 WHEN h <= 3 THEN 1.15 + (h - 2) * 0.15 ELSE 1.30 END AS factor "
        "FROM (SELECT request_id, unnest(range(1, projection_months + 1)) AS h FROM req)"
    ),
)
def q_horizon_degradation(spark, sf):
    _, req = _req(spark, sf)
    x = req.select("request_id", F.explode(WI.month_numbers(F.col("projection_months"))).alias("h"))
    return x.select("request_id", "h", horizon_degradation("h").alias("factor"))


@register(
    "confidence_level",
    wsql(
        "SELECT request_id, h, 0.85 - 0.05 * (h - 1) AS confidence, CASE WHEN (0.85 - 0.05 * (h - 1)) / (1.0 + 0.15 * (h - 1)) >= 0.8 THEN 'High' "
        "WHEN (0.85 - 0.05 * (h - 1)) / (1.0 + 0.15 * (h - 1)) >= 0.6 THEN 'Medium' ELSE 'Low' END AS level "
        "FROM (SELECT request_id, unnest(range(1, projection_months + 1)) AS h FROM req)"
    ),
)
def q_confidence_level(spark, sf):
    _, req = _req(spark, sf)
    x = req.select("request_id", F.explode(WI.month_numbers(F.col("projection_months"))).alias("h"))
    conf = F.lit(0.85) - 0.05 * (F.col("h") - 1)
    return x.select("request_id", "h", conf.cast("double").alias("confidence"), confidence_level(conf, F.col("h")).alias("level"))


@register(
    "pct_change",
    wsql(f"SELECT request_id, {r2('CASE WHEN mean_revenue <> 0 THEN (last_revenue - mean_revenue) / mean_revenue * 100 ELSE 0.0 END', 4)} AS revenue_vs_mean_pct FROM rf"),
)
def q_pct_change(spark, sf):
    f = _filled(spark, sf)
    return f.select("request_id", round2(pct_change("last_revenue", "mean_revenue"), 4).alias("revenue_vs_mean_pct"))


# --------------------------------------------------------------------------- products

_PL = [lv for lv in PRODUCT_LEVERS]


def _corr_long_sql(src_ctes, src, metrics_or_levers, name):
    pairs = [(p, x) for p in PRODUCT_NAMES for x in metrics_or_levers]
    aggs = ", ".join(f"{r2(corr_sql(product_revenue_column(p), x), 4)} AS c{i}" for i, (p, x) in enumerate(pairs))
    body = "\nUNION ALL ".join(f"SELECT '{p}' AS product, '{x}' AS {name}, c{i} AS corr FROM one" for i, (p, x) in enumerate(pairs))
    return src_ctes(body, extra_ctes=f"one AS (SELECT {aggs} FROM {src})")


@register("corr_product_lever", _corr_long_sql(with_panel, "panel", _PL, "lever"))
def q_corr_product_lever(spark, sf):
    return P.corr_product_lever(raw(spark, sf))


_REV_METRICS = ["revenue_month_1", "revenue_month_2", "revenue_month_3", "total_revenue"]


@register("corr_product_revenue", _corr_long_sql(with_features, "feat", _REV_METRICS, "metric"))
def q_corr_product_revenue(spark, sf):
    return P.corr_product_revenue(features(spark, sf))


def _stats_sql():
    aggs = ", ".join(
        f"{r2(f'avg({product_revenue_column(p)})', 2)} AS mean{i}, {r2(f'stddev_samp({product_revenue_column(p)})', 2)} AS std{i}, "
        f"{r2(f'quantile_cont({product_revenue_column(p)}, 0.5)', 2)} AS med{i}, min({product_revenue_column(p)}) AS min{i}, max({product_revenue_column(p)}) AS max{i}"
        for i, p in enumerate(PRODUCT_NAMES)
    )
    body = "\nUNION ALL ".join(
        f"SELECT '{p}' AS product, mean{i} AS mean, std{i} AS std, med{i} AS median, min{i} AS min, max{i} AS max FROM one" for i, p in enumerate(PRODUCT_NAMES)
    )
    return body, f"one AS (SELECT {aggs} FROM feat)"


@register("product_stats", with_features(_stats_sql()[0], extra_ctes=_stats_sql()[1]))
def q_product_stats(spark, sf):
    return P.product_stats(features(spark, sf))


def _matrix_sql():
    pairs = [(p, x) for p in PRODUCT_NAMES for x in _PL]
    aggs = ", ".join(f"{r2(corr_sql(product_revenue_column(p), x), 4)} AS c{i}" for i, (p, x) in enumerate(pairs))
    rows = []
    for pi, p in enumerate(PRODUCT_NAMES):
        cells = ", ".join(f"c{pi * len(_PL) + li} AS {lv}" for li, lv in enumerate(_PL))
        rows.append(f"SELECT '{p}' AS product, {cells} FROM one")
    return with_panel("\nUNION ALL ".join(rows), extra_ctes=f"one AS (SELECT {aggs} FROM panel)")


@register("corr_matrix", _matrix_sql())
def q_corr_matrix(spark, sf):
    return P.corr_matrix(P.corr_product_lever(raw(spark, sf)))


def _topk_sql():
    pairs = [(p, "total_revenue") for p in PRODUCT_NAMES]
    aggs = ", ".join(f"{r2(corr_sql(product_revenue_column(p), 'total_revenue'), 4)} AS c{i}, {r2(f'avg({product_revenue_column(p)})', 2)} AS m{i}" for i, (p, _) in enumerate(pairs))
    base = "\nUNION ALL ".join(
        f"SELECT '{p}' AS product, c{i} AS corr, m{i} AS mean, '{' '.join(w.capitalize() for w in p.split('_'))}' AS display_name FROM one"
        for i, (p, _) in enumerate(pairs)
    )
    body = """SELECT * FROM (
  SELECT 'promote' AS action, row_number() OVER (ORDER BY corr * mean DESC, product) AS rank, product, display_name, corr, mean FROM pcm WHERE corr >= 0.6)
WHERE rank <= 5
UNION ALL SELECT * FROM (
  SELECT 'demote' AS action, row_number() OVER (ORDER BY corr, product) AS rank, product, display_name, corr, mean FROM pcm WHERE corr < 0.3)
WHERE rank <= 3"""
    return with_features(body, extra_ctes=f"one AS (SELECT {aggs} FROM feat),\npcm AS (SELECT * FROM ({base}) WHERE corr IS NOT NULL)")


@register("topk_products", _topk_sql())
def q_topk_products(spark, sf):
    f = features(spark, sf)
    return P.topk_products(P.corr_product_revenue(f), P.product_stats(f))


@register(
    "display_name",
    with_panel("\nUNION ALL ".join(
        f"SELECT '{p}' AS product, '{c}' AS category, '{' '.join(w.capitalize() for w in p.split('_'))}' AS display_name, count({product_revenue_column(p)}) AS n_rows, {r2(f'sum({product_revenue_column(p)})')} AS revenue FROM panel"
        for p, c in PRODUCT_CATEGORY.items())),
)
def q_display_name(spark, sf):
    """Display names of the panel's product columns, with their rows and revenue."""
    from ..functions.scalar import display_name

    p = raw(spark, sf)
    cols = [c for c in p.columns if c in {product_revenue_column(x) for x in PRODUCT_NAMES}]
    one = p.agg(*[x for i, c in enumerate(cols) for x in (F.count(c).alias(f"n{i}"), F.sum(c).alias(f"s{i}"))])
    rows = one.selectExpr(f"stack({len(cols)}, " + ", ".join(f"'{c}', n{i}, s{i}" for i, c in enumerate(cols)) + ") AS (col, n_rows, revenue)")
    rows = rows.withColumn("product", F.regexp_replace("col", "_revenue$", ""))
    return rows.join(P.product_catalogue(spark), "product").select("product", "category", display_name(F.col("col")).alias("display_name"), "n_rows", round2("revenue").alias("revenue"))


def _trend_sql():
    body = "\nUNION ALL ".join(
        f"SELECT entity_id, '{p}' AS product, idx, CAST({product_revenue_column(p)} AS DOUBLE) AS revenue FROM x" for p in PRODUCT_NAMES
    )
    return with_panel(
        f"""SELECT entity_id, product, {r2('slope', 4)} AS slope,
                  CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend,
                  {r2('mean', 2)} AS mean, {r2('std', 2)} AS std, {r2('std / NULLIF(mean, 0)', 4)} AS cv
           FROM (SELECT entity_id, product, regr_slope(revenue, CAST(idx AS DOUBLE)) AS slope, avg(revenue) AS mean, stddev_pop(revenue) AS std
                 FROM ({body}) GROUP BY entity_id, product)""",
        extra_ctes="x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY month) AS idx, "
        "row_number() OVER (PARTITION BY entity_id ORDER BY month DESC) AS back FROM panel) WHERE back <= 12)",
    )


@register("product_trend", _trend_sql())
def q_product_trend(spark, sf):
    return P.product_trend(raw(spark, sf))


@register("product_recommendations")
def q_product_recommendations(spark, sf):
    """Per request: the promote / demote lists, each product with its two levers of highest
    |correlation| and the request's strength on them, as reasoning text."""
    from pyspark.sql import Window

    p = materialize(raw(spark, sf))
    f = materialize(engineer_features(p))
    top = P.topk_products(P.corr_product_revenue(f), P.product_stats(f))
    lev = P.corr_product_lever(p).where(F.col("corr").isNotNull())
    w = Window.partitionBy("product").orderBy(F.desc(F.abs("corr")), "lever")
    top2 = lev.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2)
    req = WI.clip_levers(WI.fill_missing_levers(WI.with_history(WI.request_table(p), p)))
    strengths = WI.lever_strength(req).select("request_id", "lever", "strength")
    j = top.join(top2.select("product", "lever", F.col("corr").alias("lever_corr")), "product", "left")
    j = j.join(strengths, "lever", "left")  # lever strengths: requests x 4 levers
    reason = F.concat_ws(" ", F.col("lever"), F.lit("("), F.format_number("lever_corr", 2), F.lit(")"), F.coalesce(F.col("strength"), F.lit("n/a")))
    g = j.groupBy("request_id", "action", "rank", "product", "display_name").agg(
        F.concat_ws("; ", F.array_sort(F.collect_list(reason))).alias("reasoning")
    )
    return g.where(F.col("request_id").isNotNull())


@register("fit_lever_ridge")
def q_fit_lever_ridge(spark, sf):
    return WI.fit_lever_ridge(raw(spark, sf), [lv for lv in LV if lv in PRESENT])


# rule effects on the historical mean: (predicted lever, conditioning input lever, condition, effect if true, effect if false, confidence)
_SIMPLE_RULES = {
    "retention_rate": ("avg_ticket_price", "< 130", -0.01, 0.01, 0.70),
    "class_attendance_rate": ("total_classes_held", "> 120", -0.02, 0.02, 0.65),
    "new_members": ("retention_rate", "> 0.80", 5.0, 0.0, 0.60),
}


def _simple_sql():
    parts = []
    for lv in LV:
        lo, hi, _, _ = B[lv]
        hist = f"hist_{lv}" if lv in PRESENT else "CAST(NULL AS DOUBLE)"
        if lv in _SIMPLE_RULES:
            src, cond, yes, no, conf = _SIMPLE_RULES[lv]
            val = f"CASE WHEN in_{src} IS NOT NULL THEN {hist} + CASE WHEN in_{src} {cond} THEN {yes} ELSE {no} END ELSE {hist} END"
            cf = f"CASE WHEN in_{src} IS NOT NULL THEN {conf} ELSE 0.65 END"
        else:
            val, cf = hist, "0.65"
        clipped = f"least(greatest({val}, {float(lo)}), {float(hi)})"
        parts.append(
            f"SELECT request_id, '{lv}' AS lever, CASE WHEN n_hist IS NOT NULL AND {hist} IS NOT NULL THEN {r2(clipped, 6)} ELSE {r2(str((lo + hi) / 2), 6)} END AS predicted_value, "
            f"CASE WHEN n_hist IS NOT NULL AND {hist} IS NOT NULL THEN {cf} ELSE 0.50 END AS confidence FROM rf"
        )
    return wsql("\nUNION ALL ".join(parts))


@register("lever_prediction_simple", _simple_sql())
def q_lever_prediction_simple(spark, sf):
    """Historical mean of the lever, shifted by a rule on another given lever, clipped;
    mid-range with confidence 0.5 when the entity has no history of it."""
    f = _filled(spark, sf)
    rows = []
    for lv in LV:
        lo, hi, _, _ = B[lv]
        hist = F.col(f"hist_{lv}") if f"hist_{lv}" in f.columns else F.lit(None).cast("double")
        val, conf = hist, F.lit(0.65)
        if lv in _SIMPLE_RULES:
            src, cond, yes, no, c = _SIMPLE_RULES[lv]
            x = F.col(f"levers.{src}")
            op, thr = cond.split()
            test = x < float(thr) if op == "<" else x > float(thr)
            val = F.when(x.isNotNull(), hist + F.when(test, F.lit(yes)).otherwise(F.lit(no))).otherwise(hist)
            conf = F.when(x.isNotNull(), F.lit(c)).otherwise(F.lit(0.65))
        have = F.col("n_hist").isNotNull() & hist.isNotNull()
        pred = F.when(have, round2(F.least(F.greatest(val, F.lit(float(lo))), F.lit(float(hi))), 6)).otherwise(round2(F.lit((lo + hi) / 2), 6))
        rows.append(F.struct(F.lit(lv).alias("lever"), pred.alias("predicted_value"), F.when(have, conf).otherwise(F.lit(0.50)).cast("double").alias("confidence")))
    return f.select("request_id", F.explode(F.array(*rows)).alias("x")).select("request_id", "x.*")
