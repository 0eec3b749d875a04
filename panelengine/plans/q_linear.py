"""Feature selection, linear fits, CV, walk-forward, explanations, model comparison
(#68, #95, #96, #128, #141, #150-#154, #162-#167, #171-#177, #180-#185)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import round2
from ..operators import explain as EX
from ..operators import features as FE
from ..operators import leakage as L
from ..operators import linear as LN
from ..operators import metrics as M
from . import oracle_models as OM
from . import training as TR
from .catalog import ORACLE, register
from .common import features, materialize
from .oracle_features import ENGINEERED_COLUMNS, q, with_features
from .oracle_panel import r2
from .q_metrics import _baseline_ctes

STRINGS = {"entity_id", "month", "studio_location", "studio_size_tier", "studio_price_tier", "split"}
TARGETS = ["revenue_month_1", "revenue_month_2", "revenue_month_3", "member_count_month_3", "retention_rate_month_3"]
ALL_FEATURES = [c for c in ENGINEERED_COLUMNS if c not in STRINGS and c not in TARGETS]
FIT = "split IN ('train', 'validation')"


def _trained(spark, sf, kind="ridge", alpha=5.0, l1_ratio=0.5, k=15):
    feat = features(spark, sf)
    model, gf, sel = TR.train(feat, k=k, kind=kind, alpha=alpha, l1_ratio=l1_ratio)
    return feat, model, gf, sel


# ---------------------------------------------------------------- selection (#95, #141, #151)


def _fscore_parts() -> tuple[str, str]:
    """(SELECT of all scores, the CTEs it needs, ending in ``sc``)."""
    y = "revenue_month_1"

    def f(c):
        num = f"covar_pop(CAST({q(c)} AS DOUBLE), CAST({y} AS DOUBLE))"
        r = f"({num} / NULLIF(sqrt(var_pop(CAST({q(c)} AS DOUBLE)) * var_pop(CAST({y} AS DOUBLE))), 0))"
        return f"{r} * {r} / (1 - {r} * {r}) * (count(*) - 2)"

    aggs = ", ".join(f"{f(c)} AS s{i}" for i, c in enumerate(ALL_FEATURES))
    rows = "\nUNION ALL ".join(f"SELECT '{c}' AS feature, s{i} AS score FROM one" for i, c in enumerate(ALL_FEATURES))
    return f"SELECT feature, {r2('score', 2)} AS score FROM sc", f"one AS (SELECT {aggs} FROM feat WHERE {FIT}),\nsc AS ({rows})"


def _fscore_sql(order_limit: str = "") -> str:
    body, extra = _fscore_parts()
    if order_limit:
        body = (f"SELECT feature, {r2('score', 2)} AS score, rk AS rank FROM (SELECT *, row_number() OVER "
                f"(ORDER BY score DESC NULLS LAST, feature) AS rk FROM sc) WHERE rk <= {order_limit}")
    return with_features(body, extra_ctes=extra)


@register("f_regression", _fscore_sql())
def q_f_regression(spark, sf):
    feat = features(spark, sf)
    gf = TR.gram_of(TR.fit_rows(feat), FE.feature_columns(feat))
    rows = [(n, None if not np.isfinite(s) else float(np.rint(s * 100) / 100)) for n, s in TR.feature_scores(gf)]
    return spark.createDataFrame(rows, "feature string, score double")


def _topk_df(spark, sf, k):
    feat = features(spark, sf)
    gf = TR.gram_of(TR.fit_rows(feat), FE.feature_columns(feat))
    scores = dict(TR.feature_scores(gf))
    sel = TR.select_k_best(gf, k)
    return spark.createDataFrame(
        [(n, float(np.rint(scores[n] * 100) / 100), i + 1) for i, n in enumerate(sel)], "feature string, score double, rank int"
    )


@register("select_k_best", _fscore_sql("15"))
def q_select_k_best(spark, sf):
    return _topk_df(spark, sf, 15)


@register("topk_features", _fscore_sql("10"))
def q_topk_features(spark, sf):
    return _topk_df(spark, sf, 10)


# ---------------------------------------------------------------- Gram (#96) and scaling (#150)

GRAM_COLS = ["retention_rate", "class_attendance_rate", "upsell_rate", "churn_rate", "month_sin", "month_cos", "retention_rate_month_3"]


def _gram_sql():
    z = ["1"] + GRAM_COLS
    rows = []
    for i in range(len(z)):
        for j in range(i, len(z)):
            a = "1.0" if i == 0 else f"CAST({z[i]} AS DOUBLE)"
            b = "1.0" if j == 0 else f"CAST({z[j]} AS DOUBLE)"
            rows.append(f"SELECT 'all' AS split_set, {i} AS i, {j} AS j, '{z[i]}' AS row_name, '{z[j]}' AS col_name, {r2(f'sum({a} * {b})', 6)} AS value FROM feat WHERE {FIT}")
    return with_features("\nUNION ALL ".join(rows))


@register("gram_matrix", _gram_sql())
def q_gram_matrix(spark, sf):
    rows = TR.fit_rows(features(spark, sf))
    names = ["1"] + GRAM_COLS
    g = LN.gram_table(rows, GRAM_COLS)
    lookup = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "k int, name string")
    return (
        g.join(F.broadcast(lookup.withColumnRenamed("k", "i").withColumnRenamed("name", "row_name")), "i")
        .join(F.broadcast(lookup.withColumnRenamed("k", "j").withColumnRenamed("name", "col_name")), "j")
        .select(F.lit("all").alias("split_set"), "i", "j", "row_name", "col_name", round2("v", 6).alias("value"))
    )


SCALE_COLS = [
    c for c in ENGINEERED_COLUMNS if c not in ("entity_id", "month", "studio_location", "studio_size_tier", "studio_price_tier", *TR.DEFAULT_SPEC.targets)
]


@register(
    "standard_scale",
    with_features(
        "SELECT entity_id, month, split, " + ", ".join(
            f"{r2(f'({q(c)} - (SELECT m_{c} FROM st)) / NULLIF((SELECT s_{c} FROM st), 0)', 6)} AS z_{c}" for c in SCALE_COLS
        ) + " FROM feat",
        extra_ctes="st AS (SELECT " + ", ".join(f"avg({q(c)}) AS m_{c}, stddev_pop({q(c)}) AS s_{c}" for c in SCALE_COLS) + " FROM feat WHERE split = 'train')",
    ),
)
def q_standard_scale(spark, sf):
    feat = features(spark, sf)
    st = feat.where(F.col("split") == "train").agg(
        *[F.avg(c).alias(f"m_{c}") for c in SCALE_COLS], *[F.stddev_pop(c).alias(f"s_{c}") for c in SCALE_COLS]
    )
    j = feat.crossJoin(F.broadcast(st))  # one row of statistics
    return j.select(
        "entity_id", "month", "split",
        *[round2(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), 6).alias(f"z_{c}") for c in SCALE_COLS],
    )


# ---------------------------------------------------------------- fits (#152-#154)


def _ridge_ctes(k: int = 15, alpha: float = 5.0, first: bool = True) -> str:
    """The ridge fit in SQL: the ``k`` best features in long form, scaled, their normal equations
    as (i, j, v), solved for all targets by elimination, one pivot a step. Ends in ``co``:
    target, feature, coef, scaled_coef, intercept."""
    body, scores = _fscore_parts()
    cast = ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in ALL_FEATURES)
    cols = ", ".join(q(c) for c in ALL_FEATURES)
    ys = "\nUNION ALL ".join(f"SELECT entity_id, month, {t} AS t, CAST({c} AS DOUBLE) AS y FROM feat WHERE {FIT}" for t, c in enumerate(TARGETS, 1))
    names = ", ".join(f"({t}, '{c}')" for t, c in enumerate(TARGETS, 1))
    return f"""{scores + "," if first else ""}
sel AS (SELECT feature, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, feature) AS rk FROM sc) WHERE rk <= {k}),
wide AS (SELECT entity_id, month, {cast} FROM feat WHERE {FIT}),
lg AS (SELECT entity_id, month, rk, value FROM (UNPIVOT wide ON {cols} INTO NAME feature VALUE value) JOIN sel USING (feature)),
st AS (SELECT rk, avg(value) AS mu, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd FROM lg GROUP BY rk),
z AS (SELECT entity_id, month, rk, (value - mu) / sd AS z FROM lg JOIN st USING (rk)),
yl AS ({ys}),
ym AS (SELECT t, avg(y) AS my FROM yl GROUP BY t),
g0 AS (
  SELECT a.rk AS i, b.rk AS j, sum(a.z * b.z) + CASE WHEN a.rk = b.rk THEN {alpha} ELSE 0 END AS v FROM z a JOIN z b USING (entity_id, month) GROUP BY a.rk, b.rk
  UNION ALL SELECT rk, {k} + t, sum(z * (y - my)) FROM z JOIN yl USING (entity_id, month) JOIN ym USING (t) GROUP BY rk, t),
{_elimination(k)}
w AS (SELECT i AS rk, j - {k} AS t, v FROM g{k} WHERE j > {k}),
co AS (SELECT t, target, feature, w.v / sd AS coef, w.v AS scaled_coef, mu, my - sum(mu * w.v / sd) OVER (PARTITION BY t) AS intercept
       FROM w JOIN st USING (rk) JOIN sel USING (rk) JOIN ym USING (t) JOIN (VALUES {names}) n(t, target) USING (t))"""


def _elimination(k: int) -> str:
    """g1 .. gk: step p makes column p that of the unit matrix."""
    return "\n".join(
        f"""g{p} AS (SELECT a.i, a.j, CASE WHEN a.i = {p} THEN r.v / d.v ELSE a.v - c.v * r.v / d.v END AS v FROM g{p - 1} a JOIN g{p - 1} r ON r.i = {p} AND r.j = a.j
  JOIN g{p - 1} c ON c.i = a.i AND c.j = {p} JOIN g{p - 1} d ON d.i = {p} AND d.j = {p}),"""
        for p in range(1, k + 1)
    )


_sig = OM.sig


def _sig_column(c):
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.when(c != 0, c)))) - 4)
    return F.coalesce(F.rint(c / p) * p, F.lit(0.0))


def _raw_metrics(long, by):
    e = F.col("actual") - F.col("predicted")
    return long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("actual") * F.count(F.lit(1)))).alias("r2"),
        (F.avg(F.abs(F.try_divide(e, F.col("actual") + 1e-10))) * 100).alias("mape"),
    )


def _metrics(long, by):
    """Metrics of a fitted model, to five significant digits."""
    m = _raw_metrics(long, by)
    return m.select(*by, "n", *[(round2("r2", 4) if c == "r2" else _sig_column(F.col(c))).alias(c) for c in ("rmse", "mae", "r2", "mape")])


_COEFS = ("coef", "scaled_coef", "intercept")


@register("fit_ridge_multi", with_features("SELECT 'ridge' AS model, target, feature, " + ", ".join(f"{_sig(c)} AS {c}" for c in _COEFS) + " FROM co", extra_ctes=_ridge_ctes()))
def q_fit_ridge_multi(spark, sf):
    _, model, _, _ = _trained(spark, sf, "ridge", 5.0)
    t = model.coefficient_table(spark, "v2.2")
    return t.select("model", "target", "feature", *[_sig_column(F.col(c)).alias(c) for c in _COEFS])


def _coef_query(kind, alpha, l1=0.5):
    def run(spark, sf):
        _, model, _, _ = _trained(spark, sf, kind, alpha, l1)
        return model.coefficient_table(spark, "v2.2")

    return run


register("fit_lasso")(_coef_query("lasso", 1.0))
register("fit_elastic_net")(_coef_query("elastic_net", 2.0, 0.5))


def _score_sql() -> str:
    cast = ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in ALL_FEATURES)
    cols = ", ".join(q(c) for c in ALL_FEATURES)
    extra = f"""{_ridge_ctes()},
wa AS (SELECT entity_id, month, split, {cast} FROM feat),
la AS (SELECT entity_id, month, split, feature, value FROM (UNPIVOT wa ON {cols} INTO NAME feature VALUE value))"""
    body = f"SELECT entity_id, month, split AS dataset, target, {_sig('sum(value * coef) + any_value(intercept)')} AS predicted FROM la JOIN co USING (feature) GROUP BY entity_id, month, split, target"
    return with_features(body, extra_ctes=extra)


@register("score_linear", _score_sql())
def q_score_linear(spark, sf):
    """Predictions of the fitted ridge model for every row and target."""
    feat, model, _, _ = _trained(spark, sf)
    w = M.to_long(TR.predictions_wide(feat, model, "ridge"))
    return w.select("entity_id", "month", "dataset", "target", _sig_column(F.col("predicted")).alias("predicted"))


# ---------------------------------------------------------------- CV (#162-#164)


def _cv(spark, sf, by_entity):
    feat = features(spark, sf)
    _, gf, sel = TR.train(feat)
    rows = TR.fit_rows(feat)
    gs, shift = TR.fold_grams(rows, sel, by_entity=by_entity)
    out = None
    for kind, a, l1 in (("ridge", 5.0, 0.5), ("elastic_net", 2.0, 0.5)):
        t = TR.cv_table(spark, TR.cross_validate_grams(gs, len(sel), shift, kind, a, l1), kind)
        out = t if out is None else out.unionByName(t)
    return out


def _cv_sql(folds: str, body: str) -> str:
    ctes = f"{_ridge_ctes()},\n{OM.long_rows(ALL_FEATURES, TARGETS)},\n{OM.cross_validated('sel', 15, TARGETS, folds, FIT)}"
    return OM.sql(body, ctes)


_CV_ROWS = f"SELECT 'ridge' AS model, fold, n_val, {r2('r2', 4)} AS r2, {_sig('rmse')} AS rmse FROM cv"


def _ridge_cv(spark, sf, by_entity):
    feat = features(spark, sf)
    _, _, sel = TR.train(feat)
    gs, shift = TR.fold_grams(TR.fit_rows(feat), sel, by_entity=by_entity)
    return TR.cv_table(spark, TR.cross_validate_grams(gs, len(sel), shift), "ridge")


def _cv_rows(cv):
    return cv.select("model", "fold", "n_val", round2("r2", 4).alias("r2"), _sig_column(F.col("rmse")).alias("rmse"))


@register("kfold_cv_ridge", _cv_sql(OM.row_folds(FIT), _CV_ROWS))
def q_kfold_cv_ridge(spark, sf):
    return _cv_rows(_ridge_cv(spark, sf, by_entity=False))


@register("group_kfold_cv_ridge", _cv_sql(OM.entity_folds(FIT), _CV_ROWS))
def q_group_kfold_cv_ridge(spark, sf):
    return _cv_rows(_ridge_cv(spark, sf, by_entity=True))


@register("kfold_cv")
def q_kfold_cv(spark, sf):
    return _cv(spark, sf, by_entity=False)


@register("group_kfold_cv")
def q_group_kfold_cv(spark, sf):
    return _cv(spark, sf, by_entity=True)


@register("cv_summary")
def q_cv_summary(spark, sf):
    return TR.cv_summary(_cv(spark, sf, by_entity=True))


@register("grid_search")
def q_grid_search(spark, sf):
    feat = features(spark, sf)
    rows = TR.fit_rows(feat)
    feats = FE.feature_columns(feat)
    gs, shift = TR.fold_grams(rows, feats, by_entity=False)
    total = sum(gs.values())
    scores = TR.feature_scores(TR.GramFit(feats, list(TR.DEFAULT_SPEC.targets), total, shift))
    res, best_k, best_alpha = TR.grid_search(gs, feats, shift, scores)
    return spark.createDataFrame(
        [(stage, params, float(r), best_k, float(best_alpha)) for stage, params, r in res],
        "stage string, params string, cv_r2 double, best_k int, best_alpha double",
    )


# ---------------------------------------------------------------- walk-forward (#68, #165-#167)


def _wf_fold_sql():
    return with_features(
        """SELECT fold, train_start, train_end, test_start, test_end FROM (
             SELECT row_number() OVER (ORDER BY s) AS fold,
                    (SELECT month FROM mi WHERE idx = s) AS train_start,
                    (SELECT month FROM mi WHERE idx = s + 35) AS train_end,
                    (SELECT month FROM mi WHERE idx = s + 36) AS test_start,
                    (SELECT month FROM mi WHERE idx = least(s + 38, (SELECT count(*) FROM mi) - 1)) AS test_end
             FROM (SELECT unnest(range(0, (SELECT count(*) FROM mi) - 39, 3)) AS s))""",
        extra_ctes="mi AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS idx FROM (SELECT DISTINCT month FROM feat))",
    )


@register("walk_forward_folds", _wf_fold_sql())
def q_walk_forward_folds(spark, sf):
    return TR.walk_forward_folds(features(spark, sf)).select("fold", "train_start", "train_end", "test_start", "test_end")


def _wf(spark, sf):
    scored, folds, coefs = TR.walk_forward(features(spark, sf))
    return scored


def _wf_sql(body: str) -> str:
    return OM.sql(body, f"{OM.walk_forward(ALL_FEATURES, TARGETS)},\n{OM.OVERALL}")


@register("walk_forward", _wf_sql(OM.metrics("fold, target", "wf")))
def q_walk_forward(spark, sf):
    return _metrics(_wf(spark, sf), ("fold", "target"))


_DRIFT = f"{r2('r2_degradation', 4)} AS r2_degradation, {_sig('rmse_degradation')} AS rmse_degradation, r2_degradation > 0.05 OR rmse_degradation > 100 AS degraded"
_LEAKAGE = "CASE WHEN avg_r2 > 0.99 THEN 'SEVERE LEAKAGE LIKELY' WHEN avg_r2 > 0.95 THEN 'POSSIBLE LEAKAGE' WHEN avg_r2 > 0.80 THEN 'UNLIKELY' ELSE 'NONE DETECTED' END"


@register(
    "walk_forward_summary",
    _wf_sql(f"SELECT {r2('avg_r2', 4)} AS avg_r2, {r2('r2_std', 4)} AS r2_std, {_sig('avg_rmse')} AS avg_rmse, {_sig('rmse_std')} AS rmse_std, {_DRIFT}, {_LEAKAGE} AS leakage_status FROM ws"),
)
def q_walk_forward_summary(spark, sf):
    s = TR.walk_forward_summary(TR.walk_forward_overall(_wf(spark, sf)))
    return s.select(*[round2(c, 4).alias(c) for c in ("avg_r2", "r2_std", "r2_degradation")], *[_sig_column(F.col(c)).alias(c) for c in ("avg_rmse", "rmse_std", "rmse_degradation")], "degraded", "leakage_status")


@register("half_split_stability", _wf_sql(f"SELECT {_DRIFT} FROM ws"))
def q_half_split_stability(spark, sf):
    return q_walk_forward_summary(spark, sf).select("r2_degradation", "rmse_degradation", "degraded")


# ---------------------------------------------------------------- explanations (#180-#185)


def _explained_sql(body: str) -> str:
    return OM.sql(body, f"{_ridge_ctes()},\n{OM.long_rows(ALL_FEATURES, TARGETS)},\n{OM.background(FIT)}")


def _top_sql(phi: str, base: str, more: str = "") -> str:
    return _explained_sql(f"""SELECT entity_id, month, target, CAST(rk AS INTEGER) AS rank, feature, {_sig('phi')} AS phi, {_sig('base_value')} AS base_value, {_sig('prediction')} AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, month, target ORDER BY CASE WHEN phi = 0 THEN 0 ELSE round_even(abs(phi) / power(10, floor(log10(abs(phi))) - 7), 0) * power(10, floor(log10(abs(phi))) - 7) END DESC, feature) AS rk, base_value + sum(phi) OVER (PARTITION BY entity_id, month, target) AS prediction
  FROM (SELECT entity_id, month, target, la.feature AS feature, {phi} AS phi, {base} AS base_value FROM la JOIN co USING (feature) {more})) WHERE rk <= 5""")


_BASE = "JOIN bg USING (feature) JOIN (SELECT target, any_value(intercept) + sum(coef * mu_bg) AS at_bg FROM co JOIN bg USING (feature) GROUP BY target) USING (target)"


def _rounded(x):
    return x.select("entity_id", "month", "target", "rank", "feature", *[_sig_column(F.col(c)).alias(c) for c in ("phi", "base_value", "prediction")])


@register("linear_shap", _top_sql("coef * (value - mu_bg)", "at_bg", _BASE))
def q_linear_shap(spark, sf):
    feat, model, _, _ = _trained(spark, sf)
    bg = EX.background_mean(TR.fit_rows(feat), model.features)
    return _rounded(EX.explanations(feat, model, bg))


@register("shap_summary", _explained_sql(f"""SELECT feature, {_sig('total')} AS total_abs_shap FROM (SELECT feature, sum(abs(coef * (value - mu_bg))) AS total FROM la JOIN co USING (feature) JOIN bg USING (feature) GROUP BY feature)
ORDER BY total DESC, feature LIMIT 10"""))
def q_shap_summary(spark, sf):
    feat, model, _, _ = _trained(spark, sf)
    bg = EX.background_mean(TR.fit_rows(feat), model.features)
    top = EX.shap_totals(feat, model, bg).orderBy(F.desc("total_abs_shap"), "feature").limit(10)
    return top.select("feature", _sig_column(F.col("total_abs_shap")).alias("total_abs_shap"))


@register("coef_contribution", _top_sql("coef * value", "intercept"))
def q_coef_contribution(spark, sf):
    feat, model, _, _ = _trained(spark, sf)
    return _rounded(EX.explanations(feat, model, None))


@register(
    "global_importance",
    with_features(f"""SELECT target, feature, {_sig('abs(scaled_coef)')} AS importance, CASE WHEN scaled_coef >= 0 THEN 'positive' ELSE 'negative' END AS direction,
CAST(row_number() OVER (PARTITION BY target ORDER BY abs(scaled_coef) DESC, feature) AS INTEGER) AS rank FROM co""", extra_ctes=_ridge_ctes()),
)
def q_global_importance(spark, sf):
    _, model, _, _ = _trained(spark, sf)
    g = EX.global_importance(model.coefficient_table(spark))
    return g.select("target", "feature", _sig_column(F.col("importance")).alias("importance"), "direction", "rank")


_BACKGROUND = ", ".join(f"max(value) FILTER (rk = {k}) AS value_{k}" for k in range(1, 16))


@register("shap_background", _explained_sql(f"SELECT entity_id, month, {_BACKGROUND} FROM la JOIN bs USING (entity_id, month) JOIN sel USING (feature) GROUP BY entity_id, month"))
def q_shap_background(spark, sf):
    """The background rows, with their features in the order of selection."""
    feat, model, _, _ = _trained(spark, sf)
    cols = [F.col(f"`{c}`").cast("double").alias(f"value_{k}") for k, c in enumerate(model.features, 1)]
    return EX.background_sample(TR.fit_rows(feat)).select("entity_id", "month", *cols)


# ---------------------------------------------------------------- comparisons and verdicts (#128, #171-#177)


def _model_long(spark, sf, kind="ridge", alpha=5.0, name="ridge", k=15):
    feat, model, _, _ = _trained(spark, sf, kind, alpha, k=k)
    return feat, M.to_long(TR.predictions_wide(feat, model, name))


def _versions_ctes(more: str = "") -> str:
    """pv: predictions of v1 (12 features, alpha 10) and v2 (15 features, alpha 5)."""
    scores = _fscore_parts()[1]
    both = f"{scores},{OM.named(_ridge_ctes(12, 10.0, first=False), '_1')},{_ridge_ctes(15, 5.0, first=False)},\n{OM.long_rows(ALL_FEATURES, TARGETS)}"
    return f"{both},\npv AS MATERIALIZED ({OM.predictions('v1', 'co_1')} UNION ALL {OM.predictions('v2', 'co')}),\npm AS MATERIALIZED ({OM.raw_metrics('model, dataset, target', 'pv')}){more}"


def improvement_class(gain):
    return F.when(gain > 0.2, "strong").when(gain > 0, "modest").otherwise("none")


def leakage_class(r2col):
    return F.when(r2col > 0.99, "LIKELY DATA LEAKAGE").when(r2col > 0.90, "VERIFY NO LEAKAGE").when(r2col > 0.70, "ACCEPTABLE").otherwise("NORMAL")


_ASSESSED = "CASE WHEN avg_r2 > 0.99 THEN 'LIKELY DATA LEAKAGE' WHEN avg_r2 > 0.90 THEN 'VERIFY NO LEAKAGE' WHEN avg_r2 > 0.70 THEN 'ACCEPTABLE' ELSE 'NORMAL' END"


def _baseline_sql() -> str:
    ctes = f"{_ridge_ctes()},\n{OM.long_rows(ALL_FEATURES, TARGETS)},\n{_baseline_ctes()}"
    ctes += f""",
al AS (SELECT model, dataset, target, actual, predicted FROM plv UNION ALL SELECT model, dataset, target, actual, predicted FROM ({OM.predictions('ridge', 'co')})),
mt AS MATERIALIZED ({OM.raw_metrics('model, target', "(SELECT * FROM al WHERE dataset = 'test')")}),
bb AS (SELECT target, max(r2) FILTER (model <> 'ridge') AS best_baseline_r2, max(r2) FILTER (model = 'ridge') AS model_r2 FROM mt GROUP BY target),
aa AS (SELECT avg(model_r2) AS avg_r2 FROM bb)"""
    cols = ", ".join(f"{r2(c, 4) if c == 'r2' else _sig(c)} AS {c}" for c in OM.RAW)
    return OM.sql(
        f"""SELECT model, target, n, {cols}, {r2('best_baseline_r2', 4)} AS best_baseline_r2, {r2('model_r2 - best_baseline_r2', 4)} AS improvement,
CASE WHEN model_r2 - best_baseline_r2 > 0.2 THEN 'strong' WHEN model_r2 - best_baseline_r2 > 0 THEN 'modest' ELSE 'none' END AS verdict, {_ASSESSED} AS assessment
FROM mt JOIN bb USING (target) CROSS JOIN aa""", ctes)


@register("baseline_comparison", _baseline_sql())
def q_baseline_comparison(spark, sf):
    """Test metrics of the baselines and the ridge model, its gain in R2 over the best baseline,
    and what its mean R2 says about leakage."""
    feat, long = _model_long(spark, sf)
    base = M.to_long(M.all_baselines(feat)).where(F.col("predicted").isNotNull() & F.col("actual").isNotNull())
    m = _raw_metrics(base.unionByName(long).where(F.col("dataset") == "test"), ("model", "target"))
    of = lambda c: F.max(F.when(c, F.col("r2")))
    best = m.groupBy("target").agg(of(F.col("model") != "ridge").alias("best_baseline_r2"), of(F.col("model") == "ridge").alias("model_r2"))
    gain = F.col("model_r2") - F.col("best_baseline_r2")
    one = best.agg(F.avg("model_r2").alias("avg_r2"))
    return m.join(best, "target").crossJoin(F.broadcast(one)).select(  # one row
        "model", "target", "n", *[(round2(c, 4) if c == "r2" else _sig_column(F.col(c))).alias(c) for c in ("rmse", "mae", "r2", "mape")],
        round2("best_baseline_r2", 4).alias("best_baseline_r2"), round2(gain, 4).alias("improvement"), improvement_class(gain).alias("verdict"), leakage_class(F.col("avg_r2")).alias("assessment"),
    )


def _version_long(spark, sf, feat=None):
    """Predictions of v1 (12 features, alpha 10) and v2 (15 features, alpha 5), from one panel."""
    feat = features(spark, sf) if feat is None else feat
    parts = []
    for name, alpha, k in (("v1", 10.0, 12), ("v2", 5.0, 15)):
        model, _, _ = TR.train(feat, k=k, alpha=alpha)
        parts.append(M.to_long(TR.predictions_wide(feat, model, name)))
    return materialize(parts[0].unionByName(parts[1]))


def _test_join(long):
    m = _raw_metrics(long.where(F.col("dataset") == "test"), ("model", "target"))
    side = lambda v: m.where(F.col("model") == v).select("target", *[F.col(c).alias(f"{v}_{c}") for c in ("rmse", "r2", "mape")])
    return side("v1").join(side("v2"), "target")


_JOINED = ("SELECT target, " + ", ".join(f"max({c}) FILTER (model = '{v}') AS {v}_{c}" for v in ("v1", "v2") for c in ("rmse", "r2", "mape")) + " FROM pm WHERE dataset = 'test' GROUP BY target")
_REVENUES = ", ".join(f"'{t}'" for t in TARGETS[:3])


@register(
    "compare_versions_join",
    OM.sql("SELECT target, " + ", ".join(f"{r2(f'{v}_{c}', 4) if c == 'r2' else _sig(f'{v}_{c}')} AS {v}_{c}" for v in ("v1", "v2") for c in ("rmse", "r2", "mape")) + f" FROM ({_JOINED})", _versions_ctes()),
)
def q_compare_versions_join(spark, sf):
    j = _test_join(_version_long(spark, sf))
    return j.select("target", *[(round2(f"{v}_{c}", 4) if c == "r2" else _sig_column(F.col(f"{v}_{c}"))).alias(f"{v}_{c}") for v in ("v1", "v2") for c in ("rmse", "r2", "mape")])


def _improvements(long):
    return _test_join(long).where(F.col("target").isin(*TARGETS[:3])).select(
        "target",
        ((F.col("v1_rmse") - F.col("v2_rmse")) / F.col("v1_rmse") * 100).alias("rmse_improvement"),
        (F.col("v2_r2") - F.col("v1_r2")).alias("r2_improvement"),
        ((F.col("v1_mape") - F.col("v2_mape")) / F.col("v1_mape") * 100).alias("mape_improvement"),
    )


_IMPROVED = f"SELECT target, (v1_rmse - v2_rmse) / v1_rmse * 100 AS rmse_improvement, v2_r2 - v1_r2 AS r2_improvement, (v1_mape - v2_mape) / v1_mape * 100 AS mape_improvement FROM ({_JOINED}) WHERE target IN ({_REVENUES})"
_BETTER = ("rmse_improvement", "r2_improvement", "mape_improvement")


@register("compare_versions", OM.sql("SELECT target, " + ", ".join(f"{r2(c, 4)} AS {c}" for c in _BETTER) + f" FROM ({_IMPROVED})", _versions_ctes()))
def q_compare_versions(spark, sf):
    return _improvements(_version_long(spark, sf)).select("target", *[round2(c, 4).alias(c) for c in _BETTER])


def _gaps(spark, sf):
    """Per version: the RMSE it is held against, the test RMSE, and the gap in percent. For v1
    training against test, mean over the revenues; for v2 cross-validation (entity folds) against
    test, over all targets together. And the predictions."""
    feat = features(spark, sf)
    long = _version_long(spark, sf, feat)
    m = _raw_metrics(long, ("model", "dataset", "target")).where((F.col("model") == "v1") & F.col("target").isin(*TARGETS[:3]))
    mean = lambda ds: F.avg(F.when(F.col("dataset") == ds, F.col("rmse")))
    v1 = m.groupBy("model").agg(F.lit("train").alias("against"), mean("train").alias("base_rmse"), mean("test").alias("test_rmse"))
    _, _, sel = TR.train(feat)
    gs, shift = TR.fold_grams(TR.fit_rows(feat), sel, by_entity=True)
    cv = float(np.mean([r[3] for r in TR.cross_validate_grams(gs, len(sel), shift)]))
    test = _raw_metrics(long.where((F.col("model") == "v2") & (F.col("dataset") == "test")), ("model",))
    v2 = test.select("model", F.lit("cv").alias("against"), F.lit(cv).alias("base_rmse"), F.col("rmse").alias("test_rmse"))
    return v1.unionByName(v2).withColumn("gap_pct", (F.col("test_rmse") - F.col("base_rmse")) / F.col("base_rmse") * 100), long


def _gap_ctes() -> str:
    cv = OM.cross_validated("sel", 15, TARGETS, OM.entity_folds(FIT), FIT)
    return _versions_ctes(f""",
{cv},
gp0 AS (
  SELECT 'v1' AS model, 'train' AS against, avg(rmse) FILTER (dataset = 'train') AS base_rmse, avg(rmse) FILTER (dataset = 'test') AS test_rmse FROM pm WHERE model = 'v1' AND target IN ({_REVENUES})
  UNION ALL SELECT 'v2', 'cv', (SELECT avg(rmse) FROM cv), (SELECT sqrt(avg((actual - predicted) * (actual - predicted))) FROM pv WHERE model = 'v2' AND dataset = 'test')),
gp AS (SELECT *, (test_rmse - base_rmse) / base_rmse * 100 AS gap_pct FROM gp0)""")


@register("generalization_gap", OM.sql(f"SELECT model, against, {_sig('base_rmse')} AS base_rmse, {_sig('test_rmse')} AS test_rmse, {r2('gap_pct', 4)} AS gap_pct FROM gp", _gap_ctes()))
def q_generalization_gap(spark, sf):
    g, _ = _gaps(spark, sf)
    return g.select("model", "against", *[_sig_column(F.col(c)).alias(c) for c in ("base_rmse", "test_rmse")], round2("gap_pct", 4).alias("gap_pct"))


def deploy_recommendation(rmse_gain, r2_gain, cv_test_gap, train_test_gap):
    """By the mean gains of the new version, its gap between cross-validation and test, and the
    old version's between training and test."""
    return (
        F.when((rmse_gain > 10) & (cv_test_gap < 50), "RECOMMENDED")
        .when(r2_gain > 0.2, "RECOMMENDED")
        .when(cv_test_gap < train_test_gap, "CONDITIONAL")
        .otherwise("NOT RECOMMENDED")
    )


_DEPLOY_COLUMNS = ("avg_rmse_improvement", "avg_r2_improvement", "v1_train_test_gap_pct", "v2_cv_test_gap_pct", "gap_improvement")


@register(
    "deploy_recommendation",
    OM.sql(
        "SELECT " + ", ".join(f"{r2(c, 4)} AS {c}" for c in _DEPLOY_COLUMNS) + f""", CASE WHEN avg_rmse_improvement > 10 AND v2_cv_test_gap_pct < 50 THEN 'RECOMMENDED' WHEN avg_r2_improvement > 0.2 THEN 'RECOMMENDED'
WHEN v2_cv_test_gap_pct < v1_train_test_gap_pct THEN 'CONDITIONAL' ELSE 'NOT RECOMMENDED' END AS recommendation FROM (
  SELECT avg(rmse_improvement) AS avg_rmse_improvement, avg(r2_improvement) AS avg_r2_improvement, (SELECT gap_pct FROM gp WHERE model = 'v1') AS v1_train_test_gap_pct,
         (SELECT gap_pct FROM gp WHERE model = 'v2') AS v2_cv_test_gap_pct, (SELECT max(gap_pct) FILTER (model = 'v1') - max(gap_pct) FILTER (model = 'v2') FROM gp) AS gap_improvement FROM ({_IMPROVED}))""", _gap_ctes()),
)
def q_deploy_recommendation(spark, sf):
    gaps, long = _gaps(spark, sf)
    better = _improvements(long).agg(F.avg("rmse_improvement").alias("avg_rmse_improvement"), F.avg("r2_improvement").alias("avg_r2_improvement"))
    of = lambda v: F.max(F.when(F.col("model") == v, F.col("gap_pct")))
    one = better.crossJoin(gaps.agg(of("v1").alias("v1_train_test_gap_pct"), of("v2").alias("v2_cv_test_gap_pct")))  # one row each
    one = one.withColumn("gap_improvement", F.col("v1_train_test_gap_pct") - F.col("v2_cv_test_gap_pct"))
    verdict = deploy_recommendation(F.col("avg_rmse_improvement"), F.col("avg_r2_improvement"), F.col("v2_cv_test_gap_pct"), F.col("v1_train_test_gap_pct"))
    return one.select(*[round2(c, 4).alias(c) for c in _DEPLOY_COLUMNS], verdict.alias("recommendation"))


def readiness(r2col):
    return (
        F.when(r2col > 0.50, "EXCELLENT").when(r2col > 0.40, "GOOD").when(r2col > 0.30, "ACCEPTABLE")
        .when(r2col > 0.20, "MARGINAL").otherwise("INSUFFICIENT")
    )


def readiness_of_first(r2col):
    """The scale of the first multi-entity version."""
    return F.when(r2col < 0, "NOT READY (negative R2)").when(r2col < 0.20, "NOT READY").when(r2col < 0.30, "MARGINAL").when(r2col < 0.40, "ACCEPTABLE").otherwise("READY")


def readiness_of_next(r2col):
    """The scale of the version after it."""
    return F.when(r2col < 0.20, "NOT READY").when(r2col < 0.30, "MARGINAL").when(r2col < 0.40, "ACCEPTABLE").when(r2col < 0.50, "READY").otherwise("EXCELLENT")


def _overall_ctes() -> str:
    return f"{_ridge_ctes()},\n{OM.long_rows(ALL_FEATURES, TARGETS)},\nto_ AS (SELECT model, r2 FROM ({OM.raw_metrics('model', '(SELECT * FROM (' + OM.predictions('ridge', 'co') + ') WHERE dataset = ' + chr(39) + 'test' + chr(39) + ')')}))"


def _test_overall(spark, sf, feat=None):
    feat = features(spark, sf) if feat is None else feat
    model, _, _ = TR.train(feat)
    long = M.to_long(TR.predictions_wide(feat, model, "ridge"))
    return _raw_metrics(long.where(F.col("dataset") == "test"), ("model",))


@register(
    "readiness_tier",
    OM.sql(f"""SELECT model, {r2('r2', 4)} AS r2, CASE WHEN r2 > 0.5 THEN 'EXCELLENT' WHEN r2 > 0.4 THEN 'GOOD' WHEN r2 > 0.3 THEN 'ACCEPTABLE' WHEN r2 > 0.2 THEN 'MARGINAL' ELSE 'INSUFFICIENT' END AS tier,
CASE WHEN r2 < 0 THEN 'NOT READY (negative R2)' WHEN r2 < 0.2 THEN 'NOT READY' WHEN r2 < 0.3 THEN 'MARGINAL' WHEN r2 < 0.4 THEN 'ACCEPTABLE' ELSE 'READY' END AS first_scale,
CASE WHEN r2 < 0.2 THEN 'NOT READY' WHEN r2 < 0.3 THEN 'MARGINAL' WHEN r2 < 0.4 THEN 'ACCEPTABLE' WHEN r2 < 0.5 THEN 'READY' ELSE 'EXCELLENT' END AS next_scale FROM to_""", _overall_ctes()),
)
def q_readiness_tier(spark, sf):
    r = F.col("r2")
    return _test_overall(spark, sf).select("model", round2("r2", 4).alias("r2"), readiness(r).alias("tier"), readiness_of_first(r).alias("first_scale"), readiness_of_next(r).alias("next_scale"))


_SEVERITY = "CASE WHEN r2 > 0.99 THEN 'CRITICAL' WHEN r2 > 0.95 THEN 'HIGH' ELSE 'OK' END"


@register("performance_sanity", OM.sql(f"SELECT model, {r2('r2', 4)} AS r2, {_SEVERITY} AS severity FROM to_", _overall_ctes()))
def q_performance_sanity(spark, sf):
    return _sanity(_test_overall(spark, sf))


def _sanity(overall):
    return overall.select("model", round2("r2", 4).alias("r2"), F.when(F.col("r2") > 0.99, "CRITICAL").when(F.col("r2") > 0.95, "HIGH").otherwise("OK").alias("severity"))


def _leakage_sql(body: str) -> str:
    """Over fi(check, issue, severity): the issues that the checks find."""
    sub = lambda name: f"({ORACLE[name]})"
    found = [
        "SELECT 'Targets in features' AS check_, feature AS issue, 'CRITICAL' AS severity FROM (SELECT feature FROM sel WHERE feature IN (" + ", ".join(f"'{t}'" for t in TARGETS) + "))",
        f"SELECT 'Current period', lag_feature, 'CRITICAL' FROM {sub('lag_match_rate')} WHERE status = 'leak'",
        f"SELECT 'Lag correlation', lag_feature, 'HIGH' FROM {sub('lag_corr_check')} WHERE flagged",
        f"SELECT 'Rolling window', feature, 'CRITICAL' FROM {sub('rolling_match_rate')} WHERE status = 'leak'",
        f"SELECT 'Performance sanity', model, {_SEVERITY} FROM to_ WHERE {_SEVERITY} <> 'OK'",
        f"SELECT 'Feature history', CAST(entity_id AS VARCHAR), 'MEDIUM' FROM {sub('first_row_history')} WHERE non_null_lagged > 0",
    ]
    return OM.sql(body, _overall_ctes() + ",\nfi AS (" + "\nUNION ALL ".join(found) + ")")


def _findings(spark, sf):
    """(check_, issue, severity): one row for each issue that a leakage check finds."""
    feat = features(spark, sf)
    model, _, _ = TR.train(feat)
    def row(df, check, issue, bad, severity):
        level = F.when(bad, severity).otherwise("OK") if isinstance(severity, str) else severity
        return df.select(F.lit(check).alias("check_"), F.col(issue).cast("string").alias("issue"), level.alias("severity"))

    leak = F.col("status") == "leak"
    targets = spark.createDataFrame([(t,) for t in model.features if t in TARGETS], "feature string")
    parts = [
        row(targets, "Targets in features", "feature", F.lit(True), "CRITICAL"),
        row(L.lag_match_rate(feat), "Current period", "lag_feature", leak, "CRITICAL"),
        row(L.lag_corr_check(feat), "Lag correlation", "lag_feature", F.col("flagged"), "HIGH"),
        row(L.rolling_match_rate(feat), "Rolling window", "feature", leak, "CRITICAL"),
        row(_sanity(_test_overall(spark, sf, feat)), "Performance sanity", "model", None, F.col("severity")),
        row(L.first_row_history(feat), "Feature history", "entity_id", F.col("non_null_lagged") > 0, "MEDIUM"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a few rows; written first, since planning the filter through the checks' wide plans takes long
    return materialize(out).where("severity <> 'OK'")


@register("leakage_findings", _leakage_sql("SELECT check_, issue, severity FROM fi"))
def q_leakage_findings(spark, sf):
    return _findings(spark, sf)


_LEVELS = ("CRITICAL", "HIGH", "MEDIUM")


@register(
    "leakage_verdict",
    _leakage_sql(
        "SELECT CASE WHEN n_critical > 0 THEN 'REJECTED' WHEN n_high > 0 THEN 'CONDITIONAL' ELSE 'APPROVED' END AS verdict, * FROM (SELECT "
        + ", ".join(f"count(*) FILTER (severity = '{x}') AS n_{x.lower()}, coalesce(string_agg(DISTINCT check_, ',' ORDER BY check_) FILTER (severity = '{x}'), '') AS {x.lower()}_checks" for x in _LEVELS) + " FROM fi)"
    ),
)
def q_leakage_verdict(spark, sf):
    """The verdict, and how many issues of each severity which checks found."""
    of = lambda x: F.col("severity") == x
    aggs = [a for x in _LEVELS for a in (F.count_if(of(x)).alias(f"n_{x.lower()}"), F.array_join(F.array_sort(F.collect_set(F.when(of(x), F.col("check_")))), ",").alias(f"{x.lower()}_checks"))]
    one = _findings(spark, sf).agg(*aggs)
    return one.select(F.when(F.col("n_critical") > 0, "REJECTED").when(F.col("n_high") > 0, "CONDITIONAL").otherwise("APPROVED").alias("verdict"), *one.columns)


@register("scan_model_registry")
def q_scan_model_registry(spark, sf):
    """Train two versions, save them as registry tables, list the registry."""
    import uuid

    from ..sources import registry as RG

    root = RG.registry_root(spark, f"registry-{uuid.uuid4().hex[:10]}")
    feat = features(spark, sf)
    for version, alpha, k in (("2.1.0", 10.0, 12), ("2.2.0", 5.0, 15)):
        model, _, _ = TR.train(feat, k=k, alpha=alpha)
        RG.save_model(spark, root, model, version)
    return RG.scan_model_registry(spark, root)
