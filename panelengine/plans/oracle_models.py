"""DuckDB SQL on top of the ridge fit: predictions, explanations, comparisons of versions, and
ridge fits by key (folds, walk-forward windows)."""

from __future__ import annotations

import re

from .oracle_features import q, with_features
from .oracle_panel import r2
from .oracle_whatif import d, uniform

MONTH_NO = "(year(month) * 12 + month(month))"


def sig(x: str) -> str:
    """Five significant digits."""
    p = f"power(10, floor(log10(abs(NULLIF({x}, 0)))) - 4)"
    return f"coalesce(round_even(({x}) / {p}, 0) * {p}, 0)"


def named(ctes: str, suffix: str) -> str:
    """The CTEs of a ridge fit under other names, so that two fits fit in one query."""
    return re.sub(r"\b(sel|wide|lg|st|z|yl|ym|w|co|g\d+)\b", lambda m: m[0] + suffix, ctes)


def long_rows(features: list[str], targets: list[str]) -> str:
    """la: every row's features in long form; ya: its targets."""
    cast = ", ".join(f"CAST({q(c)} AS DOUBLE) AS {q(c)}" for c in features)
    ys = "\nUNION ALL ".join(f"SELECT entity_id, month, split, {t} AS t, '{c}' AS target, CAST({c} AS DOUBLE) AS actual FROM feat" for t, c in enumerate(targets, 1))
    return f"""wa AS (SELECT entity_id, month, split, {cast} FROM feat),
la AS MATERIALIZED (SELECT entity_id, month, split, feature, value FROM (UNPIVOT wa ON {", ".join(q(c) for c in features)} INTO NAME feature VALUE value)),
ya AS MATERIALIZED ({ys})"""


def predictions(model: str, co: str) -> str:
    return (
        f"SELECT '{model}' AS model, entity_id, month, la.split AS dataset, target, any_value(actual) AS actual, sum(value * coef) + any_value(intercept) AS predicted "
        f"FROM la JOIN {co} USING (feature) JOIN ya USING (entity_id, month, target) GROUP BY entity_id, month, la.split, target"
    )


RAW = {
    "rmse": "sqrt(avg((actual - predicted) * (actual - predicted)))",
    "mae": "avg(abs(actual - predicted))",
    "r2": "1 - sum((actual - predicted) * (actual - predicted)) / NULLIF(var_pop(actual) * count(*), 0)",
    "mape": f"avg(abs((actual - predicted) / NULLIF(actual + {d(1e-10)}, 0))) * 100",
}


def raw_metrics(by: str, source: str) -> str:
    return f"SELECT {by}, count(*) AS n, " + ", ".join(f"{x} AS {c}" for c, x in RAW.items()) + f" FROM {source} GROUP BY {by}"


def metrics(by: str, source: str) -> str:
    cols = ", ".join(f"{r2(c, 4) if c == 'r2' else sig(c)} AS {c}" for c in RAW)
    return f"SELECT {by}, n, {cols} FROM ({raw_metrics(by, source)})"


def background(fit: str, n: int = 100, seed: int = 42) -> str:
    """bg: mean of each feature over the rows that come first by hash."""
    u = uniform("entity_id", MONTH_NO, str(seed))
    return (
        f"bs AS MATERIALIZED (SELECT entity_id, month FROM feat WHERE {fit} ORDER BY {u}, entity_id, month LIMIT {n}),\n"
        "bg AS (SELECT feature, avg(value) AS mu_bg FROM la JOIN bs USING (entity_id, month) GROUP BY feature)"
    )


def keyed_ridge(p: int, q_: int, alpha: float) -> str:
    """From zr(key, entity_id, month, rk, value) and yr(key, entity_id, month, t, y), the training
    rows of each key: kc(key, t, rk, coef) and ki(key, t, intercept). Columns are lists, the
    normal equations are solved by elimination, one pivot a step."""
    step = "list_transform(range(1, len(a.r) + 1), lambda k: a.r[k] - a.r[a.s + 1] * b.r[k] / b.r[a.s + 1])"
    return f"""ks AS MATERIALIZED (SELECT key, rk, avg(value) AS mu, CASE WHEN stddev_pop(value) <= 1e-6 * sqrt(avg(value * value)) THEN 1 ELSE stddev_pop(value) END AS sd FROM zr GROUP BY key, rk),
kx AS MATERIALIZED (SELECT key, rk, list((value - mu) / sd ORDER BY entity_id, month) AS l FROM zr JOIN ks USING (key, rk) GROUP BY key, rk),
km AS MATERIALIZED (SELECT key, t, avg(y) AS my FROM yr GROUP BY key, t),
ky AS MATERIALIZED (SELECT key, t, list(y - my ORDER BY entity_id, month) AS l FROM yr JOIN km USING (key, t) GROUP BY key, t),
kg AS MATERIALIZED (
  SELECT key, a.rk AS i, b.rk AS j, list_inner_product(a.l, b.l) + CASE WHEN a.rk = b.rk THEN {d(alpha)} ELSE 0 END AS v FROM kx a JOIN kx b USING (key)
  UNION ALL SELECT key, a.rk, {p} + t, list_inner_product(a.l, b.l) FROM kx a JOIN ky b USING (key)),
ke(key, s, i, r) AS (
  SELECT key, 0, i, list(v ORDER BY j) FROM kg GROUP BY key, i
  UNION ALL SELECT a.key, a.s + 1, a.i, CASE WHEN a.i = a.s + 1 THEN list_transform(a.r, lambda v: v / a.r[a.s + 1]) ELSE {step} END
  FROM ke a JOIN ke b ON b.key = a.key AND b.i = a.s + 1 WHERE a.s < {p}),
kw AS MATERIALIZED (SELECT key, i AS rk, t, r[{p} + t] AS w FROM (SELECT *, unnest(range(1, {q_ + 1})) AS t FROM ke WHERE s = {p})),
kc AS MATERIALIZED (SELECT key, t, rk, w / sd AS coef FROM kw JOIN ks USING (key, rk)),
ki AS MATERIALIZED (SELECT key, t, any_value(my) - sum(mu * coef) AS intercept FROM kc JOIN ks USING (key, rk) JOIN km USING (key, t) GROUP BY key, t)"""


def walk_forward(features: list[str], targets: list[str], alpha: float = 5.0) -> str:
    """wf(fold, entity_id, month, target, actual, predicted): 36 months of training, 3 of test."""
    ranks = ", ".join(f"('{c}', {i})" for i, c in enumerate(features, 1))
    return f"""{long_rows(features, targets)},
mi AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS pos FROM (SELECT DISTINCT month FROM feat)),
fo AS (SELECT row_number() OVER (ORDER BY s) AS key, s FROM (SELECT unnest(range(0, (SELECT count(*) FROM mi) - 39, 3)) AS s)),
lr AS MATERIALIZED (SELECT entity_id, month, pos, rk, value FROM la JOIN (VALUES {ranks}) n(feature, rk) USING (feature) JOIN mi USING (month)),
zr AS MATERIALIZED (SELECT key, entity_id, month, rk, value FROM lr JOIN fo ON pos BETWEEN s AND s + 35),
yr AS MATERIALIZED (SELECT key, entity_id, month, t, actual AS y FROM ya JOIN mi USING (month) JOIN fo ON pos BETWEEN s AND s + 35),
{keyed_ridge(len(features), len(targets), alpha)},
wf AS MATERIALIZED (
  SELECT key AS fold, entity_id, month, target, any_value(actual) AS actual, sum(value * coef) + any_value(intercept) AS predicted
  FROM lr JOIN fo ON pos BETWEEN s + 36 AND s + 38 JOIN kc USING (key, rk) JOIN ki USING (key, t) JOIN ya USING (entity_id, month, t) GROUP BY key, entity_id, month, target)"""


OVERALL = """wo AS (SELECT fold, count(*) AS n, sqrt(avg((actual - predicted) * (actual - predicted))) AS overall_rmse,
  1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS overall_r2 FROM wf GROUP BY fold),
wr AS (SELECT *, row_number() OVER (ORDER BY fold) <= floor(count(*) OVER () / 2) AS first FROM wo),
ws AS (SELECT avg(overall_r2) AS avg_r2, stddev_samp(overall_r2) AS r2_std, avg(overall_rmse) AS avg_rmse, stddev_samp(overall_rmse) AS rmse_std,
  avg(overall_r2) FILTER (first) - avg(overall_r2) FILTER (NOT first) AS r2_degradation, avg(overall_rmse) FILTER (NOT first) - avg(overall_rmse) FILTER (first) AS rmse_degradation FROM wr)"""


def recursive(sql: str) -> str:
    """``sql`` allowed to hold a recursive table."""
    return re.sub(r"^\s*WITH\b(?!\s+RECURSIVE)", "WITH RECURSIVE", sql, count=1)


def cross_validated(selected: str, k: int, targets: list[str], folds: str, fit: str, alpha: float = 5.0) -> str:
    """cv(fold, n_val, r2, rmse): ``selected`` is a table (feature, rk), ``folds`` one of the
    fitted rows (entity_id, month, fold); scores are over all targets together."""
    return f"""{folds},
lr AS MATERIALIZED (SELECT entity_id, month, fold, rk, value FROM la JOIN {selected} USING (feature) JOIN fd USING (entity_id, month)),
yf AS MATERIALIZED (SELECT entity_id, month, fold, t, actual FROM ya JOIN fd USING (entity_id, month)),
fk AS (SELECT DISTINCT fold AS key FROM fd),
zr AS MATERIALIZED (SELECT key, entity_id, month, rk, value FROM lr JOIN fk ON key <> fold),
yr AS MATERIALIZED (SELECT key, entity_id, month, t, actual AS y FROM yf JOIN fk ON key <> fold),
{keyed_ridge(k, len(targets), alpha)},
cp AS (SELECT fold, entity_id, month, t, sum(value * coef) AS s FROM lr JOIN kc ON kc.key = lr.fold AND kc.rk = lr.rk GROUP BY fold, entity_id, month, t),
cv AS (
  SELECT fold, count(DISTINCT (entity_id, month)) AS n_val, 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) AS r2,
         sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse
  FROM (SELECT cp.fold, cp.entity_id, cp.month, cp.t, actual, s + intercept AS predicted FROM cp JOIN ki ON ki.key = cp.fold AND ki.t = cp.t
        JOIN yf ON yf.entity_id = cp.entity_id AND yf.month = cp.month AND yf.t = cp.t) GROUP BY fold)"""


def row_folds(fit: str, n: int = 5, seed: int = 42) -> str:
    return f"fd AS MATERIALIZED (SELECT entity_id, month, CAST(floor({uniform('entity_id', MONTH_NO, str(seed))} * {n}) AS INTEGER) AS fold FROM feat WHERE {fit})"


def entity_folds(fit: str, n: int = 5) -> str:
    return (
        f"fe AS (SELECT entity_id, row_number() OVER (ORDER BY count(*) DESC, entity_id) - 1 AS place FROM feat WHERE {fit} GROUP BY entity_id),\n"
        f"fd AS MATERIALIZED (SELECT entity_id, month, CAST(CASE WHEN (place // {n}) % 2 = 0 THEN place % {n} ELSE {n - 1} - place % {n} END AS INTEGER) AS fold FROM feat JOIN fe USING (entity_id) WHERE {fit})"
    )


def sql(body: str, ctes: str) -> str:
    return recursive(with_features(body, extra_ctes=ctes))
