"""Quality, validation and leakage checks (#59-#92, #178)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import leakage as L
from ..operators import quality as Q
from ..spec import EXPECTED_POSITIVE_CORR, VALIDATION_RANGES
from ..session import read_table
from .catalog import register
from .common import features, materialize, panel, raw
from .oracle_features import ENGINEERED_COLUMNS, PANEL_COLUMNS, q, with_features
from .oracle_panel import r2, with_panel

STRINGS = {"month", "studio_location", "studio_size_tier", "studio_price_tier", "split"}
TARGETS = ["revenue_month_1", "revenue_month_2", "revenue_month_3", "member_count_month_3", "retention_rate_month_3"]
PANEL_NUM = [c for c in PANEL_COLUMNS if c not in STRINGS]
FEAT_NUM = [c for c in ENGINEERED_COLUMNS if c not in STRINGS]
# double-typed columns of the raw panel
PANEL_DOUBLE = [
    "retention_rate", "avg_ticket_price", "total_revenue", "membership_revenue", "class_pack_revenue",
    "retail_revenue", "addon_revenue", "class_attendance_rate", "avg_classes_per_member", "upsell_rate",
] + [c for c in PANEL_COLUMNS if c.endswith("_revenue") and c not in (
    "total_revenue", "membership_revenue", "class_pack_revenue", "retail_revenue", "addon_revenue")]


def union(rows: list[str]) -> str:
    return "\nUNION ALL ".join(rows)


def corr_sql(a: str, b: str) -> str:
    """Pearson on pairwise-complete rows, NULL for a constant side."""
    both = f"{q(a)} IS NOT NULL AND {q(b)} IS NOT NULL"
    xa = f"CASE WHEN {both} THEN CAST({q(a)} AS DOUBLE) END"
    xb = f"CASE WHEN {both} THEN CAST({q(b)} AS DOUBLE) END"
    return f"(covar_samp({xa}, {xb}) / NULLIF(stddev_samp({xa}) * stddev_samp({xb}), 0))"


# ---------------------------------------------------------------- profile / counts


def _profile_sql():
    cols = ["total_revenue", "total_members", "retention_rate"]
    aggs = ", ".join(
        f"CAST(min({c}) AS DOUBLE) AS min_{c}, CAST(max({c}) AS DOUBLE) AS max_{c}, {r2(f'avg({c})', 4)} AS mean_{c}, "
        f"{r2(f'quantile_cont({c}, 0.5)', 4)} AS median_{c}, {r2(f'stddev_samp({c})', 4)} AS std_{c}"
        for c in cols
    )
    body = union(
        [f"SELECT '{c}' AS \"column\", min_{c} AS min_value, max_{c} AS max_value, mean_{c} AS mean_value, "
         f"median_{c} AS median_value, std_{c} AS std_value FROM one" for c in cols]
    )
    return with_panel(body, extra_ctes=f"one AS (SELECT {aggs} FROM panel)")


@register("profile_numeric", _profile_sql())
def q_profile_numeric(spark, sf):
    return Q.profile_numeric(raw(spark, sf))


def _null_sql(src_ctes, cols, src):
    aggs = ", ".join(f"count(*) FILTER (WHERE {q(c)} IS NULL) AS nul_{i}" for i, c in enumerate(cols))
    body = union(
        [f"SELECT '{c}' AS \"column\", nul_{i} AS null_count, {r2(f'nul_{i} * 100.0 / n', 2)} AS null_pct FROM one WHERE nul_{i} > 0"
         for i, c in enumerate(cols)]
    )
    return src_ctes(body, extra_ctes=f"one AS (SELECT count(*) AS n, {aggs} FROM {src})")


@register("null_counts", _null_sql(with_panel, PANEL_COLUMNS, "panel"))
def q_null_counts(spark, sf):
    return Q.null_counts(raw(spark, sf))


def _inf_sql():
    aggs = ", ".join(f"count(*) FILTER (WHERE abs({c}) = CAST('inf' AS DOUBLE)) AS inf_{i}" for i, c in enumerate(PANEL_DOUBLE))
    body = union([f"SELECT '{c}' AS \"column\", inf_{i} AS inf_count FROM one" for i, c in enumerate(PANEL_DOUBLE)])
    return with_panel(body, extra_ctes=f"one AS (SELECT {aggs} FROM panel)")


@register("inf_counts", _inf_sql())
def q_inf_counts(spark, sf):
    return Q.inf_counts(raw(spark, sf))


def _zero_var_sql():
    cols = FEAT_NUM
    aggs = ", ".join(
        f"stddev_samp({q(c)}) AS sd_{i}, CAST(min({q(c)}) AS DOUBLE) AS mn_{i}, CAST(max({q(c)}) AS DOUBLE) AS mx_{i}"
        for i, c in enumerate(cols)
    )
    body = union(
        [f"SELECT '{c}' AS \"column\", mn_{i} AS min_value, mx_{i} AS max_value FROM one WHERE sd_{i} = 0 OR mn_{i} = mx_{i}"
         for i, c in enumerate(cols)]
    )
    return with_features(body, extra_ctes=f"one AS (SELECT {aggs} FROM feat)")


@register("zero_variance", _zero_var_sql())
def q_zero_variance(spark, sf):
    f = features(spark, sf)
    return Q.zero_variance(f, Q.numeric_columns(f))


def _neg_sql():
    cols = list(Q.NON_NEGATIVE)
    aggs = ", ".join(f"count(*) FILTER (WHERE {c} < 0) AS neg_{i}" for i, c in enumerate(cols))
    body = union([f"SELECT '{c}' AS \"column\", neg_{i} AS negative_count FROM one" for i, c in enumerate(cols)])
    return with_panel(body, extra_ctes=f"one AS (SELECT {aggs} FROM panel)")


@register("negative_values", _neg_sql())
def q_negative_values(spark, sf):
    return Q.negative_values(raw(spark, sf))


def _range_sql():
    present = [(c, lo, hi) for c, (lo, hi) in VALIDATION_RANGES.items() if c in PANEL_COLUMNS]
    aggs = ", ".join(
        f"count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS bad_{i}, CAST(min({c}) AS DOUBLE) AS mn_{i}, CAST(max({c}) AS DOUBLE) AS mx_{i}"
        for i, (c, lo, hi) in enumerate(present)
    )
    body = union(
        [f"SELECT '{c}' AS metric, CAST({float(lo)} AS DOUBLE) AS rule_min, CAST({float(hi)} AS DOUBLE) AS rule_max, "
         f"bad_{i} AS violations, mn_{i} AS actual_min, mx_{i} AS actual_max FROM one"
         for i, (c, lo, hi) in enumerate(present)]
    )
    return with_panel(body, extra_ctes=f"one AS (SELECT {aggs} FROM panel)")


@register("range_violations", _range_sql())
def q_range_violations(spark, sf):
    return Q.range_violations(raw(spark, sf))


@register(
    "revenue_consistency",
    with_panel(
        f"""SELECT count(*) FILTER (WHERE d > 1000.0) AS inconsistent_rows, {r2('max(d)')} AS max_diff
            FROM (SELECT abs(total_revenue - (membership_revenue + class_pack_revenue + retail_revenue)) AS d FROM panel)"""
    ),
)
def q_revenue_consistency(spark, sf):
    return Q.revenue_consistency(raw(spark, sf))


def _iqr_sql():
    cols = [c for c in PANEL_NUM if c != "entity_id"]
    qs = ", ".join(
        f"quantile_cont({c}, 0.25) AS q1_{i}, quantile_cont({c}, 0.75) AS q3_{i}" for i, c in enumerate(cols)
    )
    bounds = ", ".join(
        f"q1_{i} - 3.0 * (q3_{i} - q1_{i}) AS lo_{i}, q3_{i} + 3.0 * (q3_{i} - q1_{i}) AS hi_{i}" for i in range(len(cols))
    )
    cnts = ", ".join(
        f"count(*) FILTER (WHERE {c} < lo_{i} OR {c} > hi_{i}) AS out_{i}, any_value(lo_{i}) AS lo_{i}, any_value(hi_{i}) AS hi_{i}"
        for i, c in enumerate(cols)
    )
    body = union(
        [f"SELECT '{c}' AS \"column\", out_{i} AS outliers, {r2(f'lo_{i}', 4)} AS lower_bound, {r2(f'hi_{i}', 4)} AS upper_bound, "
         f"{r2(f'out_{i} * 100.0 / n', 2)} AS outlier_pct, out_{i} * 100.0 / n > 2.0 AS warn FROM one"
         for i, c in enumerate(cols)]
    )
    extra = f"""qs AS (SELECT {qs} FROM panel),
bnd AS (SELECT {bounds} FROM qs),
one AS (SELECT count(*) AS n, {cnts} FROM panel CROSS JOIN bnd)"""
    return with_panel(body, extra_ctes=extra)


@register("iqr_outliers", _iqr_sql())
def q_iqr_outliers(spark, sf):
    r = raw(spark, sf)
    return Q.iqr_outliers(r, [c for c in Q.numeric_columns(r) if c != "entity_id"])


@register(
    "split_counts",
    with_features(
        f"SELECT split, count(*) AS \"rows\", {r2('count(*) * 100.0 / sum(count(*)) OVER ()', 2)} AS pct FROM feat GROUP BY split"
    ),
)
def q_split_counts(spark, sf):
    return Q.split_counts(features(spark, sf))


@register(
    "split_counts_by_entity",
    with_features(
        """SELECT entity_id, count(*) FILTER (WHERE split = 'train') AS train,
                  count(*) FILTER (WHERE split = 'validation') AS validation,
                  count(*) FILTER (WHERE split = 'test') AS test FROM feat GROUP BY entity_id"""
    ),
)
def q_split_counts_by_entity(spark, sf):
    return Q.split_counts_by_entity(features(spark, sf))


@register(
    "entity_distribution",
    with_panel(
        "SELECT studio_location, studio_size_tier, count(DISTINCT entity_id) AS n_entities FROM panel GROUP BY ALL"
    ),
)
def q_entity_distribution(spark, sf):
    return Q.entity_distribution(panel(spark, sf))


_LAST12 = "(SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY month DESC) AS rk FROM panel) WHERE rk <= 12"


@register(
    "entity_summary",
    with_panel(
        f"""SELECT entity_id, count(*) AS months_of_data, avg(total_revenue) AS avg_revenue,
                   avg(total_members) AS avg_members, avg(retention_rate) AS avg_retention,
                   max_by(total_revenue, month) AS latest_revenue, max_by(total_members, month) AS latest_members
            FROM {_LAST12} GROUP BY entity_id"""
    ),
)
def q_entity_summary(spark, sf):
    return H.entity_summary(raw(spark, sf))


@register(
    "list_entities",
    with_panel(
        f"""SELECT entity_id, (SELECT count(DISTINCT entity_id) FROM panel) AS total_entities,
                   count(*) AS months_of_data, avg(total_revenue) AS avg_revenue
            FROM {_LAST12} GROUP BY entity_id ORDER BY entity_id LIMIT 20"""
    ),
)
def q_list_entities(spark, sf):
    p = raw(spark, sf)
    total = p.agg(F.countDistinct("entity_id").alias("total_entities"))
    s = H.entity_summary(p).select("entity_id", "months_of_data", "avg_revenue")
    # a fixed-size listing is the feature (first 20 entities by id)
    return s.orderBy("entity_id").limit(20).crossJoin(F.broadcast(total))


@register(
    "mean_revenue",
    with_panel(f"SELECT entity_id, avg(total_revenue) AS mean_revenue FROM {_LAST12} GROUP BY entity_id"),
)
def q_mean_revenue(spark, sf):
    return H.entity_summary(raw(spark, sf)).select("entity_id", F.col("avg_revenue").alias("mean_revenue"))


def _corr_pairs_sql():
    aggs = ", ".join(f"{r2(corr_sql(a, b), 4)} AS c_{i}" for i, (a, b) in enumerate(EXPECTED_POSITIVE_CORR))
    body = union(
        [f"SELECT '{a}' AS column_a, '{b}' AS column_b, c_{i} AS corr, c_{i} < 0.3 AS warn FROM one"
         for i, (a, b) in enumerate(EXPECTED_POSITIVE_CORR)]
    )
    return with_panel(body, extra_ctes=f"one AS (SELECT {aggs} FROM panel)")


@register("corr_pairs", _corr_pairs_sql())
def q_corr_pairs(spark, sf):
    return Q.corr_pairs(raw(spark, sf))


# ---------------------------------------------------------------- temporal checks

_WIN = "OVER (PARTITION BY entity_id ORDER BY month)"


@register(
    "member_flow_check",
    with_panel(
        f"""SELECT count(d) AS checked_rows, count(*) FILTER (WHERE d > 5.0) AS inconsistent_rows FROM (
              SELECT abs((total_members - lag(total_members) {_WIN}) - (new_members - churned_members)) AS d FROM panel)"""
    ),
)
def q_member_flow_check(spark, sf):
    return Q.member_flow_check(raw(spark, sf))


@register(
    "retention_flow_check",
    with_panel(
        f"""SELECT count(d) AS checked_rows, count(*) FILTER (WHERE d > e * 0.1) AS inconsistent_rows FROM (
              SELECT lag(total_members) {_WIN} * (1 - retention_rate) AS e,
                     abs(churned_members - lag(total_members) {_WIN} * (1 - retention_rate)) AS d FROM panel)"""
    ),
)
def q_retention_flow_check(spark, sf):
    return Q.retention_flow_check(raw(spark, sf))


@register(
    "monotonic_dates",
    """WITH im AS (SELECT c_nationkey AS entity_id, date_trunc('month', o_orderdate) AS month, min(o_orderkey) AS first_key FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT count(*) FILTER (WHERE b) AS out_of_order_rows FROM (SELECT month < lag(month) OVER (PARTITION BY entity_id ORDER BY first_key) AS b FROM im)""",
)
def q_monotonic_dates(spark, sf):
    """Months that come after a later one when the entity's months are taken in the order of
    their first order key, which is the order in which they were written."""
    o, c = read_table(spark, sf, "orders"), read_table(spark, sf, "customer")
    m = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("entity_id"), F.trunc("o_orderdate", "month").alias("month"))
    return Q.monotonic_dates(m.agg(F.min("o_orderkey").alias("first_key")), sequence="first_key")


@register(
    "date_gaps",
    with_panel(
        f"""SELECT count(d) AS checked_rows, count(*) FILTER (WHERE d < 25 OR d > 35) AS gap_rows FROM (
              SELECT datediff('day', lag(month) {_WIN}, month) AS d FROM panel)"""
    ),
)
def q_date_gaps(spark, sf):
    return Q.date_gaps(raw(spark, sf))


def _verdict_sql() -> str:
    cols = [c for c in PANEL_NUM if c != "entity_id"]
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{i}, quantile_cont({c}, 0.75) AS q3_{i}" for i, c in enumerate(cols))
    outs = ", ".join(f"count(*) FILTER (WHERE {c} < q1_{i} - 3.0 * (q3_{i} - q1_{i}) OR {c} > q3_{i} + 3.0 * (q3_{i} - q1_{i})) * 100.0 / count(*) > 2.0 AS w{i}" for i, c in enumerate(cols))
    pairs = (("total_members", "total_revenue"), ("avg_ticket_price", "total_revenue"), ("retention_rate", "total_revenue"), ("total_classes_held", "total_revenue"))
    low = " + ".join(f"CAST(coalesce({r2(corr_sql(a, b), 4)} < 0.3, false) AS BIGINT)" for a, b in pairs)
    checks = [
        # month_index, year_index and staff_utilization_rate are not in this panel
        ("schema", "3", "0"),
        ("missing_values", "(SELECT " + " + ".join(f"CAST(count(*) > count({c}) AS BIGINT)" for c in PANEL_COLUMNS) + " FROM panel)", "0"),
        ("data_types", "0", "0"),
        ("value_ranges", "(SELECT sum(v) FROM ranges)", "0"),
        ("business_logic", "(SELECT count(*) FROM panel WHERE abs(total_revenue - (membership_revenue + class_pack_revenue + retail_revenue)) > 1000.0)"
         f" + (SELECT count(*) FROM (SELECT abs((total_members - lag(total_members) {_WIN}) - (new_members - churned_members)) AS d FROM panel) WHERE d > 5.0)"
         f" + (SELECT count(*) FROM (SELECT lag(total_members) {_WIN} * (1 - retention_rate) AS e, abs(churned_members - lag(total_members) {_WIN} * (1 - retention_rate)) AS d FROM panel) WHERE d > e * 0.1)", "0"),
        ("temporal_consistency", f"(SELECT count(*) FROM (SELECT datediff('day', lag(month) {_WIN}, month) AS d FROM panel) WHERE d < 25 OR d > 35)", "0"),
        ("statistical_outliers", "0", "(SELECT " + " + ".join(f"CAST(w{i} AS BIGINT)" for i in range(len(cols))) + " FROM ow)"),
        ("correlations", "0", f"(SELECT {low} FROM panel)"),
    ]
    rows = union([f"SELECT '{n}' AS \"check\", CAST({i} AS BIGINT) AS issues, CAST({w} AS BIGINT) AS warnings" for n, i, w in checks])
    ranges = union([f"SELECT count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS v FROM panel" for c, (lo, hi) in VALIDATION_RANGES.items() if c in PANEL_COLUMNS])
    extra = f"ranges AS ({ranges}),\nqs AS (SELECT {qs} FROM panel),\now AS (SELECT {outs} FROM panel CROSS JOIN qs)"
    return with_panel(f'SELECT "check", issues = 0 AS passed, issues, warnings FROM ({rows})', extra_ctes=extra)


@register("quality_verdict", _verdict_sql())
def q_quality_verdict(spark, sf):
    return Q.quality_verdict(materialize(raw(spark, sf)))


# ---------------------------------------------------------------- leakage checks

_FEAT_NUM_NO_ENT = [c for c in FEAT_NUM if c != "entity_id"]


def _jump_sql():
    cols = [c for c in _FEAT_NUM_NO_ENT if "month_" not in c]
    diffs = ", ".join(f"CAST(abs({q(c)} - lag({q(c)}) {_WIN}) AS DOUBLE) AS d{i}" for i, c in enumerate(cols))
    stats = ", ".join(f"avg(d{i}) AS m{i}, stddev_samp(d{i}) AS s{i}" for i in range(len(cols)))
    cnts = ", ".join(
        f"count(*) FILTER (WHERE s{i} > 0 AND (d{i} - m{i}) / s{i} > 3.0) AS o{i}, max(d{i}) AS x{i}" for i in range(len(cols))
    )
    body = union(
        [f"SELECT '{c}' AS feature, o{i} AS outlier_count, x{i} AS max_jump FROM one WHERE o{i} > 0" for i, c in enumerate(cols)]
    )
    extra = f"""dd AS (SELECT {diffs} FROM feat),
st AS (SELECT {stats} FROM dd),
one AS (SELECT {cnts} FROM dd CROSS JOIN st)"""
    return with_features(body, extra_ctes=extra)


@register("jump_outliers", _jump_sql())
def q_jump_outliers(spark, sf):
    return L.jump_outliers(features(spark, sf))


def _lag_match_sql():
    pairs = list(L.LAG_PAIRS)
    hits = ", ".join(
        f"count(*) FILTER (WHERE abs(lag({q(b)}) {_WIN} - {q(a)}) < 0.01) AS h{i}" for i, (a, b) in enumerate(pairs)
    )
    # window inside FILTER is not allowed: compute the lagged values first
    lags = ", ".join(f"abs(lag({q(b)}) {_WIN} - {q(a)}) < 0.01 AS hit{i}" for i, (a, b) in enumerate(pairs))
    hits = ", ".join(f"count(*) FILTER (WHERE hit{i}) AS h{i}" for i in range(len(pairs)))
    rate = lambda i: r2(f"h{i} * 1.0 / n", 4)
    body = union(
        [f"SELECT '{a}' AS lag_feature, '{b}' AS base_feature, {rate(i)} AS match_rate, "
         f"CASE WHEN {rate(i)} > 0.95 THEN 'ok' WHEN {rate(i)} < 0.5 THEN 'leak' ELSE 'uncertain' END AS status FROM one"
         for i, (a, b) in enumerate(pairs)]
    )
    extra = f"""m AS (SELECT {lags} FROM feat),
one AS (SELECT count(*) AS n, {hits} FROM m)"""
    return with_features(body, extra_ctes=extra)


@register("lag_match_rate", _lag_match_sql())
def q_lag_match_rate(spark, sf):
    return L.lag_match_rate(features(spark, sf))


def _rolling_match_sql():
    pairs = L.rolling_bases(ENGINEERED_COLUMNS)
    inc = "OVER (PARTITION BY entity_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
    exc = "OVER (PARTITION BY entity_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    m = ", ".join(
        f"abs({q(f)} - avg({q(b)}) {inc}) < 0.01 AS bad{i}, abs({q(f)} - avg({q(b)}) {exc}) < 0.01 AS good{i}, {q(f)} IS NOT NULL AS nn{i}"
        for i, (f, b) in enumerate(pairs)
    )
    cnt = ", ".join(
        f"count(*) FILTER (WHERE bad{i}) AS b{i}, count(*) FILTER (WHERE good{i}) AS g{i}, count(*) FILTER (WHERE nn{i}) AS n{i}"
        for i in range(len(pairs))
    )
    bad = lambda i: r2(f"b{i} * 1.0 / NULLIF(n{i}, 0)", 4)
    good = lambda i: r2(f"g{i} * 1.0 / NULLIF(n{i}, 0)", 4)
    body = union(
        [f"SELECT '{f}' AS feature, '{b}' AS base_feature, {bad(i)} AS includes_current_rate, {good(i)} AS excludes_current_rate, "
         f"CASE WHEN {bad(i)} > {good(i)} AND {bad(i)} > 0.8 THEN 'leak' WHEN {good(i)} > 0.8 THEN 'ok' ELSE 'unverified' END AS status FROM one"
         for i, (f, b) in enumerate(pairs)]
    )
    return with_features(body, extra_ctes=f"m AS (SELECT {m} FROM feat),\none AS (SELECT {cnt} FROM m)")


@register("rolling_match_rate", _rolling_match_sql())
def q_rolling_match_rate(spark, sf):
    return L.rolling_match_rate(features(spark, sf))


def _first_row_sql():
    lagged = [c for c in ENGINEERED_COLUMNS if ("prev_month" in c or "3m_avg" in c or "mom_" in c) and c not in TARGETS]
    n = " + ".join(f"CAST({q(c)} IS NOT NULL AS INTEGER)" for c in lagged)
    return with_features(
        f"SELECT entity_id, {n} AS non_null_lagged FROM (SELECT *, row_number() {_WIN} AS rn FROM feat) WHERE rn = 1"
    )


@register("first_row_history", _first_row_sql())
def q_first_row_history(spark, sf):
    return L.first_row_history(features(spark, sf))


def _corr_targets_sql(threshold: float = 0.95):
    feats = [c for c in _FEAT_NUM_NO_ENT if c not in TARGETS]
    aggs = ", ".join(
        f"{r2(f'abs({corr_sql(f, t)})', 4)} AS c_{i}_{j}" for i, f in enumerate(feats) for j, t in enumerate(TARGETS)
    )
    body = union(
        [f"SELECT '{t}' AS target, '{f}' AS feature, c_{i}_{j} AS abs_corr FROM one WHERE c_{i}_{j} > {threshold}"
         for i, f in enumerate(feats) for j, t in enumerate(TARGETS)]
    )
    return with_features(body, extra_ctes=f"one AS (SELECT {aggs} FROM feat)")


@register("corr_with_targets", _corr_targets_sql())
def q_corr_with_targets(spark, sf):
    return L.corr_with_targets(features(spark, sf).drop("entity_id"))


@register("corr_with_targets_moderate", _corr_targets_sql(0.3))
def q_corr_with_targets_moderate(spark, sf):
    """The same with a threshold that some features pass."""
    return L.corr_with_targets(features(spark, sf).drop("entity_id"), threshold=0.3)


def _lag_corr_sql():
    pairs = list(L.LAG_PAIRS)
    aggs = ", ".join(
        f"{r2(corr_sql(a, b), 4)} AS c{i}, count(*) FILTER (WHERE {q(a)} IS NOT NULL AND {q(b)} IS NOT NULL) AS n{i}"
        for i, (a, b) in enumerate(pairs)
    )
    body = union(
        [f"SELECT '{a}' AS lag_feature, '{b}' AS base_feature, c{i} AS corr, n{i} AS valid_rows, n{i} > 10 AND c{i} > 0.99 AS flagged FROM one"
         for i, (a, b) in enumerate(pairs)]
    )
    return with_features(body, extra_ctes=f"one AS (SELECT {aggs} FROM feat)")


@register("lag_corr_check", _lag_corr_sql())
def q_lag_corr_check(spark, sf):
    return L.lag_corr_check(features(spark, sf))


def _rolling_cv_sql():
    feats = [c for c in ENGINEERED_COLUMNS if "3m_avg" in c or "3m_std" in c]
    aggs = ", ".join(f"var_samp({q(c)}) AS v{i}, avg({q(c)}) AS m{i}" for i, c in enumerate(feats))
    body = union(
        [f"SELECT '{c}' AS feature, {r2(f'v{i}', 4)} AS variance, {r2(f'm{i}', 4)} AS mean, "
         f"{r2(f'CASE WHEN m{i} <> 0 THEN v{i} / (m{i} * m{i}) ELSE 0.0 END', 6)} AS cv FROM one"
         for i, c in enumerate(feats)]
    )
    return with_features(body, extra_ctes=f"one AS (SELECT {aggs} FROM feat)")


@register("rolling_cv", _rolling_cv_sql())
def q_rolling_cv(spark, sf):
    return L.rolling_cv(features(spark, sf))


def _drift_sql():
    cols = [c for c in _FEAT_NUM_NO_ENT if "month_" not in c and "retention_rate_" not in c]
    aggs = ", ".join(
        f"avg({q(c)}) FILTER (WHERE split = 'train') AS a{i}, avg({q(c)}) FILTER (WHERE split = 'test') AS b{i}, "
        f"stddev_samp({q(c)}) FILTER (WHERE split = 'train') AS s{i}, stddev_samp({q(c)}) FILTER (WHERE split = 'test') AS t{i}"
        for i, c in enumerate(cols)
    )
    md = lambda i: f"(abs(a{i} - b{i}) / (a{i} + 1e-10))"
    sd = lambda i: f"(abs(s{i} - t{i}) / (s{i} + 1e-10))"
    body = union(
        [f"SELECT '{c}' AS feature, {r2(md(i) + ' * 100', 2)} AS mean_diff_pct, {r2(sd(i) + ' * 100', 2)} AS std_diff_pct "
         f"FROM one WHERE {md(i)} > 0.5 OR {sd(i)} > 0.5"
         for i, c in enumerate(cols)]
    )
    return with_features(body, extra_ctes=f"one AS (SELECT {aggs} FROM feat)")


@register("train_test_drift", _drift_sql())
def q_train_test_drift(spark, sf):
    return L.train_test_drift(features(spark, sf))
