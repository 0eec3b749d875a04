"""Scans, projections, scalar features and window features (#1-#58)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import round2
from ..operators import features as FE
from ..operators import history as H
from .catalog import register
from .common import feature_frame as features, panel, raw
from .oracle_features import ENGINEERED_COLUMNS, FEATURE_COLUMNS, q, select_cols, with_features
from .oracle_panel import r2, with_panel

K = ["entity_id", "month"]


def _feat_nodrop(spark, sf):
    return features(spark, sf, drop=False, split=False)


def _fsql(cols, where: str = "") -> str:
    return with_features(f"SELECT entity_id, month, {select_cols(cols)} FROM f2 {where}", drop=False, split=False)


# ---------------------------------------------------------------- scans / sinks


@register(
    "scan_panel",
    with_panel(
        """SELECT count(*) AS n_rows, CAST(count(DISTINCT entity_id) AS BIGINT) AS n_entities,
                  min(month) AS first_month, max(month) AS last_month FROM panel"""
    ),
)
def q_scan_panel(spark, sf):
    return panel(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("entity_id").alias("n_entities"),
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
    )


@register(
    "panel_without_open_month",
    with_panel("SELECT entity_id, month, total_revenue, total_members, retention_rate, staff_count FROM panel", drop_open_month=True),
)
def q_panel_without_open_month(spark, sf):
    return panel(spark, sf, drop_open_month=True).select("entity_id", "month", "total_revenue", "total_members", "retention_rate", "staff_count")


@register("entity_month_panel", with_panel("SELECT * FROM panel"))
def q_entity_month_panel(spark, sf):
    return panel(spark, sf)


@register(
    "parse_month",
    with_panel(
        """SELECT entity_id, strftime(month, '%Y-%m') AS month_year,
                  CAST(strptime(strftime(month, '%Y-%m'), '%Y-%m') AS DATE) AS month FROM panel"""
    ),
)
def q_parse_month(spark, sf):
    p = panel(spark, sf).select("entity_id", F.date_format("month", "yyyy-MM").alias("month_year"))
    return p.select("entity_id", "month_year", F.to_date("month_year", "yyyy-MM").alias("month"))


# ---------------------------------------------------------------- filters / projections


@register(
    "filter_split",
    with_features("SELECT entity_id, month, split FROM feat WHERE split IN ('train', 'validation')"),
)
def q_filter_split(spark, sf):
    return features(spark, sf).where(F.col("split").isin("train", "validation")).select("entity_id", "month", "split")


@register(
    "filter_entity",
    with_panel(
        """SELECT entity_id, month, total_revenue FROM panel
           WHERE entity_id IN (SELECT entity_id FROM panel WHERE studio_location = 'urban')"""
    ),
)
def q_filter_entity(spark, sf):
    p = panel(spark, sf)
    wanted = p.where(F.col("studio_location") == "urban").select("entity_id").distinct()
    return p.join(wanted, "entity_id", "left_semi").select("entity_id", "month", "total_revenue")


@register(
    "filter_month_range",
    with_panel(
        "SELECT entity_id, month, total_revenue FROM panel WHERE month BETWEEN DATE '1996-01-01' AND DATE '1998-12-01'"
    ),
)
def q_filter_month_range(spark, sf):
    return (
        panel(spark, sf)
        .where(F.col("month").between(F.lit("1996-01-01").cast("date"), F.lit("1998-12-01").cast("date")))
        .select("entity_id", "month", "total_revenue")
    )


_FEATS = [c for c in ENGINEERED_COLUMNS if c not in (
    "entity_id", "month", "split", "studio_location", "studio_size_tier", "studio_price_tier",
    "revenue_month_1", "revenue_month_2", "revenue_month_3", "member_count_month_3", "retention_rate_month_3")]


@register("project_exclude", with_features(f"SELECT entity_id, month, {select_cols(_FEATS)} FROM feat"))
def q_project_exclude(spark, sf):
    f = features(spark, sf)
    return f.select("entity_id", "month", *FE.feature_columns(f))


@register(
    "project_numeric",
    with_features(
        "SELECT count(*) AS n_rows, CAST(" + str(len(_FEATS)) + " AS BIGINT) AS n_numeric_features FROM feat"
    ),
)
def q_project_numeric(spark, sf):
    f = features(spark, sf)
    cols = FE.feature_columns(f, numeric_only=True)
    return f.select(*cols).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(cols)).cast("bigint").alias("n_numeric_features"))


@register(
    "drop_incomplete",
    with_features(
        "SELECT (SELECT count(*) FROM f2) AS rows_before, count(*) AS rows_after, "
        "(SELECT count(*) FROM f2) - count(*) AS rows_removed FROM f3",
        split=False,
    ),
)
def q_drop_incomplete(spark, sf):
    before = _feat_nodrop(spark, sf)
    after = FE.drop_incomplete(before)
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return b.crossJoin(a).select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed")
    )


@register(
    "drop_tail_targets",
    with_panel(
        """SELECT entity_id, month, total_revenue FROM (
             SELECT *, lead(total_revenue, 3) OVER (PARTITION BY entity_id ORDER BY month) AS nxt FROM panel)
           WHERE nxt IS NOT NULL"""
    ),
)
def q_drop_tail_targets(spark, sf):
    return FE.drop_tail_targets(panel(spark, sf)).select("entity_id", "month", "total_revenue")


# ---------------------------------------------------------------- scalar features


def _feature_query(name, cols):
    @register(name, _fsql(cols))
    def _q(spark, sf):
        return _feat_nodrop(spark, sf).select(*K, *cols)

    _q.__name__ = f"q_{name}"
    return _q


_feature_query("onehot_tiers", ["location_urban", "size_small", "size_medium", "size_large", "price_low", "price_medium", "price_high"])
_feature_query("missing_column_fallback", ["staff_util_x_members"])
_feature_query("revenue_per_member", ["revenue_per_member"])
_feature_query("churn_rate", ["churn_rate"])
_feature_query("class_utilization", ["class_utilization"])
_feature_query("staff_per_member", ["staff_per_member"])
_feature_query("estimated_ltv", ["estimated_ltv"])
_feature_query("revenue_mix", ["membership_revenue_pct", "class_pack_revenue_pct"])
_feature_query("interactions", ["retention_x_ticket", "attendance_x_classes", "upsell_x_members", "staff_util_x_members"])
_feature_query("month_index", ["month_index"])
_feature_query("cyclical", ["month_sin", "month_cos"])
_feature_query("season_flags", ["is_january", "is_summer", "is_fall"])
_feature_query("studio_age", ["studio_age"])
_feature_query("lag_1", ["prev_month_revenue", "prev_month_members"])
_feature_query("mom_growth", ["mom_revenue_growth", "mom_member_growth"])
_feature_query("rolling_mean_3", ["3m_avg_retention", "3m_avg_revenue", "3m_avg_attendance"])
_feature_query("rolling_std_3", ["3m_std_revenue"])
_feature_query("ewm_span3", ["revenue_momentum"])
_feature_query(
    "lead_targets",
    ["revenue_month_1", "revenue_month_2", "revenue_month_3", "member_count_month_3", "retention_rate_month_3"],
)


@register("engineer_features", with_features(f"SELECT {select_cols(ENGINEERED_COLUMNS + ['split'])} FROM feat"))
def q_engineer_features(spark, sf):
    return features(spark, sf)


# ---------------------------------------------------------------- classification (#21)

_CATEGORY_PATTERNS = {
    # fixed name patterns of the feature summary
    "studio": ("studio_", "location_", "size_", "price_"),
    "temporal": ("prev_", "mom_", "3m_", "momentum"),
    "derived": ("_per_", "_rate", "_pct", "ltv", "utilization"),
    "interaction": ("_x_",),
    "cyclical": ("_sin", "_cos", "is_"),
}


def _classify(names):
    out = []
    for n in names:
        hit = False
        for cat, pats in _CATEGORY_PATTERNS.items():
            if any(p in n for p in pats):
                out.append((cat, n))
                hit = True
        if not hit:
            out.append(("base", n))
    return out


def _classify_sql():
    pairs = _classify(_FEATS)
    mins = ", ".join(f"CAST(min({q(n)}) AS DOUBLE) AS {q('mn_' + n)}, CAST(max({q(n)}) AS DOUBLE) AS {q('mx_' + n)}" for n in _FEATS)
    unions = "\nUNION ALL ".join(
        f"SELECT '{cat}' AS category, '{n}' AS feature, {q('mn_' + n)} AS min_value, {q('mx_' + n)} AS max_value FROM mm"
        for cat, n in pairs
    )
    return with_features(f"SELECT * FROM ({unions})", extra_ctes=f"mm AS (SELECT {mins} FROM feat)")


@register("classify_features", _classify_sql())
def q_classify_features(spark, sf):
    f = features(spark, sf)
    names = FE.feature_columns(f)
    pairs = _classify(names)
    aggs = []
    for n in names:
        aggs += [F.min(n).cast("double").alias(f"mn_{n}"), F.max(n).cast("double").alias(f"mx_{n}")]
    mm = f.agg(*aggs)  # one pass over the panel for every column
    stack = ", ".join(f"'{c}', '{n}', `mn_{n}`, `mx_{n}`" for c, n in pairs)
    return mm.selectExpr(f"stack({len(pairs)}, {stack}) AS (category, feature, min_value, max_value)")


# ---------------------------------------------------------------- splits / history windows


@register("temporal_split_entity", with_features("SELECT entity_id, month, split FROM feat"))
def q_temporal_split_entity(spark, sf):
    return features(spark, sf).select("entity_id", "month", "split")


@register(
    "temporal_split_global",
    with_panel(
        """SELECT entity_id, month, split FROM panel JOIN (
             SELECT month,
                    CASE WHEN rn < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
                         WHEN rn < floor(n * (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))) THEN 'validation'
                         ELSE 'test' END AS split
             FROM (SELECT month, row_number() OVER (ORDER BY month) - 1 AS rn,
                          CAST(count(*) OVER () AS DOUBLE) AS n
                   FROM (SELECT DISTINCT month FROM panel))) USING (month)"""
    ),
)
def q_temporal_split_global(spark, sf):
    return FE.temporal_split_global(panel(spark, sf)).select("entity_id", "month", "split")


@register(
    "last_n_per_entity",
    with_panel(
        """SELECT entity_id, month, total_revenue FROM (
             SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY month DESC) AS rn FROM panel)
           WHERE rn <= 12"""
    ),
)
def q_last_n_per_entity(spark, sf):
    return H.last_n_per_entity(panel(spark, sf), 12).select("entity_id", "month", "total_revenue")


@register(
    "latest_value",
    with_panel(
        """SELECT entity_id, max_by(total_revenue, month) AS latest_revenue,
                  max_by(total_members, month) AS latest_members FROM panel GROUP BY entity_id"""
    ),
)
def q_latest_value(spark, sf):
    return H.latest_value(panel(spark, sf))


@register(
    "tail3_stats",
    with_panel(
        f"""SELECT entity_id,
                   avg(CASE WHEN rk <= 3 THEN retention_rate END) AS tail3_avg_retention,
                   avg(CASE WHEN rk <= 3 THEN total_revenue END) AS tail3_avg_revenue,
                   avg(CASE WHEN rk <= 3 THEN class_attendance_rate END) AS tail3_avg_attendance,
                   {r2('stddev_samp(CASE WHEN rk <= 3 THEN total_revenue END)')} AS tail3_std_revenue,
                   {r2('sum(power(0.5, rk - 1) * total_revenue) / sum(power(0.5, rk - 1))')} AS ewm_revenue
            FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY month DESC) AS rk FROM panel)
            WHERE rk <= 12 GROUP BY entity_id"""
    ),
)
def q_tail3_stats(spark, sf):
    return H.tail3_stats(panel(spark, sf))
