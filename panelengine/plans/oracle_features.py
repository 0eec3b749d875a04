"""DuckDB SQL for the engineered panel (oracle side)."""

from __future__ import annotations

from ..spec import PRODUCT_NAMES, product_count_column, product_revenue_column
from .oracle_panel import r2, sdiv, with_panel

PANEL_COLUMNS = [
    "entity_id", "month", "total_members", "new_members", "churned_members", "retention_rate",
    "avg_ticket_price", "total_revenue", "membership_revenue", "class_pack_revenue",
    "retail_revenue", "addon_revenue", "total_classes_held", "total_class_attendance",
    "class_attendance_rate", "staff_count", "avg_classes_per_member", "upsell_rate",
    "studio_location", "studio_size_tier", "studio_price_tier",
] + [c for p in PRODUCT_NAMES for c in (product_count_column(p), product_revenue_column(p))]

FEATURE_COLUMNS = [
    "studio_age", "location_urban", "size_small", "size_medium", "size_large", "price_low",
    "price_medium", "price_high", "revenue_per_member", "churn_rate", "class_utilization",
    "staff_per_member", "estimated_ltv", "membership_revenue_pct", "class_pack_revenue_pct",
    "prev_month_revenue", "prev_month_members", "mom_revenue_growth", "mom_member_growth",
    "3m_avg_retention", "3m_avg_revenue", "3m_avg_attendance", "3m_std_revenue",
    "revenue_momentum", "retention_x_ticket", "attendance_x_classes", "upsell_x_members",
    "staff_util_x_members", "month_index", "month_sin", "month_cos", "is_january", "is_summer",
    "is_fall",
]
TARGET_COLUMNS = [
    "revenue_month_1", "revenue_month_2", "revenue_month_3", "member_count_month_3",
    "retention_rate_month_3",
]
ENGINEERED_COLUMNS = PANEL_COLUMNS + FEATURE_COLUMNS + TARGET_COLUMNS


def q(c: str) -> str:
    return f'"{c}"'


W = "(PARTITION BY entity_id ORDER BY month"


def feature_ctes(drop: bool = True, split: bool = True) -> str:
    frame = f"{W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    w = f"{W})"
    not_null = " AND ".join(f"{q(c)} IS NOT NULL" for c in ENGINEERED_COLUMNS)
    ctes = f"""
rn AS (
  SELECT entity_id, month, total_revenue,
         row_number() OVER (PARTITION BY entity_id ORDER BY month) AS rn FROM panel),
ewm AS (
  SELECT a.entity_id, a.month,
         sum(power(0.5, a.rn - b.rn - 1) * b.total_revenue) / sum(power(0.5, a.rn - b.rn - 1)) AS ewm_raw
  FROM rn a JOIN rn b ON a.entity_id = b.entity_id AND b.rn < a.rn
  GROUP BY a.entity_id, a.month),
f1 AS (
  SELECT panel.*,
    dense_rank() OVER {w} AS studio_age,
    CAST(studio_location = 'urban' AS INTEGER) AS location_urban,
    CAST(studio_size_tier = 'small' AS INTEGER) AS size_small,
    CAST(studio_size_tier = 'medium' AS INTEGER) AS size_medium,
    CAST(studio_size_tier = 'large' AS INTEGER) AS size_large,
    CAST(studio_price_tier = 'low' AS INTEGER) AS price_low,
    CAST(studio_price_tier = 'medium' AS INTEGER) AS price_medium,
    CAST(studio_price_tier = 'high' AS INTEGER) AS price_high,
    {r2(sdiv('total_revenue', 'total_members'))} AS revenue_per_member,
    {r2('1 - retention_rate')} AS churn_rate,
    {r2(sdiv('total_class_attendance', 'total_classes_held * 20'))} AS class_utilization,
    {r2(sdiv('staff_count', 'total_members'))} AS staff_per_member,
    {r2('avg_ticket_price * retention_rate * 12')} AS estimated_ltv,
    {r2(sdiv('membership_revenue', 'total_revenue'))} AS membership_revenue_pct,
    {r2(sdiv('class_pack_revenue', 'total_revenue'))} AS class_pack_revenue_pct,
    {r2(f'lag(total_revenue, 1) OVER {w}')} AS prev_month_revenue,
    lag(total_members, 1) OVER {w} AS prev_month_members,
    {r2(f'avg(retention_rate) OVER {frame}')} AS "3m_avg_retention",
    {r2(f'avg(total_revenue) OVER {frame}')} AS "3m_avg_revenue",
    {r2(f'avg(class_attendance_rate) OVER {frame}')} AS "3m_avg_attendance",
    {r2(f'stddev_samp(total_revenue) OVER {frame}')} AS "3m_std_revenue",
    {r2('ewm_raw')} AS revenue_momentum,
    {r2('retention_rate * avg_ticket_price')} AS retention_x_ticket,
    {r2('class_attendance_rate * total_classes_held')} AS attendance_x_classes,
    {r2('upsell_rate * total_members')} AS upsell_x_members,
    {r2('staff_count * total_members')} AS staff_util_x_members,
    month(month) AS month_index,
    lead(total_revenue, 1) OVER {w} AS revenue_month_1,
    lead(total_revenue, 2) OVER {w} AS revenue_month_2,
    lead(total_revenue, 3) OVER {w} AS revenue_month_3,
    lead(total_members, 3) OVER {w} AS member_count_month_3,
    lead(retention_rate, 3) OVER {w} AS retention_rate_month_3
  FROM panel LEFT JOIN ewm USING (entity_id, month)),
f2 AS (
  SELECT *,
    {r2(sdiv('total_revenue - prev_month_revenue', 'prev_month_revenue'))} AS mom_revenue_growth,
    {r2(sdiv('total_members - prev_month_members', 'prev_month_members'))} AS mom_member_growth,
    {r2('sin(2 * pi() * month_index / 12)')} AS month_sin,
    {r2('cos(2 * pi() * month_index / 12)')} AS month_cos,
    CAST(month_index = 1 AS INTEGER) AS is_january,
    CAST(month_index IN (6, 7, 8) AS INTEGER) AS is_summer,
    CAST(month_index = 9 AS INTEGER) AS is_fall
  FROM f1),
f3 AS (
  SELECT * FROM f2 {'WHERE ' + not_null if drop else ''}),
feat AS (
  SELECT *{split_sql() if split else ''} FROM f3)
"""
    return ctes


def split_sql() -> str:
    n = "CAST(count(*) OVER (PARTITION BY entity_id) AS DOUBLE)"
    rn = "(row_number() OVER (PARTITION BY entity_id ORDER BY month) - 1)"
    return (
        f",\n    CASE WHEN {rn} < floor({n} * CAST(0.75 AS DOUBLE)) THEN 'train'"
        f" WHEN {rn} < floor({n} * CAST(0.9 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split"
    )


def with_features(body: str, extra_ctes: str = "", drop: bool = True, split: bool = True, level: str = "nation") -> str:
    ctes = feature_ctes(drop, split).strip()
    if extra_ctes:
        ctes = ctes + ",\n" + extra_ctes.strip()
    return with_panel(body, level=level, extra_ctes=ctes)


def select_cols(cols) -> str:
    return ", ".join(q(c) for c in cols)
