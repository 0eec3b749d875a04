"""DuckDB SQL for the panel (the oracle side of the correctness check).

Written independently of the DataFrame code in ``sources/tpch.py``; both must give the
same rows.  ``round2`` in SQL is ``round_even(x * 100, 0) / 100`` (numpy rounding).
"""

from __future__ import annotations

from ..sources.tpch import (
    ADDON_PRIORITY,
    CLASS_PACK_PRIORITY,
    CLASS_PACK_SIZES,
    MEMBERSHIP_PRIORITIES,
    RETAIL_PRIORITY,
    STATUS_ORDER,
    URBAN_REGIONS,
)
from ..spec import PRODUCTS, product_count_column, product_revenue_column


def r2(expr: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"(round_even(CAST({expr} AS DOUBLE) * {scale}, 0) / {scale})"


def sdiv(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def _q(vals) -> str:
    return ", ".join(f"'{v}'" for v in vals)


def _product_sql_conditions():
    out = []
    memb = _q(MEMBERSHIP_PRIORITIES)
    for p, st in zip(PRODUCTS["memberships"], STATUS_ORDER):
        out.append((p, f"o_orderpriority IN ({memb}) AND o_orderstatus = '{st}'"))
    for p, (lo, hi) in zip(PRODUCTS["class_packages"], CLASS_PACK_SIZES):
        size = f"n_items >= {lo}" if hi is None else f"n_items BETWEEN {lo} AND {hi}"
        out.append((p, f"o_orderpriority = '{CLASS_PACK_PRIORITY}' AND {size}"))
    for p, st in zip(PRODUCTS["retail"], STATUS_ORDER):
        out.append((p, f"o_orderpriority = '{RETAIL_PRIORITY}' AND o_orderstatus = '{st}'"))
    for p, st in zip(PRODUCTS["add_on_services"], STATUS_ORDER):
        out.append((p, f"o_orderpriority = '{ADDON_PRIORITY}' AND o_orderstatus = '{st}'"))
    return out


def panel_ctes(level: str = "nation", drop_open_month: bool = False) -> str:
    """CTE list ending in a relation named ``panel``."""
    prods = _product_sql_conditions()
    prod_cm = ",\n".join(
        f"  sum(CASE WHEN {c} THEN price ELSE 0 END) AS {product_revenue_column(p)},\n"
        f"  count(*) FILTER (WHERE {c}) AS {product_count_column(p)}"
        for p, c in prods
    )
    money = ["membership_revenue", "class_pack_revenue", "retail_revenue", "addon_revenue"] + [
        product_revenue_column(p) for p, _ in prods
    ]
    counts = [product_count_column(p) for p, _ in prods]
    em_money = ",\n".join(f"  CAST(sum({c}) AS DOUBLE) AS {c}" for c in money)
    em_counts = ",\n".join(f"  sum({c}) AS {c}" for c in counts)
    prod_out = ", ".join(
        f"{product_count_column(p)}, {product_revenue_column(p)}" for p, _ in prods
    )
    if level == "nation":
        ent_join = "JOIN customer ON c_custkey = o_custkey"
        ent_expr = "CAST(c_nationkey AS BIGINT)"
        loc = f"""loc AS (
  SELECT CAST(n_nationkey AS BIGINT) AS entity_id,
         CASE WHEN r_name IN ({_q(URBAN_REGIONS)}) THEN 'urban' ELSE 'suburban' END AS studio_location
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
    else:
        ent_join = ""
        ent_expr = "CAST(o_custkey AS BIGINT)"
        loc = f"""loc AS (
  SELECT CAST(c_custkey AS BIGINT) AS entity_id,
         CASE WHEN r_name IN ({_q(URBAN_REGIONS)}) THEN 'urban' ELSE 'suburban' END AS studio_location
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
    open_month = "\n  WHERE o_orderdate < (SELECT date_trunc('month', max(o_orderdate)) FROM orders)" if drop_open_month else ""
    return f"""
o AS (
  SELECT o_orderkey, o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CAST(o_totalprice AS DECIMAL(14,2)) AS price, o_orderpriority, o_orderstatus
  FROM orders{open_month}),
per_order AS (
  SELECT l_orderkey, count(*) AS n_items, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey),
ol AS (
  SELECT o.*, coalesce(n_items, 0) AS n_items, coalesce(qty, 0.0) AS qty
  FROM o LEFT JOIN per_order ON o_orderkey = l_orderkey),
cm0 AS (
  SELECT o_custkey, month, sum(price) AS revenue, count(*) AS n_orders, sum(qty) AS qty,
         sum(n_items) AS n_items, count(*) FILTER (WHERE n_items >= 4) AS n_upsell,
         sum(CASE WHEN o_orderpriority IN ({_q(MEMBERSHIP_PRIORITIES)}) THEN price ELSE 0 END) AS membership_revenue,
         sum(CASE WHEN o_orderpriority = '{CLASS_PACK_PRIORITY}' THEN price ELSE 0 END) AS class_pack_revenue,
         sum(CASE WHEN o_orderpriority = '{RETAIL_PRIORITY}' THEN price ELSE 0 END) AS retail_revenue,
         sum(CASE WHEN o_orderpriority = '{ADDON_PRIORITY}' THEN price ELSE 0 END) AS addon_revenue,
{prod_cm}
  FROM ol GROUP BY o_custkey, month),
cm1 AS (
  SELECT *, lag(month) OVER (PARTITION BY o_custkey ORDER BY month) AS prev_active FROM cm0),
cm AS (
  SELECT cm1.*, {ent_expr} AS entity_id,
         CASE WHEN prev_active IS NULL THEN 1 ELSE 0 END AS is_new,
         CASE WHEN prev_active = CAST(month - INTERVAL 1 MONTH AS DATE) THEN 1 ELSE 0 END AS is_retained
  FROM cm1 {ent_join}),
staff AS (
  SELECT {ent_expr} AS entity_id, month, count(DISTINCT l_suppkey) AS staff_count
  FROM lineitem JOIN o ON l_orderkey = o_orderkey {ent_join}
  GROUP BY ALL),
em0 AS (
  SELECT entity_id, month, count(*) AS total_members, sum(is_new) AS new_members,
         sum(is_retained) AS retained_members, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
         sum(n_orders) AS total_classes_held, CAST(sum(qty) AS BIGINT) AS total_class_attendance,
         sum(n_items) AS n_items_all, sum(n_upsell) AS n_upsell,
{em_money},
{em_counts}
  FROM cm GROUP BY entity_id, month),
em1 AS (
  SELECT em0.*, coalesce(staff_count, 0) AS staff_count,
         {sdiv('total_revenue', 'total_members')} AS avg_ticket_price,
         CASE WHEN lag(month) OVER (PARTITION BY entity_id ORDER BY month) = CAST(month - INTERVAL 1 MONTH AS DATE)
              THEN lag(total_members) OVER (PARTITION BY entity_id ORDER BY month) END AS prev_members
  FROM em0 LEFT JOIN staff USING (entity_id, month)),
ent AS (
  SELECT entity_id, avg(total_members) AS ent_members, avg(avg_ticket_price) AS ent_ticket
  FROM em1 GROUP BY entity_id),
gmeans AS (SELECT avg(ent_members) AS g_members, avg(ent_ticket) AS g_ticket FROM ent),
{loc},
panel AS (
  SELECT em1.entity_id, month, total_members, new_members,
         prev_members - retained_members AS churned_members,
         {sdiv('retained_members', 'prev_members')} AS retention_rate,
         avg_ticket_price, total_revenue, membership_revenue, class_pack_revenue, retail_revenue,
         addon_revenue, total_classes_held, total_class_attendance,
         {sdiv('total_class_attendance', 'n_items_all * 50')} AS class_attendance_rate,
         staff_count,
         {sdiv('total_classes_held', 'total_members')} AS avg_classes_per_member,
         {sdiv('n_upsell', 'total_classes_held')} AS upsell_rate,
         studio_location,
         CASE WHEN ent_members / g_members < 0.8 THEN 'small'
              WHEN ent_members / g_members > 1.2 THEN 'large' ELSE 'medium' END AS studio_size_tier,
         CASE WHEN ent_ticket / g_ticket < 0.8 THEN 'low'
              WHEN ent_ticket / g_ticket > 1.2 THEN 'high' ELSE 'medium' END AS studio_price_tier,
         {prod_out}
  FROM em1 JOIN ent USING (entity_id) CROSS JOIN gmeans LEFT JOIN loc ON loc.entity_id = em1.entity_id)
"""


def with_panel(body: str, level: str = "nation", extra_ctes: str = "", drop_open_month: bool = False) -> str:
    ctes = panel_ctes(level, drop_open_month)
    if extra_ctes:
        ctes = ctes.rstrip() + ",\n" + extra_ctes.strip()
    return f"WITH {ctes.strip()}\n{body.strip()}"
