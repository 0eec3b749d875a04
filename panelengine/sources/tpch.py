"""Entity x month business panel derived from the order tables.

Mapping (one row per entity and calendar month):

* entity            ``c_nationkey`` (level ``nation``) or ``o_custkey`` (level ``customer``)
* month             month of ``o_orderdate`` (``drop_open_month`` leaves out the month of the
                    latest order, which may be incomplete)
* total_revenue     sum of ``o_totalprice`` (summed as DECIMAL, then DOUBLE)
* total_members     distinct customers with an order in the month
* new_members       customers whose first order month is this month
* retained          customers also active in the previous calendar month
* churned_members / retention_rate   prev_members - retained / retained / prev_members,
                    NULL unless the previous calendar month is in the panel
* avg_ticket_price  revenue / members
* total_classes_held / total_class_attendance   orders / sum(l_quantity)
* class_attendance_rate   attendance / (50 * line items)   (quantity is 1..50)
* staff_count       distinct suppliers on the month's line items
* avg_classes_per_member  orders / members
* upsell_rate       share of orders with 4 or more line items
* revenue mix       order priority 1,2 membership / 3 class pack / 4 retail / 5 add-on
* products          category from the priority as above; product inside the category from
                    the order status (F, O, P), class packages from the order size
                    (1, 2-3, 4-5, 6+ line items)
* tiers             location from the region; size / price tier from the entity's mean members /
                    mean ticket against the mean over entities (< 0.8 x small/low,
                    > 1.2 x large/high)

Plan shape: lineitem is reduced to one row per order before it meets orders; orders are
reduced to one row per (customer, month) before any customer-keyed shuffle, so a customer
holding a third of all orders still becomes at most one row per month.  Every later step
works on these pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from ..session import ensure_checkpoint_dir, read_table
from ..spec import PRODUCTS, product_count_column, product_revenue_column

# Fixed mapping values -------------------------------------------------------
URBAN_REGIONS = ("AMERICA", "ASIA", "EUROPE")
MEMBERSHIP_PRIORITIES = ("1-URGENT", "2-HIGH")
CLASS_PACK_PRIORITY = "3-MEDIUM"
RETAIL_PRIORITY = "4-NOT SPECIFIED"
ADDON_PRIORITY = "5-LOW"
STATUS_ORDER = ("F", "O", "P")
# class package by order size: (min items, max items)
CLASS_PACK_SIZES = ((1, 1), (2, 3), (4, 5), (6, None))


def _product_conditions():
    """(product, condition on an order row) pairs."""
    prio = F.col("o_orderpriority")
    status = F.col("o_orderstatus")
    n = F.col("n_items")
    out = []
    for product, st in zip(PRODUCTS["memberships"], STATUS_ORDER):
        out.append((product, prio.isin(*MEMBERSHIP_PRIORITIES) & (status == st)))
    for product, (lo, hi) in zip(PRODUCTS["class_packages"], CLASS_PACK_SIZES):
        size_ok = (n >= lo) if hi is None else n.between(lo, hi)
        out.append((product, (prio == CLASS_PACK_PRIORITY) & size_ok))
    for product, st in zip(PRODUCTS["retail"], STATUS_ORDER):
        out.append((product, (prio == RETAIL_PRIORITY) & (status == st)))
    for product, st in zip(PRODUCTS["add_on_services"], STATUS_ORDER):
        out.append((product, (prio == ADDON_PRIORITY) & (status == st)))
    return out


def _sum_if(cond, value):
    return F.sum(F.when(cond, value).otherwise(F.lit(0)))


def build_panel(spark: SparkSession, sf_dir: str, level: str = "nation", drop_open_month: bool = False) -> DataFrame:
    """Raw entity-month panel (the multi-entity raw panel of the reference)."""
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")

    if drop_open_month:
        latest = orders.agg(F.trunc(F.max("o_orderdate"), "month").alias("_open_month"))
        orders = orders.crossJoin(F.broadcast(latest)).where(F.col("o_orderdate") < F.col("_open_month"))  # one row
    o = orders.select(
        "o_orderkey",
        "o_custkey",
        F.trunc("o_orderdate", "month").alias("month"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("price"),
        "o_orderpriority",
        "o_orderstatus",
    )

    # one row per order: line count, quantity and its distinct suppliers, so the line items
    # are read and shuffled once
    per_order = lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("l_quantity").alias("qty"), F.collect_set("l_suppkey").alias("suppliers")
    )
    ol = o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left").select(
        o["*"],
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("qty", F.lit(0.0)).alias("qty"),
        "suppliers",
    )

    price = F.col("price")
    prio = F.col("o_orderpriority")
    dec0 = F.lit(0).cast("decimal(14,2)")
    product_aggs = []
    for product, cond in _product_conditions():
        product_aggs.append(
            F.sum(F.when(cond, price).otherwise(dec0)).alias(product_revenue_column(product))
        )
        product_aggs.append(F.count_if(cond).alias(product_count_column(product)))

    # (customer, month): bounded rows per customer no matter how skewed orders are
    if level == "nation":
        cust = customer.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("entity_id"))
        ol = ol.join(cust, ol.o_custkey == cust.c_custkey).drop("c_custkey")
    elif level == "customer":
        ol = ol.withColumn("entity_id", F.col("o_custkey").cast("bigint"))
    else:
        raise ValueError(f"unknown panel level {level!r}")
    # read twice (sums, and suppliers below): one row per order, written once
    ensure_checkpoint_dir(spark)
    ol = ol.checkpoint()

    cm = ol.groupBy("entity_id", "o_custkey", "month").agg(
        F.sum("price").alias("revenue"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum("qty").alias("qty"),
        F.sum("n_items").alias("n_items"),
        F.count_if(F.col("n_items") >= 4).alias("n_upsell"),
        F.sum(F.when(prio.isin(*MEMBERSHIP_PRIORITIES), price).otherwise(dec0)).alias("membership_revenue"),
        F.sum(F.when(prio == CLASS_PACK_PRIORITY, price).otherwise(dec0)).alias("class_pack_revenue"),
        F.sum(F.when(prio == RETAIL_PRIORITY, price).otherwise(dec0)).alias("retail_revenue"),
        F.sum(F.when(prio == ADDON_PRIORITY, price).otherwise(dec0)).alias("addon_revenue"),
        *product_aggs,
    )
    wc = Window.partitionBy("o_custkey").orderBy("month")
    prev_active = F.lag("month").over(wc)
    cm = cm.withColumn("is_new", prev_active.isNull().cast("int")).withColumn(
        "is_retained", F.coalesce((prev_active == F.add_months("month", -1)).cast("int"), F.lit(0))
    )

    # distinct suppliers per (entity, month); the entity is known, so equal rows combine map-side
    staff = (
        ol.select("entity_id", "month", F.explode("suppliers").alias("supplier"))
        .distinct()
        .groupBy("entity_id", "month")
        .agg(F.count(F.lit(1)).alias("staff_count"))
    )

    money_cols = [
        "membership_revenue",
        "class_pack_revenue",
        "retail_revenue",
        "addon_revenue",
    ] + [product_revenue_column(p) for p, _ in _product_conditions()]
    count_cols = [product_count_column(p) for p, _ in _product_conditions()]
    em = cm.groupBy("entity_id", "month").agg(
        F.count(F.lit(1)).alias("total_members"),
        F.sum("is_new").alias("new_members"),
        F.sum("is_retained").alias("retained_members"),
        F.sum("revenue").cast("double").alias("total_revenue"),
        F.sum("n_orders").alias("total_classes_held"),
        F.sum("qty").cast("bigint").alias("total_class_attendance"),
        F.sum("n_items").alias("_n_items"),
        F.sum("n_upsell").alias("_n_upsell"),
        *[F.sum(c).cast("double").alias(c) for c in money_cols],
        *[F.sum(c).alias(c) for c in count_cols],
    )
    em = em.join(staff, ["entity_id", "month"], "left").withColumn(
        "staff_count", F.coalesce("staff_count", F.lit(0)).cast("bigint")
    )
    # The tier step reads this table twice (per-row windows and the mean over entities);
    # a reliable checkpoint keeps the second read from re-aggregating the order tables.
    em = em.checkpoint()

    we = Window.partitionBy("entity_id").orderBy("month")
    contiguous = F.lag("month").over(we) == F.add_months("month", -1)
    prev_members = F.when(contiguous, F.lag("total_members").over(we))
    em = em.withColumn("_prev_members", prev_members)

    # entity tiers: mean members / ticket per entity against the mean over entities
    wall = Window.partitionBy("entity_id")
    em = em.withColumn("avg_ticket_price", safe_div("total_revenue", "total_members"))
    em = em.withColumn("_ent_members", F.avg("total_members").over(wall)).withColumn(
        "_ent_ticket", F.avg("avg_ticket_price").over(wall)
    )
    ent = em.select("entity_id", "_ent_members", "_ent_ticket").distinct()
    glob = ent.agg(
        F.avg("_ent_members").alias("_g_members"), F.avg("_ent_ticket").alias("_g_ticket")
    )
    em = em.crossJoin(F.broadcast(glob))  # one row: size bound is exact

    if level == "nation":
        reg = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
            F.col("n_nationkey").cast("bigint").alias("entity_id"),
            F.when(F.col("r_name").isin(*URBAN_REGIONS), "urban").otherwise("suburban").alias("studio_location"),
        )
        em = em.join(F.broadcast(reg), "entity_id", "left")  # nation x region: fixed 25-row dimension
    else:
        creg = (
            customer.select("c_custkey", "c_nationkey")
            .join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("c_custkey").cast("bigint").alias("entity_id"),
                F.when(F.col("r_name").isin(*URBAN_REGIONS), "urban").otherwise("suburban").alias("studio_location"),
            )
        )
        em = em.join(creg, "entity_id", "left")

    def tier(ratio, low, mid, high):
        return F.when(ratio < 0.8, F.lit(low)).when(ratio > 1.2, F.lit(high)).otherwise(F.lit(mid))

    em = em.withColumn(
        "studio_size_tier", tier(F.col("_ent_members") / F.col("_g_members"), "small", "medium", "large")
    ).withColumn(
        "studio_price_tier", tier(F.col("_ent_ticket") / F.col("_g_ticket"), "low", "medium", "high")
    )

    out = em.select(
        "entity_id",
        "month",
        "total_members",
        "new_members",
        (F.col("_prev_members") - F.col("retained_members")).alias("churned_members"),
        safe_div("retained_members", "_prev_members").alias("retention_rate"),
        "avg_ticket_price",
        "total_revenue",
        "membership_revenue",
        "class_pack_revenue",
        "retail_revenue",
        "addon_revenue",
        "total_classes_held",
        "total_class_attendance",
        safe_div("total_class_attendance", F.col("_n_items") * 50).alias("class_attendance_rate"),
        "staff_count",
        safe_div("total_classes_held", "total_members").alias("avg_classes_per_member"),
        safe_div("_n_upsell", "total_classes_held").alias("upsell_rate"),
        "studio_location",
        "studio_size_tier",
        "studio_price_tier",
        *[c for p, _ in _product_conditions() for c in (product_count_column(p), product_revenue_column(p))],
    )
    return out
