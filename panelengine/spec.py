"""Panel specification and the fixed business constants.

A *panel* has one row per (entity, month).  ``PanelSpec`` names the key
columns; every operator takes its column names from here instead of
probing the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "entity_id"
    month: str = "month"
    revenue: str = "total_revenue"
    members: str = "total_members"
    retention: str = "retention_rate"
    targets: tuple[str, ...] = (
        "revenue_month_1",
        "revenue_month_2",
        "revenue_month_3",
        "member_count_month_3",
        "retention_rate_month_3",
    )
    split: str = "split"
    # columns that are never model features
    non_features: tuple[str, ...] = field(
        default=(
            "entity_id",
            "month",
            "split",
            "studio_location",
            "studio_size_tier",
            "studio_price_tier",
        )
    )


DEFAULT_SPEC = PanelSpec()

TARGETS = DEFAULT_SPEC.targets
REVENUE_TARGETS = TARGETS[:3]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (lever metadata, validator
# rules, product catalogue).  Kept together, in their natural order.
# ---------------------------------------------------------------------------

# lever name -> (min, max, fill default, integer?)
LEVERS = {
    "retention_rate": (0.5, 1.0, 0.75, False),
    "avg_ticket_price": (50.0, 500.0, 150.0, False),
    "class_attendance_rate": (0.4, 1.0, 0.70, False),
    "new_members": (0.0, 100.0, 20.0, True),
    "staff_utilization_rate": (0.6, 1.0, 0.80, False),
    "upsell_rate": (0.0, 0.5, 0.25, False),
    "total_classes_held": (50.0, 500.0, 100.0, True),
    "total_members": (50.0, 1000.0, 180.0, True),
}
LEVER_NAMES = tuple(LEVERS)

# base priority of each lever in an action plan (1 = first)
LEVER_PRIORITY = {
    "retention_rate": 1,
    "avg_ticket_price": 2,
    "new_members": 3,
    "upsell_rate": 4,
    "class_attendance_rate": 5,
    "staff_utilization_rate": 6,
    "total_classes_held": 7,
    "total_members": 8,
}

# implementation weeks per lever in an action plan
LEVER_TIMELINE_WEEKS = {
    "retention_rate": 8,
    "avg_ticket_price": 4,
    "new_members": 6,
    "upsell_rate": 3,
    "class_attendance_rate": 2,
    "staff_utilization_rate": 2,
    "total_classes_held": 2,
    "total_members": 12,
}

# validator rules: metric -> (min, max)
VALIDATION_RANGES = {
    "total_members": (50, 1000),
    "new_members": (0, 100),
    "churned_members": (0, 200),
    "retention_rate": (0.5, 1.0),
    "avg_ticket_price": (50.0, 500.0),
    "total_classes_held": (50, 500),
    "total_class_attendance": (0, 10000),
    "class_attendance_rate": (0.3, 1.0),
    "staff_count": (3, 50),
    "staff_utilization_rate": (0.5, 1.0),
    "upsell_rate": (0.0, 0.6),
    "total_revenue": (5000.0, 200000.0),
}

# expected positive correlations checked by the validator
EXPECTED_POSITIVE_CORR = (
    ("total_members", "total_revenue"),
    ("avg_ticket_price", "total_revenue"),
    ("retention_rate", "total_revenue"),
    ("total_classes_held", "total_revenue"),
)

# product catalogue: category -> products
PRODUCTS = {
    "memberships": ("basic_membership", "premium_membership", "family_membership"),
    "class_packages": ("drop_in_class", "class_pack_10", "class_pack_20", "unlimited_class"),
    "retail": ("apparel", "supplements", "equipment"),
    "add_on_services": ("personal_training", "nutrition_coaching", "wellness_services"),
}
PRODUCT_CATEGORY = {p: c for c, ps in PRODUCTS.items() for p in ps}
PRODUCT_NAMES = tuple(PRODUCT_CATEGORY)
RETAIL_PRODUCTS = PRODUCTS["retail"]

# levers that product revenue is correlated against
PRODUCT_LEVERS = (
    "retention_rate",
    "avg_ticket_price",
    "class_attendance_rate",
    "new_members",
    "upsell_rate",
    "total_members",
)

# lever strength targets (value / target >= 1.05 strong, >= 0.95 moderate)
LEVER_STRENGTH_TARGETS = {
    "retention_rate": 0.75,
    "class_attendance_rate": 0.70,
    "upsell_rate": 0.20,
    "avg_ticket_price": 150.0,
}


def product_count_column(product: str) -> str:
    return f"{product}_sales_count" if product in RETAIL_PRODUCTS else f"{product}_count"


def product_revenue_column(product: str) -> str:
    return f"{product}_revenue"
