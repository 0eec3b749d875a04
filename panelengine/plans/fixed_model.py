"""A linear model with documented coefficients.

The request queries score with it, so that SQL can follow them to the last step; the fitted
models have queries of their own. Its features are those of a request's feature row, its
targets those of the panel; every lever moves revenue, directly or through an interaction.
"""

from __future__ import annotations

import numpy as np

from ..operators.linear import LinearModel
from ..spec import TARGETS

FEATURES = [
    "total_members", "avg_ticket_price", "retention_rate", "class_attendance_rate", "new_members", "total_classes_held",
    "upsell_x_members", "staff_util_x_members", "upsell_rate", "prev_month_revenue", "month_sin", "month_cos",
]
#: target -> (intercept, coefficients in the order of FEATURES)
COEFFICIENTS = {
    "revenue_month_1": (2000.0, [55.0, 20.0, 9000.0, 3000.0, 35.0, 8.0, 12.0, 6.0, 0.0, 0.001, 300.0, -200.0]),
    "revenue_month_2": (2100.0, [56.0, 21.0, 9200.0, 3100.0, 40.0, 8.5, 12.5, 6.25, 0.0, 0.001, 250.0, -150.0]),
    "revenue_month_3": (2250.0, [57.5, 21.5, 9500.0, 3250.0, 45.0, 9.0, 13.0, 6.5, 0.0, 0.001, 200.0, -100.0]),
    "member_count_month_3": (4.0, [0.92, -0.02, 30.0, 5.0, 1.5, 0.01, 0.0, 0.0, 0.0, 0.0, 0.5, 0.25]),
    "retention_rate_month_3": (0.09, [0.0, -0.0001, 0.85, 0.05, 0.0, 0.0, 0.0, 0.0, 0.02, 0.0, 0.001, 0.001]),
}
#: lever models for the sequential prediction: lever -> (intercept, coefficients by input lever)
LEVER_MODELS = {
    "new_members": (2.0, {"retention_rate": 12.0, "avg_ticket_price": -0.02, "total_members": 0.03}),
    "upsell_rate": (0.05, {"class_attendance_rate": 0.1, "new_members": 0.002, "retention_rate": 0.05}),
    "class_attendance_rate": (0.35, {"retention_rate": 0.4, "total_classes_held": -0.0004, "upsell_rate": 0.2}),
}

MODEL = LinearModel(
    FEATURES, list(TARGETS), np.array([COEFFICIENTS[t][1] for t in TARGETS]).T, np.array([COEFFICIENTS[t][0] for t in TARGETS]),
    np.zeros(len(FEATURES)), np.ones(len(FEATURES)), "fixed",
)
